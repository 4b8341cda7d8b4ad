"""A small reverse-mode graph over NumPy arrays, and the layers of the sequence models.

Every operation records how to pass gradients back, so a model only states its forward pass.
"""

from __future__ import annotations

import numpy as np


class Node:
    """A value, and what it was made from."""

    __slots__ = ("value", "grad", "back", "parents")

    def __init__(self, value, parents=(), back=None):
        self.value, self.grad, self.parents, self.back = np.asarray(value, float), None, parents, back

    def gather(self, grad: np.ndarray) -> None:
        while grad.ndim > self.value.ndim:
            grad = grad.sum(0)
        for axis, n in enumerate(self.value.shape):
            if n == 1 and grad.shape[axis] != 1:
                grad = grad.sum(axis, keepdims=True)
        self.grad = grad if self.grad is None else self.grad + grad

    def backward(self) -> None:
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            node, done = stack.pop()
            if done:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                stack.append((node, True))
                stack.extend((p, False) for p in node.parents)
        self.grad = np.ones_like(self.value)
        for node in reversed(order):
            if node.back is not None and node.grad is not None:
                node.back(node.grad)

    def __add__(self, other: "Node") -> "Node":
        def back(g):
            self.gather(g)
            other.gather(g)

        return Node(self.value + other.value, (self, other), back)

    def __mul__(self, other: "Node") -> "Node":
        def back(g):
            self.gather(g * other.value)
            other.gather(g * self.value)

        return Node(self.value * other.value, (self, other), back)

    def __matmul__(self, other: "Node") -> "Node":
        """(..., n) @ (n, m)."""

        def back(g):
            self.gather(g @ other.value.T)
            n, m = other.value.shape
            other.gather(self.value.reshape(-1, n).T @ g.reshape(-1, m))

        return Node(self.value @ other.value, (self, other), back)

    def tanh(self) -> "Node":
        y = np.tanh(self.value)
        return Node(y, (self,), lambda g: self.gather(g * (1 - y * y)))

    def sigmoid(self) -> "Node":
        y = 1 / (1 + np.exp(-np.clip(self.value, -500, 500)))
        return Node(y, (self,), lambda g: self.gather(g * y * (1 - y)))

    def at(self, index) -> "Node":
        def back(g):
            whole = np.zeros_like(self.value)
            np.add.at(whole, index, g)
            self.gather(whole)

        return Node(self.value[index], (self,), back)

    def reshape(self, *shape) -> "Node":
        return Node(self.value.reshape(shape), (self,), lambda g: self.gather(g.reshape(self.value.shape)))


def constant(value) -> Node:
    return Node(value)


def concat(nodes: list[Node]) -> Node:
    """Along the last axis."""
    cuts = np.cumsum([n.value.shape[-1] for n in nodes])[:-1]

    def back(g):
        for node, part in zip(nodes, np.split(g, cuts, -1), strict=True):
            node.gather(part)

    return Node(np.concatenate([n.value for n in nodes], -1), tuple(nodes), back)


def stack(nodes: list[Node], axis: int = 1) -> Node:
    def back(g):
        for i, node in enumerate(nodes):
            node.gather(np.take(g, i, axis))

    return Node(np.stack([n.value for n in nodes], axis), tuple(nodes), back)


def blend(mask: np.ndarray, new: Node, old: Node) -> Node:
    """``new`` where the mask is 1, ``old`` where it is 0: a padded step leaves the state alone."""

    def back(g):
        new.gather(g * mask)
        old.gather(g * (1 - mask))

    return Node(new.value * mask + old.value * (1 - mask), (new, old), back)


def attend(scores: Node, states: Node, masked: np.ndarray) -> Node:
    """Softmax of (batch, steps) scores over unmasked steps, and the weighted sum of the states."""
    s = np.where(masked, -1e10, scores.value)
    w = np.exp(s - s.max(1, keepdims=True))
    w /= w.sum(1, keepdims=True)

    def back(g):
        states.gather(w[:, :, None] * g[:, None, :])
        gw = (states.value * g[:, None, :]).sum(2)
        gs = w * (gw - (gw * w).sum(1, keepdims=True))
        scores.gather(np.where(masked, 0.0, gs))

    return Node((w[:, :, None] * states.value).sum(1), (scores, states), back)


def cross_entropy(logits: Node, target: np.ndarray, ignore: int = 0) -> Node:
    """Mean negative log likelihood over targets other than ``ignore``."""
    z = logits.value - logits.value.max(-1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(-1, keepdims=True)
    use = target != ignore
    n = max(int(use.sum()), 1)
    at = (*np.indices(target.shape), target)
    loss = -(np.log(p[at] + 1e-12) * use).sum() / n

    def back(g):
        d = p.copy()
        d[at] -= 1
        logits.gather(g * d * use[..., None] / n)

    return Node(loss, (logits,), back)


class Params(dict):
    """Named parameters, drawn from a seed."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.rng = np.random.default_rng(seed)

    def add(self, name: str, *shape: int, scale: float | None = None) -> None:
        bound = scale if scale is not None else 1 / np.sqrt(shape[-1] if len(shape) == 1 else shape[0])
        self[name] = Node(self.rng.uniform(-bound, bound, shape))

    def linear(self, name: str, n: int, m: int, bias: bool = True) -> None:
        self.add(f"{name}.weight", n, m)
        if bias:
            self.add(f"{name}.bias", m, scale=1 / np.sqrt(n))

    def apply(self, name: str, x: Node) -> Node:
        y = x @ self[f"{name}.weight"]
        return y + self[f"{name}.bias"] if f"{name}.bias" in self else y

    def values(self_) -> dict[str, np.ndarray]:  # noqa: N805
        return {k: self_[k].value for k in self_}

    def count(self) -> int:
        return sum(self[k].value.size for k in self)


class Cell:
    """A recurrent step; ``state`` is a tuple of (batch, hidden) nodes."""

    gates: tuple[str, ...] = ()
    parts = 1

    @classmethod
    def declare(cls, params: Params, name: str, n: int, hidden: int) -> None:
        raise NotImplementedError

    @classmethod
    def step(cls, params: Params, name: str, x: Node, state: tuple[Node, ...]) -> tuple[Node, ...]:
        raise NotImplementedError


class RNNCell(Cell):
    """tanh of a linear map of the input plus one of the state."""

    @classmethod
    def declare(cls, params, name, n, hidden):
        params.linear(f"{name}.ih", n, hidden)
        params.linear(f"{name}.hh", hidden, hidden)

    @classmethod
    def step(cls, params, name, x, state):
        return ((params.apply(f"{name}.ih", x) + params.apply(f"{name}.hh", state[0])).tanh(),)


class LSTMCell(Cell):
    """Forget, input and output gates and a candidate, each one linear map of [state, input]."""

    gates = ("f", "i", "g", "o")
    parts = 2

    @classmethod
    def declare(cls, params, name, n, hidden):
        for gate in cls.gates:
            params.linear(f"{name}.{gate}", hidden + n, hidden)

    @classmethod
    def step(cls, params, name, x, state):
        both = concat([state[0], x])
        f, i, g, o = (params.apply(f"{name}.{gate}", both) for gate in cls.gates)
        c = f.sigmoid() * state[1] + i.sigmoid() * g.tanh()
        return (o.sigmoid() * c.tanh(), c)


def dropout(x: Node, rate: float, rng: np.random.Generator | None) -> Node:
    if rng is None or rate <= 0:
        return x
    return x * constant((rng.random(x.value.shape) >= rate) / (1 - rate))


def zeros(cell: type[Cell], layers: int, batch: int, hidden: int) -> list[tuple[Node, ...]]:
    return [tuple(constant(np.zeros((batch, hidden))) for _ in range(cell.parts)) for _ in range(layers)]


def unroll(params: Params, name: str, cell: type[Cell], inputs: list[Node], state: list[tuple[Node, ...]], mask: np.ndarray | None = None, rate: float = 0.0, rng=None, backwards: bool = False):
    """Stacked layers over time: top outputs step by step, and the last state.  Steps beyond a row's length do not touch its state."""
    seq = list(inputs)
    final = []
    for layer in range(len(state)):
        now, out = state[layer], [None] * len(seq)
        for t in range(len(seq))[::-1] if backwards else range(len(seq)):
            new = cell.step(params, f"{name}.{layer}", seq[t], now)
            if mask is not None:
                m = mask[:, t : t + 1]
                new = tuple(blend(m, a, b) for a, b in zip(new, now, strict=True))
            now = new
            out[t] = now[0]
        final.append(now)
        seq = [dropout(x, rate, rng) for x in out] if layer < len(state) - 1 else out
    return seq, final
