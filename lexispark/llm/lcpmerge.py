"""Front-coded sorted runs of byte strings, and a loser tree that merges them by longest common prefixes.

A contestant knows how many bytes it shares with the last string that left the tree.  Of two such
contestants the one that shares more is smaller; only on a tie are bytes looked at, from the first
that is not yet known to be equal.  The loser then knows what it shares with the winner.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

_HEAD = struct.Struct("<HHHqqqq")  # bytes shared with the string before, further bytes, bytes of the payload string; four numbers


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the longest common prefix, ``known`` bytes of which are known to be equal."""
    n = min(len(a), len(b)) - known
    if n <= 0:
        return known + max(n, 0)
    differ = int.from_bytes(a[known : known + n], "big") ^ int.from_bytes(b[known : known + n], "big")
    return known + n - (differ.bit_length() + 7) // 8


def encode(items: list[tuple]) -> bytes:
    """A run of sorted (string, payload string, four numbers): each string only as far as it differs from the one before."""
    out, last = [], b""
    for string, payload, *numbers in items:
        shared = common(last, string)
        out.append(_HEAD.pack(shared, len(string) - shared, len(payload), *numbers))
        out.append(string[shared:])
        out.append(payload)
        last = string
    return b"".join(out)


def decode(run: bytes) -> Iterator[tuple[int, tuple]]:
    """(bytes shared with the string before, item) of each item of a run."""
    at, last = 0, b""
    while at < len(run):
        shared, more, extra, *numbers = _HEAD.unpack_from(run, at)
        at += _HEAD.size
        last = last[:shared] + run[at : at + more]
        at += more
        yield shared, (last, run[at : at + extra], *numbers)
        at += extra


def merge(runs: list[bytes]) -> Iterator[tuple[int, tuple]]:
    """All items in order of their strings, each with the bytes it shares with the one before."""
    sources = [decode(r) for r in runs]
    size = 1
    while size < len(sources):
        size *= 2
    item: list[tuple | None] = [None] * size
    shared = [0] * size
    for i, source in enumerate(sources):
        got = next(source, None)
        if got:
            item[i] = got[1]

    def beats(x: int, y: int) -> bool:
        """Whether x leaves before y; the loser's shared count is set against the winner."""
        a, b = item[x], item[y]
        if a is None or b is None:
            return a is not None
        if shared[x] != shared[y]:
            return shared[x] > shared[y]
        h = common(a[0], b[0], shared[x])
        first = a[0][h : h + 1] < b[0][h : h + 1] if h < len(a[0]) and h < len(b[0]) else len(a[0]) <= len(b[0])
        shared[y if first else x] = h
        return first

    losers = [0] * size
    winners = list(range(size))
    while len(winners) > 1:  # play the first tournament; the node of a match is found from its leaves
        base = len(winners) // 2
        up = []
        for k in range(base):
            x, y = winners[2 * k], winners[2 * k + 1]
            if not beats(x, y):
                x, y = y, x
            losers[base + k] = y
            up.append(x)
        winners = up
    champion = winners[0]
    while (out := item[champion]) is not None:
        yield shared[champion], out
        got = next(sources[champion], None)
        if got:
            shared[champion], item[champion] = got
        else:
            item[champion], shared[champion] = None, -1
        node = (champion + size) // 2
        while node:
            other = losers[node]
            if beats(other, champion):
                losers[node], champion = champion, other
            node //= 2
