"""Byte-pair encoding over words: exact pair counts, deterministic merges, encoding by merge rank.

Word frequencies are counted in Spark; merges are learned on the table of all distinct words, dealt over
the tasks (``merges``), with exact pair deltas and ties broken by (frequency descending, left, right).
Symbols and merges, as many as ``vocab_size``, visit the driver, words do not.  Texts are encoded row by
row over Arrow batches, each distinct word of a batch once.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lists
from ..functions import text as X
from ..sources import files
from .merges import learn
from .vocabulary import SPECIALS, UNK, names_of, with_ends

END = "</w>"


def prepared(text: Column, lowercase: bool = True) -> Column:
    return X.strip(F.lower(text) if lowercase else text)


def words(lines: DataFrame, lowercase: bool = True) -> DataFrame:
    """(keys, pos, word)."""
    keys = [c for c in lines.columns if c != "text"]
    return lines.select(*keys, F.posexplode(X.split_words(prepared(F.col("text"), lowercase))).alias("pos", "word"))


def initial_symbols(lines: DataFrame, lowercase: bool = True) -> DataFrame:
    """(word, symbols, freq): each distinct word as its characters and the end mark."""
    counts = words(lines.select("text"), lowercase).groupBy("word").agg(F.count("*").alias("freq"))
    return counts.select("word", symbols_of(F.col("word")).alias("symbols"), "freq")


def symbols_of(word: Column) -> Column:
    return F.concat(F.filter(F.split(word, ""), lambda c: c != ""), F.array(F.lit(END)))


def symbol_counts(initial: DataFrame) -> DataFrame:
    return initial.select(F.explode("symbols").alias("symbol"), "freq").groupBy("symbol").agg(F.sum("freq").alias("freq"))


def pair_counts(initial: DataFrame) -> DataFrame:
    """(left, right, freq) of adjacent symbols, weighted by word frequency."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("symbols") - 1), lambda i: F.struct(F.element_at("symbols", i).alias("left"), F.element_at("symbols", i + 1).alias("right")))
    rows = initial.filter(F.size("symbols") > 1).select(F.explode(pairs).alias("p"), "freq")
    return rows.groupBy("p.left", "p.right").agg(F.sum("freq").alias("freq"))


def merge_word(symbols: tuple[str, ...], left: str, right: str) -> tuple[str, ...]:
    """All places of the pair replaced, from the left and without overlap."""
    out, i = [], 0
    while i < len(symbols):
        if i + 1 < len(symbols) and symbols[i] == left and symbols[i + 1] == right:
            out.append(left + right)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return tuple(out)



def learn_merges(table: dict[tuple[str, ...], int], wanted: int, min_freq: int = 2) -> list[tuple[str, str]]:
    """The merges in order, over distinct words with their frequencies, in one process: for tables that fit."""
    items = [[symbols, freq] for symbols, freq in table.items()]
    counts: Counter = Counter()
    where: dict[tuple[str, str], set[int]] = defaultdict(set)
    for i, (symbols, freq) in enumerate(items):
        for pair in zip(symbols, symbols[1:], strict=False):
            counts[pair] += freq
            where[pair].add(i)
    heap = [(-n, *pair) for pair, n in counts.items()]
    heapq.heapify(heap)
    merges = []
    while len(merges) < wanted and heap:
        n, left, right = heapq.heappop(heap)
        if counts.get((left, right), 0) != -n:
            continue  # an older count of this pair; its present one is in the heap too
        if -n < min_freq:
            break
        merges.append((left, right))
        changed: set[tuple[str, str]] = set()
        for i in where.pop((left, right)):
            symbols, freq = items[i]
            new = merge_word(symbols, left, right)
            old_pairs, new_pairs = Counter(zip(symbols, symbols[1:], strict=False)), Counter(zip(new, new[1:], strict=False))
            for pair, many in old_pairs.items():
                counts[pair] -= many * freq
                changed.add(pair)
                if pair not in new_pairs and pair in where:
                    where[pair].discard(i)
            for pair, many in new_pairs.items():
                counts[pair] += many * freq
                changed.add(pair)
                where[pair].add(i)
            items[i][0] = new
        for pair in changed:
            if counts[pair] > 0:
                heapq.heappush(heap, (-counts[pair], *pair))
            else:
                counts.pop(pair, None)
    return merges


def encode_symbols(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The lowest-ranked pair merged at its leftmost place, until no pair has a rank."""
    symbols = list(symbols)
    while len(symbols) > 1:
        rank, at = min(((ranks.get(p, len(ranks)), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False))), default=(len(ranks), 0))
        if rank == len(ranks):
            break
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return symbols


@dataclass
class BPETokenizer:
    vocab_size: int = 32000
    min_freq: int = 2
    lowercase: bool = True
    merges: list[tuple[str, str]] = field(default_factory=list)
    vocabulary: DataFrame | None = None  # (token, idx)

    def train(self, lines: DataFrame, n_merges: int | None = None) -> "BPETokenizer":
        """Learn as many merges as fill ``vocab_size``, or just ``n_merges``, which then sets ``vocab_size``."""
        spark = lines.sparkSession
        counts = words(lines.select("text"), self.lowercase).groupBy("word").agg(F.count("*").alias("freq"))
        base, self.merges = learn(counts, END, n_merges, self.vocab_size - len(SPECIALS), self.min_freq)
        symbols = set(base)
        if n_merges is not None:
            self.vocab_size = len(SPECIALS) + len(symbols) + n_merges
        final = sorted(symbols | {s for pair in self.merges for s in (*pair, pair[0] + pair[1])})
        rows = list(enumerate([*SPECIALS, *final]))
        self.vocabulary = spark.createDataFrame([(t, i) for i, t in rows], "token string, idx int")
        return self

    @property
    def ranks(self) -> dict[tuple[str, str], int]:
        return {pair: i for i, pair in enumerate(self.merges)}

    def word_table(self, distinct: DataFrame) -> DataFrame:
        """(word, pieces): the pieces of each distinct word; one batch of words at a time in Python."""
        ranks = distinct.sparkSession.sparkContext.broadcast(self.ranks)  # at most vocab_size entries

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def pieces(words_: pd.Series) -> pd.Series:
            return words_.map(lambda w: encode_symbols([*w, END], ranks.value))

        return distinct.select("word", pieces("word").alias("pieces"))

    def encode(self, lines: DataFrame, add_bos: bool = False, add_eos: bool = False) -> DataFrame:
        """``lines`` with ``ids``."""
        ranks, known = self.ranks, {r["token"]: r["idx"] for r in self.vocabulary.collect()}  # vocab_size entries each

        def ids_of(model, word):
            return [model[1].get(p, UNK) for p in encode_symbols([*word, END], model[0])]

        code = lists.mapper(lines.sparkSession, ids_of, (ranks, known))
        out = lines.withColumn("ids", lists.or_empty(code(X.split_words(prepared(F.col("text"), self.lowercase)))))
        return out.withColumn("ids", with_ends(F.col("ids"), add_bos, add_eos)) if add_bos or add_eos else out

    def decode(self, coded: DataFrame, keys: list[str], remove_special: bool = True) -> DataFrame:
        """(keys, text): pieces joined, end marks read as blanks."""
        ids = F.filter("ids", lambda i: i >= len(SPECIALS)) if remove_special else F.col("ids")
        rows = names_of(coded.select(*keys, ids.alias("ids")), self.vocabulary)
        return rows.select(*keys, X.strip(F.replace(F.array_join("words", ""), F.lit(END), F.lit(" "))).alias("text"))

    def merge_table(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, a, b, a + b) for i, (a, b) in enumerate(self.merges)], "rank int, left string, right string, merged string")

    def save(self, path: str) -> None:
        spark = self.vocabulary.sparkSession
        files.save_model(spark, path, {"vocab_size": self.vocab_size, "min_freq": self.min_freq, "lowercase": self.lowercase}, vocabulary=self.vocabulary, merges=self.merge_table(spark))

    @classmethod
    def load(cls, spark, path: str) -> "BPETokenizer":
        params, tables = files.load_model(spark, path)
        merges = [(r["left"], r["right"]) for r in tables["merges"].orderBy("rank").collect()]  # at most vocab_size rows
        return cls(**params, merges=merges, vocabulary=tables["vocabulary"])


# Declarative forms of the same steps, for a handful of merges: a symbol is wrapped in two blanks.


def spelled(word: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(symbols_of(word), "  "), F.lit(" "))


def apply_merges(spelled_: Column, merges: list[tuple[str, str]]) -> Column:
    for left, right in merges:
        spelled_ = F.replace(spelled_, F.lit(f" {left}  {right} "), F.lit(f" {left}{right} "))
    return spelled_


def length_bucket(token: Column, special: Column) -> Column:
    n = F.length(token)
    return F.when(special, "special").when(n == 1, "1").when(n <= 4, "2-4").when(n <= 8, "5-8").when(n <= 12, "9-12").otherwise("13+")


def vocabulary_buckets(vocabulary: DataFrame) -> DataFrame:
    """(bucket, n): pieces by length, end mark included."""
    return vocabulary.groupBy(length_bucket(F.col("token"), F.col("idx") < len(SPECIALS)).alias("bucket")).agg(F.count("*").alias("n"))


def merge_lengths(merges: DataFrame) -> DataFrame:
    n = F.length("merged")
    return merges.agg(F.avg(n).alias("mean_len"), F.median(n).alias("median_len"), F.min(n).cast("long").alias("min_len"), F.max(n).cast("long").alias("max_len"))


def morphemes(vocabulary: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lang, category, morpheme, found): whether a piece is the morpheme, with or without end mark."""
    known = vocabulary.select(F.regexp_replace("token", "</w>$", "").alias("morpheme")).distinct().withColumn("found", F.lit(True))
    return wanted.join(known, "morpheme", "left").select("lang", "category", "morpheme", F.coalesce("found", F.lit(False)).alias("found"))


def family_pieces(pieces: DataFrame) -> DataFrame:
    """(family, piece) of the pieces that all words of a family share; ``pieces`` has (family, word, pieces)."""
    rows = pieces.select("family", "word", F.explode(F.array_distinct("pieces")).alias("piece"))
    sizes = pieces.groupBy("family").agg(F.count_distinct("word").alias("size"))
    return rows.groupBy("family", "piece").agg(F.count_distinct("word").alias("n")).join(sizes, "family").filter("n = size").select("family", "piece")


def trace(lines: DataFrame, tokenizer: BPETokenizer) -> DataFrame:
    """(keys, pos, word, symbols, pieces): what encoding starts from and ends with."""
    rows = words(lines, tokenizer.lowercase)
    table = tokenizer.word_table(rows.select("word").distinct())
    return rows.join(table, "word").withColumn("symbols", symbols_of(F.col("word")))


def encode_steps(distinct: DataFrame, tokenizer: BPETokenizer) -> DataFrame:
    """(word, step, merged, symbols): the symbols of each distinct word after every merge; step 0 is the spelling."""
    ranks = distinct.sparkSession.sparkContext.broadcast(tokenizer.ranks)

    @F.pandas_udf("array<struct<merged:string,symbols:array<string>>>")
    def steps(words_: pd.Series) -> pd.Series:
        def one(word):
            symbols, out = [*word, END], []
            out.append((None, list(symbols)))
            while pairs := [(ranks.value[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks.value]:
                _, at = min(pairs)
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
                out.append((symbols[at], list(symbols)))
            return out

        return words_.map(one)

    rows = distinct.select("word", F.posexplode(steps("word")).alias("step", "s"))
    return rows.select("word", "step", "s.merged", "s.symbols")


def parallel_examples(pairs: DataFrame, tokenizer: BPETokenizer) -> DataFrame:
    """(line_no, src_pieces, tgt_pieces, ratio) of parallel lines (line_no, src, tgt); ratio is target to source pieces."""
    out = pairs.select("line_no", "src", "tgt")
    for side in ("src", "tgt"):
        coded = tokenizer.encode(out.withColumn("text", F.col(side))).withColumnRenamed("ids", f"{side}_ids").drop("text")
        out = names_of(coded, tokenizer.vocabulary, f"{side}_ids", f"{side}_pieces")
    n = {side: F.size(f"{side}_pieces") for side in ("src", "tgt")}
    return out.select("line_no", "src_pieces", "tgt_pieces", F.when(n["src"] > 0, n["tgt"] / n["src"]).alias("ratio"))


def coverage(coded: DataFrame, key: str = "lang") -> DataFrame:
    """Mean pieces and characters, fertility, share of UNK and characters per piece of each group; empty texts are left out."""
    rows = coded.filter("text <> ''").select(key, F.size("ids").alias("n"), F.length("text").alias("c"), F.size(F.filter("ids", lambda i: i == UNK)).alias("unk"))
    return rows.groupBy(key).agg(
        F.avg("n").alias("mean_tokens"), F.avg("c").alias("mean_chars"), (F.avg("n") / F.avg("c")).alias("fertility"), (100.0 * F.sum("unk") / F.greatest(F.sum("n"), F.lit(1))).alias("unk_rate"),
        (F.sum("c") / F.greatest(F.sum("n"), F.lit(1))).alias("chars_per_token"),
    )


def utilization(coded: DataFrame, vocab_size: int) -> DataFrame:
    used = coded.select(F.explode("ids").alias("idx")).groupBy("idx").agg(F.count("*").alias("n"))
    return used.agg(F.count("*").alias("used"), (100.0 * F.count("*") / vocab_size).alias("utilization"))


