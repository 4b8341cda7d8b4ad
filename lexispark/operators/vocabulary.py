"""Word vocabulary: counting, id assignment, encoding and decoding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import staging
from ..functions import lists
from ..functions import text as X
from ..sources import files

#: Special tokens and their ids.
SPECIALS = ("<PAD>", "<UNK>", "<BOS>", "<EOS>")
PAD, UNK, BOS, EOS = range(4)
#: A vocabulary of at most this many rows is broadcast; a larger one is joined by key.
BROADCAST_ROWS = 1_000_000


def tokens(lines: DataFrame, lowercase: bool = True, *keys: str) -> DataFrame:
    """(keys, pos, token) of every word of ``text``; pos counts from 0."""
    keys = keys or tuple(c for c in lines.columns if c != "text")
    return lines.select(*keys, F.posexplode(X.plain_words(F.col("text"), lowercase)).alias("pos", "token"))


def word_counts(toks: DataFrame, order: tuple[str, ...] = ("doc_id", "line_no", "pos")) -> DataFrame:
    """(token, freq, first_seen)."""
    return toks.groupBy("token").agg(F.count("*").alias("freq"), F.min(F.struct(*order)).alias("first_seen"))


def assign_ids(counts: DataFrame, min_freq: int = 5, max_size: int | None = None) -> DataFrame:
    """(token, idx, freq): the most frequent first, ties by first sight; ids follow the specials.

    The counts are staged once.  Words are ranked in stretches of the order (frequency, then the first
    field of ``first_seen``), so the many rare words of one frequency are no single task.
    """
    kept = counts.filter(F.col("freq") >= min_freq)
    if max_size is not None:
        kept = kept.orderBy(F.desc("freq"), "first_seen").limit(max(0, max_size - len(SPECIALS)))
    kept = staging.staged(kept.select("token", "freq", "first_seen"), "word-counts")
    least, most = kept.agg(F.min(lead := F.col(f"first_seen.{kept.schema['first_seen'].dataType[0].name}")), F.max(lead)).first()
    number = isinstance(least, int)
    share = (F.coalesce(lead, F.lit(least)) - F.lit(least)) / F.lit(float(most - least + 1)) if number else F.lit(0.0)  # below 1
    out = staging.ranked(kept, share - F.col("freq"), [F.desc("freq"), F.col("first_seen")])
    return staging.staged(out.select("token", (F.col("rank") + len(SPECIALS) - 1).cast("int").alias("idx"), "freq"), "vocabulary")


def kept_share(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Share of all tokens, in percent, that the vocabulary covers; 0 without tokens."""
    total = counts.agg(F.sum("freq").alias("total"))
    kept = vocabulary.agg(F.sum("freq").alias("kept"))
    return total.crossJoin(kept).select(F.when(F.col("total") > 0, 100.0 * F.coalesce("kept", F.lit(0)) / F.col("total")).otherwise(0.0).alias("coverage"))  # one row each


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows it to be small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def encode_tokens(toks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``toks`` with ``idx``; words outside the vocabulary become UNK."""
    met = toks.join(small(vocabulary.select("token", "idx")), "token", "left")
    return met.withColumn("idx", F.coalesce("idx", F.lit(UNK)))


def collected(vocabulary: DataFrame, *columns: str, rows: int = BROADCAST_ROWS):
    """These columns as an Arrow table if there are at most ``rows`` rows, else None."""
    table = vocabulary.select(*columns).limit(rows + 1).toArrow()
    return table.combine_chunks() if table.num_rows <= rows else None


def encode_lists(rows: DataFrame, words: str, vocabulary: DataFrame, ids: str = "ids") -> DataFrame:
    """``rows`` with the ids of a list of words, row by row; a null list has none."""
    table = collected(vocabulary, "token", "idx")
    if table is not None:
        code = lists.coder(rows.sparkSession, table["token"].combine_chunks(), table["idx"].to_numpy(), UNK)
        return rows.withColumn(ids, lists.or_empty(code(F.col(words))))
    rows = staging.staged(rows.withColumn("__row", F.monotonically_increasing_id()), "encode-rows")
    toks = rows.select("__row", F.posexplode(words).alias("pos", "token"))
    coded = encode_tokens(toks, vocabulary).groupBy("__row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "idx"))), lambda p: p["idx"]).alias(ids))
    return rows.join(coded, "__row", "left").withColumn(ids, lists.or_empty(F.col(ids))).drop("__row")


def with_ends(ids: Column, add_bos: bool = True, add_eos: bool = True) -> Column:
    parts = ([F.array(F.lit(BOS))] if add_bos else []) + [ids] + ([F.array(F.lit(EOS))] if add_eos else [])
    return F.concat(*parts)


def names_of(rows: DataFrame, vocabulary: DataFrame, ids: str = "ids", words: str = "words") -> DataFrame:
    """``rows`` with the words of a list of ids, row by row; ids that the vocabulary lacks read as the UNK token."""
    table = collected(vocabulary, "idx", "token")
    if table is not None:
        at, tokens_ = table["idx"].to_pylist(), table["token"].to_pylist()
        names: list[str | None] = [*SPECIALS, *[None] * max(0, max(at, default=0) + 1 - len(SPECIALS))]
        for i, token in zip(at, tokens_, strict=True):
            names[i] = token
        return rows.withColumn(words, lists.or_empty(lists.reader(rows.sparkSession, names, SPECIALS[UNK])(F.col(ids)), "array<string>"))
    rows = staging.staged(rows.withColumn("__row", F.monotonically_increasing_id()), "decode-rows")
    special = F.element_at(F.array(*[F.lit(s) for s in SPECIALS]), F.least(F.col("idx"), F.lit(3)) + 1)
    met = rows.select("__row", F.posexplode(ids).alias("pos", "idx")).join(vocabulary.select("idx", "token"), "idx", "left")
    met = met.withColumn("token", F.when(F.col("idx") < len(SPECIALS), special).otherwise(F.coalesce("token", F.lit(SPECIALS[UNK]))))
    out = met.groupBy("__row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda p: p["token"]).alias(words))
    return rows.join(out, "__row", "left").withColumn(words, lists.or_empty(F.col(words), "array<string>")).drop("__row")


def decode(coded: DataFrame, vocabulary: DataFrame, keys: list[str], remove_special: bool = True) -> DataFrame:
    """(keys, text): words joined by blanks; unknown ids read as the UNK token unless specials are removed."""
    ids = F.filter("ids", lambda i: i >= len(SPECIALS)) if remove_special else F.col("ids")
    rows = names_of(coded.select(*keys, ids.alias("ids")), vocabulary)
    return rows.select(*keys, F.array_join("words", " ").alias("text"))


@dataclass
class WordTokenizer:
    min_freq: int = 5
    max_size: int | None = None
    lowercase: bool = True
    vocabulary: DataFrame | None = None

    def train(self, lines: DataFrame) -> "WordTokenizer":
        """Learn from ``lines`` (doc_id, line_no, text)."""
        counts = word_counts(tokens(lines.select("doc_id", "line_no", "text"), self.lowercase))
        self.vocabulary = assign_ids(counts, self.min_freq, self.max_size)
        return self

    def encode(self, lines: DataFrame, add_bos: bool = False, add_eos: bool = False) -> DataFrame:
        """``lines`` with ``ids``; a line without words has none but the ends."""
        rows = lines.withColumn("__words", X.plain_words(F.col("text"), self.lowercase))
        out = encode_lists(rows, "__words", self.vocabulary).drop("__words")
        return out.withColumn("ids", with_ends(F.col("ids"), add_bos, add_eos)) if add_bos or add_eos else out

    def decode(self, coded: DataFrame, keys: list[str], remove_special: bool = True) -> DataFrame:
        return decode(coded, self.vocabulary, keys, remove_special)

    def save(self, path: str) -> None:
        files.save_model(self.vocabulary.sparkSession, path, {"min_freq": self.min_freq, "max_size": self.max_size, "lowercase": self.lowercase}, vocabulary=self.vocabulary)

    @classmethod
    def load(cls, spark, path: str) -> "WordTokenizer":
        params, tables = files.load_model(spark, path)
        return cls(**params, vocabulary=tables["vocabulary"])


def build_word_tokenizers(lines: DataFrame, languages: list[str], min_freq: int = 5, max_size: int | None = None) -> dict[str, WordTokenizer]:
    """One vocabulary for each language."""
    return {lang: WordTokenizer(min_freq, max_size).train(lines.filter(F.col("lang") == lang)) for lang in languages}
