"""Parallel-corpus cleaning: normalise, filter, deduplicate and account for every pair in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import staging
from ..functions import text as X
from ..sources import files

#: Reasons in the order in which a pair is charged to them.
REASONS = ("empty", "punctuation_only", "length_filtered", "misaligned")


def normalize_unicode(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"src": X.nfc(F.col("src")), "tgt": X.nfc(F.col("tgt"))})


def clean_html(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"src": X.strip_tags(F.col("src")), "tgt": X.strip_tags(F.col("tgt"))})


def normalize_whitespace(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"src": X.normalize_space(F.col("src")), "tgt": X.normalize_space(F.col("tgt"))})


def misaligned(a: Column, b: Column, max_ratio: float) -> Column:
    """Word counts too far apart; a side without words always is."""
    least = F.least(a, b)
    return (least == 0) | (F.greatest(a, b) / least > max_ratio)


def filter_empty(pairs: DataFrame) -> DataFrame:
    return pairs.filter(~X.is_blank(F.col("src")) & ~X.is_blank(F.col("tgt")))


def filter_punctuation_only(pairs: DataFrame) -> DataFrame:
    return pairs.filter(X.has_letter(F.col("src")) & X.has_letter(F.col("tgt")))


def filter_length(pairs: DataFrame, min_tokens: int = 3, max_tokens: int = 100) -> DataFrame:
    return pairs.filter(X.count_words(F.col("src")).between(min_tokens, max_tokens) & X.count_words(F.col("tgt")).between(min_tokens, max_tokens))


def filter_misaligned(pairs: DataFrame, max_ratio: float = 3.0) -> DataFrame:
    return pairs.filter(~misaligned(X.count_words(F.col("src")), X.count_words(F.col("tgt")), max_ratio))


def length_mismatches(pairs: DataFrame, threshold: float = 3.0) -> DataFrame:
    """(line_no, src_len, tgt_len, ratio) of the pairs whose ratio is above the threshold; sides without words are skipped."""
    a, b = X.count_words(F.col("src")), X.count_words(F.col("tgt"))
    rows = pairs.select("line_no", a.cast("long").alias("src_len"), b.cast("long").alias("tgt_len")).filter("src_len > 0 and tgt_len > 0")
    return rows.withColumn("ratio", F.greatest("src_len", "tgt_len") / F.least("src_len", "tgt_len")).filter(F.col("ratio") > threshold)


def deduplicate(pairs: DataFrame, *within: str) -> DataFrame:
    """The first row of each exact pair, in the whole table or for each value of ``within``.

    Minima are taken on the map side, so a pair that fills a third of the corpus is one row a task.
    """
    rest = [c for c in pairs.columns if c not in ("src", "tgt", *within)]
    first = pairs.groupBy(*within, "src", "tgt").agg(F.min(F.struct("line_no", *[c for c in rest if c != "line_no"])).alias("f"))
    return first.select(*[F.col(f"f.{c}").alias(c) if c in rest else F.col(c) for c in pairs.columns])


def shuffle(pairs: DataFrame, seed: int) -> DataFrame:
    """A reproducible random order."""
    return pairs.orderBy(F.xxhash64("line_no", F.lit(seed)), "line_no")


def judged(pairs: DataFrame, min_tokens: int = 3, max_tokens: int = 100, max_ratio: float = 3.0) -> DataFrame:
    """All steps but deduplication as columns: cleaned sides, what changed, and the first reason to reject."""
    raw = pairs.withColumns({"raw_src": F.col("src"), "raw_tgt": F.col("tgt")})
    step = normalize_unicode(raw)
    step = step.withColumn("unicode_changed", (F.col("src") != F.col("raw_src")) | (F.col("tgt") != F.col("raw_tgt"))).drop("raw_src", "raw_tgt")
    before = step.withColumns({"was_src": F.col("src"), "was_tgt": F.col("tgt")})
    step = clean_html(before).withColumn("html_changed", (F.col("src") != F.col("was_src")) | (F.col("tgt") != F.col("was_tgt")))
    step = step.withColumns({"was_src": F.col("src"), "was_tgt": F.col("tgt")})
    step = normalize_whitespace(step)
    changed = (F.col("src") != X.strip(F.col("was_src"))) | (F.col("tgt") != X.strip(F.col("was_tgt")))
    step = step.withColumn("space_changed", changed).drop("was_src", "was_tgt")
    step = step.withColumns({"src_len": X.count_words(F.col("src")), "tgt_len": X.count_words(F.col("tgt"))})
    letters = X.has_letter(F.col("src")) & X.has_letter(F.col("tgt"))
    fits = F.col("src_len").between(min_tokens, max_tokens) & F.col("tgt_len").between(min_tokens, max_tokens)
    reason = (
        F.when((F.col("src") == "") | (F.col("tgt") == ""), "empty").when(~letters, "punctuation_only").when(~fits, "length_filtered")
        .when(misaligned(F.col("src_len"), F.col("tgt_len"), max_ratio), "misaligned")
    )
    return step.withColumn("reject_reason", reason)


def clean(pairs: DataFrame, dedup: bool = True, **limits) -> DataFrame:
    """The cleaned pairs, in the columns of ``pairs``; splits, if there is such a column, are deduplicated each on its own."""
    kept = judged(pairs, **limits).filter("reject_reason is null").select(pairs.columns)
    return deduplicate(kept, *[c for c in pairs.columns if c == "split"]) if dedup else kept


def accounting(pairs: DataFrame, dedup: bool = True, **limits) -> DataFrame:
    """One row of counters for each ``split``: what each step changed or removed, in order; they add up to ``original``."""
    rows = judged(pairs, **limits)
    # Per distinct survivor first, so duplicates are counted without a second pass.
    key = F.when(F.col("reject_reason").isNull(), F.struct("src", "tgt"))
    flags = ("unicode_changed", "html_changed", "space_changed")
    part = rows.groupBy("split", "reject_reason", key.alias("pair")).agg(F.count("*").alias("n"), *[F.count_if(f).alias(f) for f in flags])
    again = F.sum(F.when(F.col("reject_reason").isNull(), F.col("n") - 1).otherwise(0)) if dedup else F.lit(0)
    total = part.groupBy("split").agg(
        F.sum("n").alias("original"), F.sum("unicode_changed").alias("unicode_normalized"), F.sum("html_changed").alias("html_cleaned"), F.sum("space_changed").alias("whitespace_normalized"),
        *[F.sum(F.when(F.col("reject_reason") == r, F.col("n")).otherwise(0)).alias(r) for r in REASONS], again.cast("long").alias("duplicates"),
    )
    return total.withColumn("final", F.expr("original - " + " - ".join([*REASONS, "duplicates"])))


def preprocess_splits(spark, source: str, target: str, langs: tuple[str, str] = ("en", "es"), splits: tuple[str, ...] = ("train", "dev", "test"), dedup: tuple[str, ...] = ("train",), shuffled: tuple[str, ...] = ("train",), seed: int = 42, **limits) -> DataFrame:
    """Clean the files ``source/<split>.<lang>`` into ``target``, split by split, and write the counters as JSON; gives the counters."""
    counted = []
    for split in splits:
        pairs = files.read_parallel(spark, *[f"{source}/{split}.{lang}" for lang in langs]).withColumn("split", F.lit(split))
        pairs = staging.staged(pairs, f"split-{split}")
        counted.append(accounting(pairs, split in dedup, **limits))
        kept = staging.staged(clean(pairs, split in dedup, **limits), f"clean-{split}")
        order = F.xxhash64("line_no", F.lit(seed)) if split in shuffled else F.lit(0)
        kept = kept.select("src", "tgt", F.struct(order, F.col("line_no")).alias("place"))
        for side, lang in zip(("src", "tgt"), langs, strict=True):
            files.write_lines(kept, f"{target}/{split}.{lang}", side, "place")
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    config = {"min_tokens": 3, "max_tokens": 100, "max_ratio": 3.0} | limits
    files.write_stats(out, config, f"{target}/preprocessing_stats.json")
    return out
