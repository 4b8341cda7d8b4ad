"""Corpus profiling: lengths, characters, vocabulary coverage, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

COVERAGE_POINTS = (10, 50, 100, 500, 1000, 5000, 10000, 20000, 50000)


def length_stats(lines: DataFrame, key: str = "lang") -> DataFrame:
    """Lines, mean and median words and characters of each group."""
    rows = lines.select(key, X.count_words(F.col("text")).alias("w"), F.length("text").alias("c"))
    return rows.groupBy(key).agg(
        F.count("*").alias("n_lines"), F.avg("w").alias("mean_words"), F.median("w").alias("median_words"), F.avg("c").alias("mean_chars"), F.max("w").cast("long").alias("max_words")
    )


def histogram(values: DataFrame, column: str, low: float, high: float, bins: int, density: bool = False) -> DataFrame:
    """(bin, n): counts in ``bins`` equal bins of [low, high]; the last one includes its upper end."""
    inside = values.filter(F.col(column).between(low, high))
    at = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1))
    out = inside.groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    if density:
        out = out.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy(F.lit(0))) * ((high - low) / bins)))  # one row a bin
    return out


def length_correlation(pairs: DataFrame) -> DataFrame:
    """Pearson correlation of the word counts, and the mean target/source ratio (sources without words are skipped)."""
    rows = pairs.select(X.count_words(F.col("src")).cast("double").alias("a"), X.count_words(F.col("tgt")).cast("double").alias("b"))
    return rows.agg(F.corr("a", "b").alias("pearson"), F.avg(F.when(F.col("a") > 0, F.col("b") / F.col("a"))).alias("mean_ratio"))


def split_shares(lines: DataFrame, key: str = "lang") -> DataFrame:
    sizes = lines.groupBy(key).agg(F.count("*").alias("n"))
    return sizes.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # one row a group


def split_means(lines: DataFrame, key: str = "lang") -> DataFrame:
    """Mean words of each group and over all of them (a null key)."""
    return lines.rollup(key).agg(F.avg(X.count_words(F.col("text"))).alias("mean_words"), F.count("*").alias("n"))


def percent_longer(lines: DataFrame, first: str, second: str, key: str = "lang") -> DataFrame:
    """One row: mean words of two groups, and by how many percent the second is longer; null if either has no row."""
    mean = lambda group: F.avg(F.when(F.col(key) == group, X.count_words(F.col("text"))))
    out = lines.agg(mean(first).alias("mean_first"), mean(second).alias("mean_second"))
    return out.withColumn("percent_longer", F.when(F.col("mean_first") > 0, 100.0 * (F.col("mean_second") / F.col("mean_first") - 1)))


def char_counts(lines: DataFrame, key: str = "lang") -> DataFrame:
    return lines.select(key, F.explode(F.split("text", "")).alias("ch")).filter("ch <> ''").groupBy(key, "ch").agg(F.count("*").alias("n"))


def raw_vocabulary(lines: DataFrame) -> DataFrame:
    """(token, freq) of lower-cased words, punctuation kept."""
    return lines.select(F.explode(X.split_words(F.lower("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("freq"))


def coverage(vocabulary: DataFrame, points: tuple[int, ...] = COVERAGE_POINTS) -> DataFrame:
    """(top_n, coverage): share of all tokens, in percent, that the top_n most frequent words cover."""
    total = vocabulary.agg(F.sum("freq")).first()[0] or 0
    top = vocabulary.orderBy(F.desc("freq"), "token").limit(max(points))  # bounded by the largest point
    ranked = top.withColumn("rn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("freq"), "token")))
    wanted = [F.sum(F.when(F.col("rn") <= n, F.col("freq")).otherwise(0)).alias(f"c{n}") for n in points]
    stacked = ", ".join(f"{n}L, c{n}" for n in points)
    wide = ranked.agg(*wanted)
    return wide.select(F.expr(f"stack({len(points)}, {stacked}) as (top_n, covered)")).select("top_n", (100.0 * F.coalesce("covered", F.lit(0)) / max(total, 1)).alias("coverage"))


def rare_words(vocabulary: DataFrame) -> DataFrame:
    count = lambda c, n: F.count_if(c).alias(n)
    return vocabulary.agg(count(F.col("freq") == 1, "singletons"), count(F.col("freq") == 2, "doubletons"), count(F.col("freq") <= 5, "up_to_5"), count(F.col("freq") <= 10, "up_to_10"), F.count("*").alias("total"))


def frequency_of_frequency(vocabulary: DataFrame, most: int = 50) -> DataFrame:
    return vocabulary.filter(F.col("freq") <= most).groupBy("freq").agg(F.count("*").alias("n_words"))


def duplicate_summary(pairs: DataFrame) -> DataFrame:
    """Rows, and how many sources, targets and pairs repeat an earlier one; distinct values are counted by partial sums."""
    parts = []
    for name, columns in (("src_dups", ["src"]), ("tgt_dups", ["tgt"]), ("pair_dups", ["src", "tgt"])):
        groups = pairs.groupBy(*columns).agg(F.count("*").alias("n"))
        parts.append(groups.agg(F.sum(F.col("n") - 1).alias(name), F.sum("n").alias("n_pairs")))
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part.drop("n_pairs"))  # one row each
    return out


def one_to_many(pairs: DataFrame) -> DataFrame:
    """(src, n_targets) of sources with several different targets."""
    return pairs.groupBy("src", "tgt").agg(F.lit(1).alias("one")).groupBy("src").agg(F.count("*").alias("n_targets")).filter("n_targets > 1")


def top_repeated(lines: DataFrame, n: int = 10) -> DataFrame:
    return lines.groupBy("text").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "text").limit(n)


def quality_counts(lines: DataFrame, key: str = "lang") -> DataFrame:
    rows = lines.select(key, X.count_words(F.col("text")).alias("w"))
    return rows.groupBy(key).agg(F.count_if(F.col("w") == 0).alias("n_empty"), F.count_if((F.col("w") > 0) & (F.col("w") < 3)).alias("n_short"), F.count_if(F.col("w") > 100).alias("n_long"))


def sample(rows: DataFrame, n: int, seed: int, key: str = "line_no") -> DataFrame:
    """``n`` rows without replacement, the same ones for the same seed."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)
