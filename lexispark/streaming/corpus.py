"""Stream forms of the stateless text operators, and the few that keep state.

A stream has columns ``text`` and an event time; the batch column functions apply unchanged.  Counts
and deduplication are bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X


def read_lines(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Text files that arrive in a folder, one row a line, stamped with the file's time."""
    rows = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path).select("value", "_metadata.file_modification_time")
    return rows.select(X.strip(F.col("value")).alias("text"), F.col("file_modification_time").alias("ts"))


def cleaned(lines: DataFrame, min_tokens: int = 3, max_tokens: int = 100) -> DataFrame:
    """Normalised lines with letters and an accepted length: no state at all."""
    text = X.normalize_space(X.strip_tags(X.nfc(F.col("text"))))
    return lines.withColumn("text", text).filter(X.has_letter(F.col("text")) & X.count_words(F.col("text")).between(min_tokens, max_tokens))


def distinct(lines: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first of equal lines within the watermark; the state holds a hash of each line."""
    keyed = lines.withColumn("key", F.sha2(F.col("text"), 256)).withWatermark("ts", late)
    return keyed.dropDuplicatesWithinWatermark(["key"]).drop("key")


def word_counts(lines: DataFrame, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, token, freq) per window of event time."""
    words = lines.withWatermark("ts", late).select("ts", F.explode(X.plain_words(F.col("text"))).alias("token"))
    return words.groupBy(F.window("ts", window), "token").agg(F.count("*").alias("freq")).select(F.col("window.start").alias("start"), "token", "freq")


def write_parquet(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """An exactly-once file sink that takes what is there and ends."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
