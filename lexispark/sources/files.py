"""Sources and sinks: parallel text files, vocabularies, vectors, statistics, histories."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

HISTORY = "epoch int, train_loss double, val_loss double, learning_rate double, grad_norm_total double, grad_norm_encoder double, grad_norm_decoder double"


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(line_no, text): the stripped lines of text files, numbered through the files in the order given."""
    frames = []
    for i, path in enumerate(paths):
        place = F.monotonically_increasing_id()  # the split of the file, and the line in it
        rows = spark.read.text(path).select("value", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("pos"))
        sizes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row a split
        base = F.create_map(*[F.lit(x) for p in sizes for x in (p, sum(n for q, n in sizes.items() if q < p))]) if sizes else F.create_map(F.lit(0).cast("long"), F.lit(0))
        frames.append(rows.select(F.lit(i).alias("file"), (F.element_at(base, F.col("part")) + F.col("pos")).alias("at"), X.strip(F.col("value")).alias("text")))
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    if len(paths) == 1:
        return out.select(F.col("at").alias("line_no"), "text")
    sizes = {r["file"]: r["n"] for r in out.groupBy("file").agg(F.count("*").alias("n")).collect()}
    base = F.create_map(*[F.lit(x) for i in range(len(paths)) for x in (i, sum(sizes.get(j, 0) for j in range(i)))])
    return out.select((F.element_at(base, F.col("file")) + F.col("at")).alias("line_no"), "text")


def read_parallel(spark: SparkSession, source: str, target: str) -> DataFrame:
    """(line_no, src, tgt) of two files of equally many lines; raises ValueError where the counts differ."""
    src, tgt = read_lines(spark, source), read_lines(spark, target)
    a, b = src.count(), tgt.count()
    if a != b:
        raise ValueError(f"{source} has {a} lines, {target} has {b}")
    return src.withColumnRenamed("text", "src").join(tgt.withColumnRenamed("text", "tgt"), "line_no")


def write_lines(rows: DataFrame, path: str, text: str, order: str = "line_no") -> None:
    """One text file in order: for export only; Parquet is the native sink."""
    rows.orderBy(order).select(F.col(text).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_parallel(pairs: DataFrame, source: str, target: str) -> None:
    write_lines(pairs, source, "src")
    write_lines(pairs, target, "tgt")


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small JSON document, two blanks of indent."""
    spark.createDataFrame([(json.dumps(value, indent=2, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_stats(stats: DataFrame, config: dict, path: str) -> None:
    """Counters of each split, and the configuration, as one JSON document."""
    rows = {r["split"]: {k: v for k, v in r.asDict().items() if k != "split"} for r in stats.collect()}  # one row a split
    write_json(stats.sparkSession, rows | {"config": config}, path)


def write_history(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).option("header", True).csv(path)


def save_model(spark: SparkSession, path: str, params: dict, **tables: DataFrame) -> None:
    """Parameters as JSON and any tables as Parquet under one folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    write_json(spark, params | {"tables": sorted(tables)}, f"{path}/params")


def load_model(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    params = read_json(spark, f"{path}/params")
    return params, {name: spark.read.parquet(f"{path}/{name}") for name in params.pop("tables")}


def write_translations(rows: DataFrame, path: str) -> None:
    """Blocks of SRC, REF and PRED lines with a blank line between."""
    block = F.concat(F.lit("SRC: "), "src", F.lit("\nREF: "), "ref", F.lit("\nPRED: "), "pred", F.lit("\n"))
    rows.orderBy("line_no").select(block.alias("value")).coalesce(1).write.mode("overwrite").text(path)
