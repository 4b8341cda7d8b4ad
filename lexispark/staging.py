"""Tables written once and read back, and ranks over a whole table without a task that sees all of it."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task ranks, more or less.
RANKED = 100_000


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder (the warehouse where ``spark.checkpoint.dir`` is unset) and read back."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    path = f"{where.rstrip('/') if where else spark.conf.get('spark.sql.warehouse.dir').rstrip('/') + '/_staged'}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(table: DataFrame, lead: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """``table`` (staged) with the place of each row in ``order``, from 1.

    ``lead`` is a number that never falls along ``order``.  Its quantiles cut the table into stretches;
    rows are numbered within theirs and shifted by the sizes of those before.
    """
    rows = table.withColumn("__lead", lead.cast("double"))
    parts = math.ceil(rows.count() / RANKED)
    stretch = F.lit(0)
    if parts > 1:
        cuts = rows.agg(F.percentile_approx("__lead", [i / parts for i in range(1, parts)], 100 * parts).alias("c")).first()["c"]
        for cut in sorted(set(cuts)):
            stretch = stretch + (F.col("__lead") > F.lit(cut)).cast("int")
    rows = rows.withColumn("__stretch", stretch)
    sizes = rows.groupBy("__stretch").agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch
    sizes = F.broadcast(sizes.select("__stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base")))
    place = F.row_number().over(Window.partitionBy("__stretch").orderBy(*order)) + F.col("__base")
    return rows.join(sizes, "__stretch").withColumn(name, place).drop("__lead", "__stretch", "__base")
