"""Shared folders, staged tables and input reading for the operators of this subpackage.

Executors may be lost at any time and share no local disk with the driver, so everything that
must outlive a job is written to the folder named by ``spark.checkpoint.dir``.  Only where that
setting is absent (a unit test, say) does the warehouse folder stand in for it.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch: texts may be long, so batches are kept short.
ARROW_ROWS = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    return where.rstrip("/") if where else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_staged_at", None)
        if path:
            remove_path(df.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def short_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, **kinds: str) -> DataFrame:
    """Exactly the named columns, cast; a column that is absent becomes null, extra ones are left out."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(n: float, per: float, least: int) -> int:
    return max(least, math.ceil(n / per))
