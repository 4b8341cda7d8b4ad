"""The driver's tables as corpora, in Spark and in SQL.

``lines`` splits documents at line feeds; ``pairs`` joins a user turn to the assistant's next one;
``line_pairs`` joins each line to the next line of its document, with the language as split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


#: One number names a line or a turn: so many at most to a document or conversation.
LINES_A_DOCUMENT, TURNS = 10_000_000, 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A single small file arrives as one partition; explode-heavy work wants one a core.  Larger inputs come split already."""
    spark = df.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width) if df.rdd.getNumPartitions() < min(width, spark.sparkContext.defaultParallelism) else df


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("p", "t")).select("doc_id", "lang", (F.col("p") + 1).cast("long").alias("line_no"), X.strip(F.col("t")).alias("text"))


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", F.split("text", "\n").alias("ls")))
    both = F.transform(F.sequence(F.lit(1), F.size("ls") - 1), lambda i: F.struct(i.alias("i"), F.element_at("ls", i).alias("a"), F.element_at("ls", i + 1).alias("b")))
    rows = docs.filter(F.size("ls") > 1).select("doc_id", "lang", F.explode(both).alias("p"))
    return rows.select((F.col("doc_id") * LINES_A_DOCUMENT + F.col("p.i")).alias("line_no"), F.col("lang").alias("split"), X.strip(F.col("p.a")).alias("src"), X.strip(F.col("p.b")).alias("tgt"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    user = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("src"))
    reply = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt"))
    return user.join(reply, ["conv_id", "turn"]).select((F.col("conv_id") * TURNS + F.col("turn")).alias("line_no"), "src", "tgt")


LINES = "select doc_id, lang, u.p as line_no, trim(u.t) as text from documents, unnest(string_split(text, chr(10))) with ordinality as u(t, p)"
LINE_PAIRS = f"select doc_id * {LINES_A_DOCUMENT} + line_no as line_no, lang as split, text as src, lead(text) over (partition by doc_id order by line_no) as tgt from ({LINES}) qualify tgt is not null"
PAIRS = f"select u.conv_id * {TURNS} + u.turn as line_no, u.text as src, a.text as tgt from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant'"


def words_sql(column: str) -> str:
    return rf"list_filter(string_split_regex({column}, '\s+'), lambda x: x <> '')"


def plain_sql(column: str) -> str:
    return rf"list_filter(string_split(regexp_replace(lower({column}), '[!-/:-@\[-`{{-~]', '', 'g'), ' '), lambda x: x <> '')"


TOKENS = f"select doc_id, lang, line_no, u.p - 1 as pos, u.w as token from ({LINES}), unnest({plain_sql('text')}) with ordinality as u(w, p)"
COUNTS = f"select token, count(*) as freq, min((doc_id, line_no, pos)) as seen from ({TOKENS}) group by token"


def vocab_sql(min_freq: int = 5) -> str:
    return f"select token, cast(row_number() over (order by freq desc, seen) + 3 as integer) as idx, freq from ({COUNTS}) where freq >= {min_freq}"
