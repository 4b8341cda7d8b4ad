"""The corpus pipeline: toxic documents go, repeated chunks of lines go, one of each near-duplicate group
stays, sources are mixed to their targets, and what remains is packed into windows.

Every stage takes all rows that the one before it kept.  All but the last return the columns of
``documents``; the last returns the pieces of the packed sequences.

Edge cases of all stages: a column of ``documents`` that is absent becomes null, extra ones are left out whatever
their names; an empty table gives no rows; texts are read whole, however long.  The rest is stated with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm import jaccard, linededup, mixing, packing, toxicity, work


def _documents(docs: DataFrame) -> DataFrame:
    return work.columns(docs, doc_id="long", text="string", lang="string", source="string", n_chars="long")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the boosted trees call toxic go; all others stay as they are.

    A null or empty text has the score of its zero features.  A score of exactly 0.5 goes.  Rows that
    repeat are judged each on its own text.  Without usable labels every row stays.
    """
    docs = _documents(docs)
    _, labels = toxicity.inputs(spark, sf_dir)
    work.short_batches(spark)
    return toxicity.rejected(docs, toxicity.learn(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go, but for their first occurrence; every row stays, its text perhaps empty.

    A null text stays null.  A null doc_id sorts before all others.  Rows that repeat doc_id and text
    keep or lose the same lines.  ``n_chars`` follows the text.
    """
    return linededup.dedupe(_documents(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts stays, that of the smallest doc_id, then of the smallest hash of the text.

    A null doc_id comes last.  Rows that repeat doc_id and text are one group.  Texts that are null, or
    hold no word, are linked with nothing and all stay.
    """
    return jaccard.one_of_each(_documents(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of each source in the share that its weight gives; a row taken more than once comes out more than once.

    A null source is a source of its own, the last.  Null and blank texts have nothing to take, so
    these rows go.  Rows that repeat are separate entries.  ``n_chars`` follows the text.
    """
    return mixing.mix(_documents(docs))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; every id of every text lies in exactly one of them.

    A null or empty text is the end id alone.  Rows that repeat are packed each on its own.  A null
    doc_id stays null.  Equal scores go to the smaller doc_id.
    """
    return packing.pack(_documents(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Boosted trees and multinomial draws cannot be written in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder and read back."""
    docs = work.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
