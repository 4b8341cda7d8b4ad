"""Connected components by alternating large-star and small-star steps on a staged edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work


def _star(edges: DataFrame, name: str, small: bool) -> DataFrame:
    """One step: every neighbour of a node (of lower id if ``small``, of higher id otherwise) is tied to the least node seen from it."""
    if small:
        both = edges  # u > v in every row: only lower neighbours
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        e, m = both.alias("e"), work.staged(least, f"{name}-least").alias("m")
        met = e.join(m, F.col("e.u") == F.col("m.u"))
        out = met.filter("e.v <> m.m").select(F.col("e.v").alias("u"), F.col("m.m").alias("v")).unionByName(m.select("u", F.col("m").alias("v")))
    else:
        back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        both = edges.unionByName(back)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e, m = back.alias("e"), work.staged(least, f"{name}-least").alias("m")
        # Higher neighbours e.v of e.u move to the least node around e.u.
        out = e.join(m, F.col("e.u") == F.col("m.u")).select(F.col("e.v").alias("u"), F.col("m.m").alias("v"))
    made = work.staged(out.distinct(), name)
    work.discard(m)
    return made


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b), label being the least node of its component.

    Hot nodes are safe: minima are summed before the shuffle, and nodes meet their minimum in a join
    of two staged tables, whose skewed keys adaptive execution splits.
    """
    edges = work.staged(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        wide = _star(edges, "edges", small=False)
        work.discard(edges)
        edges = _star(wide, "edges", small=True)
        work.discard(wide)
        # Done once all are stars: no node has two centres, and no centre has one.
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("tied"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("tied"), F.lit(1).alias("centre")))
        nodes = ends.groupBy("node").agg(F.sum("tied").alias("tied"), F.max("centre").alias("centre"))
        if nodes.filter("tied > 1 or tied > 0 and centre > 0").isEmpty():
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return work.staged(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots), "components")
