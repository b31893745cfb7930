"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import counted, materialized

ROUNDS = 60


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex hands its smallest smaller neighbour to its other smaller neighbours."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    return e.join(low, "a").selectExpr(
        "explode(if(b = m, array(struct(a, m as b)), array(struct(b as a, m as b)))) as e"
    ).selectExpr("e.a", "e.b").where("a != b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every vertex hands the smallest vertex around it, itself included, to its larger neighbours."""
    e = edges.select("a", "b").union(edges.select("b", "a"))
    low = e.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return e.join(low, "a").where("b > a").selectExpr("b as a", "m as b").where("a != b")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest vertex that links reach from each vertex, for vertices with a link.

    ``edges`` has bigint columns a and b; self-loops and repeats don't matter. Each round is written to the
    shared folder, so that a lost executor costs one round. Rounds grow with the logarithm of the longest path.
    The rows of one vertex are pre-aggregated (min) or joined, where Spark splits skewed keys; nothing is
    collected. An empty edge table gives no rows.
    """
    now = materialized(edges.where("a != b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), "cc")
    seen, edge = None, F.xxhash64("a", "b")
    for _ in range(ROUNDS):
        now, mark = counted(_small_star(_large_star(now)), "cc", xor=F.bit_xor(edge), total=F.sum(edge % 1000003))
        if mark == seen or mark["rows"] == 0:
            return now.selectExpr("a as id", "b as component").union(now.selectExpr("b", "b").distinct())
        seen = mark
    raise RuntimeError("components did not settle")
