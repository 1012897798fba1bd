"""Connected components of a distributed edge list.

Rounds of smallest-neighbour labels with pointer jumping; every round is a few
partial aggregates and joins, and its labels are written to the shared folder, so
no link, label or component passes through the driver (only a count of changes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stage


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(``node``, ``component``): the smallest node reachable, for the nodes of ``edges`` (``a``, ``b``).

    Self-loops, repeated and reversed edges are fine. Each round replaces the edge
    list by edges to the smallest neighbour: first every node links its larger
    neighbours to its smallest one, then its smaller neighbours. Both steps keep
    the components and shrink paths; when nothing changes each component is a star
    around its smallest node. A neighbour list is never gathered: the smallest
    neighbour comes from a partial aggregate and joins back on the edges, which
    Spark splits where a node has very many.
    """
    work = stage(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b")
                 .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        # large star: larger neighbours go to the smallest of a node and its neighbours
        both = work.unionAll(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = stage(small.where("a != b").distinct(), "edges")
        # a star forest: every node has one edge and no centre is itself a leaf
        several = new.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        if several == 0 and new.select("b").distinct().join(new.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count() == 0:
            work = new
            break
        work = new
    else:
        raise RuntimeError("the components did not settle")
    labels = work.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = work.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return labels.unionAll(centres)
