"""Connected components of a large undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeclerk.llm.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``component``) for every node of the edges (``a``, ``b``).

    A component is named after its least node. Alternates two steps until
    nothing changes: every node links its greater neighbours to its least one,
    and then its lesser ones too. Both keep what is connected, and a chain
    shrinks to a star in a number of rounds that grows with the logarithm of
    its length. The least neighbour of a node is an aggregate that each task
    reduces first, so a node with a great many edges is no single task's. Each
    round is written to the shared folder; only the numbers of changed edges
    reach the driver. Null ends and loops are left out; repeated edges count
    once.
    """
    pairs = edges.select("a", "b").where(F.col("a") != F.col("b"))
    current = written(
        pairs.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "edges",
    )
    while True:
        both = current.unionByName(current.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy(F.col("hi").alias("node")).agg(
            F.least(F.min("lo"), F.first("hi")).alias("least")
        )
        large = (
            both.where(F.col("lo") > F.col("hi"))
            .join(least, F.col("hi") == F.col("node"))
            .select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        )
        large = written(large.distinct(), "edges")
        # Every lesser neighbour, and the node itself, links to the least one.
        least = large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least"))
        small = large.join(least, F.col("hi") == F.col("node")).select(
            F.explode(
                F.array(
                    F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")),
                    F.struct(F.col("hi").alias("hi"), F.col("least").alias("lo")),
                )
            ).alias("edge")
        )
        small = written(
            small.select("edge.hi", "edge.lo").where(F.col("hi") != F.col("lo")).distinct(),
            "edges",
        )
        same = small.join(current, ["hi", "lo"], "left_semi").count()
        settled = same == small.count() == current.count()
        current = small
        if settled:
            break
    members = current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return members.unionByName(roots)
