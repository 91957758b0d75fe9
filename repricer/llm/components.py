"""Connected components of a graph given by its edges, by alternating large and small stars.

Every round links nodes to the least node they know of; a node with any number of neighbours is
reduced before the shuffle, and where its edges meet that least node both sides are plain tables, so
that Spark can split a hot node's join. Rounds end when the edges no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repricer.llm.common import written


#: Edges of a written file, about: few edges make few files.
_EDGES = 50_000


def _written(df: DataFrame, name: str, files: int) -> DataFrame:
    return written(df.coalesce(files), name)


def _least(edges: DataFrame, files: int) -> DataFrame:
    """For each node u of edges (u, v) the least of its neighbours and itself."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _written(least, "least", files)


def _large_star(edges: DataFrame, files: int) -> DataFrame:
    """Links every larger neighbour of a node to the least node that the node knows."""
    both = _written(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both", files)
    return (
        both.join(_least(both, files), "u")
        .filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame, files: int) -> DataFrame:
    """Links the smaller neighbours of a node, and the node, to the least of them."""
    least = _least(edges, files)
    linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Columns node and component (the least node) for all nodes of the undirected edges (a, b).

    Edges of a node with itself, or with null, count for nothing.
    """
    now = written(
        edges.filter("a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    files, mark = -(-max(1, now.count()) // _EDGES), None
    now = _written(now, "edges", files)
    while True:
        large = _written(_large_star(now, files), "large", files)
        now = _written(_small_star(large, files), "small", files)
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == mark:
            break
        mark = (row["n"], row["h"])
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
