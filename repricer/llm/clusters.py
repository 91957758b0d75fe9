"""Centroid clustering of vectors in whole numbers, with column expressions only.

Components are scaled and floored, so all sums and distances are exact and every run gives the same
result. In each round the centroids are literals of the query: `zip_with` and `aggregate` give the
squared distance of a vector to each, `array_min` of (distance, number) picks the nearest, and one
sum per component and cluster, added up in the map tasks first, moves the centroids. A round
shuffles and collects one row per cluster, whatever the number of vectors.

Vectors that are null, of another length, or with a null or non-finite component are left out.
Scaled components are held to +-2**27, so that every distance fits a long; sums over vectors that do not
fit one are null. Rows that repeat a vec_id count each by itself; seeds of equal hash are taken in the order
of their components, null ids last. With fewer vectors than clusters there are fewer clusters, and an empty
table gives no rows. Only the id and vector columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repricer.llm.common import written

CLUSTERS = 40
ROUNDS = 5
SCALE = 256
DIMENSIONS = 64
SEED = 2
#: Scaled components lie between plus and minus this.
BOUND = 1 << 27
_LONGEST = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, dimensions: int, scale: int, vector_column: str = "embedding") -> DataFrame:
    """Columns vec_id and v (floored multiples of the components) of the vectors that take part."""
    v = F.col(vector_column)
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # NaN is above all
    held = lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(float(BOUND))), F.lit(-float(BOUND)))
    return vectors.filter((F.size(v) == dimensions) & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(held(x)).cast("long")).alias("v")
    )


def _array(values: Sequence[int]) -> str:
    return f"array({','.join(f'{x}L' for x in values)})"


def nearest(v: Column, centroids: Sequence[Sequence[int]]) -> Column:
    """The struct (distance, cluster) of the centroid nearest to v; of equally near ones the first."""

    def place(centroid: Column, number: Column) -> Column:
        squares = F.zip_with(v, centroid, lambda x, c: (x - c) * (x - c))
        return F.struct(
            F.aggregate(squares, F.lit(0).cast("long"), lambda total, square: total + square).alias("distance"), number.alias("cluster")
        )

    return F.array_min(F.transform(F.expr(f"array({','.join(map(_array, centroids))})"), place))


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: floored means of their vectors; those without vectors stay."""
    sums = (
        vectors.select("v", nearest(F.col("v"), centroids)["cluster"].alias("cluster"))
        .groupBy("cluster")
        .agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i]).alias(f"sum{i}") for i in range(len(centroids[0]))])
    )
    means = {r["cluster"]: [total // r["n"] for total in r[2:]] for r in sums.collect()}  # a row per cluster
    return [means.get(k, centroid) for k, centroid in enumerate(centroids)]


def clustered(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: int = SEED,
    vector_column: str = "embedding",
) -> tuple[DataFrame, list[list[int]]]:
    """Columns vec_id, cluster, distance, cluster_inertia and inertia, a row per vector, and the final centroids.

    Seeds are the vectors with the smallest SHA-256 of `seed:vec_id`.
    """
    spark = vectors.sparkSession
    kept = written(whole_vectors(vectors, dimensions, scale, vector_column), "vectors")
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    seeds = kept.select(by_hash.alias("hash"), "v").orderBy(F.col("hash").asc_nulls_last(), "v").limit(clusters).collect()
    centroids = [list(r["v"]) for r in seeds]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long"), []
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    near = written(kept.select("vec_id", nearest(F.col("v"), centroids).alias("near")), "nearest")
    near = near.select("vec_id", "near.cluster", "near.distance")
    sums = near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
    inertia = {r["cluster"]: int(r["total"]) for r in sums.collect()}  # a row per cluster
    fitting = lambda total: f"{total}L" if total <= _LONGEST else "CAST(NULL AS BIGINT)"
    each = f"array({','.join(fitting(inertia.get(k, 0)) for k in range(len(centroids)))})"
    return near.select(
        "vec_id",
        F.col("cluster").cast("int").alias("cluster"),
        "distance",
        F.expr(f"{each}[cluster]").alias("cluster_inertia"),
        F.expr(fitting(sum(inertia.values()))).alias("inertia"),
    ), centroids


def centroid_digests(centroids: list[list[int]]) -> Column:
    """By the column `cluster`: SHA-256 of the centroid's components, joined by commas."""
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return F.expr(f"""array({",".join(f"'{d}'" for d in digests)})[cluster]""") if digests else F.lit(None).cast("string")
