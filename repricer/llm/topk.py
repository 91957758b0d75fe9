"""Exact top-k search by inner product over norm-sorted, rotated vectors.

Components are scaled and floored to whole numbers; scores are their exact inner products. All
vectors are range-partitioned by descending length and packed into blocks. A rotation from the
singular value decomposition of their second moments gathers most of every length in the first
components, so a partial sum over those and the Cauchy-Schwarz bound of the rest (product of the
residual lengths) tells for most pairs that they cannot reach the query's k-th best score; what is
left is scored in whole numbers. A query first meets the longest vectors, which gives its k-th best
score so far. Then it is sent to those partitions only whose longest vector could still reach that
score, and inside one it stops at the first block that could not.

A partition holds PART_BYTES of vectors in memory while queries stream past; nothing is broadcast but
the rotation, of at most ROTATED squared numbers. Bounds are computed in floating point with a margin, so they
only decide which pairs are scored.

Vectors that are null or hold a null or non-finite component take no part. Scaled components are
held to +-2**28, so that scores of up to 64 components always fit a long. A shorter vector counts as followed by zeros. A row is never its
own candidate, but other rows of its id are; rows that repeat a query's id are queries each by itself. Null ids rank behind all others of the same score.
An empty table, or one without queries, gives no rows. Only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repricer.llm.common import written

SCALE = 1024
#: Scaled components lie between plus and minus this.
BOUND = 1 << 28
#: Components that the rotation mixes, at most; those beyond count as residual.
ROTATED = 256
#: Bytes of vectors that a task holds, about.
PART_BYTES = 32 << 20
#: Components in a block of vectors, about, and those of queries handled at once.
CELLS = 1 << 20
QUERY_CELLS = 1 << 15
#: Vectors of a block looked at in one step.
STEP = 2048
#: Shares of the squared length that the partial sums hold.
SHARES = (0.5, 0.8)
#: Relative margin of bounds computed in floating point.
MARGIN = 1e-9

_NO_ID = np.iinfo(np.int64).max
_FOUND = "query long, query_id long, score long, vec_id long, row long"


def _whole(vectors: DataFrame, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """Columns row, vec_id, width, norm and data (whole numbers of 32 bits) of the vectors that take part."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            present = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            widths = pc.list_value_length(lists.take(pa.array(present))).to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
            ends = np.r_[0, np.cumsum(widths)]
            odd = np.r_[0, np.cumsum(~np.isfinite(values))]
            whole = np.clip(np.floor(np.nan_to_num(values) * scale), -BOUND, BOUND).astype("<i4")
            fine = np.flatnonzero(odd[ends[1:]] == odd[ends[:-1]])
            norms = [float(np.linalg.norm(whole[ends[k] : ends[k + 1]].astype(np.float64))) for k in fine]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(present[fine])),
                    pa.array(widths[fine], pa.int32()),
                    pa.array(norms, pa.float64()),
                    pa.array([whole[ends[k] : ends[k + 1]].tobytes() for k in fine], pa.binary()),
                ],
                names=["vec_id", "width", "norm", "data"],
            )

    ids = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v"))
    return ids.mapInArrow(read, "vec_id long, width int, norm double, data binary").withColumn("row", F.monotonically_increasing_id())


def _matrix(data: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows, short ones followed by zeros."""
    if all(len(own) == 4 * width for own in data):
        return np.frombuffer(b"".join(data), "<i4").reshape(len(data), width)
    return np.frombuffer(b"".join(own.ljust(4 * width, b"\0") for own in data), "<i4").reshape(len(data), width)


def _groups(widths: list[int], cells: int) -> Iterator[tuple[int, int]]:
    """Runs of vectors that fill a matrix of some `cells` components."""
    start, widest = 0, 1
    for k, width in enumerate(widths):
        if k > start and (k + 1 - start) * max(widest, width) > cells:
            yield start, k
            start, widest = k, 1
        widest = max(widest, width)
    if start < len(widths):
        yield start, len(widths)


def _rotation(whole: DataFrame, width: int) -> tuple[np.ndarray, list[int]]:
    """The rotation, most telling direction first, and how many directions hold the wanted shares."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            data = [own[: 4 * width] for own in batch.column("data").to_pylist()]
            for start, stop in _groups([width] * len(data), CELLS):
                own = _matrix(data[start:stop], width).astype(np.float64)
                total += own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["moments"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for own in batch.column("moments"):
                total += np.frombuffer(own.as_py()).reshape(width, width)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["moments"])

    parts = whole.select("data").mapInArrow(moments, "moments binary").repartition(8).mapInArrow(add, "moments binary").collect()
    total = sum((np.frombuffer(r["moments"]).reshape(width, width) for r in parts), np.zeros((width, width)))
    directions, strengths, _ = np.linalg.svd(total)
    held = np.cumsum(strengths) / max(float(strengths.sum()), 1e-300)
    return directions, sorted({min(width, int(np.searchsorted(held, share)) + 1) for share in SHARES})


def _packed(whole: DataFrame, parts: int) -> DataFrame:
    """Blocks of vectors, longest first: part and place in it, width, norm of the longest, ids, rows and data."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            widths = batch.column("width").to_pylist()
            for start, stop in _groups(widths, CELLS):
                own, width = batch.slice(start, stop - start), max(widths[start:stop])
                ids = own.column("vec_id").fill_null(_NO_ID).to_numpy().astype("<i8")
                rows = own.column("row").to_numpy().astype("<i8")
                data = _matrix(own.column("data").to_pylist(), width)
                values = [part, place, width, float(own.column("norm")[0].as_py()), ids.tobytes(), rows.tobytes(), data.tobytes()]
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=_BLOCK)
                place += 1

    order = [F.col("norm").desc(), F.col("vec_id").asc_nulls_last(), F.col("row")]
    by_norm = whole.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return by_norm.select("vec_id", "row", "width", "norm", "data").mapInArrow(
        pack, "part int, place int, width int, top double, ids binary, rows binary, data binary"
    )


_BLOCK = ["part", "place", "width", "top", "ids", "rows", "data"]


class _Turned:
    """Vectors of one matrix with their rotated components, lengths, and residual lengths after the partial sums."""

    def __init__(self, whole: np.ndarray, rotation: np.ndarray, cuts: list[int]):
        first = len(rotation)
        own = whole[:, :first].astype(np.float64)
        rotated = own @ rotation[: own.shape[1]]
        beyond = (whole[:, first:].astype(np.float64) ** 2).sum(axis=1)
        squares = rotated**2
        self.whole = whole
        self.norm = np.sqrt(squares.sum(axis=1) + beyond)
        self.partial = [rotated[:, a:b] for a, b in zip([0, *cuts], cuts)]
        self.residual = [np.sqrt(squares[:, cut:].sum(axis=1) + beyond) for cut in cuts]


class _Block(_Turned):
    def __init__(self, row: dict, rotation: np.ndarray, cuts: list[int]):
        super().__init__(np.frombuffer(row["data"], "<i4").reshape(-1, row["width"]), rotation, cuts)
        self.ids, self.rows = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["rows"], "<i8")


def _scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of x with rows of y, whole numbers."""
    width = min(x.shape[1], y.shape[1])
    x, y = x[:, :width], y[:, :width]
    large = lambda z: float(np.abs(z.astype(np.float64)).max(initial=0))
    if large(x) * large(y) * width < 1 << 53:  # every sum is exact in floating point
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    return x.astype(np.int64) @ y.T.astype(np.int64)


class _Best:
    """The k best candidates of some queries so far."""

    def __init__(self, k: int, floors: np.ndarray, rows: np.ndarray):
        self.k, self.floors, self.rows = k, floors, rows
        self.found = [np.empty(0, np.int64)] * 4  # query, score, id, row

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        good = (score >= self.floors[query]) & (rows != self.rows[query])
        if not good.any():
            return
        query, score, ids, rows = (np.r_[x, y[good]] for x, y in zip(self.found, (query, score, ids, rows)))
        order = np.lexsort((rows, ids, -score, query))
        query, score, ids, rows = query[order], score[order], ids[order], rows[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        last = rank == self.k - 1
        self.floors[query[last]] = score[last]
        self.found = [x[rank < self.k] for x in (query, score, ids, rows)]


def _answer(queries: _Turned, rows: np.ndarray, floors: np.ndarray, blocks: list[_Block], k: int) -> list[np.ndarray]:
    best = _Best(k, floors, rows)
    for block in blocks:
        if not (queries.norm * block.norm[0] * (1 + MARGIN) >= best.floors).any():
            break  # all that follow are shorter
        step = 4 * k  # few at first, so that the floors rise early
        start = 0
        while start < len(block.ids):
            stop = min(len(block.ids), start + step)
            start, step, part = stop, min(STEP, 4 * step), slice(start, stop)
            live = np.flatnonzero(queries.norm * block.norm[part][0] * (1 + MARGIN) >= best.floors)
            if not len(live):
                break
            slack = MARGIN * queries.norm[live, None] * block.norm[None, part]
            floor = best.floors[live, None] - slack
            sums = queries.partial[0][live] @ block.partial[0][part].T
            near = sums + queries.residual[0][live, None] * block.residual[0][None, part] >= floor
            if near.mean() > 0.1:  # most may still be among the best: score them all
                score = _scores(queries.whole[live], block.whole[part])
                q, c = np.nonzero((score >= best.floors[live, None]) & near)
                best.add(live[q], score[q, c], block.ids[part][c], block.rows[part][c])
                continue
            q, c = np.nonzero(near)
            sums = sums[q, c]
            for depth in range(1, len(queries.partial)):
                own, other = queries.partial[depth][live[q]], block.partial[depth][part][c]
                sums = sums + np.einsum("ij,ij->i", own, other)
                rest = queries.residual[depth][live[q]] * block.residual[depth][part][c]
                still = sums + rest >= floor[q, c]
                q, c, sums = q[still], c[still], sums[still]
            width = min(queries.whole.shape[1], block.whole.shape[1])
            own, other = queries.whole[live[q], :width].astype(np.int64), block.whole[part][c, :width].astype(np.int64)
            best.add(live[q], np.einsum("ij,ij->i", own, other), block.ids[part][c], block.rows[part][c])
    return best.found


def _search(rotation: np.ndarray, cuts: list[int], k: int):
    """Of rows sorted by key, kind and place: the blocks of a key, then its queries; gives the best of each query in those blocks."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blocks = None, []
        for batch in batches:
            keys, kinds = batch.column("key").to_numpy(), batch.column("kind").to_numpy()
            turns = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])])
            for start, stop in zip(turns, [*turns[1:], len(keys)]):
                own = batch.slice(start, stop - start)
                if keys[start] != key:
                    key, blocks = keys[start], []
                if kinds[start] == 0:
                    blocks += [_Block(row, rotation, cuts) for row in own.select(["width", "ids", "rows", "data"]).to_pylist()]
                    continue
                widths, data = own.column("width").to_pylist(), own.column("data").to_pylist()
                rows, ids = own.column("row").to_numpy(), own.column("vec_id")
                floors = own.column("floor").fill_null(np.iinfo(np.int64).min).to_numpy()
                for first, last in _groups(widths, QUERY_CELLS):
                    queries = _Turned(_matrix(data[first:last], max(1, *widths[first:last])), rotation, cuts)
                    query, score, found, found_rows = _answer(queries, rows[first:last], floors[first:last].copy(), blocks, k)
                    columns = [
                        pa.array(rows[first:last][query], pa.int64()),
                        ids.slice(first, last - first).take(pa.array(query)),
                        pa.array(score, pa.int64()),
                        pa.array(found, pa.int64(), mask=found == _NO_ID),
                        pa.array(found_rows, pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["query", "query_id", "score", "vec_id", "row"])

    return search


def _met(blocks: DataFrame, queries: DataFrame, keys: int, rotation: np.ndarray, cuts: list[int], k: int) -> DataFrame:
    """The best of each query in the blocks of its keys; both tables have a `key` from 0 to keys - 1."""
    nothing = lambda kind: F.lit(None).cast(kind)
    block_rows = blocks.select(
        "key", F.lit(0).alias("kind"), "place", "width", "ids", "rows", "data",
        nothing("long").alias("vec_id"), nothing("long").alias("row"), nothing("long").alias("floor"),
    )
    query_rows = queries.select(
        "key", F.lit(1).alias("kind"), F.lit(0).alias("place"), "width", nothing("binary").alias("ids"), nothing("binary").alias("rows"),
        "data", "vec_id", "row", "floor",
    )
    together = block_rows.unionByName(query_rows).repartitionById(keys, F.col("key"))
    return together.sortWithinPartitions("key", "kind", "place").mapInArrow(_search(rotation, cuts, k), _FOUND)


def top_inner_products(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: int = SCALE,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """Columns query_id, rank, vec_id and score: the k best of each row whose `vec_id` fulfils `is_query`.

    Scores rank from the highest, equal ones by the smaller vec_id. With fewer than k candidates all are given.
    """
    spark = vectors.sparkSession
    whole = written(_whole(vectors, scale, id_column, vector_column), "whole")
    size = whole.agg(F.max("width").alias("width"), F.sum(F.col("width") * 4 + 24).alias("bytes")).first()
    queries = whole.filter(is_query)
    n_queries = queries.count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rotation, cuts = _rotation(whole, max(1, min(ROTATED, size["width"])))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    blocks = written(_packed(whole, max(tasks, -(-size["bytes"] // PART_BYTES))), "blocks")
    # a row per partition; the first one has the longest vectors
    tops = {r["part"]: r["top"] for r in blocks.groupBy("part").agg(F.max("top").alias("top")).collect()}
    parts = sorted(tops)
    lead = (F.col("part") == parts[0]) & (F.col("place") == 0)
    # every query with the first block, in some tasks
    chunks = max(1, min(tasks, n_queries // 64))
    dealt = queries.withColumn("key", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int")).withColumn("floor", F.lit(None).cast("long"))
    copied = blocks.filter(lead).withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    first = written(_met(copied, dealt, chunks, rotation, cuts, k), "first")
    floors = first.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor")).withColumnRenamed("query", "row")
    # and with the partitions that it can reach, which are the first ones
    lengths = F.expr(f"array({','.join(repr(float(tops[p])) + 'D' for p in parts)})")
    reach = F.col("norm") * (1 + MARGIN)
    within = F.when(F.col("floor").isNull(), F.lit(len(parts))).otherwise(F.size(F.filter(lengths, lambda top: top * reach >= F.col("floor"))))
    number = F.expr(f"map_from_arrays(array({','.join(map(str, parts))}), sequence(0, {len(parts) - 1}))")
    aimed = queries.join(floors, "row", "left").withColumn("within", within).filter("within > 0")
    aimed = aimed.withColumn("key", F.explode(F.sequence(F.lit(0), F.col("within") - 1)))
    others = blocks.filter(~lead).withColumn("key", F.element_at(number, F.col("part")))
    rest = _met(others, aimed, len(parts), rotation, cuts, k)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
