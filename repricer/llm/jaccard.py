"""Groups of documents linked by the Jaccard similarity of their word shingles.

Documents with the same words in the same order are one node from the start. The join is the prefix
join: shingles are put in one global order, rare ones first, and two sets of the wanted similarity
must share a shingle among the first few of each. Those prefixes are shuffled by shingle, and what
meets there is thinned by the length filter (sizes too different), the positional filter (too little
left after the shared shingle) and the suffix filter (how the sets spread over ranges of the hash
space bounds their overlap) before the texts themselves are compared, once per pair.

The order comes from a table of counts of fixed size that all documents add to; any order gives the
same result, counts only make it fast. Prefixes travel packed, by range of the shingles, and under the first 64 bits of their nodes.
A node of a shingle goes on only if the sizes and places that occur there leave it a partner, so a large group that shares a
shingle too late in its prefixes to be linked by it is gone before any pair is formed. What is wanted is which documents hang
together, so pairs are not spelled out: in rounds, every shingle's nodes are compared with a few leads, the same ones for all
shingles where they can be, and only nodes of different components that meet in a prefix go on. When few pairs are left, or a
round joins hardly any, every one of them is compared that was not yet: the nodes outside a shingle's largest component with
those of each size that they can be linked with, as an ordinary join, which Spark splits where it is skewed. Nodes of very
common shingles are dealt over several tasks when prefixes meet. Tables of finished rounds are removed.

Null texts and texts without words have no shingle and link with nothing. Rows that repeat a doc_id
are linked by their own texts. An empty table gives no rows. Only `doc_id` and `text` are read.
Shingles are told apart by 64-bit hashes while candidates are sought; pairs are verified on the words.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repricer.llm.common import WORD, dropped, released, written
from repricer.llm.components import components

#: Counters of the shingle counts, a power of two, and those that travel in one row.
COUNTERS = 1 << 22
_CHUNK = 1 << 12
#: Ranges of the hash space for the suffix filter: as powers of two, and hashes in one of them, about.
RANGE_BITS = (4, 12)
IN_RANGE = 16
#: Rows of the prefixes that a task packs at once, and buckets of them for each shuffle partition.
PACKED_ROWS = 1 << 19
BUCKETS = 8
#: Nodes of a shingle that one task handles in the first step, about.
HOT = 20_000
#: Leads that each node of a shingle is compared with in a round after the first.
LEADS = 8
#: Pairs for each row that the sizes and places still allow when all pairs that are left are compared at once.
FEW = 3
#: The same where the last round left more than half of them: another round costs more than so many.
SLOW = 64
#: Shingles of texts that a task keeps while it compares pairs.
KNOWN_SHINGLES = 50_000
#: Bits of the map of candidates, at most.
_MAP_BITS = 1 << 27


@dataclass(frozen=True)
class Similarity:
    """Shingles of `words` words; linked where percent / 100 of the union is shared."""

    words: int = 5
    percent: int = 80

    def prefix(self, n: np.ndarray | int):
        return n - (self.percent * n + 99) // 100 + 1

    def overlap(self, n: Column, m: Column) -> Column:
        """The least intersection of linked sets of sizes n and m."""
        return F.ceil((self.percent * (n + m)) / F.lit(100 + self.percent))


def words_of(text: str | None) -> list[bytes]:
    """Words with A to Z lower-cased, in UTF-8; bytes.split() knows exactly the ASCII white space."""
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return set(zip(*(words[k:] for k in range(size))))


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, sorted; a text shorter than a shingle has one."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    take = min(size, len(hashes))
    if not take:
        return hashes
    n = len(hashes) - take + 1
    mixed = np.full(n, take, dtype=np.uint64)
    for k in range(take):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def node_of(words: list[bytes]) -> bytes | None:
    return xxhash.xxh3_128_digest(b" ".join(words)) if words else None


def number_of(node: bytes) -> int:
    """A node's first 64 bits, by which it goes while prefixes meet."""
    return int.from_bytes(node[:8], "little", signed=True)


def _spread(hashes: np.ndarray) -> bytes:
    """How many hashes lie in each range of the hash space; the more hashes, the more ranges."""
    bits = min(RANGE_BITS[1], max(RANGE_BITS[0], (len(hashes) // IN_RANGE).bit_length()))
    return np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype("<u4").tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """How much two spreads differ, in as many ranges as the coarser one has."""
    left, right = (np.frombuffer(s, "<u4").astype(np.int64) for s in (x, y))
    few = min(len(left), len(right))
    return int(np.abs(left.reshape(few, -1).sum(axis=1) - right.reshape(few, -1).sum(axis=1)).sum())


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers, most of which are small, byte by byte of all of them, compressed."""
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 1)


def _restored(packed: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def _read(docs: DataFrame, size: int) -> DataFrame:
    """One pass over the texts: rows (doc_id, node, number, n) and the tasks' shingle counts (chunk, counts)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, seen = np.zeros(COUNTERS, dtype=np.uint32), set()
        waiting, waits = [], 0
        for batch in batches:
            nodes, sizes, numbers = [], [], []
            for text in batch["text"]:
                words = words_of(text)
                node = node_of(words)
                hashes = shingle_hashes(words, size)
                nodes.append(node)
                numbers.append(None if node is None else number_of(node))
                sizes.append(len(hashes))
                if node is not None and node not in seen:  # copies within a task count once
                    seen.add(node)
                    waiting.append(hashes)
                    waits += len(hashes)
                if waits > 1_000_000:
                    _count(counts, waiting)
                    waiting, waits = [], 0
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"].astype("Int64"), "node": nodes, "number": pd.array(numbers, "Int64"), "n": sizes, "chunk": None, "counts": None}
            )
        if waits:
            _count(counts, waiting)
        if seen:
            parts = counts.astype("<u4").reshape(-1, _CHUNK)
            yield pd.DataFrame(
                {"doc_id": None, "node": None, "number": None, "n": None, "chunk": range(len(parts)), "counts": [_squeezed(p) for p in parts]}
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        released(read), "doc_id long, node binary, number long, n long, chunk int, counts binary"
    )


def _count(counts: np.ndarray, parts: list[np.ndarray]) -> None:
    np.add.at(counts, (np.concatenate(parts) & np.uint64(COUNTERS - 1)).astype(np.int64), 1)


def _total(chunks: DataFrame) -> np.ndarray:
    """The tasks' counts added up: COUNTERS numbers, whatever the size of the data."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch["chunk"], batch["counts"]):
                own = _restored(counts, "<u4").astype(np.int64)
                sums[chunk] = sums[chunk] + own if chunk in sums else own
        for chunk, counts in sums.items():
            yield pd.DataFrame({"chunk": [chunk], "counts": [np.minimum(counts, 0xFFFFFFFF).astype("<u4").tobytes()]})

    total = np.zeros((COUNTERS // _CHUNK, _CHUNK), dtype=np.uint32)
    summed = chunks.repartition("chunk").mapInPandas(add, "chunk int, counts binary")
    for row in summed.collect():
        total[row["chunk"]] += np.frombuffer(row["counts"], "<u4")
    return total.reshape(-1)


_PREFIX = "bucket long, shingles binary, numbers binary, sizes binary, places binary"


def _prefixes(docs: DataFrame, counts, similarity: Similarity, bits: int) -> DataFrame:
    """The prefixes, packed: a row has those of some documents in one bucket, sorted by shingle.

    A bucket is a range of the shingles (of 2 ** bits) and, of a common shingle, the part that a node is dealt to.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = counts.value, set()
        waiting, waits = [], 0
        for batch in batches:
            for text in batch["text"]:
                words = words_of(text)
                node = node_of(words)
                if node is None or node in seen:
                    continue
                seen.add(node)
                hashes = shingle_hashes(words, similarity.words)
                count = total[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)]
                first = np.lexsort((hashes, count))[: similarity.prefix(len(hashes))]
                shared = count[first] > 1  # a shingle counted once is in no other node
                at = np.flatnonzero(shared)
                if not len(at):
                    continue
                number = number_of(node)
                parts = -(-count[first][shared].astype(np.int64) // HOT)
                part = np.where(parts > 1, 1 + number % np.maximum(parts, 1), 0)
                waiting.append((hashes[first][shared], np.full(len(at), number), np.full(len(at), len(hashes), np.int32), at.astype(np.int32), part))
                waits += len(at)
                if waits >= PACKED_ROWS:
                    yield _packed(waiting, bits)
                    waiting, waits = [], 0
        if waits:
            yield _packed(waiting, bits)

    return docs.select("text").mapInPandas(released(emit), _PREFIX)


def _packed(waiting: list[tuple], bits: int) -> pd.DataFrame:
    shingle, number, size, at, part = (np.concatenate(x) for x in zip(*waiting))
    bucket = (shingle >> np.uint64(64 - bits)).astype(np.int64) << 32 | part
    order = np.lexsort((shingle, bucket))
    shingle, number, size, at, bucket = shingle[order], number[order], size[order], at[order], bucket[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    rows = []
    for a, b in zip(starts, [*starts[1:], len(bucket)]):
        steps = np.diff(shingle[a:b], prepend=np.uint64(0))
        rows.append((int(bucket[a]), _squeezed(steps), number[a:b].astype("<i8").tobytes(), _squeezed(size[a:b]), _squeezed(at[a:b])))
    return pd.DataFrame(rows, columns=["bucket", "shingles", "numbers", "sizes", "places"])


def _meet(similarity: Similarity):
    """Of packed prefixes sorted by bucket: rows (shingle, number, n, at) that may be in a pair, once each, and the first candidate pairs (a, b, n, m): every node with two others of its shingle and part."""

    def rows_of(packed: list[tuple]) -> pd.DataFrame:
        columns = [
            [np.cumsum(_restored(row.shingles, np.uint64), dtype=np.uint64).view(np.int64) for row in packed],
            [np.frombuffer(row.numbers, "<i8") for row in packed],
            [_restored(row.sizes, np.int32) for row in packed],
            [_restored(row.places, np.int32) for row in packed],
        ]
        shingle, number, n, at = (np.concatenate(x) for x in columns)
        order = np.lexsort((number, shingle))
        part = np.full(len(order), packed[0].bucket & 0xFFFFFFFF)
        return pd.DataFrame({"shingle": shingle[order], "part": part, "number": number[order], "n": n[order].astype(np.int64), "at": at[order].astype(np.int64)})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packed: list = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if packed and packed[0].bucket != row.bucket:
                    yield from _shared(rows_of(packed), similarity)
                    packed = []
                packed.append(row)
        if packed:
            yield from _shared(rows_of(packed), similarity)

    return meet


def _reach(similarity: Similarity, n: np.ndarray, at: np.ndarray, m: np.ndarray, at_m: np.ndarray) -> np.ndarray:
    """The positional filter."""
    return np.minimum(n - at, m - at_m) >= -(-similarity.percent * (n + m) // (100 + similarity.percent))


def _last_places(similarity: Similarity, group: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row the last place at which it may have a partner in its group, by the length and positional filters; -1 if none.

    Of the rows of one size those with the first places are partners of the others, so sizes are compared, not rows.
    """
    order = np.lexsort((at, n, group))
    g, size, place = group[order], n[order], at[order]
    starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (size[1:] != size[:-1])])
    many = np.diff(np.r_[starts, len(order)])
    g, size, first = g[starts], size[starts], place[starts]
    second = place[np.minimum(starts + 1, len(order) - 1)]
    overlap = lambda x, y: -(-similarity.percent * (x + y) // (100 + similarity.percent))
    own = size - overlap(size, size)
    last = np.where((many > 1) & (second <= own), own, -1)
    left = np.arange(len(starts))
    for step in range(1, len(starts)):
        left = left[left + step < len(starts)]
        right = left + step
        near = (g[left] == g[right]) & (size[left] * 100 >= size[right] * similarity.percent)
        left, right = left[near], right[near]
        if not len(left):
            break
        shared = overlap(size[left], size[right])
        fits = size[right] - first[right] >= shared
        last[left[fits]] = np.maximum(last[left[fits]], (size[left] - shared)[fits])
        fits = size[left] - first[left] >= shared
        last[right[fits]] = np.maximum(last[right[fits]], (size[right] - shared)[fits])
    found = np.empty(len(order), dtype=np.int64)
    found[order] = np.repeat(last, many)
    return found


def _shared(rows: pd.DataFrame, similarity: Similarity) -> Iterator[pd.DataFrame]:
    rows = rows.drop_duplicates(["shingle", "number"], ignore_index=True)

    def groups(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        shingle, part = rows["shingle"].to_numpy(), rows["part"].to_numpy()
        starts = np.flatnonzero(np.r_[True, (shingle[1:] != shingle[:-1]) | (part[1:] != part[:-1])])
        return starts, np.diff(np.r_[starts, len(rows)])

    starts, sizes = groups(rows)
    last = _last_places(similarity, np.repeat(np.arange(len(starts)), sizes), rows["n"].to_numpy(), rows["at"].to_numpy())
    # partners of a shingle dealt over several parts may be in others
    rows = rows[(rows["at"].to_numpy() <= last) | (rows["part"].to_numpy() > 0)]
    yield rows[["shingle", "number", "n", "at"]].assign(a=None, b=None, size_a=None, size_b=None)
    if not len(rows):
        return
    starts, sizes = groups(rows)
    number, n, at = rows["number"].to_numpy(), rows["n"].to_numpy(), rows["at"].to_numpy()
    pairs = []
    # the least and the greatest number lead, so that nodes that share many shingles have the same leads in each
    for lead in (np.repeat(starts, sizes), np.repeat(starts + sizes - 1, sizes)):
        m = n[lead]
        good = np.minimum(n, m) * 100 >= np.maximum(n, m) * similarity.percent
        good &= _reach(similarity, n, at, m, at[lead])
        own = np.flatnonzero(good & (lead != np.arange(len(rows))))
        x, y = np.minimum(own, lead[own]), np.maximum(own, lead[own])  # sorted by number within a shingle
        pairs.append(pd.DataFrame({"a": number[x], "b": number[y], "size_a": n[x], "size_b": n[y]}))
    yield pd.concat(pairs, ignore_index=True).drop_duplicates(["a", "b"]).assign(shingle=None, number=None, n=None, at=None)


_MET = "shingle long, number long, n int, at int, a long, b long, size_a int, size_b int"


def _can_reach(similarity: Similarity, n: Column, at: Column, m: Column, at_m: Column) -> Column:
    """The length filter, and the positional filter for the first shingle that two sets share."""
    sizes = F.least(n, m) * 100 >= F.greatest(n, m) * similarity.percent
    return sizes & (1 + F.least(n - at, m - at_m) - 1 >= similarity.overlap(n, m))


def _map_of(spark: SparkSession, ids: DataFrame):
    """A map of fixed size in which every value of the table's one column has its bit set."""
    size, (column,) = 1 << 13, ids.columns
    wanted = ids.count() * 16
    while size < min(wanted, _MAP_BITS):
        size *= 2
    slot = F.pmod(F.xxhash64(column), F.lit(size))
    words = ids.groupBy(F.floor(slot / 32).cast("int").alias("word")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast(pmod(xxhash64({column}), {size}) % 32 as int)))").alias("bits")
    )
    held = np.zeros(size // 32, dtype=np.int64)
    for row in words.toPandas().itertuples():  # at most size / 32 rows
        held[row.word] = row.bits
    return size, spark.sparkContext.broadcast(held)


def _texts(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Columns node, spread and words (compressed) of the documents with the wanted ids, and of a few more."""
    bits, held = _map_of(docs.sparkSession, wanted)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slot = batch["slot"].to_numpy()
            chosen = batch["text"][(held.value[slot // 32] >> (slot % 32)) & 1 == 1]
            rows = []
            for text in chosen:
                words = words_of(text)
                if words:
                    own = zlib.compress(b" ".join(words), 1)
                    rows.append((node_of(words), _spread(shingle_hashes(words, size)), own))
            yield pd.DataFrame(rows, columns=["node", "spread", "words"])

    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits)).alias("slot")
    return docs.select("text", slot).mapInPandas(released(pick), "node binary, spread binary, words binary")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: Similarity) -> DataFrame:
    """Of pairs (a, b, n, m) those that are linked. `texts` may list a node more than once."""
    spreads = texts.select("node", "spread").dropDuplicates(["node"])

    @F.pandas_udf("long")
    def apart(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_apart(*pair) for pair in zip(x, y)], dtype="int64")

    # the suffix filter: sets differ by no less than their spreads do
    near = (
        pairs.join(spreads.select(F.col("node").alias("a"), F.col("spread").alias("spread_a")), "a")
        .join(spreads.select(F.col("node").alias("b"), F.col("spread").alias("spread_b")), "b")
        .filter(F.col("n") + F.col("m") - apart("spread_a", "spread_b") >= 2 * similarity.overlap(F.col("n"), F.col("m")))
        .select("a", "b")
    )
    near = written(near, "near", small_batches=True)
    # of the texts only those of such pairs are sent, and a few more
    bits, held = _map_of(texts.sparkSession, near.select(F.explode(F.array("a", "b")).alias("node")).distinct())

    @F.pandas_udf("boolean")
    def is_held(slots: pd.Series) -> pd.Series:
        own = slots.to_numpy()
        return pd.Series((held.value[own // 32] >> (own % 32)) & 1 == 1)

    wanted = texts.select("node", "words").filter(is_held(F.pmod(F.xxhash64("node"), F.lit(bits))))
    words = wanted.dropDuplicates(["node"])

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        known: dict[bytes, set] = {}
        held = 0

        def of(packed: bytes) -> set:
            nonlocal held
            if packed not in known:
                own = shingles(zlib.decompress(packed).split(b" "), similarity.words)
                held += len(own)
                if held > KNOWN_SHINGLES:
                    known.clear()
                    held = len(own)
                known[packed] = own
            return known[packed]

        found = []
        for left, right in zip(x, y):
            left, right = of(left), of(right)
            shared = len(left & right)
            found.append(100 * shared >= similarity.percent * (len(left) + len(right) - shared))
        return pd.Series(found, dtype=bool)

    return (
        near.join(words.select(F.col("node").alias("a"), F.col("words").alias("words_a")), "a")
        .join(words.select(F.col("node").alias("b"), F.col("words").alias("words_b")), "b")
        .filter(linked("words_a", "words_b"))
        .select("a", "b")
    )


def _classes(labelled: DataFrame, similarity: Similarity) -> DataFrame:
    """Rows (shingle, n, m): nodes of size n outside the shingle's largest component may be linked with others of size m."""
    sizes = written(
        labelled.groupBy("shingle", "n").agg(F.min(F.when(F.col("minor"), F.col("at"))).alias("minor_at"), F.min("at").alias("at"), F.count("*").alias("c")), "sizes"
    )
    x = sizes.filter("minor_at IS NOT NULL").select("shingle", "n", "minor_at")
    y = sizes.select("shingle", F.col("n").alias("m"), F.col("at").alias("at_m"), "c")
    fits = _can_reach(similarity, F.col("n"), F.col("minor_at"), F.col("m"), F.col("at_m")) & ((F.col("n") != F.col("m")) | (F.col("c") > 1))
    return x.join(y, "shingle").filter(fits).select("shingle", "n", "m")


def _mixed(left: DataFrame, joined: DataFrame, similarity: Similarity) -> tuple[DataFrame, DataFrame, int, int]:
    """The rows (shingle, node, n, at, component, minor) that may still be in a pair, and the sizes of such pairs (shingle, n, m).

    With the number of rows, and that of the pairs that their sizes and first places allow. A row is `minor` outside the largest
    component of its shingle; every pair of different components has one of these.
    """
    labelled = written(
        left.select("shingle", "node", "n", "at")
        .join(joined, "node", "left")
        .withColumn("component", F.coalesce("component", "node")),
        "labelled",
    )
    same = labelled.groupBy("shingle", "component").agg(F.count("*").alias("c"))
    groups = same.groupBy("shingle").agg(F.max(F.struct("c", "component")).alias("most"), F.count("*").alias("components"))
    major = groups.filter("components > 1").select("shingle", F.col("most.component").alias("major"))
    mixed = written(labelled.join(major, "shingle").withColumn("minor", F.col("component") != F.col("major")).drop("major"), "mixed")
    classes = written(_classes(mixed, similarity), "classes")
    # the least size that a size can be linked with asks for the least overlap
    both = classes.union(classes.select("shingle", F.col("m").alias("n"), F.col("n").alias("m"))).groupBy("shingle", "n").agg(F.min("m").alias("m"))
    kept = mixed.join(both, ["shingle", "n"]).filter(F.col("n") - F.col("at") >= similarity.overlap(F.col("n"), F.col("m"))).drop("m")
    left = written(kept.select("shingle", "node", "n", "at", "component", "minor"), "left")
    counts = left.groupBy("shingle", "n").agg(F.count(F.when(F.col("minor"), 1)).cast("double").alias("minor"), F.count("*").cast("double").alias("all"))
    pairs = (
        classes.join(counts.select("shingle", "n", "minor"), ["shingle", "n"])
        .join(counts.select("shingle", F.col("n").alias("m"), "all"), ["shingle", "m"])
        .agg(F.sum(F.col("minor") * F.col("all")).alias("pairs"))
        .first()["pairs"]
    )
    dropped(labelled, mixed)
    return left, classes, left.count(), int(pairs or 0)


def _in_order(x: str, y: str, n: str, m: str) -> list[Column]:
    """Columns a, b, n, m of a pair, the smaller node first."""
    first = F.col(x) < F.col(y)
    return [
        F.when(first, F.col(x)).otherwise(F.col(y)).alias("a"),
        F.when(first, F.col(y)).otherwise(F.col(x)).alias("b"),
        F.when(first, F.col(n)).otherwise(F.col(m)).alias("n"),
        F.when(first, F.col(m)).otherwise(F.col(n)).alias("m"),
    ]


def _pairs_with_leads(left: DataFrame, similarity: Similarity, step: int) -> DataFrame:
    """Nodes outside the largest component of a shingle with LEADS of its nodes, others in each step; half of these are in that component."""
    lead = F.struct("node", "n", "at", "component")
    # drawn by the node alone, so that nodes that share many shingles have the same leads in each
    draw = lambda k: F.struct(F.col("minor") == F.lit(k % 2 == 0), F.xxhash64("node", F.lit(step * LEADS + k)))
    leads = left.groupBy("shingle").agg(*[F.min_by(lead, draw(k)).alias(f"lead{k}") for k in range(LEADS)])
    leads = leads.select("shingle", F.array_distinct(F.array(*[f"lead{k}" for k in range(LEADS)])).alias("leads"))
    return (
        left.filter("minor").join(written(leads, "leads"), "shingle")
        .withColumn("lead", F.explode("leads"))
        .filter((F.col("component") != F.col("lead.component")))
        .filter(_can_reach(similarity, F.col("n"), F.col("at"), F.col("lead.n"), F.col("lead.at")))
        .select(*_in_order("node", "lead.node", "n", "lead.n"))
        .distinct()
    )


def _meetings(left: DataFrame, classes: DataFrame, similarity: Similarity) -> DataFrame:
    """Pairs of nodes of different components at the first shingle of `left` that both have, if they pass the length and positional filters there.

    Places follow one global order, so a shingle that both have before this one is before it in each; the first shared shingle of
    linked sets is kept in `left` for both and passes the filters, so no link is lost, and near copies meet once, not at every shingle.
    """
    own = left.groupBy("node").agg(F.collect_list(F.struct("at", "shingle")).alias("own"))
    earlier = F.transform(F.filter("own", lambda s: s["at"] < F.col("at")), lambda s: s["shingle"])
    placed = left.join(own, "node").withColumn("earlier", earlier).drop("own")
    x = placed.filter("minor").join(classes, ["shingle", "n"])
    x = x.filter(F.col("n") - F.col("at") >= similarity.overlap(F.col("n"), F.col("m")))
    x, y = x.alias("x"), placed.alias("y")
    return x.join(
        y,
        (F.col("x.shingle") == F.col("y.shingle"))
        & (F.col("x.m") == F.col("y.n"))
        & (F.col("x.component") != F.col("y.component"))
        & _can_reach(similarity, F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at"))
        & ~F.arrays_overlap(F.col("x.earlier"), F.col("y.earlier")),
    ).select(*_in_order("x.node", "y.node", "x.n", "y.n"))


def _every_pair(left: DataFrame, classes: DataFrame, similarity: Similarity) -> DataFrame:
    """All pairs of nodes of different components that share a shingle and pass the length and positional filters there."""
    return _meetings(left, classes, similarity).distinct()


def _linked(docs: DataFrame, similarity: Similarity) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A row per document (doc_id, node, n), the nodes with their smallest doc_id (node, first_id, n), and the components of those that are linked."""
    spark = docs.sparkSession
    read = written(_read(docs, similarity.words), "read", small_batches=True)
    counts = spark.sparkContext.broadcast(_total(read.filter("chunk IS NOT NULL").select("chunk", "counts")))
    rows = read.filter("chunk IS NULL").select("doc_id", "node", "number", "n")
    nodes = written(
        rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("number").alias("number")), "nodes"
    )
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    met = written(
        _prefixes(docs, counts, similarity, (BUCKETS * partitions).bit_length())
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInPandas(released(_meet(similarity)), _MET),
        "met",
        small_batches=True,
    )
    counts.unpersist()
    # from numbers to nodes; should two nodes share a number, both are looked at
    named = nodes.select("number", "node")
    left = written(met.filter("number IS NOT NULL").join(named, "number").select("shingle", "node", "n", "at"), "left")
    pairs = met.filter("a IS NOT NULL").select("a", "b", F.col("size_a").alias("n"), F.col("size_b").alias("m")).distinct()
    for side in ("a", "b"):
        pairs = pairs.withColumnRenamed(side, "number").join(named, "number").withColumnRenamed("node", side).drop("number")
    pairs = pairs.select(*_in_order("a", "b", "n", "m"))
    meeting = left.select("node").distinct().join(nodes, "node")
    texts = written(_texts(docs, meeting.select(F.col("first_id").alias("doc_id")), similarity.words), "texts", small_batches=True)

    links, looked, pairs_left = None, None, None
    for step in itertools.count(1):
        links, looked = _looked_at(pairs, texts, similarity, links, looked)
        joined = written(components(links), "components")
        before, spent = pairs_left, left
        left, classes, rows_left, pairs_left = _mixed(spent, joined, similarity)
        dropped(met, spent)
        if pairs_left <= FEW * rows_left:
            break
        if before is not None and pairs_left > (0.5 if pairs_left <= SLOW * rows_left else 0.98) * before:
            break
        pairs = _pairs_with_leads(left, similarity, step)
    if pairs_left:
        links, _ = _looked_at(_every_pair(left, classes, similarity), texts, similarity, links, looked)
        joined = written(components(links), "components")
    dropped(left, texts)
    return rows, nodes, joined


def _looked_at(
    pairs: DataFrame, texts: DataFrame, similarity: Similarity, links: DataFrame | None, looked: DataFrame | None
) -> tuple[DataFrame, DataFrame]:
    """The links found so far and the pairs compared so far, with those of `pairs` that were not compared before."""
    fresh = pairs if looked is None else pairs.join(looked, ["a", "b"], "left_anti")
    fresh = written(fresh, "pairs")
    found = written(_verified(fresh, texts, similarity), "links", small_batches=True)
    own = fresh.select("a", "b")
    return (found, own) if links is None else (links.union(found), looked.union(own))


def linked_documents(docs: DataFrame, similarity: Similarity = Similarity()) -> DataFrame:
    """Columns doc_id, n_shingles, component_id (the smallest doc_id reachable) and node (of its words), a row per document."""
    rows, nodes, joined = _linked(docs, similarity)
    # the smallest doc_id of each component, and of copies where there is no link
    least = (
        nodes.join(joined, "node")
        .groupBy("component")
        .agg(F.min("first_id").alias("least_id"))
    )
    reached = written(
        nodes.join(joined, "node", "left")
        .join(written(least, "least"), "component", "left")
        .select("node", F.coalesce("least_id", "first_id").alias("component_id")),
        "reached",
    )
    with_words = rows.filter("node IS NOT NULL").join(reached, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "node")
    without = rows.filter("node IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), "node")
    return with_words.unionByName(without)


def one_of_each_group(docs: DataFrame, similarity: Similarity = Similarity()) -> DataFrame:
    """The rows that stay: of each component one with the smallest doc_id, all columns kept.

    Of several texts with that id the one of the smallest node stays; null ids come last. Documents without words stay.
    Rows that repeat the doc_id and text of one that stays are repeats of it and go.
    """
    rows, nodes, joined = _linked(docs, similarity)
    no_id, own_id = F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("own_id")
    keys = ["no_id", "own_id", "node"]
    stay = (
        nodes.withColumnRenamed("first_id", "id")
        .join(joined, "node", "left")
        .groupBy(F.coalesce("component", "node").alias("group"))
        .agg(F.min(F.struct(no_id, own_id, "node")).alias("least"))
        .select("least.*")
    )
    repeats = rows.filter("node IS NOT NULL").select(F.col("doc_id").alias("id"), "node").groupBy(no_id, own_id, "node").agg(F.count("*").alias("rows"))
    stay = written(stay.join(repeats, keys), "stay")

    @F.pandas_udf("binary")
    def key(texts: pd.Series) -> pd.Series:
        return pd.Series([node_of(words_of(t)) for t in texts], dtype=object)

    # the row as one value, whatever its columns are called; whole rows are sent once, and never sorted
    found = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.struct("*").alias("doc"))
    has_words = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    noted = found.filter(has_words).select(no_id, own_id, key("text").alias("node"), "text", "doc")
    chosen = noted.join(stay.filter("rows = 1").hint("shuffle_hash"), keys, "left_semi").select("doc")
    several = stay.filter("rows > 1")
    if not several.isEmpty():
        again = noted.join(several.hint("shuffle_hash"), keys, "left_semi").groupBy(*keys).agg(F.min_by("doc", "text").alias("doc"))
        chosen = chosen.unionByName(again.select("doc"))
    without = found.filter(~has_words).select(no_id, own_id, F.col("text").isNull().alias("no_text"), F.coalesce("text", F.lit("")).alias("own_text"), "doc")
    return chosen.unionByName(without.dropDuplicates(["no_id", "own_id", "no_text", "own_text"]).select("doc")).select("doc.*")
