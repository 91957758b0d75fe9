"""How filters of documents interact: what each removes, in every order of them.

Words come as a sparse document-term matrix. Texts are read once, in shards of some megabytes; a
shard numbers its words with a dictionary of its own and stores its rows compressed (row starts,
word numbers, counts). The shards' distinct words alone are shuffled, once, by word: there each word gets its
number in the global dictionary, and the numbers go back to the shards in packed arrays and replace the shards' own. Row sums
are the documents' words, the number of entries of a row its distinct words.

Each document then is a set of failed filters. Rows are added up by text before equal texts are
compared, so a text that a third of the rows share is a few rows; labels meet one row per document. From there one count per part and set of failed
filters is enough to follow all orders.

Null texts are empty, a null part is the empty string. A document whose doc_id is null has no
smaller id and is smaller than none. Rows that repeat a doc_id count each by itself, and none of them is a copy of
another. Of several labels of a doc_id one that is 1 counts. An empty table gives no rows. Only
`doc_id`, `text`, `lang` and of the labels `doc_id`, `quality`, `toxic` are read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repricer.llm.common import text_of, written

#: Bytes of text in a shard, about; a longer document is a shard of its own.
SHARD_BYTES = 8 << 20
#: Words of the dictionary pass that a task numbers at once.
PACKED_WORDS = 1 << 20
LETTERS = "ABCDE"
#: Fewer words fail A; fewer distinct words for each 100 fail B; more capitals for each 100 code points fail C.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
MARKS = b"#$%&*|"

_DOC = "struct<doc_id: bigint, part: string, digest: binary, characters: bigint, capitals: bigint, marks: bigint>"
_DOC_TYPE = pa.struct(
    [("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("characters", pa.int64()), ("capitals", pa.int64()), ("marks", pa.int64())]
)


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of some SHARD_BYTES each."""
    start, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if held and held + size > SHARD_BYTES:
            yield start, row
            start, held = row, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def _rows_of_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row starts, word numbers and counts of a matrix, and its words in the order of their numbers."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    rows = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    filled = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty string
    encoded = words.filter(filled).dictionary_encode()
    width = max(1, len(encoded.dictionary))
    cells, counts = np.unique(rows[filled.to_numpy(zero_copy_only=False)] * width + encoded.indices.to_numpy(), return_counts=True)
    starts = np.searchsorted(cells, np.arange(len(texts) + 1) * width)
    return starts, cells % width, counts, encoded.dictionary


def _characters(texts: pa.Array) -> list[np.ndarray]:
    """Code points, capitals A to Z and marks of each text."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    own = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    filled = np.flatnonzero(ends[1:] > ends[:-1])
    found = []
    for flags in ((own & 0xC0) != 0x80, (own >= 65) & (own <= 90), np.isin(own, np.frombuffer(MARKS, np.uint8))):
        counts = np.zeros(len(texts), np.int64)
        if len(filled):
            counts[filled] = np.add.reduceat(flags, ends[filled] - ends[0], dtype=np.int64)
        found.append(counts)
    return found


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(np.diff(values, prepend=0).astype("<i4").tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), "<i4"), dtype=np.int64)


def _shards(docs: DataFrame) -> DataFrame:
    """The texts in shards: documents, rows in the shard's own numbers, and its words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string())
            for start, stop in _slices(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
                own = batch.slice(start, stop - start)
                part = texts.slice(start, stop - start)
                starts, numbers, counts, words = _rows_of_words(part)
                characters = [pa.array(x, pa.int64()) for x in _characters(part)]
                described = pa.StructArray.from_arrays(
                    [own.column("doc_id"), own.column("part").cast(pa.string()), own.column("digest"), *characters], fields=list(_DOC_TYPE)
                )
                matrix = [pa.array([_packed(x)], pa.binary()) for x in (starts, numbers, counts)]
                yield pa.RecordBatch.from_arrays(
                    [_one_list(described), *matrix, _one_list(words.cast(pa.string()))], names=["docs", "starts", "numbers", "counts", "words"]
                )

    read_rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text_of("text"), 256)).alias("digest"),
        text_of("text").alias("text"),
    )
    made = read_rows.mapInArrow(read, f"docs array<{_DOC}>, starts binary, numbers binary, counts binary, words array<string>")
    return written(made.withColumn("shard", F.monotonically_increasing_id()), "shards")


def _numbered(shards: DataFrame) -> DataFrame:
    """The words of all shards numbered, one run of numbers per task.

    Rows either say for some words of a shard which numbers they have (shard, own, within the run) or list words of
    the dictionary in the order of their numbers (words, and the number of the first).
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last, known, waiting, waits = TaskContext.get().partitionId(), None, -1, [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            shard, own, within = (np.concatenate(x) for x in zip(*waiting))
            order = np.lexsort((own, shard))
            shard, own, within = shard[order], own[order], within[order]
            starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            for start, stop in zip(starts, [*starts[1:], len(shard)]):
                yield row(int(shard[start]), _packed(own[start:stop]), _packed(within[start:stop]), None, None)

        def row(shard, own, within, words, first) -> pa.RecordBatch:
            values = [run, shard, own, within, words, first]
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values[:4], kinds)] + [
                pa.nulls(1, kinds[4]) if words is None else _one_list(words), pa.array([first], kinds[5])
            ], names=["run", "shard", "own", "within", "words", "first"])

        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column("word").cast(pa.string())
            new = np.ones(len(words), bool)
            new[1:] = pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)
            new[0] = words[0].as_py() != last
            within, last = known + np.cumsum(new), words[-1].as_py()
            if new.any():
                yield row(None, None, None, words.filter(pa.array(new)), known + 1)
            known = int(within[-1])
            waiting.append((batch.column("shard").to_numpy(), batch.column("number").to_numpy().astype(np.int64), within))
            waits += len(within)
            if waits >= PACKED_WORDS:
                yield from packed()
                waiting, waits = [], 0
        if waits:
            yield from packed()

    words = shards.select("shard", F.posexplode("words").alias("number", "word")).select("word", "shard", "number")
    return words.repartition("word").sortWithinPartitions("word").mapInArrow(
        number, "run int, shard long, own binary, within binary, words array<string>, first long"
    )


def _matrix(docs: DataFrame, give, schema: str) -> tuple[DataFrame, DataFrame]:
    """What `give` makes of the shards (docs, starts, ids, counts), and the dictionary."""
    shards = _shards(docs)
    numbered = written(_numbered(shards), "numbered")
    # one row per task of that pass
    runs = numbered.where("first IS NOT NULL").groupBy("run").agg(F.max(F.col("first") + F.size("words")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = numbered.join(F.broadcast(runs.select("run", before.alias("before"))), "run")
    dictionary = placed.where("first IS NOT NULL").select((F.col("before") + F.col("first")).alias("from"), F.posexplode("words").alias("nth", "word"))

    def renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Of rows sorted by shard, numbers first: the shards with the numbers of the dictionary."""
        numbers: list[tuple] = []
        for batch in batches:
            for row in range(batch.num_rows):
                own = [batch.column(name)[row].as_py() for name in ("own", "within", "before", "starts", "numbers", "counts")]
                if own[0] is not None:
                    numbers.append((_unpacked(own[0]), _unpacked(own[1]) + own[2]))
                    continue
                to = np.empty(sum(len(x) for x, _ in numbers), np.int64)
                for x, ids in numbers:
                    to[x] = ids
                numbers = []
                yield batch.column("docs").slice(row, 1).flatten(), _unpacked(own[3]), to[_unpacked(own[4])], _unpacked(own[5])

    nothing = lambda kind: F.lit(None).cast(kind)
    numbers = placed.where("own IS NOT NULL").select(
        "shard", F.lit(0).alias("kind"), "own", "within", "before", nothing(f"array<{_DOC}>").alias("docs"),
        *[nothing("binary").alias(name) for name in ("starts", "numbers", "counts")],
    )
    own = shards.select(
        "shard", F.lit(1).alias("kind"), *[nothing("binary").alias(name) for name in ("own", "within")], nothing("long").alias("before"),
        "docs", "starts", "numbers", "counts",
    )
    together = numbers.unionByName(own).repartition("shard").sortWithinPartitions("shard", "kind")
    made = together.mapInArrow(lambda batches: (give(*shard) for shard in renumber(batches)), schema)
    return made, dictionary.select("word", (F.col("from") + F.col("nth")).alias("id"))


def document_term_matrix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The shards of the matrix and the dictionary (word, id; ids from 0 without gaps).

    A shard has its documents in row order (doc_id, part, digest of the text, characters, capitals, marks) and, as little-endian
    integers, the starts of its rows (32 bits; one more than rows), the word ids (64 bits) and the counts (32 bits).
    """

    def give(described, starts, ids, counts) -> pa.RecordBatch:
        arrays = [starts.astype("<i4"), ids.astype("<i8"), counts.astype("<i4")]
        columns = [_one_list(described), *[pa.array([x.tobytes()], pa.binary()) for x in arrays]]
        return pa.RecordBatch.from_arrays(columns, names=["docs", "starts", "ids", "counts"])

    return _matrix(docs, give, f"docs array<{_DOC}>, starts binary, ids binary, counts binary")


def row_statistics(docs: DataFrame) -> DataFrame:
    """A row per document: what its shard of the matrix says of it, n_words (its row's sum) and n_distinct (its nonzero entries)."""

    def give(described, starts, ids, counts) -> pa.RecordBatch:
        upto = np.r_[0, np.cumsum(counts)]
        entries = np.r_[0, np.cumsum(counts > 0)]
        sums, nonzero = (pa.array(x[starts[1:]] - x[starts[:-1]], pa.int64()) for x in (upto, entries))
        return pa.RecordBatch.from_arrays([*described.flatten(), sums, nonzero], names=[f.name for f in _DOC_TYPE] + ["n_words", "n_distinct"])

    schema = "doc_id bigint, part string, digest binary, characters bigint, capitals bigint, marks bigint, n_words bigint, n_distinct bigint"
    return _matrix(docs, give, schema)[0]


def _failed() -> Column:
    """Bits of the filters A to D that a document fails."""
    conditions = [
        F.col("n_words") < LEAST_WORDS,
        100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"),
        100 * F.col("capitals") > MOST_CAPITALS * F.col("characters"),
        F.col("marks") > 0,
    ]
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions)), F.lit(0)).cast("int")


def failed_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Columns part, failed (bits of A to E), n, good and toxic: documents of each part that fail exactly these filters."""
    statistics = row_statistics(docs)
    by_id = written(
        statistics.withColumn("failed", _failed()).groupBy("doc_id", "digest", "part", "failed").agg(F.count("*").alias("n")), "by_id"
    )
    is_one = lambda name: F.coalesce(F.max((F.col(name) == 1).cast("int")), F.lit(0)).alias(name)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(is_one("quality"), is_one("toxic"))
    named = by_id.filter("doc_id IS NOT NULL").join(known, "doc_id", "left").fillna(0, ["quality", "toxic"])
    unnamed = by_id.filter("doc_id IS NULL").select("*", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    # all rows of a text that are alike; those of its smallest id are no copies
    alike = written(
        named.unionByName(unnamed)
        .groupBy("digest", "part", "failed", "quality", "toxic")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without_id"),
            F.min("doc_id").alias("least"),
            F.min_by("n", "doc_id").alias("n_least"),
        ),
        "alike",
    )
    first = alike.groupBy("digest").agg(F.min("least").alias("first"))
    own = F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    copies = F.col("n") - F.col("without_id") - own
    counted = alike.join(first, "digest").withColumn("copies", copies).groupBy("part", "failed", "quality", "toxic").agg(
        F.sum(F.col("n") - F.col("copies")).alias("firsts"), F.sum("copies").alias("copies")
    )
    copy = 1 << LETTERS.index("E")
    split = F.explode(
        F.array(
            F.struct(F.col("failed").alias("set"), F.col("firsts").alias("m")),
            F.struct(F.col("failed").bitwiseOR(copy).alias("set"), F.col("copies").alias("m")),
        )
    )
    return (
        counted.withColumn("split", split)
        .groupBy("part", F.col("split.set").alias("failed"))
        .agg(
            F.sum("split.m").alias("n"),
            F.sum(F.when(F.col("quality") == 1, F.col("split.m")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic") == 1, F.col("split.m")).otherwise(0)).alias("toxic"),
        )
    )


def _steps() -> Column:
    """Every step of every order: its filter's bit and those of the filters before it."""
    steps = []
    for order in itertools.permutations(LETTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << LETTERS.index(letter)
            steps.append(f"named_struct('filter_order','{''.join(order)}','step',{step},'bit',{bit},'before',{before})")
            before |= bit
    return F.explode(F.expr(f"array({','.join(steps)})"))


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Columns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    # at most 32 sets a part
    parts = failed_sets(docs, labels).groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("sets"))
    bit, before = F.col("at.bit"), F.col("at.before")

    def total(condition, value) -> Column:
        return F.aggregate(
            F.filter("sets", condition), F.lit(0).cast("long"), lambda s, x: s + value(x)
        )

    fails = lambda x: x["failed"].bitwiseAND(bit) != 0
    reached = lambda x: x["failed"].bitwiseAND(before) == 0
    lost = lambda x: fails(x) & reached(x)
    # in all orders together each of the filters that a document fails comes first equally often
    orders = F.lit(120)
    return parts.select("part", "sets", _steps().alias("at")).select(
        "part",
        "at.filter_order",
        "at.step",
        total(lambda x: x["failed"].bitwiseAND(bit.bitwiseOR(before)) == 0, lambda x: x["n"]).alias("kept"),
        total(lost, lambda x: x["n"]).alias("removed"),
        total(lambda x: fails(x) & ~reached(x), lambda x: x["n"]).alias("redundant"),
        total(lambda x: x["failed"] == bit, lambda x: x["n"]).alias("unique_fails"),
        total(lost, lambda x: x["good"]).alias("good_lost"),
        total(lost, lambda x: x["toxic"]).alias("toxic_lost"),
        total(fails, lambda x: x["n"] * (orders / F.bit_count(x["failed"])).cast("long")).alias("shapley"),
    )
