"""Packing of tokenised documents by minimum bin slack.

A document is its token ids and an end mark. Documents of more than `capacity` ids are cut, the first
piece taking the remainder. Pieces of one length are interchangeable, so the packing is worked out
on the number of pieces of each length (at most `capacity` numbers): a bin starts with the longest
piece left, a subset-sum over the lengths left, held as the bits of an integer, finds the fullest
way to fill it, and that combination is used as often as its lengths allow before the next search.
Then each piece takes the place that its rank among the pieces of its length has in that plan.

Nulls count as empty texts, which are one end mark. Repeated rows are packed each by itself; which
of equal rows gets which place is left open. An empty table gives no rows. Only `doc_id` and `text`
are read.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repricer.llm.common import released, written

CAPACITY = 1024
END = 2
VOCABULARY = "byte_bpe_50k"
#: Chunks of text that a worker remembers the ids of.
_REMEMBERED = 300_000


class ChunkTokenizer:
    """Token ids of texts as bytes (little-endian, 32 bits each).

    The vocabulary's splitting rule never joins what a single space divides, so a text is split at
    single spaces, and each chunk's ids are looked up or found once. Chunks are encoded with the rank
    file, which gives the same ids as the tokenizer file; texts that may hold a special token, and those with
    white space before a space, are encoded whole, the former by the tokenizer file.
    """

    _WIDE = re.compile(r"\s ")

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self._ranks = tiktoken.Encoding(
            vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self._file = public_tokenizers.path(f"{vocabulary}.json")
        self._known: dict[str, bytes] = {}

    @functools.cached_property
    def _special(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._file)

    def _encode(self, text: str) -> bytes:
        return array("I", self._ranks.encode_ordinary(text)).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        ids = self._encode(f" {chunk}")
        if len(chunk) <= 40:
            if len(self._known) >= _REMEMBERED:
                self._known.clear()
            self._known[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if "<|" in text:
            return array("I", self._special.encode(text, add_special_tokens=False).ids).tobytes()
        if self._WIDE.search(text):
            return self._encode(text)
        first, *chunks = text.split(" ")
        known, find = self._known.get, self._chunk
        return b"".join([self._encode(first), *[known(chunk) or find(chunk) for chunk in chunks]])


def cut(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and length of each piece of a document."""
    start, size = 0, length % capacity or capacity
    while start < length:
        yield start, min(size, length)
        start, size = start + size, capacity


@functools.cache
def _tokenizer(vocabulary: str) -> ChunkTokenizer:
    return ChunkTokenizer(vocabulary)


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str = VOCABULARY, with_ids: bool = False
) -> DataFrame:
    """Columns doc_id, piece, start, length, ids_crc32 and, if asked for, the ids themselves."""
    mark = array("I", [end]).tobytes()

    def cut_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = tokenizer.ids(text or "") + mark
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    row = (doc_id, piece, start, length, zlib.crc32(own))
                    rows.append((*row, np.frombuffer(own, "<i4")) if with_ids else row)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
            frame = pd.DataFrame(rows, columns=names)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(released(cut_all), schema)


def fullest(left: dict[int, int], room: int) -> list[int]:
    """The lengths, out of those left and as often as they are left, whose sum is the largest up to `room`."""
    mask, reached = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # length, how many at once, the sums reached before
    for length in sorted((x for x in left if x <= room), reverse=True):
        many = min(left[length], room // length)
        at_once = 1
        while many and not reached >> room:
            at_once = min(at_once, many)
            steps.append((length, at_once, reached))
            reached |= (reached << (length * at_once)) & mask
            many, at_once = many - at_once, 2 * at_once
        if reached >> room:
            break
    total, taken = reached.bit_length() - 1, []
    for length, at_once, before in reversed(steps):
        if not before >> total & 1:
            taken += [length] * at_once
            total -= length * at_once
    return taken


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Combinations of lengths, and how many bins each fills, that use up all pieces."""
    left = {length: n for length, n in counts.items() if n > 0}
    bins = []
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = fullest({length: n for length, n in left.items() if n}, capacity - longest)
        left[longest] += 1
        combination = [longest, *rest]
        needed = Counter(combination)
        times = min(left[length] // n for length, n in needed.items())
        bins.append((combination, times))
        for length, n in needed.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return bins


def _places(bins: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """For runs of ranks of one length: key (length and first rank), first sequence and offset."""
    used: Counter[int] = Counter()
    runs, sequence = [], 0
    for combination, times in bins:
        offset = 0
        for length in combination:
            runs.append((length << 44 | used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    runs.sort()
    return tuple(np.array(column, dtype=np.int64) for column in zip(*runs)) if runs else (np.empty(0, np.int64),) * 3


def placed(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. Pieces must come from a table, as they are read twice."""
    spark = cut_pieces.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    # a length may be that of a third of all pieces: each is ranked in parts, and parts are added up
    salted = cut_pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    parts = salted.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "parts")
    # one row per length
    counts = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    held = spark.sparkContext.broadcast(_places(plan(counts, capacity)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        keys, sequences, starts = held.value
        wanted = (lengths.to_numpy(np.int64) << 44) | ranks.to_numpy(np.int64)
        run = np.searchsorted(keys, wanted, side="right") - 1
        return pd.DataFrame({"sequence_id": sequences[run] + wanted - keys[run], "offset": starts[run]})

    within = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1)
    return (
        ranked.join(offsets.drop("_n"), ["length", "_part"])
        .withColumn("_place", place("length", F.col("_before") + F.col("_rank")))
        .select(*cut_pieces.columns, "_place.sequence_id", "_place.offset")
    )


def packed(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with the sequence and offset at which each is placed."""
    return placed(written(pieces(docs, capacity, end, vocabulary, with_ids), "pieces", small_batches=True), capacity)
