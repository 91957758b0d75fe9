"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the normalised text. A batch is
reduced to one row per digest, the digests already known are removed by a sort-merge anti-join
that reads the index in place (its buckets need no shuffle), and the rest is appended.

Nulls count as empty texts, so all null and empty texts are one group. Rows with a null doc_id
rank below all others. Of rows with the same doc_id and text exactly one stays. An empty batch
appends nothing. Only `doc_id` and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repricer.llm.common import ascii_lower, new_path, text_of, written

#: Rows of one text are counted in so many parts, so that a hot text is no single task.
SALTS = 64


def digest(text: str | Column) -> Column:
    """SHA-256 of the text with A to Z lower-cased, in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(ascii_lower(text_of(text)), 256))


@dataclass(frozen=True)
class DigestIndex:
    """A digest index at a path in shared storage; opening a path again finds what was appended."""

    spark: SparkSession
    path: str
    buckets: int = 32

    @property
    def name(self) -> str:
        return "llm_digests_" + hashlib.md5(self.path.encode()).hexdigest()

    def table(self) -> DataFrame:
        """Columns digest, keep_id and group_size (rows of the text in the batch that brought it)."""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT)"
            f" USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
            f" LOCATION '{self.path}'"
        )
        return self.spark.table(self.name)

    def add(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """Appends the batch's new texts and returns one decision per row of the batch.

        Columns: doc_id, digest, keep_id (of the row that holds the text in the index), group_size
        (rows of the batch with the text) and kept. Of new texts the row with the largest doc_id is
        kept; of texts that the index knew no row is. Adding the same batch again keeps nothing.
        """
        rows = written(
            docs.select(F.col(id_column).cast("long").alias("doc_id"), digest(text_column).alias("digest"))
            .withColumn("row", F.monotonically_increasing_id())
            .withColumn("salt", F.pmod(F.xxhash64("doc_id", "row"), F.lit(SALTS)).cast("int")),
            "digests",
        )
        parts = rows.groupBy("digest", "salt").agg(
            F.max(F.struct("doc_id", "row")).alias("last"), F.count("*").alias("n")
        )
        # a table, as the joins must see one row per text: Spark would move them below the sums, to every row
        parts = written(parts, "parts")
        groups = written(parts.groupBy("digest").agg(F.max("last").alias("last"), F.sum("n").alias("group_size")), "groups")
        # written before the append, as the anti-join must see the index as it was
        fresh = written(groups.hint("merge").join(self.table().select("digest"), "digest", "left_anti"), "fresh")
        fresh.select("digest", F.col("last.doc_id").alias("keep_id"), "group_size").repartition(
            self.buckets, "digest"
        ).write.insertInto(self.name)
        verdict = groups.select("digest", "group_size").join(
            self.table().select("digest", "keep_id").hint("merge"), "digest"
        ).join(fresh.select("digest", F.col("last.row").alias("keep_row")), "digest", "left")
        # one row per text and part, so that rows of a hot text meet it in many tasks
        dealt = parts.select("digest", "salt").join(verdict, "digest")
        return rows.join(dealt, ["digest", "salt"]).select(
            "doc_id",
            "digest",
            "keep_id",
            "group_size",
            F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        )


def open_index(spark: SparkSession, path: str | None = None, buckets: int | None = None) -> DigestIndex:
    """The index at a path, or a new one in the shared folder.

    `buckets` belongs to the index and has to be the same each time; about 128 MB of digests per bucket are right.
    """
    n = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    return DigestIndex(spark, path or new_path(spark, "digest-index"), n)


def distinct_documents(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows whose texts are new to the index (to a fresh one by default), one per text, all columns kept."""
    index = index or open_index(docs.sparkSession)
    decided = index.add(docs).groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    kept = written(decided.filter("kept").select("doc_id", "digest", "rows"), "kept")
    # the row as one value, whatever its columns are called; whole rows are sent once, and never sorted
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), digest("text").alias("digest"), F.struct("*").alias("doc"))
    same = F.col("id").eqNullSafe(F.col("k.doc_id")) & (F.col("r.digest") == F.col("k.digest"))
    of = lambda keys: rows.alias("r").join(keys.alias("k").hint("shuffle_hash"), same, "left_semi")
    chosen, several = of(kept.filter("rows = 1")), kept.filter("rows > 1")
    if not several.isEmpty():
        chosen = chosen.unionByName(of(several).dropDuplicates(["id", "digest"]))
    return chosen.select("doc.*")
