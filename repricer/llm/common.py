"""What the operators share: tables in, shared scratch tables, text normalisation."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import string
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space and U+0009 to U+000D. Words are the maximal runs of anything else.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Documents in a small Arrow batch.
ARROW_ROWS = 1000
_GAP_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the sample."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="repricer-llm-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    Where the session names none and runs on this machine alone (tests), a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
    return _own_dir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Python passes that are planned inside get ARROW_ROWS rows at once at most: texts are large, and a worker holds two batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, small_batches: bool = False) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends here, and no later step computes them again."""
    path = new_path(df.sparkSession, name)
    with _small_batches(df.sparkSession) if small_batches else contextlib.nullcontext():
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Removes tables that `written` made. Only for tables of which all that is read again has itself been written since."""
    for df in tables:
        if path := getattr(df, "_written_at", None):
            jvm = df.sparkSession.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def released(run):
    """A pass over batches that gives back to the machine what it has used: a worker process outlives its tasks, and idle ones stay."""

    def passing(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return passing


def text_of(column: str | Column) -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_count(text: Column) -> Column:
    """Number of words of a non-null text."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def word_chars(text: Column) -> Column:
    """Code points in words of a non-null text."""
    return F.char_length(F.translate(text, _GAP_CHARS, "")).cast("long")


def unit(*columns: Column | str, seed: int) -> Column:
    """A uniform number in (0, 1) that only the values and the seed decide."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 12)
    return (bits.cast("double") + 0.5) / float(1 << 52)
