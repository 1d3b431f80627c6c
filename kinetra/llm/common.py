"""Helpers shared by the text operators: shared scratch tables, Arrow batches, word splitting."""

from __future__ import annotations

import ctypes
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts that a task holds as Python objects at once.
BATCH_ROWS = 256
#: How the folders of scratch tables begin.
PREFIX = "kinetra-"

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one on a local master."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


#: Tables written since each open ``scratch`` of this thread began, innermost last.
_OPEN = threading.local()


def _opened() -> list[dict[str, DataFrame]]:
    if not hasattr(_OPEN, "tables"):
        _OPEN.tables = []
    return _OPEN.tables


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts the lineage.

    A lost executor then costs the tasks that it ran, not the passes before them. ``scratch`` and ``dropped`` delete it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{PREFIX}{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _opened():
        _opened()[-1][path] = out
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete at its end the tables that ``materialize`` wrote meanwhile, but for those handed to the function it gives.

    These are what a lazy result still reads; they are passed on to the scratch around it, if there is one.
    """
    made: dict[str, DataFrame] = {}
    kept: list[DataFrame] = []
    _opened().append(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        # by identity: two empty ones are equal
        _opened()[:] = [x for x in _opened() if x is not made]
        for path, df in made.items():
            if not any(df is k for k in kept):
                _delete(spark, path)
            elif _opened():
                _opened()[-1][path] = df


def dropped(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that no later plan reads."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.rpartition("/")[2].startswith(PREFIX):
            _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """For jobs, not operators: Arrow batches of at most ``most`` bytes in this session, unless its user has set a size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, most)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows: few texts are Python objects at once.

    Spark itself bounds the bytes of a batch (``spark.sql.execution.arrow.maxBytesPerBatch``).
    """
    try:
        for b in batches:
            for i in range(0, max(b.num_rows, 1), rows):
                yield b.slice(i, rows)
    finally:
        give_back()


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers live on, and would hold the most that any task has needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn`` to every Arrow batch of ``df``, in pieces; a result of None gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in sliced(batches):
            out = fn(piece)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def batch(**columns: tuple[object, pa.DataType]) -> pa.RecordBatch:
    """A record batch from ``name=(values, type)``."""
    return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in columns.values()], names=list(columns))


def texts_of(rows: pa.RecordBatch, name: str = "text") -> list[str]:
    """A column of texts, null as empty."""
    return [x or "" for x in rows.column(name).to_pylist()]


def bytes_of(rows: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A column of texts as UTF-8, null as empty."""
    return [x or b"" for x in rows.column(name).cast(pa.binary()).to_pylist()]


def lower_words(text: bytes) -> list[bytes]:
    """Words of UTF-8 text with A-Z in lower case (bytes methods know ASCII only, as wanted)."""
    return text.lower().split()


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
