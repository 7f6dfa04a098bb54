"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task holds as Python objects at once; a longer text stands alone, and is cut into pieces
#: wherever it is split into words.
CHUNK_BYTES = 1 << 19

_local: dict[str, str] = {}
#: Paths that each open `scratch` has stored, the innermost last.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt anew only if it has fewer partitions than the cluster has cores (one small file, say)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which driver and executors share. Where no such folder
    is set, a temporary one that goes with the process, on a local master only: on a cluster each executor would write to
    its own disk."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = tempfile.mkdtemp(prefix="marlstone-")
            atexit.register(shutil.rmtree, _local[context.applicationId], ignore_errors=True)
        folder = "file://" + _local[context.applicationId]
    return f"{folder}/marlstone-{context.applicationId}"


def store(df: DataFrame, lasting: bool = False) -> tuple[DataFrame, str]:
    """`df` written as Parquet to the shared folder and read again, and the path: cuts the lineage and outlives lost
    executors. A `lasting` table outlives the `scratch` it is stored in."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    open_ = _scratch.get()
    for held in (open_[:-1] if lasting else open_)[-1:]:
        held.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, lasting: bool = False) -> DataFrame:
    return store(df, lasting)[0]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was stored within it, but for lasting tables: what comes out must read those alone."""
    before, mine = _scratch.get(), []
    token = _scratch.set((*before, mine))
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in mine:
            delete(spark, path)


def small(df: DataFrame, most: int) -> DataFrame:
    """`df`, marked for broadcast if it has at most `most` rows; for stored tables of narrow rows, as they are counted."""
    return F.broadcast(df) if df.count() <= most else df


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's file system for it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear_stored(spark: SparkSession) -> None:
    """Deletes what this application's operators have stored; for when their results have been used."""
    delete(spark, shared_folder(spark))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `most` bytes of `text`; a longer row comes alone. Nothing is copied."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def pieces(text: bytes, most: int = CHUNK_BYTES) -> Iterator[bytes]:
    """`text` in slices of about `most` bytes that are cut at spaces only, so that no word is cut."""
    start = 0
    while len(text) - start > most and (stop := text.find(b" ", start + most)) >= 0:
        yield text[start:stop]
        start = stop
    yield text[start:] if start else text


def as_text(column: pa.Array) -> list[str]:
    """The texts of a string column; null is empty, bytes that aren't UTF-8 become U+FFFD."""
    try:
        return ["" if x is None else x for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [x.decode("utf-8", "replace") for x in as_bytes(column)]


def id_text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def fold(column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`."""
    return F.pmod(F.crc32(id_text(column).cast("binary")), F.lit(folds)).cast("int")


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each 64-bit value (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def set_columns(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    """`batch` with `added`; a column of the same name is replaced."""
    kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in added}
    return pa.RecordBatch.from_pydict(kept | added)


def set_aside(df: DataFrame, added: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """`df` with its own columns of the names `added` renamed, and the columns that bring the old names back."""
    taken = {c.lower() for c in df.columns}
    names = {}
    for c in df.columns:
        name = c
        while name.lower() in added or name != c and name.lower() in taken:
            name = f"_{name}"
        names[c] = name
    return df.withColumnsRenamed({c: n for c, n in names.items() if c != n}), [F.col(f"`{n}`").alias(c) for c, n in names.items()]
