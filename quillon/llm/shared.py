"""What the corpus operators share: scratch tables, text blocks, hashed splits."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Most bytes of a batch that is handed to Python, but for a single longer row.
BATCH_BYTES = 6 << 20
_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary folder where it is unset on one machine."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    if sc.applicationId not in _local_roots:
        _local_roots[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _local_roots[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/quillon/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting name is value within."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def shuffles_removed(spark: SparkSession) -> AbstractContextManager[None]:
    """Writes within remove their shuffle files when they end, rather than when the driver next collects garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def discard(df: DataFrame) -> None:
    """Remove the files of a table that materialise() wrote, once nothing that is still to run reads them."""
    for folder in {path.rpartition("/")[0] for path in df.inputFiles()}:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows; df should be materialised, as its rows are counted."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of at most BATCH_BYTES: a batch of Spark's 10,000 rows holds any amount of text.

    The bound is a setting of the session, read when a plan runs; a smaller one stays.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < byte_count(conf.get(name)) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    """Return freed memory to the system: Spark's Python workers outlive their tasks, and idle ones keep what they once took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def byte_count(size: str) -> int:
    """Bytes of a setting such as 6m or 4096; without a unit it counts bytes."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", size.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def unused(name: str, columns: list[str]) -> str:
    """name, lengthened until no column is called so in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def gathered(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches joined up to about max_bytes of text each, so that what is made once a block is made less often."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pa.compute.sum(pa.compute.binary_length(batch.column(column))).as_py() or 0
        if size >= max_bytes:
            yield joined(held)
            held, size = [], 0
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch of the rows of several."""
    return batches[0] if len(batches) == 1 else pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(i) for b in batches]) for i in range(batches[0].num_columns)], batches[0].schema.names)


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % divisor


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of about max_bytes of text, of even size within a batch; a row goes where its middle falls."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = int(sizes.sum())
        share = max(1.0, total / max(1, round(total / max_bytes)))
        run = ((np.cumsum(sizes) - sizes / 2) // share).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)
