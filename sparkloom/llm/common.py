"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows and bytes of text handled at once inside a task.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without one a local folder serves a local session; a cluster needs one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def short_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are no longer than SLICE_BYTES: plans that are returned run later, when a setting
    of this module's own jobs has gone. A lower bound of the user's stays. No result depends on it, only memory does."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(name)
    if not (now.rstrip("b").isdigit() and 0 < int(now.rstrip("b")) <= SLICE_BYTES):
        df.sparkSession.conf.set(name, str(SLICE_BYTES))
    return df


@contextlib.contextmanager
def own_settings(spark: SparkSession) -> Iterator[None]:
    """For jobs that run here: shuffle files go when a job has ended, as nothing reads them again, and Arrow batches are
    short. The session's settings come back afterwards."""
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(SLICE_BYTES)}
    before = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


@contextlib.contextmanager
def partitions(spark: SparkSession, least: int) -> Iterator[None]:
    """For jobs that run here: shuffles have at least so many partitions, of which Spark joins small ones again."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(int(before), least)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    schema = df.schema
    with own_settings(spark):
        df.write.parquet(path)
    table = spark.read.schema(schema).parquet(path)
    _paths[table] = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again; what reads them lazily must have run."""
    for table in tables:
        if path := _paths.pop(table, None):
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, in any case: results replace them."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def slices(batch: pa.RecordBatch, column: str, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with about SLICE_BYTES in a column of texts or bytes, and a bounded number of rows."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        seen = ends[start - 1] if start else 0
        stop = min(start + rows, int(np.searchsorted(ends, seen + SLICE_BYTES)) + 1, len(ends))
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[bytes | None]], dict[str, list]]],
    fields: list[T.StructField],
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds columns computed from slices of UTF-8 texts.

    make() runs once in each task and returns a function from a list of texts (bytes or None) to the new
    columns. keep names the columns returned beside them (all, by default); a column of df that has the name
    of a new one is replaced.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("binary").alias("_text_bytes"))
    schema = T.StructType([source.schema[i] for i in range(len(kept))] + fields)
    types = [to_arrow_type(f.dataType) for f in fields]
    width = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, "_text_bytes"):
                made = work(part.column(width).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(width)] + [pa.array(made[f.name], t) for f, t in zip(fields, types, strict=True)],
                    names=[*kept, *(f.name for f in fields)],
                )

    return short_batches(source).mapInArrow(run, schema)
