"""Tables that several passes read: written once, in the folder that driver and executors share, and deleted afterwards."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from sparkloom.sources.files import scratch


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def staged_at(df: DataFrame, *by: str) -> Iterator[str]:
    """Where df is, as Parquet, dealt to folders by the values of some columns, until the block ends."""
    path = scratch(df.sparkSession)
    try:
        df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
        yield path
    finally:
        delete(df.sparkSession, path)


@contextlib.contextmanager
def staged(df: DataFrame) -> Iterator[DataFrame]:
    """df, computed once, until the block ends; what reads it must have run by then."""
    schema = df.schema
    with staged_at(df) as path:
        yield df.sparkSession.read.schema(schema).parquet(path)
