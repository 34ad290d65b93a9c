"""All queries of the library's own operators, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans import dense, ensembles, files, learning, measures, rows, sampling, sequence, tabular, text
from sparkloom.plans.base import ORACLES, QUERIES, Query

MODULES = (tabular, text, sequence, sampling, learning, ensembles, measures, dense, files, rows)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character vocabulary by first occurrence, ids of fixed length and labels of all documents."""
    return text.content_to_id_char(spark, sf_dir)
