"""Aggregates of what happened before each row, over several horizons of time, by key.

A key's rows are sorted once for all horizons. So that a key with a large share of all rows is not one task's, its time is
split into spans, and the rows that a span's first ones look back to are carried over from the spans before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spans are this many times the longest horizon: of a key's rows, one in so many is carried over.
SPANS = 4


def over_horizons(
    df: DataFrame, key: str, seconds: Column, horizons: dict[str, int], values: dict[str, tuple[str, Column]], *, span: int | None = None, spread: str | None = None
) -> DataFrame:
    """df with a column `value_horizon` for each of both: an aggregate (`count`, `sum`, `avg`, `min` or `max`) of a column over
    the key's rows from a horizon's seconds before a row to its time, rows of the same time included.

    A row without a time gets nulls and counts nowhere. span is the length in seconds of the parts that a key's rows are dealt to;
    spread names a column that gets the part.
    """
    longest = max(horizons.values())
    span = span or SPANS * (longest + 1)
    if span <= longest:
        raise ValueError("a span must be longer than the longest horizon")
    made = {f"{v}_{h}": (how, c, s) for v, (how, c) in values.items() for h, s in horizons.items()}
    timed = df.withColumns({"_t": seconds.cast("long"), **{f"_{v}": c for v, (_, c) in values.items()}})
    own = F.floor(F.col("_t") / span)
    # a row is needed where it stands, and in the next span if that begins within the longest horizon
    parts = F.when(F.pmod("_t", F.lit(span)) >= span - longest, F.array(own, own + 1)).otherwise(F.array(own))
    rows = timed.where("_t is not null").withColumn("_span", F.explode(parts))
    window = Window.partitionBy(key, "_span").orderBy("_t")
    every = rows.withColumns({n: F.call_function(how, F.col(f"_{n[: n.rindex('_')]}")).over(window.rangeBetween(-s, 0)) for n, (how, _, s) in made.items()})
    found = every.where(F.col("_span") == own)
    if spread:
        found = found.withColumn(spread, F.col("_span"))
    late = timed.where("_t is null").withColumns({n: F.lit(None).cast(found.schema[n].dataType) for n in made} | ({spread: F.lit(None).cast("long")} if spread else {}))
    return found.drop("_span").unionByName(late).drop("_t", *[f"_{v}" for v in values])
