"""Strict backward as-of joins against a few reference streams, in buckets of time.

Each bucket is ordered by itself and gets, for each reference, the last observation of the buckets before it (the carry),
so that no task holds more than a bucket and no pair of event and observation is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strict_asof(timeline: DataFrame, references: dict[str, Column], price: str, order: list[str], width_ns: int, by_time: bool = False) -> DataFrame:
    """Adds for each reference a struct (the columns of ``order``, price) of its latest observation before each row, or null.

    ``order`` starts with the time and is a total order; a row is an observation of a reference where its condition holds.
    by_time asks for a strictly earlier time instead of a strictly earlier row, so that ties are never eligible.
    A row without a time stays, has no reference and is none.
    """
    time = order[0]
    body = F.struct(*order, price)
    rows = timeline.withColumn("__bucket", F.floor(F.col(time) / width_ns))
    for name, is_reference in references.items():
        rows = rows.withColumn(f"__ref_{name}", F.when(is_reference & F.col(time).isNotNull(), body))
    per = rows.groupBy("__bucket").agg(*[F.max(f"__ref_{n}").alias(f"__carry_{n}") for n in references])
    # one row a bucket of time
    until = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select("__bucket", *[F.max(f"__carry_{n}").over(until).alias(f"__carry_{n}") for n in references])
    w = Window.partitionBy("__bucket").orderBy(time).rangeBetween(Window.unboundedPreceding, -1) if by_time else Window.partitionBy("__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(carry, "__bucket", "left")
    for name in references:
        joined = joined.withColumn(name, F.coalesce(F.max(f"__ref_{name}").over(w), F.col(f"__carry_{name}")))
    return joined.drop("__bucket", *[f"__ref_{n}" for n in references], *[f"__carry_{n}" for n in references])


def aged(reference: Column, time: Column, max_age_ns: int, price: str, time_field: str) -> tuple[Column, Column]:
    """(price or null, failure: missing, stale or null) of an as-of struct; an age equal to the limit is fresh."""
    fresh = (time - reference[time_field]) <= max_age_ns
    return F.when(fresh, reference[price]), F.when(reference.isNull(), "missing").when(~fresh, "stale")
