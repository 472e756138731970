"""Positions and running sums that never put a whole key into one task.

Rows are cut into ordered buckets. Bucket totals are aggregated with map-side combine, a window over the (small)
totals gives each bucket its offset, and the only window over rows runs inside one bucket. A key holding a third of
all rows is therefore spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _offsets(df: DataFrame, keys: list[str], amounts: dict[str, Column]) -> DataFrame:
    totals = df.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in amounts.items()])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_bucket").alias("_b"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in amounts],
    )


def running_sums(
    df: DataFrame, keys: list[str], order: list[Column], bucket: Column, amounts: dict[str, Column]
) -> DataFrame:
    """Add inclusive running sums of ``amounts`` within ``keys`` in ``order``.

    ``bucket`` must be monotone in ``order``; it decides how finely a key is spread.
    """
    rows = df.withColumn("_bucket", bucket)
    offsets = _offsets(rows, keys, amounts)
    match = [rows[k].eqNullSafe(offsets[f"_k_{k}"]) for k in keys] + [rows["_bucket"].eqNullSafe(offsets["_b"])]
    joined = rows.join(offsets, reduce(lambda a, b: a & b, match), "left")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for name, amount in amounts.items():
        joined = joined.withColumn(name, F.col(f"_before_{name}") + F.sum(amount).over(inside))
    return joined.select(*df.columns, *amounts)


def ordinals(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str = "ordinal") -> DataFrame:
    """Add the 1-based position of each row within ``keys``."""
    return running_sums(df, keys, order, bucket, {name: F.lit(1).cast("long")})


def floor_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], bucket: Column) -> DataFrame:
    """Per key: sorted[min(n-1, floor(p*n))] for each named probability, without collecting any group."""
    if not keys:
        return floor_percentiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs, bucket).drop("_all")
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = running_sums(counts, keys, [F.col(value)], bucket, {"_upto": F.col("_n")})
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    both = ranked.join(sizes, keys)
    target = {n: F.least(F.col("_size") - 1, F.floor(F.lit(p) * F.col("_size"))) for n, p in probs.items()}
    return both.groupBy(*keys).agg(
        *[F.min(F.when(F.col("_upto") > t, F.col(value))).alias(n) for n, t in target.items()]
    )
