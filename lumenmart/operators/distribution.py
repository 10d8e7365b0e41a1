"""Exact order statistics per group that stay distributed when one group is huge.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation
buffer. Here a group is cut into order-preserving value buckets first: equal
values collapse before any shuffle, only bucket totals (a bounded number per
group) meet in one window, and the fine ordering happens bucket by bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS_PER_E_FOLD = 512
_TINY = 1e-9
_SHIFT = 21 * BUCKETS_PER_E_FOLD


def value_bucket(value: Column) -> Column:
    """Monotone bucket number of a double; relative width about 0.2 percent."""
    magnitude = F.floor(F.log(F.abs(value)) * BUCKETS_PER_E_FOLD) + _SHIFT
    return F.when(F.abs(value) <= _TINY, F.lit(0)).otherwise(
        F.signum(value).cast("long") * magnitude
    ).cast("long")


def ranked_values(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per distinct value of a group: value, copies, before, total.

    ``before`` counts the smaller rows of the group, ``total`` all of them, so
    the value at rank k is the row with before <= k < before + copies.
    """
    keys = list(keys)
    cells = (
        rows.where(F.col(value).isNotNull())
        .select(*keys, F.col(value).cast("double").alias("value"))
        .withColumn("bucket", value_bucket(F.col("value")))
        .groupBy(*keys, "bucket", "value")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    in_bucket = Window.partitionBy(*keys, "bucket").orderBy("value")
    cells = cells.withColumn(
        "before_in_bucket",
        F.coalesce(
            F.sum("copies").over(in_bucket.rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    )
    totals = cells.groupBy(*keys, "bucket").agg(F.sum("copies").alias("bucket_copies"))
    by_group = Window.partitionBy(*keys)
    totals = totals.select(
        *keys,
        "bucket",
        F.coalesce(
            F.sum("bucket_copies").over(
                by_group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("before_bucket"),
        F.sum("bucket_copies").over(by_group).alias("total"),
    )
    joined = cells.alias("c").join(totals.alias("t"), _same([*keys, "bucket"]), "inner")
    return joined.select(
        *[F.col(f"c.{key}").alias(key) for key in keys],
        F.col("c.value"),
        F.col("c.copies"),
        (F.col("t.before_bucket") + F.col("c.before_in_bucket")).alias("before"),
        F.col("t.total"),
    )


def _same(keys: Sequence[str]) -> Column:
    """Null-safe equality of the keys of the frames aliased c and t."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"c.{key}").eqNullSafe(F.col(f"t.{key}"))
    return condition


def quantile(fraction: float, value="value", copies="copies", before="before", total="total") -> Column:
    """Aggregate: linearly interpolated quantile over ranked rows of a group."""
    rank = (F.col(total) - 1) * F.lit(float(fraction))
    covers = lambda at: (F.col(before) <= at) & (at < F.col(before) + F.col(copies))
    low = F.max(F.when(covers(F.floor(rank)), F.col(value)))
    high = F.max(F.when(covers(F.ceil(rank)), F.col(value)))
    weight = F.max(rank - F.floor(rank))
    return F.when(weight == 0, low).otherwise(low * (1 - weight) + high * weight)


def trimmed_mean(fraction: float = 0.10, value="value", copies="copies", before="before", total="total") -> Column:
    """Aggregate: mean after dropping floor(n * fraction) rows at each end."""
    cut = F.floor(F.col(total) * F.lit(float(fraction)))
    applied = F.when(cut * 2 >= F.col(total), F.lit(0)).otherwise(cut)
    kept = F.greatest(
        F.lit(0),
        F.least(F.col(before) + F.col(copies), F.col(total) - applied)
        - F.greatest(F.col(before), applied),
    )
    return F.sum(F.col(value) * kept) / F.sum(kept)


def price_statistics(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median, mean, trimmed mean, extremes, deviation, percentiles, volatility."""
    shift = F.col("value") - F.col("value_origin") if "value_origin" in ranked.columns else F.col("value")
    count = F.sum("copies")
    mean = F.sum(F.col("value") * F.col("copies")) / count
    shifted_mean = F.sum(shift * F.col("copies")) / count
    variance = F.sum(shift * shift * F.col("copies")) / count - shifted_mean * shifted_mean
    out = ranked.groupBy(*keys).agg(
        count.alias("valid_sample_size"),
        quantile(0.5).alias("median_price"),
        mean.alias("mean_price"),
        trimmed_mean().alias("trimmed_mean"),
        F.min("value").alias("lowest_price"),
        F.max("value").alias("highest_price"),
        F.sqrt(F.greatest(variance, F.lit(0.0))).alias("standard_deviation"),
        quantile(0.10).alias("percentile_10"),
        quantile(0.25).alias("percentile_25"),
        quantile(0.75).alias("percentile_75"),
        quantile(0.90).alias("percentile_90"),
    )
    return out.withColumn(
        "price_volatility",
        F.when(
            F.col("mean_price") > 0,
            F.col("standard_deviation") / F.col("mean_price") * 100,
        ),
    )


def iqr_fences(ranked: DataFrame, keys: Sequence[str], minimum_rows: int = 4, spread: float = 1.5) -> DataFrame:
    """Lower and upper outlier fence per group; null where the group is too small."""
    quartiles = ranked.groupBy(*keys).agg(
        F.max("total").alias("eligible"), quantile(0.25).alias("q1"), quantile(0.75).alias("q3")
    )
    enough = F.col("eligible") >= minimum_rows
    width = (F.col("q3") - F.col("q1")) * F.lit(spread)
    return quartiles.select(
        *keys,
        "eligible",
        "q1",
        F.when(enough, F.col("q1") - width).alias("lower_fence"),
        F.when(enough, F.col("q3") + width).alias("upper_fence"),
    )


def within_fences(value: Column) -> Column:
    """True where no fence applies or the value lies between the fences."""
    return F.col("lower_fence").isNull() | (
        (value >= F.col("lower_fence")) & (value <= F.col("upper_fence"))
    )


def drop_outliers(ranked: DataFrame, fences: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ranked rows inside the fences, re-ranked without sorting them again."""
    keys = list(keys)
    marked = ranked.join(fences, keys, "inner")
    inside = within_fences(F.col("value"))
    removed = marked.groupBy(*keys).agg(
        F.sum(F.when(F.col("value") < F.col("lower_fence"), F.col("copies")).otherwise(0)).alias("below"),
        F.sum(F.when(inside, F.col("copies")).otherwise(0)).alias("kept"),
    )
    return (
        marked.where(inside)
        .join(removed, keys, "inner")
        .select(
            *keys,
            "value",
            "copies",
            (F.col("before") - F.col("below")).alias("before"),
            F.col("kept").alias("total"),
            F.col("q1").alias("value_origin"),
        )
    )
