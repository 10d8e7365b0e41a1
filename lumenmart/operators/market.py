"""Market observations, exclusion reasons, snapshots and their confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumenmart.operators import dedupe, distribution
from lumenmart.session import broadcast_if_small, stage

# Exclusion reasons in order of precedence.
EXCLUSION_REASONS = (
    "OUTLIER", "MISSING_PRICE", "WRONG_CURRENCY", "PRODUCT_NOT_CONFIRMED", "SEVERE_DAMAGE",
    "DUPLICATE", "INSUFFICIENT_INFORMATION", "SEGMENT_MISMATCH", "LANDED_COST_UNKNOWN", "UNKNOWN",
)
UNKNOWN_CONDITIONS = ("unknown", "not specified")


MARKET_COLUMNS = (
    "listing_id", "url", "title", "source", "seller", "location", "price", "source_country", "observed_at", "evidence_count",
    "landed_cost_estimate", "statistical_price", "listing_quality", "excluded_reason", "foreign_without_landed",
)
# what is still read of a listing once its duplicates are known
ACCOUNT_COLUMNS = ("source_country", "observed_at", "listing_quality", "statistical_price", "excluded_reason", "foreign_without_landed")


def clamp(value: Column, low: int = 0, high: int = 100) -> Column:
    """Value held within bounds; null stays null (greatest and least would drop it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def half_even(value: Column) -> Column:
    """Round to a whole number, ties to the even neighbour."""
    return F.bround(value.cast("double"), 0).cast("int")


def condition_unknown(condition: Column) -> Column:
    folded = F.lower(F.trim(F.coalesce(condition, F.lit(""))))
    return (folded == "") | folded.isin(*UNKNOWN_CONDITIONS)


def with_quality(listings: DataFrame) -> DataFrame:
    """Add ``listing_quality`` (0..100); a listing without a price has none."""
    shortfall = lambda column, weight: F.coalesce(
        half_even((100 - clamp(F.col(column))) * F.lit(weight)), F.lit(int(weight * 100))
    )
    incomplete = F.exists(
        F.coalesce(F.col("defects"), F.array().cast("array<struct<category:string,description:string,severity:string,affected_component:string,source_text:string,confidence:double>>")),
        lambda d: (F.trim(d["description"]) == "") | (F.trim(d["affected_component"]) == "") | (F.trim(d["severity"]) == ""),
    )
    off = lambda flag, points: F.when(flag, points).otherwise(0)
    score = (
        F.lit(100)
        - shortfall("recognition_confidence", 0.20)
        - shortfall("description_confidence", 0.15)
        - off(condition_unknown(F.col("condition")), 15)
        - F.least(F.lit(20), 5 * F.size(F.coalesce("missing_information", F.array().cast("array<string>"))))
        - off(~F.coalesce("warranty_clear", F.lit(False)), 10)
        - off(~F.coalesce("accessories_complete", F.lit(False)), 5)
        - off(F.coalesce("contradictory", F.lit(False)), 25)
        - off(incomplete, 10)
    )
    priced = F.col("price").isNotNull() & (F.col("price") > 0)
    return listings.withColumn("listing_quality", F.when(priced, clamp(score)).otherwise(0))


def with_observation(listings: DataFrame, target_country: Column, currency: Column, segment: Column) -> DataFrame:
    """Add landed cost, statistical price, quality and the exclusion reason."""
    domestic = F.coalesce(F.lower("source_country") == F.lower(target_country), F.lit(False))
    landed = F.coalesce(F.col("landed_cost"), F.when(domestic, F.col("price")))
    severe = F.exists("defects", lambda d: d["severity"].isin("major", "critical"))
    rows = with_quality(listings).withColumn("landed_cost_estimate", landed)
    reason = (
        F.when(F.col("price").isNull() | (F.col("price") <= 0), "MISSING_PRICE")
        .when(F.lower("currency") != F.lower(currency), "WRONG_CURRENCY")
        .when(~F.col("recognized_product_id").eqNullSafe(F.col("product_id")), "PRODUCT_NOT_CONFIRMED")
        .when(F.col("segment").isNull(), "INSUFFICIENT_INFORMATION")
        .when(F.upper("segment") != segment, "SEGMENT_MISMATCH")
        .when(F.col("source_country").isNull(), "INSUFFICIENT_INFORMATION")
        .when(~domestic & F.col("landed_cost_estimate").isNull(), "LANDED_COST_UNKNOWN")
        .when(F.coalesce(severe, F.lit(False)), "SEVERE_DAMAGE")
    )
    return rows.withColumn("statistical_price", F.col("landed_cost_estimate")).withColumn(
        "excluded_reason", reason
    ).withColumn(
        "foreign_without_landed", F.col("source_country").isNotNull() & ~domestic & F.col("landed_cost_estimate").isNull()
    )


def mark_duplicates(rows: DataFrame, scope: Sequence[str]) -> DataFrame:
    """A duplicate loses whatever reason it had; winners keep theirs."""
    losers = stage(dedupe.duplicates(rows, scope).where("is_duplicate").select("listing_id").distinct()).withColumn("loses", F.lit(True))
    return (
        rows.join(broadcast_if_small(losers), "listing_id", "left")
        .withColumn("excluded_reason", F.when(F.col("loses"), F.lit("DUPLICATE")).otherwise(F.col("excluded_reason")))
        .drop("loses")
    )


def mark_outliers(rows: DataFrame, fences: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Set OUTLIER on included rows outside the fences of their group."""
    joined = rows.join(fences.select(*keys, "lower_fence", "upper_fence"), list(keys), "left")
    outside = (
        F.col("excluded_reason").isNull()
        & F.col("statistical_price").isNotNull()
        & ~distribution.within_fences(F.col("statistical_price"))
    )
    return joined.withColumn(
        "excluded_reason", F.when(outside, F.lit("OUTLIER")).otherwise(F.col("excluded_reason"))
    ).drop("lower_fence", "upper_fence")


def confidence_score(valid, total, outliers, eligible, quality_average, days) -> Column:
    """Market confidence from sample, quality, completeness, outliers and spread in time."""
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    spread = (
        F.when(days >= 21, 10).when(days >= 14, 7).when(days >= 7, 4).when(days > 0, 1).otherwise(0)
    )
    raw = (
        F.lit(40.0) * F.least(valid / F.lit(20.0), F.lit(1.0))
        + F.lit(25.0) * F.coalesce(quality_average, F.lit(0.0)) / 100
        + F.when(total > 0, F.lit(15.0) * valid / total).otherwise(0.0)
        + F.when(eligible > 0, F.lit(10.0) * (1 - share(outliers, eligible))).otherwise(0.0)
        + spread
    )
    return clamp(half_even(raw))


def accounting(rows: DataFrame, keys: Sequence[str], **latest: Column) -> DataFrame:
    """Sample counts, quality, confidence inputs and countries per group; ``latest``: maxima of columns by name.

    Listings are added up per group, country and day first, by aggregates of fixed width; sets are collected of the sums.
    """
    included = F.col("excluded_reason").isNull()
    outlier = F.col("excluded_reason") == "OUTLIER"
    sums = rows.groupBy(*keys, "source_country", F.to_date("observed_at").alias("day")).agg(
        F.count(F.lit(1)).alias("listings"),
        F.count_if(included).alias("included"),
        F.count_if(F.coalesce(outlier, F.lit(False))).alias("outliers"),
        F.sum("listing_quality").alias("quality"),
        F.count("listing_quality").alias("rated"),
        F.max(F.col("foreign_without_landed").cast("int")).alias("foreign"),
        *[column.alias(name) for name, column in latest.items()],
    )
    summary = sums.groupBy(*keys).agg(
        F.sum("listings").alias("sample_size"),
        F.sum("included").alias("included_rows"),
        F.sum("outliers").alias("outlier_count"),
        F.try_divide(F.sum("quality"), F.sum("rated")).alias("listing_quality_average"),
        F.array_sort(F.collect_set("source_country")).alias("source_countries"),
        F.max("foreign").alias("foreign_gap"),
        F.size(F.collect_set(F.when(F.col("included") > 0, F.col("day")))).cast("long").alias("distinct_days"),
        *[F.max(name).alias(name) for name in latest],
    )
    return (
        summary.withColumn(
            "market_confidence",
            confidence_score(
                F.col("included_rows"), F.col("sample_size"), F.col("outlier_count"),
                F.col("included_rows") + F.col("outlier_count"),
                F.col("listing_quality_average"), F.col("distinct_days"),
            ),
        )
        .withColumn(
            "foreign_cost_note",
            (F.size("source_countries") > 1) & (F.col("foreign_gap") == 1),
        )
        .drop("foreign_gap")
    )


def clean(rows: DataFrame, scope: Sequence[str], keys: Sequence[str], staged: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Duplicates then outliers. Returns (marked rows, ranked prices, fences).

    Each stage feeds several branches, so it is written once; only the columns the
    market needs are kept, and fewer of them once duplicates are marked. ``staged``: the rows are written already.
    """
    slim = rows.select(*dict.fromkeys([*scope, *keys, *MARKET_COLUMNS]))
    deduped = stage(mark_duplicates(slim if staged else stage(slim), scope).select(*dict.fromkeys([*keys, *ACCOUNT_COLUMNS])))
    ranked = stage(distribution.ranked_values(deduped.where("excluded_reason is null"), keys, "statistical_price"))
    fences = stage(distribution.iqr_fences(ranked, keys))
    return mark_outliers(deduped, fences, keys), ranked, fences


def snapshots(rows: DataFrame, keys: Sequence[str], created_at: Column, staged: bool = False) -> DataFrame:
    """One market snapshot per group; ``rows`` come from ``with_observation``, ``created_at`` is the maximum of a column; ``staged`` as in ``clean``."""
    keys = list(keys)
    marked, ranked, fences = clean(rows, keys, keys, staged)
    statistics = distribution.price_statistics(distribution.drop_outliers(ranked, fences, keys), keys)
    return (
        accounting(marked, keys, created_at=created_at)
        .join(statistics, keys, "left")
        .withColumn("valid_sample_size", F.coalesce("valid_sample_size", F.lit(0)))
    )


def sample_band(valid: Column) -> Column:
    """Label of how much a valid sample size can support."""
    return (
        F.when(valid <= 0, "none").when(valid == 1, "single offer").when(valid <= 4, "very limited")
        .when(valid <= 9, "limited").otherwise("sample")
    )


def price_band(valid: Column) -> Column:
    return F.when(valid == 1, "observed price").otherwise("market median")
