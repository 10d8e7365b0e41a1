"""Market queries over the observation view and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumenmart.operators import asof, dedupe, distribution, market
from lumenmart.plans import derived
from lumenmart.plans.market_sql import (
    confidence_sql, dedupe_sql, outlier_sql, rows_sql, snapshot_sql, statistics_sql,
)
from lumenmart.plans.registry import Tables, query
from lumenmart.session import stage

MARKET_KEYS = ["product_id", "currency", "segment"]
PRODUCT_SEGMENT = ["product_id", "segment"]
STATISTICS = [
    "median_price", "mean_price", "trimmed_mean", "lowest_price", "highest_price", "standard_deviation",
    "percentile_10", "percentile_25", "percentile_75", "percentile_90",
]


def observed_rows(tables: Tables, currency=None) -> DataFrame:
    """Observations with their exclusion reason; by default each row's own currency."""
    return market.with_observation(
        derived.observations(tables), F.lit(derived.TARGET_COUNTRY),
        F.col("currency") if currency is None else F.lit(currency), F.upper("segment"),
    )


def market_rows(tables: Tables) -> DataFrame:
    """The columns a market reads, written once for the snapshots of all time and of the months."""
    return tables.shared("market_rows", lambda t: observed_rows(t).select(*dict.fromkeys([*MARKET_KEYS, *market.MARKET_COLUMNS])))


def market_snapshots(tables: Tables) -> DataFrame:
    return market.snapshots(market_rows(tables), MARKET_KEYS, F.max("observed_at"), staged=True)


def monthly_snapshots(tables: Tables) -> DataFrame:
    rows = market_rows(tables).withColumn("month", F.date_trunc("month", F.col("observed_at").cast("timestamp")))
    return market.snapshots(rows, [*MARKET_KEYS, "month"], F.max("month"), staged=True)


def rounded(*names: str):
    return [F.round(F.col(name), 4).alias(name) for name in names]


def rounded_sql(names, prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{name}, 4) as {name}" for name in names)


_SNAPSHOT = snapshot_sql(MARKET_KEYS, "max(observed_at)")
_MONTHLY = snapshot_sql(MARKET_KEYS + ["month"], "max(month)", ", date_trunc('month', observed_at) as month")


@query(
    "market_snapshot",
    f"with recursive {_SNAPSHOT} select product_id, currency, segment, strftime(created_at, '%Y-%m-%d') as created_on, sample_size, "
    f"valid_sample_size, outlier_count, market_confidence, round(listing_quality_average, 4) as listing_quality_average, source_countries, "
    f"{rounded_sql(STATISTICS)}, round(case when mean_price > 0 then standard_deviation / mean_price * 100 end, 4) as price_volatility from snap",
)
def market_snapshot(tables: Tables) -> DataFrame:
    """One snapshot per product, currency and segment: clean, dedupe, outliers, statistics."""
    return market_snapshots(tables).select(
        *MARKET_KEYS, F.date_format("created_at", "yyyy-MM-dd").alias("created_on"),
        "sample_size", "valid_sample_size", "outlier_count", "market_confidence",
        *rounded("listing_quality_average"), F.array_join("source_countries", ",").alias("source_countries"),
        *rounded(*STATISTICS, "price_volatility"),
    )


@query(
    "price_statistics",
    f"with {rows_sql()}, {statistics_sql(PRODUCT_SEGMENT, 'rows')} select product_id, segment, valid_sample_size, {rounded_sql(STATISTICS)} from stats",
)
def price_statistics(tables: Tables) -> DataFrame:
    """Exact percentiles, mean and deviation of included prices per product and segment."""
    ranked = distribution.ranked_values(observed_rows(tables).where("excluded_reason is null"), PRODUCT_SEGMENT, "statistical_price")
    return distribution.price_statistics(ranked, PRODUCT_SEGMENT).select(*PRODUCT_SEGMENT, "valid_sample_size", *rounded(*STATISTICS))


@query(
    "trimmed_mean",
    f"with {rows_sql()}, {statistics_sql(['source', 'segment'], 'rows')} select source, segment, valid_sample_size, "
    "round(mean_price, 4) as mean_price, round(trimmed_mean, 4) as trimmed_mean from stats",
)
def trimmed_mean(tables: Tables) -> DataFrame:
    """Mean after cutting ten percent at each end, for the few very large source groups."""
    keys = ["source", "segment"]
    ranked = distribution.ranked_values(observed_rows(tables).where("excluded_reason is null"), keys, "statistical_price")
    return distribution.price_statistics(ranked, keys).select(*keys, "valid_sample_size", *rounded("mean_price", "trimmed_mean"))


@query(
    "iqr_outliers",
    f"with {rows_sql()}, {outlier_sql(PRODUCT_SEGMENT, 'rows')} select listing_id, product_id, segment, round(statistical_price, 4) as statistical_price "
    "from marked where excluded_reason = 'OUTLIER'",
)
def iqr_outliers(tables: Tables) -> DataFrame:
    """Included rows outside the quartile fences of their product and segment."""
    # only an included row can turn out an outlier; the rows are read twice, so they are written once
    rows = stage(observed_rows(tables).where("excluded_reason is null").select("listing_id", *PRODUCT_SEGMENT, "statistical_price", "excluded_reason"))
    ranked = distribution.ranked_values(rows, PRODUCT_SEGMENT, "statistical_price")
    marked = market.mark_outliers(rows, distribution.iqr_fences(ranked, PRODUCT_SEGMENT), PRODUCT_SEGMENT)
    return marked.where("excluded_reason = 'OUTLIER'").select("listing_id", *PRODUCT_SEGMENT, *rounded("statistical_price"))


@query(
    "exclusion_accounting",
    f"with {rows_sql(repr(derived.TARGET_CURRENCY))} select segment, coalesce(excluded_reason, 'VALID') as outcome, count(*) as listings, "
    "round(avg(listing_quality), 4) as quality_average from rows group by all",
)
def exclusion_accounting(tables: Tables) -> DataFrame:
    """Listings per exclusion reason against one target currency."""
    rows = observed_rows(tables, derived.TARGET_CURRENCY)
    return rows.groupBy("segment", F.coalesce("excluded_reason", F.lit("VALID")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("listings"), F.round(F.avg("listing_quality"), 4).alias("quality_average")
    )


@query(
    "market_confidence",
    f"with {rows_sql()}, {outlier_sql(PRODUCT_SEGMENT, 'rows')} select product_id, segment, {confidence_sql()} as market_confidence, "
    "count(distinct cast(observed_at as date)) filter (where excluded_reason is null) as distinct_days from marked group by all",
)
def market_confidence(tables: Tables) -> DataFrame:
    """Confidence of each market from sample size, quality, outliers and spread in time."""
    rows = stage(observed_rows(tables).select(*PRODUCT_SEGMENT, *market.ACCOUNT_COLUMNS))
    ranked = distribution.ranked_values(rows.where("excluded_reason is null"), PRODUCT_SEGMENT, "statistical_price")
    marked = market.mark_outliers(rows, distribution.iqr_fences(ranked, PRODUCT_SEGMENT), PRODUCT_SEGMENT)
    return market.accounting(marked, PRODUCT_SEGMENT).select(*PRODUCT_SEGMENT, "market_confidence", "distinct_days")


@query("listing_quality", f"with {rows_sql()} select listing_id, product_id, segment, listing_quality from rows")
def listing_quality(tables: Tables) -> DataFrame:
    """Quality score of every listing."""
    return observed_rows(tables).select("listing_id", *PRODUCT_SEGMENT, "listing_quality")


@query(
    "source_coverage",
    f"with {rows_sql()} select product_id, segment, array_to_string(list_sort(list(distinct source_country)), ',') as source_countries, "
    "round(avg(listing_quality), 4) as quality_average, count(distinct source_country) > 1 and "
    f"count(*) filter (where source_country <> '{derived.TARGET_COUNTRY}' and landed_cost_estimate is null) > 0 as foreign_cost_note from rows group by all",
)
def source_coverage(tables: Tables) -> DataFrame:
    """Countries seen per market and whether foreign costs are still unknown."""
    return market.accounting(observed_rows(tables), PRODUCT_SEGMENT).select(
        *PRODUCT_SEGMENT, F.array_join("source_countries", ",").alias("source_countries"),
        F.round("listing_quality_average", 4).alias("quality_average"), "foreign_cost_note",
    )


@query(
    "near_duplicates",
    f"with recursive {rows_sql()}, {dedupe_sql(['product_id'])} select listing_id, winner_id, listing_id <> winner_id as is_duplicate from grouped",
)
def near_duplicates(tables: Tables) -> DataFrame:
    """Transitive near-duplicate groups of each product with their winning listing."""
    rows = stage(observed_rows(tables).select("product_id", *market.MARKET_COLUMNS))
    return dedupe.duplicates(rows, ["product_id"]).select("listing_id", "winner_id", "is_duplicate")


def _history_sql(horizons) -> str:
    parts = []
    for name, days, tolerance, both in horizons:
        change = "(1 - c.median_price / h.median_price) * 100" if both else "(c.median_price / h.median_price - 1) * 100"
        after = f"h.created_at < target + interval {tolerance + 1} day" if both else "h.created_at <= target"
        parts.append(
            f"select c.product_id, c.currency, c.segment, c.created_at, '{name}' as horizon, "
            f"min_by({change}, row(abs(epoch(h.created_at) - epoch(target)), epoch(h.created_at))) as change "
            f"from (select *, created_at - interval {days} day as target from usable) c join usable h "
            "on c.product_id = h.product_id and c.currency = h.currency and c.segment = h.segment "
            f"and h.created_at >= target - interval {tolerance} day and {after} group by all"
        )
    return f"usable as (select * from snap where market_confidence >= 40 and median_price > 0), found as ({' union all '.join(parts)})"


def _history_query(tables: Tables, horizons) -> DataFrame:
    snapshots = stage(monthly_snapshots(tables).select(*MARKET_KEYS, "created_at", "median_price", "market_confidence"))
    wide = asof.with_history(snapshots, snapshots, MARKET_KEYS, horizons)
    names = [name for name, *_ in horizons]
    return wide.where(F.coalesce(*names).isNotNull()).select(
        *MARKET_KEYS, F.date_format("created_at", "yyyy-MM-dd").alias("created_on"), *rounded(*names)
    )


def _history_oracle(horizons) -> str:
    names = ", ".join(f"round(max(change) filter (where horizon = '{name}'), 4) as {name}" for name, *_ in horizons)
    return (
        f"with recursive {_MONTHLY}, {_history_sql(horizons)} select product_id, currency, segment, "
        f"strftime(created_at, '%Y-%m-%d') as created_on, {names} from found group by product_id, currency, segment, created_at"
    )


@query("trend_asof", _history_oracle(asof.TREND_HORIZONS))
def trend_asof(tables: Tables) -> DataFrame:
    """Price change of monthly snapshots against the nearest earlier one."""
    return _history_query(tables, asof.TREND_HORIZONS)


@query("depreciation_nearest", _history_oracle(asof.DEPRECIATION_HORIZONS))
def depreciation_nearest(tables: Tables) -> DataFrame:
    """Yearly value loss of monthly snapshots against the nearest one around the target."""
    return _history_query(tables, asof.DEPRECIATION_HORIZONS)
