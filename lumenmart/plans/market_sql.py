"""SQL text shared by the twins of the market queries."""

from __future__ import annotations

from lumenmart.plans.derived import OBS_SQL, SEVERE_SQL, TARGET_COUNTRY

QUALITY_SQL = (
    "case when price is null or price <= 0 then 0 else greatest(0, least(100, 100 "
    "- cast(round_even((100 - recognition_confidence) * cast(0.20 as double), 0) as int) "
    "- cast(round_even((100 - description_confidence) * cast(0.15 as double), 0) as int) "
    "- case when condition = 'unknown' then 15 else 0 end - least(20, 5 * missing_count) "
    "- case when warranty_clear then 0 else 10 end - case when accessories_complete then 0 else 5 end "
    "- case when contradictory then 25 else 0 end)) end"
)


def rows_sql(currency: str = "currency", extra: str = "") -> str:
    """CTEs ``obs`` and ``rows`` with quality, landed cost and exclusion reason."""
    landed = f"coalesce(landed_cost, case when source_country = '{TARGET_COUNTRY}' then price end)"
    return (
        f"obs as materialized ({OBS_SQL}), rows as materialized (select *, {landed} as landed_cost_estimate, "
        f"{landed} as statistical_price, cast({QUALITY_SQL} as int) as listing_quality, "
        "case when price is null or price <= 0 then 'MISSING_PRICE' "
        f"when currency <> {currency} then 'WRONG_CURRENCY' "
        "when recognition_confidence < 75 then 'PRODUCT_NOT_CONFIRMED' "
        f"when {landed} is null then 'LANDED_COST_UNKNOWN' "
        f"when {SEVERE_SQL} then 'SEVERE_DAMAGE' end as excluded_reason{extra} from obs)"
    )


def dedupe_sql(scope: list[str]) -> str:
    """CTEs up to ``deduped`` (excluded_reason overridden) and ``grouped``."""
    same = " and ".join(f"a.{name} = b.{name}" for name in scope)
    return f"""
edges as materialized (
  select a.listing_id as x, b.listing_id as y from rows a join rows b on {same} and a.listing_id <> b.listing_id
  and (a.url = b.url
       or (a.title = b.title and a.price is not distinct from b.price and a.source = b.source)
       or (a.price is not distinct from b.price and a.location = b.location and a.seller = b.seller
           and abs(epoch(a.observed_at) - epoch(b.observed_at)) <= 2592000))),
reach(x, y) as (select x, y from edges union select r.x, e.y from reach r join edges e on r.y = e.x),
grouped as materialized (
  select listing_id, component, first_value(listing_id) over (partition by component order by
      case when landed_cost_estimate is not null then 0 else 1 end, listing_quality desc, evidence_count desc,
      observed_at, listing_id) as winner_id
  from rows join (select x, least(min(x), min(y)) as component from reach group by x) on listing_id = x),
deduped as materialized (
  select rows.* exclude (excluded_reason),
    case when winner_id is not null and winner_id <> rows.listing_id then 'DUPLICATE' else excluded_reason end as excluded_reason
  from rows left join grouped on rows.listing_id = grouped.listing_id)"""


def outlier_sql(keys: list[str], base: str) -> str:
    """CTEs ``fences`` and ``marked`` over the rows of ``base``."""
    k = ", ".join(keys)
    on = " and ".join(f"b.{name} = f.{name}" for name in keys)
    return f"""
quartiles as (select {k}, count(*) as n, quantile_cont(statistical_price, 0.25) as q1, quantile_cont(statistical_price, 0.75) as q3
  from {base} where excluded_reason is null and statistical_price is not null group by {k}),
fences as (select {k}, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from quartiles where n >= 4),
marked as materialized (select b.* exclude (excluded_reason), case when b.excluded_reason is null and f.lo is not null
    and (b.statistical_price < f.lo or b.statistical_price > f.hi) then 'OUTLIER' else b.excluded_reason end as excluded_reason
  from {base} b left join fences f on {on})"""


def confidence_sql() -> str:
    return (
        "cast(greatest(0, least(100, round_even(40 * least(count(*) filter (where excluded_reason is null) / cast(20 as double), 1) "
        "+ 25 * avg(listing_quality) / 100 + 15 * (count(*) filter (where excluded_reason is null)) / cast(count(*) as double) "
        "+ case when count(*) filter (where excluded_reason is null or excluded_reason = 'OUTLIER') > 0 then "
        "10 * (1 - (count(*) filter (where excluded_reason = 'OUTLIER')) / cast(count(*) filter (where excluded_reason is null or excluded_reason = 'OUTLIER') as double)) else 0 end "
        "+ case when count(distinct cast(observed_at as date)) filter (where excluded_reason is null) >= 21 then 10 "
        "when count(distinct cast(observed_at as date)) filter (where excluded_reason is null) >= 14 then 7 "
        "when count(distinct cast(observed_at as date)) filter (where excluded_reason is null) >= 7 then 4 "
        "when count(distinct cast(observed_at as date)) filter (where excluded_reason is null) >= 1 then 1 else 0 end, 0))) as int)"
    )


def statistics_sql(keys: list[str], base: str) -> str:
    """CTE ``stats``: price statistics of the included rows of ``base``."""
    k = ", ".join(keys)
    return f"""
ranked as (select {k}, statistical_price as v, row_number() over (partition by {k} order by statistical_price) as rn,
   count(*) over (partition by {k}) as n from {base} where excluded_reason is null and statistical_price is not null),
stats as materialized (select {k}, count(*) as valid_sample_size, quantile_cont(v, 0.5) as median_price, avg(v) as mean_price,
   avg(v) filter (where rn > floor(n * cast(0.1 as double)) and rn <= n - floor(n * cast(0.1 as double))) as trimmed_mean,
   min(v) as lowest_price, max(v) as highest_price, stddev_pop(v) as standard_deviation,
   quantile_cont(v, 0.10) as percentile_10, quantile_cont(v, 0.25) as percentile_25,
   quantile_cont(v, 0.75) as percentile_75, quantile_cont(v, 0.90) as percentile_90 from ranked group by {k})"""


def snapshot_sql(keys: list[str], created: str, extra: str = "") -> str:
    """CTEs ending in ``snap``: one market snapshot per group."""
    k = ", ".join(keys)
    return (
        rows_sql(extra=extra) + "," + dedupe_sql(keys) + "," + outlier_sql(keys, "deduped") + ","
        + statistics_sql(keys, "marked")
        + f""",
account as (select {k}, count(*) as sample_size, count(*) filter (where excluded_reason = 'OUTLIER') as outlier_count,
   avg(listing_quality) as listing_quality_average, array_to_string(list_sort(list(distinct source_country)), ',') as source_countries,
   {confidence_sql()} as market_confidence, {created} as created_at from marked group by {k}),
snap as materialized (select account.*, stats.* exclude ({k}, valid_sample_size), coalesce(stats.valid_sample_size, 0) as valid_sample_size
   from account left join stats on {' and '.join(f'account.{name} = stats.{name}' for name in keys)})"""
    )
