"""Ingest, watch, alert and health queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumenmart.operators import health, listings, notify
from lumenmart.plans import derived
from lumenmart.plans.derived import DUCK_HEALTH, OBS_SQL, WATCH_SQL
from lumenmart.plans.registry import Tables, query
from lumenmart.session import stage

NEW_SINCE = "2000-01-01"
STALE_AT = "2001-06-30"
STALE_AFTER = 365

_WATCHES_SQL = f"watches as materialized (select watch_id, product_id, max_price, currency from ({WATCH_SQL}) where active)"
_QUERIES_SQL = "queries as materialized (select concat('name-', p_name) as watch_id, p_name as query, round(avg(p_retailprice), 2) as max_price from part group by p_name)"
_PAIRS_SQL = (
    "pairs as materialized (select distinct listing_id, watch_id, max_price, w.currency as watch_currency from obs join watches w on obs.product_id = w.product_id "
    "union all select distinct listing_id, watch_id, max_price, 'EUR' from obs join queries on contains(lower(title), lower(query)))"
)


def all_watches(tables: Tables) -> DataFrame:
    """Product watches from open orders and one text watch per part name."""
    columns = ["watch_id", "product_id", "query", "source_ids", "max_price", "currency", "active"]
    empty = F.array().cast("array<string>")
    by_product = derived.watches(tables).select(
        "watch_id", "product_id", F.lit(None).cast("string").alias("query"), empty.alias("source_ids"), "max_price", "currency", "active")
    by_text = tables.part.groupBy("p_name").agg(F.round(F.avg("p_retailprice"), 2).alias("max_price")).select(
        F.concat(F.lit("name-"), F.col("p_name")).alias("watch_id"), F.lit(None).cast("string").alias("product_id"), F.col("p_name").alias("query"),
        empty.alias("source_ids"), "max_price", F.lit("EUR").alias("currency"), F.lit(True).alias("active"))
    return by_product.select(*columns).unionByName(by_text.select(*columns))


@query("watch_matches", f"with obs as ({OBS_SQL}), {_WATCHES_SQL}, {_QUERIES_SQL}, {_PAIRS_SQL} select listing_id, watch_id from pairs")
def watch_matches(tables: Tables) -> DataFrame:
    """Every listing with the watches it satisfies, by product or by title text."""
    pairs = listings.watch_pairs(derived.observations(tables), all_watches(tables), F.col("title"))
    return pairs.select("listing_id", F.col("watch.watch_id").alias("watch_id"))


@query(
    "price_alerts",
    f"""with obs as ({OBS_SQL}), {_WATCHES_SQL}, {_QUERIES_SQL}, {_PAIRS_SQL},
rows as (select obs.*, watch_id, pairs.max_price, watch_currency from obs join pairs on obs.listing_id = pairs.listing_id
  where recognition_confidence >= 75 and observed_at >= timestamp '{NEW_SINCE}'),
alerts as (select listing_id, 'NEW_MATCH' as notification_type, 'NOTICE' as severity, concat_ws(':', 'NEW_MATCH', listing_id, watch_id) as deduplication_key, segment from rows
  union all select listing_id, 'HIGH_CONFIDENCE_MATCH', 'IMPORTANT', concat_ws(':', 'HIGH_CONFIDENCE_MATCH', listing_id, watch_id), segment from rows where recognition_confidence >= 90 and description_confidence >= 80
  union all select listing_id, 'PRICE_BELOW_TARGET', 'IMPORTANT', concat_ws(':', 'PRICE_BELOW_TARGET', listing_id, watch_id, watch_currency, format('{{:.2f}}', max_price)), segment from rows where price <= max_price and currency = watch_currency)
select listing_id, notification_type, severity, deduplication_key from alerts where not (segment = 'NEW' and notification_type = 'NEW_MATCH')""",
)
def price_alerts(tables: Tables) -> DataFrame:
    """Alerts of listings new since a date that were not sent before."""
    observed = derived.observations(tables).withColumn("active", F.lit(True)).withColumn("warnings", F.array().cast("array<string>"))
    known = observed.where(F.col("observed_at") < F.lit(NEW_SINCE).cast("timestamp_ntz"))
    # read by both kinds of watches, by the alerts and by what was sent: joined once, in the columns they read
    fresh = stage(listings.new_since(observed, known).select(
        "listing_id", "source", "product_id", "title", "segment", "price", "currency", "recognition_confidence", "description_confidence", "active", "warnings"))
    pairs = listings.watch_pairs(fresh, all_watches(tables), F.col("title"))
    candidates = stage(notify.listing_alerts(fresh, pairs, notify.Preference(high_confidence_match=True)))
    sent = candidates.join(fresh.where("segment = 'NEW'").select("listing_id"), "listing_id", "left_semi").where(
        "notification_type = 'NEW_MATCH'").select("deduplication_key")
    return notify.fresh(candidates, sent).select("listing_id", "notification_type", "severity", "deduplication_key")


@query(
    "stale_listings",
    f"with obs as ({OBS_SQL}) select source, segment, count(*) filter (where observed_at >= timestamp '{STALE_AT}' - interval {STALE_AFTER} day) as active, "
    f"count(*) filter (where observed_at < timestamp '{STALE_AT}' - interval {STALE_AFTER} day) as stale from obs group by all",
)
def stale_listings(tables: Tables) -> DataFrame:
    """Listings not seen for too long, per source and segment."""
    seen = derived.observations(tables).select("source", "segment", F.col("observed_at").cast("timestamp").alias("last_seen_at"), F.lit(True).alias("active"))
    expired = listings.expire(seen, F.lit(STALE_AT).cast("timestamp"), STALE_AFTER)
    return expired.groupBy("source", "segment").agg(F.count_if("active").alias("active"), F.count_if(~F.col("active")).alias("stale"))


FEED_SPLIT = "2024-01-16"
UPSERT_SQL = (
    "with records as (select concat(event_type, ':', cast(user_id as varchar)) as duplicate_key, ts, event_id, value from events) "
    "select duplicate_key, cast(arg_min(event_id, row(ts, event_id)) as varchar) as listing_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_seen, "
    "strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_seen, arg_max(value, row(ts, event_id)) as price from records group by duplicate_key"
)


def feed_records(events: DataFrame) -> DataFrame:
    """Events as feed records: the type is the source, the user its external id."""
    external, empty = F.col("user_id").cast("string"), F.lit("")
    return events.select(
        listings.duplicate_key(F.col("event_type"), external, empty, empty, F.col("value")).alias("duplicate_key"),
        F.col("event_id").cast("string").alias("record_id"), F.col("ts").cast("timestamp").alias("seen_at"), "event_id", F.col("value").alias("price"))


def collapsed(records: DataFrame) -> DataFrame:
    rows = listings.collapse(records, "seen_at", "event_id")
    return rows.select("duplicate_key", F.col("first_record").cast("string").alias("listing_id"), "first_seen_at", "last_seen_at", "price")


def upsert_view(rows: DataFrame) -> DataFrame:
    stamp = lambda name: F.date_format(name, "yyyy-MM-dd HH:mm:ss")
    return rows.select("duplicate_key", "listing_id", stamp("first_seen_at").alias("first_seen"), stamp("last_seen_at").alias("last_seen"), "price")


@query("listing_upsert", UPSERT_SQL)
def listing_upsert(tables: Tables) -> DataFrame:
    """Second half of the feed merged into the stored first half."""
    records = feed_records(tables.events)
    split = F.lit(FEED_SPLIT).cast("timestamp")
    stored = collapsed(records.where(F.col("seen_at") < split))
    return upsert_view(listings.upsert(stored, collapsed(records.where(F.col("seen_at") >= split))))


_ORDERED = "partition by source_id order by checked_at, event_id"


def checks(tables: Tables) -> DataFrame:
    return derived.source_health(tables).withColumnRenamed("event_id", "check_id")


@query(
    "health_streaks",
    f"""with h as (select *, sum(case when status <> 'FAILED' then 1 else 0 end) over ({_ORDERED} rows unbounded preceding) as block from ({DUCK_HEALTH}))
select event_id as check_id, source_id, status, cast(sum(case when status = 'FAILED' then 1 else 0 end) over (partition by source_id, block order by checked_at, event_id rows unbounded preceding) as bigint) as consecutive_failures,
  strftime(max(case when status <> 'FAILED' then checked_at end) over ({_ORDERED} rows unbounded preceding), '%Y-%m-%d %H:%M:%S') as last_success,
  lag(status) over ({_ORDERED}) as previous_status,
  case when status <> 'FAILED' and result_count = 0 and lag(result_count) over ({_ORDERED}) > 0 then 'empty_results' when status <> 'FAILED' and response_time_ms > 0.8 * 300 then 'slow_response' end as degradation from h""",
)
def health_streaks(tables: Tables) -> DataFrame:
    """Failure streak, last success, transition and hidden degradation at every check."""
    return health.streaks(checks(tables)).select(
        "check_id", "source_id", "status", F.col("consecutive_failures").cast("long").alias("consecutive_failures"),
        F.date_format("last_success_at", "yyyy-MM-dd HH:mm:ss").alias("last_success"), "previous_status", health.quality_of_response(300).alias("degradation"))


_PROBLEM_CASE = "case event_type when 'error' then 'timeout' when 'signup' then case when response_time_ms > 100 then 'network' else 'timeout' end end"
_RANK_CASE = "case event_type when 'error' then case when response_time_ms > 100 then 3 else 2 end when 'signup' then 1 end"
_INCIDENTS_SQL = f"""h as (select event_id, source_id, checked_at, status, {_PROBLEM_CASE} as error_type, {_RANK_CASE} as severity_rank from ({DUCK_HEALTH})),
runs as (select *, sum(case when coalesce(error_type, '') = coalesce(prev, '') and prev_id is not null then 0 else 1 end) over ({_ORDERED} rows unbounded preceding) as run_no
  from (select *, lag(error_type) over ({_ORDERED}) as prev, lag(event_id) over ({_ORDERED}) as prev_id from h)),
starts as (select *, severity_rank > coalesce(max(severity_rank) over (partition by source_id, run_no order by checked_at, event_id rows between unbounded preceding and 1 preceding), 0) as begins
  from runs where error_type is not null),
numbered as (select *, sum(case when begins then 1 else 0 end) over ({_ORDERED} rows unbounded preceding) as incident_no from starts)"""


@query(
    "incident_islands",
    f"""with {_INCIDENTS_SQL} select source_id, cast(incident_no as bigint) as incident_no, strftime(min(checked_at), '%Y-%m-%d %H:%M:%S') as occurred_at, count(*) as checks,
  arg_min(error_type, row(checked_at, event_id)) as error_type, arg_min(severity_rank, row(checked_at, event_id)) as severity_rank, bool_or(status = 'FAILED') as repair_proposed from numbered group by source_id, incident_no""",
)
def incident_islands(tables: Tables) -> DataFrame:
    """Incidents per source with their first problem and whether a repair was proposed."""
    problems = checks(tables).withColumn("error_type", F.expr(_PROBLEM_CASE)).withColumn("severity_rank", F.expr(_RANK_CASE))
    found = health.incident_summary(health.incidents(problems))
    return found.select(
        "source_id", F.col("incident_no").cast("long").alias("incident_no"), F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss").alias("occurred_at"),
        "checks", "error_type", "severity_rank", "repair_proposed")


@query(
    "run_summary",
    """with records as (select date_trunc('hour', ts) as run_id, event_type as source_id, event_type <> 'error' as normalized, event_type = 'purchase' as relevant, event_type = 'error' as error from events),
per as (select run_id, source_id, count(*) as raw, count(*) filter (where normalized) as normalized, count(*) filter (where relevant) as relevant, count(*) filter (where error) as errors, bool_and(error) as failed from records group by all)
select strftime(run_id, '%Y-%m-%d %H') as run_id, cast(sum(raw) as bigint) as raw, cast(sum(normalized) as bigint) as normalized, cast(sum(relevant) as bigint) as relevant,
  cast(sum(normalized - relevant) as bigint) as ignored, cast(sum(errors) as bigint) as errors, count(*) filter (where not failed) as sources_ok, count(*) filter (where failed) as sources_failed,
  case when count(*) filter (where failed) = 0 then 'COMPLETED' when count(*) filter (where not failed) > 0 then 'PARTIAL' else 'FAILED' end as status from per group by run_id""",
)
def run_summary(tables: Tables) -> DataFrame:
    """Counters and status of every hourly run."""
    error = F.col("event_type") == "error"
    records = tables.events.select(
        F.date_format(F.date_trunc("hour", F.col("ts").cast("timestamp")), "yyyy-MM-dd HH").alias("run_id"), F.col("event_type").alias("source_id"),
        (~error).alias("normalized"), (F.col("event_type") == "purchase").alias("relevant"), error.alias("error"), error.alias("source_failed"))
    return health.run_summary(records)


@query(
    "alert_digest",
    """select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as digest, event_type, count(*) as alerts,
  bool_or(strftime(ts, '%H:%M:%S') >= '22:00:00' or strftime(ts, '%H:%M:%S') < '07:00:00') as deferred from events group by all""",
)
def alert_digest(tables: Tables) -> DataFrame:
    """Hourly digest counts and whether the hour falls into the quiet time."""
    alerts = tables.events.select(F.col("ts").cast("timestamp").alias("created_at"), "event_type")
    quiet = notify.Preference(quiet_start="22:00", quiet_end="07:00")
    counted = notify.digest(alerts, "created_at", "1 hour", "event_type")
    start = F.col("window.start")
    return counted.select(F.date_format(start, "yyyy-MM-dd HH").alias("digest"), "event_type", "alerts", notify.deferred(start, quiet).alias("deferred"))


@query(
    "review_split",
    f"with obs as ({OBS_SQL}) select segment, recognition_confidence < 70 or contradictory or defects_text like '%bogus%' as needs_review, count(*) as listings from obs group by all",
)
def review_split(tables: Tables) -> DataFrame:
    """Listings that need a review before they count as evidence."""
    catalog = derived.catalog(tables)
    return listings.needs_review(derived.observations(tables), catalog).groupBy("segment", "needs_review").agg(F.count(F.lit(1)).alias("listings"))
