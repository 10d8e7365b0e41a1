"""The whole ingest run over a feed written out from the observations, and its SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumenmart.operators import health, ingest, notify, resolve
from lumenmart.plans import derived
from lumenmart.plans.derived import OBS_SQL
from lumenmart.plans.registry import Tables, query
from lumenmart.session import ON_DROP, stage

# The same text on both sides. Line numbers 6 and 7 (confidence 75 and 70) carry faults.
_FEED_COLUMNS = (
    "source as source_id, listing_id as external_id, url, "
    "case when recognition_confidence = 70 then '' when recognition_confidence >= 85 then concat('Offer prod', product_id) else concat('zzqq', product_id) end as title, "
    "case when recognition_confidence = 100 then 'shutter count: 12000, write to seller@shop.example' else 'plain' end as description, "
    "case when recognition_confidence = 75 then 'abc' when price is null then '' else cast(cast(price as bigint) as string) end as price, "
    "case when currency = 'USD' then 'USD' else '' end as currency, '' as source_country, segment, '' as condition, "
    "cast(cast(observed_at as date) as string) as detected_at, recognition_confidence"
)
_RUN_SQL = (
    f"obs as ({OBS_SQL}), feed as (select distinct {_FEED_COLUMNS} from obs where source <> 'S9'), "
    "watches as (select concat('zzqq', cast(p_partkey as varchar)) as query from part where p_partkey % 3 = 0), "
    "titles as materialized (select title, bool_or(query is not null) as watched from (select distinct title from feed) t left join watches on contains(t.title, query) group by title), "
    "rows as (select feed.*, titles.watched, title = '' or price = 'abc' as error, recognition_confidence >= 85 as sure, source_id = 'S0' as supplied from feed join titles using (title)), "
    "kept as (select *, recognition_confidence in (100, 95) as earlier from rows where not error and (sure or watched or supplied))"
)
SOURCES = [
    (f"S{i}", f"Shop {i}", "FILE_IMPORT" if i == 0 else "JSON_FEED", "IT", "EUR" if i < 5 else "GBP", "USED", i != 9) for i in range(10)
]
SOURCE_SCHEMA = "source_id string, name string, source_type string, country string, currency string, segment string, enabled boolean"


def feed(tables: Tables) -> DataFrame:
    """Raw records: every observation as text fields."""
    view = tables.spark.sql(f"select {_FEED_COLUMNS} from {{obs}}", obs=derived.observations(tables))
    return view.distinct()


def product_catalog(tables: Tables) -> DataFrame:
    name = F.col("p_partkey").cast("string")
    return tables.part.select(
        F.concat(F.lit("prod"), name).alias("product_id"), F.lit("brandx").alias("brand"), F.concat(F.lit("model"), name).alias("model"),
        F.lit("").alias("version"), F.lit("Lens").alias("category"), F.lit("none").alias("native_mount"))


def text_watches(tables: Tables) -> DataFrame:
    name = F.concat(F.lit("zzqq"), F.col("p_partkey").cast("string"))
    return tables.part.where("p_partkey % 3 = 0").select(
        name.alias("watch_id"), F.lit(None).cast("string").alias("product_id"), name.alias("query"), F.array().cast("array<string>").alias("source_ids"),
        F.lit(None).cast("double").alias("max_price"), F.lit("EUR").alias("currency"), F.lit(True).alias("active"))


def two_runs(tables: Tables) -> tuple[DataFrame, ingest.Run]:
    """A first run over a part of the feed, then one over all of it: (stored before, second run)."""
    spark = tables.spark
    # both runs read the feed and the catalog, which are worked out once
    records, now = stage(feed(tables)), F.lit("2001-06-30").cast("timestamp")
    sources = spark.createDataFrame(SOURCES, SOURCE_SCHEMA)
    catalog, watches = product_catalog(tables), text_watches(tables)
    aliases = spark.createDataFrame([], "product_id string, alias string")
    known = resolve.known(catalog, aliases)
    first = ingest.run(
        records.where("recognition_confidence in (100, 95, 70)").drop("recognition_confidence"), sources, catalog, aliases, watches, None, now, known=known)
    return first.live, ingest.run(records.drop("recognition_confidence"), sources, catalog, aliases, watches, first.live, now, known=known)


_RUNS: dict[tuple, tuple[DataFrame, ingest.Run]] = {}
ON_DROP.append(_RUNS.clear)


def _both(tables: Tables) -> tuple[DataFrame, ingest.Run]:
    """The two runs, done once per session and folder; they rest on staged tables."""
    key = (tables.spark.sparkContext.applicationId, tables.folder)
    if key not in _RUNS:
        _RUNS[key] = two_runs(tables)
    return _RUNS[key]


@query(
    "ingest_run",
    f"""with {_RUN_SQL} select concat(source_id, ':', external_id) as duplicate_key, case when sure then replace(title, 'Offer ', '') end as product_id,
  case when sure then 100 else 0 end as recognition_confidence, title, replace(description, 'seller@shop.example', '[removed]') as description,
  try_cast(nullif(price, '') as double) as price, case when currency <> '' then currency when source_id in ('S0', 'S1', 'S2', 'S3', 'S4') then 'EUR' else 'GBP' end as currency,
  'IT' as source_country, segment, detected_at, case when recognition_confidence = 100 then 12000 end as shutter_count,
  recognition_confidence = 100 as redacted from kept qualify row_number() over (partition by source_id, external_id order by detected_at desc) = 1""",
)
def ingest_run(tables: Tables) -> DataFrame:
    """Live listings after two runs over the feed: recognized, read, watched, redacted, merged by key."""
    return _both(tables)[1].live.select(
        "duplicate_key", "product_id", "recognition_confidence", "title", "description", "price", "currency", "source_country", "segment",
        F.date_format("detected_at", "yyyy-MM-dd").alias("detected_at"), "shutter_count",
        F.exists("warnings", lambda w: F.contains(w, F.lit("personal data"))).alias("redacted"))


@query(
    "ingest_counters",
    f"""with {_RUN_SQL}, all_rows as (select count(*) as raw, count(*) filter (where error) as errors, count(*) filter (where not error) as normalized, count(distinct source_id) as sources_ok from rows),
merged as (select count(*) as relevant, count(distinct external_id) filter (where earlier) as updated, count(distinct external_id) filter (where not earlier) as new from kept)
select 'run-2' as run_id, raw, normalized, relevant, normalized - relevant as ignored, errors, sources_ok, 0 as sources_failed, 'COMPLETED' as status, new, updated from all_rows, merged""",
)
def ingest_counters(tables: Tables) -> DataFrame:
    """Counters of the second run: records by outcome, sources, new and updated listings."""
    stored, done = _both(tables)
    return ingest.counters(done, stored, "run-2").select(
        "run_id", "raw", "normalized", "relevant", "ignored", "errors", "sources_ok", "sources_failed", "status", "new", "updated")


# What each source's fetch came to in the second run, and its health before: S2 is slow, S7 fails again, S10 sends nothing.
_FETCHES = [(f"S{i}", i == 7, 20_000 if i == 2 else 100) for i in (*range(9), 10)]
_BEFORE = [(f"S{i}", {1: "FAILED", 7: "FAILED", 8: "DEGRADED"}.get(i, "HEALTHY"), 0 if i in (1, 7) else 5, {1: 1, 7: 2}.get(i, 0)) for i in (*range(8), 8, 10)]
_TIMEOUT_MS = 15_000
_VALUES = lambda rows: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() for v in row) + ")" for row in rows)


@query(
    "ingest_health",
    f"""with {_RUN_SQL}, fetches(source_id, source_failed, response_time_ms) as (values {_VALUES(_FETCHES)}), before(source_id, status, relevant, streak) as (values {_VALUES(_BEFORE)}),
counted as (select f.source_id, source_failed, response_time_ms, count(r.source_id) filter (where not source_failed) as raw, count(*) filter (where r.error and not source_failed) as errors,
    count(*) filter (where not r.error and (r.sure or r.watched or r.supplied) and not source_failed) as relevant from fetches f left join rows r on r.source_id = f.source_id group by all),
judged as (select c.*, b.status as previous_status, case when source_failed then streak + 1 else 0 end as streak,
    case when source_failed then null when errors > 0 then 'record errors' when response_time_ms > {_TIMEOUT_MS} then 'response over timeout' when c.relevant = 0 and b.relevant > 0 then 'nothing relevant any more' end as rule
  from counted c left join before b using (source_id)),
stated as (select *, case when source_failed then 'FAILED' when rule is not null then 'DEGRADED' else 'HEALTHY' end as status from judged),
run as (select 'run-2' as run_id, case when count(*) filter (where source_failed) = 0 then 'COMPLETED' when count(*) filter (where not source_failed) > 0 then 'PARTIAL' else 'FAILED' end as status,
    sum(raw) as raw, sum(relevant) as relevant, sum(errors) as errors from stated)
select 'source' as kind, source_id as name, status, rule as detail, raw, relevant, errors, streak from stated
union all select 'run', run_id, status, null, raw, relevant, errors, null from run
union all select 'alert', concat('RADAR_', status, ':', run_id), case status when 'PARTIAL' then 'IMPORTANT' else 'CRITICAL' end, null, null, null, null, null from run where status in ('PARTIAL', 'FAILED')
union all select 'alert', concat('CONNECTOR_FAILED:', source_id, ':failed'), 'CRITICAL', null, null, null, null, null from stated where status = 'FAILED' and coalesce(previous_status, '') <> 'FAILED'
union all select 'alert', concat('CONNECTOR_RECOVERED:', source_id, ':healthy'), 'NOTICE', null, null, null, null, null from stated where status = 'HEALTHY' and previous_status = 'FAILED'""",
)
def ingest_health(tables: Tables) -> DataFrame:
    """Sources after the second run with slow, failing and silent ones; the run's status; the alerts all of that raises."""
    spark = tables.spark
    fetches = spark.createDataFrame(_FETCHES, "source_id string, source_failed boolean, response_time_ms long")
    before = spark.createDataFrame(_BEFORE, "source_id string, status string, relevant long, consecutive_failures int")
    # watches of all sources cover every source
    sources = health.after_run(_both(tables)[1].outcomes, fetches, before, fetches.select("source_id"), _TIMEOUT_MS)
    run = health.run_after(sources, "run-2")
    alerts = notify.run_alerts(run).unionByName(notify.health_alerts(sources).select("notification_type", "severity", "deduplication_key"))
    long = lambda name: F.col(name).cast("long").alias(name)
    rows = sources.select(
        F.lit("source").alias("kind"), F.col("source_id").alias("name"), "status", F.col("rule").alias("detail"), long("raw"), long("relevant"), long("errors"),
        F.col("consecutive_failures").cast("long").alias("streak"))
    whole = run.select(F.lit("run").alias("kind"), F.col("run_id").alias("name"), "status", long("raw"), long("relevant"), long("errors"))
    sent = alerts.select(F.lit("alert").alias("kind"), F.col("deduplication_key").alias("name"), F.col("severity").alias("status"))
    return rows.unionByName(whole, allowMissingColumns=True).unionByName(sent, allowMissingColumns=True)


# Titles and descriptions of six kinds: product id, product name, negated id, both, and two kinds of bundles.
_KIND = "p_partkey % 6"
_OTHER = "cast((p_partkey + case when p_partkey % 6 = 4 then 1 else 2 end) % n as string)"
_ID = "cast(p_partkey as string)"
_TITLE = (
    f"case {_KIND} when 0 then concat('Offer prod', {_ID}) when 1 then concat('Brandx  model', {_ID}, ' fine') when 2 then concat('this is not the prod', {_ID}) "
    f"when 3 then concat('brandx-model', {_ID}) else concat('prod', {_ID}, ' and prod', {_OTHER}) end"
)
_DESCRIPTION = f"case when {_KIND} = 3 then concat('ref prod', {_ID}) else 'plain' end"
_NAME_SCORE = resolve.BASE_SCORES["exact_model"] + resolve.ADJUSTMENTS["title"]


@query(
    "recognition_scores",
    f"""with counted as (select p_partkey, p_partkey % 2 = 0 as camera, {_KIND} as kind, count(*) over () as n from part),
rows as (select *, concat('prod', cast(p_partkey as varchar)) as own, case when kind = 4 then not camera else camera end as other_camera from counted)
select p_partkey, case when kind in (0, 1, 3) or (kind = 4 and camera) then own end as product_id,
  case kind when 1 then {_NAME_SCORE} when 2 then 0 else 100 end as recognition_confidence, kind = 5 or (kind = 4 and not camera) as ambiguous,
  case when kind = 4 then case when camera then 'kit' else 'unclear kit' end when kind = 5 then case when camera then 'bodies' else 'lenses' end else 'single' end as structure,
  case kind when 2 then 0 when 4 then 2 when 5 then 2 else 1 end as candidates from rows""",
)
def recognition_scores(tables: Tables) -> DataFrame:
    """Recognition of texts with ids, names, negations and bundles: product, score, ambiguity, structure, candidates."""
    size = tables.part.count()
    category = F.when(F.col("p_partkey") % 2 == 0, "Camera").otherwise("Lens")
    products = product_catalog(tables).drop("category").withColumn("p_partkey", F.substring("product_id", 5, 18).cast("long")).withColumn("category", category).drop("p_partkey")
    texts = tables.wide("part").select("p_partkey", F.lit(size).alias("n")).selectExpr(f"{_ID} as listing_id", f"{_TITLE} as title", f"{_DESCRIPTION} as description")
    ranked, chosen = resolve.recognize(texts, products, tables.spark.createDataFrame([], "product_id string, alias string"))
    places = ranked.groupBy("listing_id").agg(F.max("place").alias("candidates"))
    return chosen.join(places, "listing_id", "left").select(
        F.col("listing_id").cast("long").alias("p_partkey"), "product_id", "recognition_confidence", "ambiguous", "structure",
        F.coalesce("candidates", F.lit(0)).alias("candidates"))
