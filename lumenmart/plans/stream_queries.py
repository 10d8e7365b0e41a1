"""Streaming and file-format queries over the given tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from lumenmart.functions import text
from lumenmart import session
from lumenmart.operators import contracts, health, listings
from lumenmart.plans import derived
from lumenmart.plans.derived import DUCK_HEALTH
from lumenmart.plans.ingest_queries import (
    _INCIDENTS_SQL, _ORDERED, _PROBLEM_CASE, _RANK_CASE, UPSERT_SQL, feed_records, upsert_view,
)
from lumenmart.plans.registry import Tables, query
from lumenmart.sources import scans
from lumenmart.sources.keyed_table import KeyedTable
from lumenmart.streaming import jobs, stateful


def work_folder(tables: Tables, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return session.work_folder(tables.spark, name)


def event_stream(tables: Tables) -> DataFrame:
    return jobs.read_feed(tables.spark, tables.folder, tables.events.schema, pattern="events.parquet")


@query("stream_upsert", UPSERT_SQL)
def stream_upsert(tables: Tables) -> DataFrame:
    """The event feed as a file stream, upserted by key; final state."""
    folder = work_folder(tables, "upsert")
    table = KeyedTable.of_changes(tables.spark, f"{folder}/table", ["duplicate_key"])
    jobs.write_keyed(jobs.upsert_stream(feed_records(event_stream(tables))), table, f"{folder}/checkpoint")
    return upsert_view(table.read())


#: Micro-batches of more bytes come in several files, so that several tasks read them.
FEED_FILE_BYTES = 8 << 20


def shuffled_events(tables: Tables, batches: int) -> DataFrame:
    """The event feed as a stream of files that mix all times, in a given number of micro-batches."""
    folder = work_folder(tables, "feed")
    files = max(1, math.ceil(session.plan_bytes(tables.events) / (batches * FEED_FILE_BYTES)))
    tables.events.repartition(batches * files, F.xxhash64("event_id")).write.parquet(folder)
    return jobs.read_feed(tables.spark, folder, tables.events.schema, files_per_batch=files)


@query(
    "stream_live_listings",
    UPSERT_SQL.replace("cast(arg_min(event_id, row(ts, event_id)) as varchar) as listing_id, ", ""),
)
def stream_live_listings(tables: Tables) -> DataFrame:
    """The event feed collapsed per micro-batch into the live table, whose runs merge as they grow in number."""
    folder = work_folder(tables, "live")
    table = KeyedTable(tables.spark, f"{folder}/table", listings.fold_batches)

    def add(batch: DataFrame, number: int) -> None:
        rows = listings.collapse(feed_records(batch), "seen_at", "event_id")
        table.commit(rows.select("duplicate_key", F.col("first_record").cast("string").alias("listing_id"), "first_seen_at", "last_seen_at", "price"), number)

    shuffled_events(tables, 6).writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(add).start().awaitTermination()
    return upsert_view(table.read()).drop("listing_id")


def slot_checks(tables: Tables) -> DataFrame:
    """Slot summaries of the health feed, in mixed order and with source names of either case."""
    folder = work_folder(tables, "checks")
    checks = tables.spark.sql(derived.SPARK_HEALTH.replace(" from events", " from {base}"), base=shuffled_events(tables, 4))
    checks = checks.withColumnRenamed("event_id", "check_id").withColumn("error_type", F.expr(_PROBLEM_CASE)).withColumn("severity_rank", F.expr(_RANK_CASE))
    named = checks.withColumn("source_id", F.when(F.col("check_id") % 2 == 0, F.upper("source_id")).otherwise(F.col("source_id")))
    return stateful.run_slot_checks(named, f"{folder}/table", f"{folder}/checkpoint", slot_seconds=5 * 86_400).read()


@query(
    "stream_health",
    f"""with h as (select *, sum(case when status <> 'FAILED' then 1 else 0 end) over ({_ORDERED} rows unbounded preceding) as block from ({DUCK_HEALTH}))
select source_id, arg_max(status, row(checked_at, event_id)) as status, count(*) filter (where status = 'FAILED' and block = last_block) as consecutive_failures,
  strftime(max(checked_at) filter (where status <> 'FAILED'), '%Y-%m-%d %H:%M:%S') as last_success, count(*) as checks
from (select *, max(block) over (partition by source_id) as last_block from h) group by source_id""",
)
def stream_health(tables: Tables) -> DataFrame:
    """Status, failure streak and last success of every source, kept by time slot over files in mixed order."""
    rows = stateful.source_state(tables.shared("slot_checks", slot_checks))
    return rows.select("source_id", "status", "consecutive_failures", F.date_format("last_success_at", "yyyy-MM-dd HH:mm:ss").alias("last_success"), "checks")


@query(
    "stream_incident_lives",
    f"""with {_INCIDENTS_SQL},
marks as (select runs.source_id, runs.event_id, runs.checked_at, runs.error_type is null or coalesce(numbered.begins, false) as ends, numbered.begins, numbered.incident_no
  from runs left join numbered on runs.source_id = numbered.source_id and runs.event_id = numbered.event_id),
closed as (select source_id, incident_no, begins, lead(checked_at) over ({_ORDERED}) as resolved_at from marks where ends),
lives as (select source_id, incident_no, count(*) as checks, min(checked_at) as occurred_at, arg_min(error_type, row(checked_at, event_id)) as error_type,
  arg_min(severity_rank, row(checked_at, event_id)) as severity_rank, max(case when status = 'FAILED' then row(checked_at, event_id) end) as failed from numbered group by all)
select source_id, cast(incident_no as bigint) as incident_no, strftime(occurred_at, '%Y-%m-%d %H:%M:%S') as occurred_at, checks, error_type, severity_rank, resolved_at is not null as resolved,
  strftime(resolved_at, '%Y-%m-%d %H:%M:%S') as resolved_at, coalesce(failed = max(failed) over (partition by source_id), false) as latest_proposal,
  case when coalesce(failed = max(failed) over (partition by source_id), false) then case error_type when 'timeout' then 'slow or unreachable source' when 'network' then 'connection lost' end end as probable_cause
from lives join closed using (source_id, incident_no) where begins""",
)
def stream_incident_lives(tables: Tables) -> DataFrame:
    """Incidents with resolution and each source's latest repair proposal, kept by time slot over files in mixed order."""
    rows = stateful.incident_lifecycle(tables.shared("slot_checks", slot_checks))
    stamp = lambda name: F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)
    return rows.select(
        "source_id", F.col("incident_no").cast("long").alias("incident_no"), stamp("occurred_at"), "checks", "error_type", "severity_rank", "resolved",
        stamp("resolved_at"), "latest_proposal", "probable_cause")


STALE_DAYS = 5


@query(
    "stream_expiry",
    f"""with seen as (select concat(event_type, ':', cast(user_id as varchar)) as duplicate_key, epoch_ms(min(ts)) as first_ms, epoch_ms(max(ts)) as last_ms from events group by all)
select duplicate_key, strftime(epoch_ms(first_ms), '%Y-%m-%d %H:%M:%S') as first_seen, strftime(epoch_ms(last_ms), '%Y-%m-%d %H:%M:%S') as last_seen,
  last_ms >= max(last_ms) over () - {STALE_DAYS * 86_400_000} as active from seen""",
)
def stream_expiry(tables: Tables) -> DataFrame:
    """Listings that expire by timer and revive by a late sighting, over files in mixed order, in two scheduled runs."""
    folder = work_folder(tables, "expiry")
    feed = work_folder(tables, "feed")
    table = None
    for late in (False, True):  # the later run brings old and new sightings
        tables.events.where((F.col("event_id") % 3 == 0) == F.lit(late)).repartition(2, F.xxhash64("event_id")).write.mode("append").parquet(feed)
        records = feed_records(jobs.read_feed(tables.spark, feed, tables.events.schema, files_per_batch=1))
        stateful.reduce_sightings(records, f"{folder}/sightings", f"{folder}/sightings-checkpoint")
        table = stateful.run_expiry(tables.spark, f"{folder}/sightings", f"{folder}/table", f"{folder}/checkpoint", STALE_DAYS)
    stamp = lambda name: F.date_format(name, "yyyy-MM-dd HH:mm:ss")
    return stateful.listing_state(table).select("duplicate_key", stamp("first_seen_at").alias("first_seen"), stamp("last_seen_at").alias("last_seen"), "active")


@query(
    "stream_digest",
    "select strftime(date_trunc('day', ts), '%Y-%m-%d') as digest, event_type, count(*) as alerts from events group by all",
)
def stream_digest(tables: Tables) -> DataFrame:
    """Daily digest counts of the event stream, late rows included."""
    folder = work_folder(tables, "digest")
    alerts = event_stream(tables).select(F.col("ts").cast("timestamp").alias("created_at"), "event_type")
    jobs.write_digest(alerts, f"{folder}/log", f"{folder}/checkpoint", "created_at", "1 day", "event_type")
    rows = jobs.digest_totals(tables.spark, f"{folder}/log", "event_type")
    return rows.select(F.date_format("digest_start", "yyyy-MM-dd").alias("digest"), "event_type", "alerts")


@query(
    "stream_incidents",
    f"with {_INCIDENTS_SQL} select source_id, cast(incident_no as bigint) as incident_no, count(*) as checks, strftime(min(checked_at), '%Y-%m-%d %H:%M:%S') as occurred_at from numbered group by source_id, incident_no",
)
def stream_incidents(tables: Tables) -> DataFrame:
    """Incident lifecycle kept across the micro-batches of the health feed."""
    folder = work_folder(tables, "incidents")
    feed = event_stream(tables)
    checks = tables.spark.sql(derived.SPARK_HEALTH.replace(" from events", " from {base}"), base=feed)
    checks = checks.withColumnRenamed("event_id", "check_id").withColumn("error_type", F.expr(_PROBLEM_CASE)).withColumn("severity_rank", F.expr(_RANK_CASE))
    jobs.incident_stream(checks, f"{folder}/log", f"{folder}/state", f"{folder}/checkpoint")
    found = health.incident_summary(jobs.incident_log(tables.spark, f"{folder}/log"))
    return found.select("source_id", F.col("incident_no").cast("long").alias("incident_no"), "checks", F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss").alias("occurred_at"))


@query(
    "catalog_scan",
    """select cast(p_partkey as varchar) as product_id, p_name as model, nullif(case when p_type in ('STANDARD', 'PROMO') then 'II' else '' end, '') as version,
  case when p_size > 25 then 1980 + p_size end as release_year, case when p_size > 10 then p_retailprice end as price_used from part""",
)
def catalog_scan(tables: Tables) -> DataFrame:
    """Catalog written as padded CSV text, read back trimmed and typed."""
    folder = work_folder(tables, "catalog")
    cells = {
        "id": F.concat(F.lit(" "), F.col("p_partkey").cast("string")), "model": F.concat(F.lit(" "), F.col("p_name"), F.lit("  ")), "brand": F.col("p_brand"),
        "version": F.when(F.col("p_type").isin("STANDARD", "PROMO"), F.lit("II")).otherwise(F.lit(" ")),
        "release_year": F.when(F.col("p_size") > 25, (F.col("p_size") + 1980).cast("string")).otherwise("unknown"),
        "price_used": F.when(F.col("p_size") > 10, F.col("p_retailprice").cast("string")).otherwise(""),
    }
    written = tables.part.select(*[cells.get(name, F.lit("x")).alias(name) for name in scans.PRODUCT_FIELDS])
    written.write.csv(folder, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return scans.load_products(tables.spark, folder).select("product_id", "model", "version", "release_year", "price_used")


# Headers of the files of five kinds, and what is wrong with each.
_HEADERS = ("custkey,name,balance", "custkey,balance", "custkey,name,balance,color", "name,custkey,balance", "\ufeff custkey, \"name\" ,balance")
_HEADER_FAULTS = "(1, 'name', 'missing column'), (2, 'color', 'unknown column'), (3, 'name', 'column order')"


@query(
    "header_contract",
    f"select distinct c_nationkey as nation, field, rule from customer join (values {_HEADER_FAULTS}) faults(kind, field, rule) on c_nationkey % 5 = kind",
)
def header_contract(tables: Tables) -> DataFrame:
    """Customers written as one CSV file per nation, with headers of five kinds; what each header lacks."""
    folder = work_folder(tables, "headers")
    rows = tables.customer.select("c_nationkey", F.lit(1).alias("place"), F.concat_ws(",", "c_custkey", "c_name", F.col("c_acctbal").cast("string")).alias("value"))
    kinds = F.element_at(F.array(*[F.lit(h) for h in _HEADERS]), (F.col("c_nationkey") % len(_HEADERS) + 1).cast("int"))
    heads = tables.customer.select("c_nationkey").distinct().select("c_nationkey", F.lit(0).alias("place"), kinds.alias("value"))
    lines = rows.unionByName(heads).repartition("c_nationkey").sortWithinPartitions("c_nationkey", "place")
    lines.select("c_nationkey", "value").write.partitionBy("c_nationkey").text(folder)
    found = contracts.header_violations(tables.spark, folder, "customers", ("custkey", "name", "balance"), exact_order=True)
    return found.select(F.regexp_extract("row_key", "c_nationkey=(\\d+)", 1).cast("int").alias("nation"), "field", "rule")


_ROWS_PER_FEED = 50


@query(
    "source_contract",
    f"""with sources as (select s_suppkey as k, s_suppkey // {_ROWS_PER_FEED} as document, row_number() over (partition by s_suppkey // {_ROWS_PER_FEED} order by s_suppkey) as record,
  case when s_suppkey % 7 = 6 then s_suppkey - 1 else s_suppkey end as id from supplier),
faults as (select *, row_number() over (partition by document, id order by k) as time from sources)
select document, record, field, rule, value from faults join (values (1, 'notes', 'missing key', null), (1, 'name', 'missing key', null), (2, 'colour', 'unknown key', null),
  (3, 'segment', 'domain', 'OLD'), (4, 'mapping', 'unknown mapping key', 'price_regex'), (5, 'source_type', 'domain', 'FTP')) f(kind, field, rule, value) on k % 7 = kind
union all select document, record, 'source_id', 'repeated id', concat('S', id) from faults where time > 1
union all select distinct document, 0, 'version', 'unknown key', null from sources where document % 2 = 1""",
)
def source_contract(tables: Tables) -> DataFrame:
    """Suppliers written as JSON source files with faults of every kind; what the strict reader finds."""
    folder = work_folder(tables, "sources")
    kind, key = F.col("s_suppkey") % 7, F.col("s_suppkey")
    unless = lambda fault, value: F.when(kind != fault, value)
    mapping = F.when(kind == 4, F.create_map(F.lit("title"), F.lit("t"), F.lit("price_regex"), F.lit("x"))).otherwise(F.create_map(F.lit("title"), F.lit("t")))
    source = F.struct(
        F.concat(F.lit("S"), F.when(kind == 6, key - 1).otherwise(key).cast("string")).alias("source_id"), unless(1, F.col("s_name")).alias("name"),
        F.when(kind == 5, "FTP").otherwise("JSON_FEED").alias("source_type"), F.lit("https://shop.example/feed").alias("endpoint"), F.lit(True).alias("enabled"),
        F.lit("IT").alias("country"), F.lit("EUR").alias("currency"), F.when(kind == 3, "OLD").otherwise("USED").alias("segment"),
        F.lit(10.0).alias("request_timeout_seconds"), F.lit(2).alias("retry_count"), F.lit(1.0).alias("minimum_request_interval_seconds"),
        mapping.alias("mapping"), unless(1, F.lit("")).alias("notes"), F.when(kind == 2, "red").alias("colour"))
    # at most _ROWS_PER_FEED sources share a document
    by_key = lambda left, right: (left["k"] - right["k"]).cast("int")
    listed = F.array_sort(F.collect_list(F.struct(key.alias("k"), source.alias("s"))), by_key)
    documents = tables.supplier.groupBy(F.floor(key / _ROWS_PER_FEED).alias("document")).agg(listed.alias("sorted"))
    content = F.to_json(F.struct(F.transform("sorted", lambda item: item["s"]).alias("sources"), F.when(F.col("document") % 2 == 1, 1).alias("version")))
    documents.select("document", content.alias("value")).write.partitionBy("document").text(folder)
    place = lambda pattern: F.regexp_extract("row_key", pattern, 1).cast("long")
    return contracts.source_file_violations(tables.spark, folder).select(
        place("document=(\\d+)").alias("document"), place("#(\\d+)$").alias("record"), "field", "rule", "value")


@query(
    "json_feed_scan",
    "select cast(page_id as varchar) as external_id, url, cast(page_id * 10 as varchar) as price from pages",
)
def json_feed_scan(tables: Tables) -> DataFrame:
    """Pages written as JSON feed documents, read back by record path and mapping."""
    folder = work_folder(tables, "feed")
    item = F.struct(F.col("page_id").alias("id"), F.struct(F.col("url").alias("href")).alias("link"), (F.col("page_id") * 10).alias("amount"))
    documents = tables.pages.groupBy(F.floor(F.col("page_id") / _ROWS_PER_FEED).alias("document")).agg(F.collect_list(item).alias("items"))
    documents.select(F.to_json(F.struct(F.struct("items").alias("data"))).alias("value")).repartition(F.col("value")).write.option("maxRecordsPerFile", 1).text(folder)
    mapping = {"list_path": "data.items", "external_id": "id", "url": "link.href", "price": "amount"}
    records, _ = scans.json_feed(tables.spark, folder, mapping)
    return records.select("external_id", "url", "price")


@query(
    "rss_feed_scan",
    "select cast(page_id as varchar) as external_id, url, case when page_id % 2 = 0 then page_id + 1000.5 end as price, "
    "case when page_id % 2 = 1 then 'price text not readable' end as problem from pages",
)
def rss_feed_scan(tables: Tables) -> DataFrame:
    """Pages written as RSS items, read back with a price parsed from prose."""
    folder = work_folder(tables, "rss")
    amount = F.concat(F.lit("price € "), F.regexp_replace(F.format_number(F.col("page_id") + 1000, 0), ",", "."), F.lit(",50"))
    items = tables.pages.select(
        F.col("page_id").cast("string").alias("guid"), F.col("url").alias("link"), F.lit("page").alias("title"),
        F.when(F.col("page_id") % 2 == 0, amount).otherwise("about 7 items, 30 euro cheaper").alias("description"))
    items.write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(folder)
    price_format = {"currency_symbol": "€", "currency_code": "EUR", "decimal_separator": ",", "thousands_separator": "."}
    return scans.rss_feed(tables.spark, folder, price_format).select("external_id", "url", "price", "problem")


ALL_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)


@query("table_counts", " union all ".join(f"select '{name}' as \"table\", count(*) as rows from {name}" for name in ALL_TABLES))
def table_counts(tables: Tables) -> DataFrame:
    """Rows of every table in one job."""
    return scans.count_rows({name: getattr(tables, name) for name in ALL_TABLES})


@query(
    "stream_fresh_alerts",
    "select distinct concat(event_type, ':', cast(user_id as varchar)) as deduplication_key from events",
)
def stream_fresh_alerts(tables: Tables) -> DataFrame:
    """The event stream as alerts in 20 micro-batches, each deduplication key sent once."""
    folder = work_folder(tables, "alerts")
    key = F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("deduplication_key")
    alerts = shuffled_events(tables, 20).select(key, F.col("ts").cast("timestamp").alias("created_at"))
    stateful.write_fresh_alerts(alerts, f"{folder}/log", f"{folder}/checkpoint")
    return tables.spark.read.parquet(f"{folder}/log").select("deduplication_key")
