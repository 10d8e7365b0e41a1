"""Serving, log and context queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lumenmart.functions import text
from lumenmart.operators import contracts, health, listings, memory, notify, serve
from lumenmart.plans import derived
from lumenmart.plans.decision_queries import _MONTHS_SQL, DECISION_SQL as LISTING_DECISION_SQL, decisions
from lumenmart.plans.derived import AS_OF, CATALOG_SQL, DECISION_SQL, DUCK_HEALTH, OBS_SQL, OWNED_SQL, WATCH_SQL
from lumenmart.plans.market_queries import _SNAPSHOT
from lumenmart.plans.ingest_queries import _ORDERED, checks
from lumenmart.plans.registry import Tables, query
from lumenmart.plans.serving_queries import lens_catalog, wishes


@query(
    "latest_health",
    f"select source_id, arg_max(event_id, row(checked_at, event_id)) as check_id, arg_max(status, row(checked_at, event_id)) as status, "
    f"arg_max(result_count, row(checked_at, event_id)) as result_count from ({DUCK_HEALTH}) group by source_id",
)
def latest_health(tables: Tables) -> DataFrame:
    """Last check of every source."""
    return health.latest(checks(tables)).select("source_id", "check_id", "status", "result_count")


@query(
    "health_alerts",
    f"""with h as (select *, lag(status) over ({_ORDERED}) as previous from ({DUCK_HEALTH})),
alerts as (select source_id, case when status = 'FAILED' and coalesce(previous, '') <> 'FAILED' then 'CONNECTOR_FAILED' when status = 'HEALTHY' and previous = 'FAILED' then 'CONNECTOR_RECOVERED' end as notification_type from h)
select source_id, notification_type, case notification_type when 'CONNECTOR_FAILED' then 'CRITICAL' else 'NOTICE' end as severity, count(*) as alerts from alerts where notification_type is not null group by all""",
)
def health_alerts(tables: Tables) -> DataFrame:
    """Failure and recovery alerts per source."""
    found = notify.health_alerts(health.streaks(checks(tables)))
    return found.groupBy("source_id", "notification_type", "severity").agg(F.count(F.lit(1)).alias("alerts"))


@query(
    "source_metrics",
    """with records as (select date_trunc('hour', ts) as run_id, event_type as source_id, event_type <> 'error' as normalized, event_type = 'purchase' as relevant, value > 50 as error, event_type = 'error' as failed from events)
select strftime(run_id, '%Y-%m-%d %H') as run_id, source_id, count(*) as raw, count(*) filter (where normalized) as normalized, count(*) filter (where relevant) as relevant, count(*) filter (where error) as errors,
  case when bool_or(failed) then 'FAILED' when count(*) filter (where error) > 0 then 'DEGRADED' else 'HEALTHY' end as status from records group by all""",
)
def source_metrics(tables: Tables) -> DataFrame:
    """Records and health of every source in every hourly run."""
    kind = F.col("event_type")
    records = tables.events.select(
        F.date_format(F.date_trunc("hour", F.col("ts").cast("timestamp")), "yyyy-MM-dd HH").alias("run_id"), kind.alias("source_id"), (kind != "error").alias("normalized"),
        (kind == "purchase").alias("relevant"), (F.col("value") > 50).alias("error"), (kind == "error").alias("source_failed"))
    return health.source_metrics(records).drop("source_failed")


@query(
    "run_recovery",
    f"select case o_orderstatus when 'P' then 'FAILED' else 'COMPLETED' end as status, count(*) as runs, count(*) filter (where o_orderstatus = 'P') as errors, "
    f"strftime(max(case when o_orderstatus = 'P' then timestamp '{AS_OF}' else o_orderdate end), '%Y-%m-%d') as last_finished from orders group by 1",
)
def run_recovery(tables: Tables) -> DataFrame:
    """Interrupted runs closed as failed, each with an error row."""
    runs = tables.orders.select(
        F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "P", "STARTED").otherwise("COMPLETED").alias("status"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("timestamp")).alias("finished_at"))
    closed, errors = health.recover_interrupted(runs, F.lit(AS_OF).cast("timestamp"))
    joined = closed.join(errors.select("run_id", F.lit(1).alias("hung")), "run_id", "left")
    return joined.groupBy("status").agg(
        F.count(F.lit(1)).alias("runs"), F.count("hung").alias("errors"), F.date_format(F.max("finished_at"), "yyyy-MM-dd").alias("last_finished"))


@query(
    "notification_counters",
    "with state as (select o_orderstatus = 'F' or o_orderpriority = '1-URGENT' as read, o_orderpriority = '5-LOW' as dismissed from orders) "
    "select count(*) filter (where not dismissed) as visible, count(*) filter (where not dismissed and not read) as unread, count(*) filter (where read) as read, count(*) filter (where dismissed) as dismissed from state",
)
def notification_counters(tables: Tables) -> DataFrame:
    """Counters after read marks were applied by id."""
    stored = tables.orders.select(F.col("o_orderkey").alias("notification_id"), (F.col("o_orderstatus") == "F").alias("read"), (F.col("o_orderpriority") == "5-LOW").alias("dismissed"))
    marks = tables.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("notification_id"), F.lit(True).alias("read"), F.lit(None).cast("boolean").alias("dismissed"))
    return notify.counters(notify.apply_state(stored, marks))


@query(
    "user_context",
    f"""with catalog as ({CATALOG_SQL}), owned as (select * from ({OWNED_SQL})), held as (select o.product_id, count(*) as n from owned o where active group by 1),
have as (select coalesce(max(case when category <> 'Camera' and contains(product_type, 'Zoom') then 1 else 0 end), 0) as zooms, coalesce(max(case when n > 1 then 1 else 0 end), 0) as dup,
   coalesce(max(case when category <> 'Camera' and focal_low <= 69 and focal_high >= 24 then 1 else 0 end), 0) as standard from held join catalog using (product_id)),
again as (select count(*) as n from ({WATCH_SQL}) w where active and product_id in (select product_id from held))
select (select count(*) from owned where active) as active_items, (select count(*) from ({WATCH_SQL}) where active) as active_wishes, (select count(*) from orders) as decisions,
  concat_ws(',', 'target market missing', case when zooms = 0 or standard = 0 then 'no standard zoom owned' end, case when dup = 1 then 'duplicate products owned' end, case when again.n > 0 then 'wishlist product already owned' end) as gaps from have, again""",
)
def user_context(tables: Tables) -> DataFrame:
    """Counts and gaps of the user's tables in one row."""
    owned, catalog, wanted = derived.owned(tables), lens_catalog(tables), wishes(tables)
    flagged = memory.wishlist_flags(wanted, owned, catalog, F.lit(AS_OF).cast("date"))
    rows = memory.user_context(owned, wanted, derived.decision_log(tables), catalog, flagged, None)
    return rows.select("active_items", "active_wishes", "decisions", F.array_join("gaps", ",").alias("gaps"))


@query(
    "decision_view",
    f"""with catalog as ({CATALOG_SQL}) select entry_id, product_id, concat_ws(' ', brand, model, nullif(version, '')) as product_name, decision,
  concat('https://shop.example/', entry_id) as listing_url, concat_ws(',', 'a', 'b', 'c') as reasons from ({DECISION_SQL}) left join catalog using (product_id)""",
)
def decision_view(tables: Tables) -> DataFrame:
    """Decision history with product names, canonical links and three reasons."""
    link = text.canonical_url(F.concat(F.lit("https://shop.example/"), F.col("entry_id"), F.lit("?utm_source=mail#top")))
    log = derived.decision_log(tables).withColumn("listing_url", link).withColumn("reasons", F.array(*[F.lit(x) for x in "abcd"]))
    rows = serve.decision_view(log, derived.catalog(tables))
    return rows.select("entry_id", "product_id", "product_name", "decision", "listing_url", F.array_join("reasons", ",").alias("reasons"))


@query(
    "listing_view",
    f"""with recursive {_SNAPSHOT}, {LISTING_DECISION_SQL}, catalog as ({CATALOG_SQL})
select listing_id, concat_ws(' ', c.brand, model, nullif(version, '')) as product_name, recommendation as decision, warranty_until is not null as warranty_known,
  case when recognition_confidence < 70 or contradictory or defects_text like '%bogus%' then 'to be checked' else 'analyzed' end as analysis_status,
  case when warranty_until is null then 'not specified' when {_MONTHS_SQL.format('')} = 0 then 'none' else concat('until ', strftime(warranty_until, '%Y-%m-%d')) end as warranty_label
from decided left join catalog c using (product_id)""",
)
def listing_view(tables: Tables) -> DataFrame:
    """Public row of every listing with its decision, review state and warranty label."""
    seen = F.col("observed_at").cast("timestamp")
    rows = derived.observations(tables).withColumns({
        "description": F.lit(""), "detected_at": seen, "first_seen_at": seen, "last_seen_at": seen, "active": F.lit(True)})
    rows = listings.needs_review(listings.warranty_columns(rows), derived.catalog(tables))
    view = serve.listing_view(rows, derived.catalog(tables), decisions(tables))
    return view.select("listing_id", "product_name", "decision", F.col("warranty_until").isNotNull().alias("warranty_known"), "analysis_status", "warranty_label")


@query(
    "listing_structure",
    f"""with catalog as ({CATALOG_SQL}), mentions as (select o_orderkey, l_linenumber, category from orders join lineitem on l_orderkey = o_orderkey join catalog on product_id = cast(l_partkey as varchar)),
per as (select o_orderkey, count(*) filter (where category = 'Camera') as cameras, count(*) filter (where category <> 'Camera') as lenses from mentions group by 1)
select case when cameras > 1 then 'bodies' when cameras > 0 and lenses > 0 then 'kit' when cameras = 0 and lenses > 1 then 'lenses' else 'single' end as structure, count(*) as orders from per group by 1""",
)
def listing_structure(tables: Tables) -> DataFrame:
    """Orders as bundles: several bodies, kit, several lenses or single."""
    catalog = derived.catalog(tables).select("product_id", "category")
    items = tables.lineitem.join(tables.orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "o_orderkey", F.col("l_partkey").cast("string").alias("product_id")).join(catalog, "product_id")
    camera = F.col("category") == "Camera"
    per = items.groupBy("o_orderkey").agg(F.count_if(camera).alias("cameras"), F.count_if(~camera).alias("lenses"))
    kind = F.when(F.col("cameras") > 1, "bodies").when((F.col("cameras") > 0) & (F.col("lenses") > 0), "kit").when(
        (F.col("cameras") == 0) & (F.col("lenses") > 1), "lenses").otherwise("single")
    return per.groupBy(kind.alias("structure")).agg(F.count(F.lit(1)).alias("orders"))


_NAMES_SQL = f"names as (select product_id, concat_ws(' ', nullif(brand, ''), nullif(model, ''), nullif(version, '')) as product_name from ({CATALOG_SQL}))"


@query(
    "wishlist_rows",
    f"with {_NAMES_SQL} select watch_id, w.product_id, coalesce(product_name, w.product_id) as product_name, priority, max_price, active from ({WATCH_SQL}) w left join names using (product_id)",
)
def wishlist_rows(tables: Tables) -> DataFrame:
    """Watches with the name of their product."""
    return serve.wishlist_view(derived.watches(tables), derived.catalog(tables)).select(
        "watch_id", "product_id", "product_name", "priority", "max_price", "active")


@query(
    "inventory_rows",
    f"with {_NAMES_SQL} select item_id, o.product_id, coalesce(product_name, o.product_id) as product_name, purchase_price, active from ({OWNED_SQL}) o left join names using (product_id)",
)
def inventory_rows(tables: Tables) -> DataFrame:
    """Owned items with the name of their product, without private columns."""
    items = derived.owned(tables).withColumns({"serial_reference": F.lit("x"), "notes": F.lit("y")})
    shown = serve.inventory_view(items, derived.catalog(tables))
    kept = [name for name in ("item_id", "product_id", "product_name", "purchase_price", "active", "serial_reference", "notes") if name in shown.columns]
    return shown.select(*kept)


@query(
    "latest_run",
    "select strftime(date_trunc('hour', max(ts)), '%Y-%m-%d %H') as run_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as started_at from events",
)
def latest_run(tables: Tables) -> DataFrame:
    """The run that started last; every hour of events is a run, started by its last event."""
    stamp = F.col("ts").cast("timestamp")
    runs = tables.events.groupBy(F.date_format(F.date_trunc("hour", stamp), "yyyy-MM-dd HH").alias("run_id")).agg(F.max(stamp).alias("started_at"))
    return health.latest_run(runs).select("run_id", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"))


@query(
    "live_listing_filters",
    f"with obs as ({OBS_SQL}) select source_country, currency, count(*) as listings from obs where source = 'S3' and segment = 'USED' and recognition_confidence >= 90 group by all",
)
def live_listing_filters(tables: Tables) -> DataFrame:
    """Active used listings of one source, whatever the case of the filter values."""
    rows = derived.observations(tables).withColumn("active", F.col("recognition_confidence") >= 90)
    found = serve.filter_listings(rows, active=True, source="s3", segment="Used")
    return found.groupBy("source_country", "currency").agg(F.count(F.lit(1)).alias("listings"))


NEWEST = 50


@query(
    "newest_listings",
    f"with obs as ({OBS_SQL}) select listing_id, row_number() over (order by observed_at desc, listing_id desc) as place from obs qualify place <= {NEWEST}",
)
def newest_listings(tables: Tables) -> DataFrame:
    """The newest listings, a report of fixed length."""
    rows = derived.observations(tables).withColumn("last_seen_at", F.col("observed_at"))
    top = serve.newest_listings(rows).limit(NEWEST).select("listing_id", "last_seen_at")
    order = Window.orderBy(F.desc("last_seen_at"), F.desc("listing_id"))
    return top.select("listing_id", F.row_number().over(order).alias("place"))


REQUESTED = ("7", "3", "7", "11")


@query(
    "requested_comparison",
    f"with {_NAMES_SQL}, asked as (select * from (values ('7', 1), ('3', 2), ('11', 3)) a(product_id, request_order)) select product_id, product_name, request_order from asked join names using (product_id)",
)
def requested_comparison(tables: Tables) -> DataFrame:
    """Requested products once each, in the order they were asked for."""
    products = derived.catalog(tables).select("product_id", serve.display_name().alias("product_name"))
    return serve.requested_products(products, REQUESTED)


_LISTED_SQL = (
    "select case when l_linenumber = 4 then '' else concat(case when l_linenumber = 5 then 'DUP-' else 'dup-' end, cast(l_orderkey as {text})) end as external_id, "
    "case when l_linenumber = 6 then null else cast(l_suppkey as {text}) end as url, 'S' as source, 'T' as title, 'EUR' as currency, "
    "case when l_linenumber = 7 then 'other' else 'feed' end as connector_name, l_linenumber, l_orderkey, "
    "case when l_linenumber % 2 = 0 then null else l_extendedprice end as price, 'used' as condition, 'x' as location, 'y' as seller, 'z' as description from lineitem"
)
_LISTED_DUCK = _LISTED_SQL.format(text="varchar")


@query(
    "listing_contract",
    f"""with raw as ({_LISTED_DUCK}), flagged as (select *, external_id = '' as no_id, url is null as no_url, connector_name <> 'feed' as wrong from raw),
placed as (select *, row_number() over (partition by lower(external_id) order by l_linenumber) as place from flagged where not (no_id or no_url or wrong)),
found as (select 'external_id' as field, 'required' as rule, count(*) as n from flagged where no_id union all select 'url', 'required', count(*) from flagged where no_url
  union all select 'connector_name', 'wrong connector', count(*) from flagged where wrong union all select 'external_id', 'repeated id', count(*) from placed where place > 1
  union all select 'accepted', case when price is null then 'incomplete' else 'complete' end, count(*) from placed where place = 1 group by price is null)
select field, rule, n from found where n > 0""",
)
def listing_contract(tables: Tables) -> DataFrame:
    """Connector rows by outcome: violations per rule, accepted ones complete or not."""
    raw = tables.spark.sql(_LISTED_SQL.format(text="string").replace("from lineitem", "from {base}"), base=tables.lineitem)
    accepted, found = contracts.accepted_listings(raw, F.col("l_linenumber"), F.lit("Feed"))
    kinds = accepted.select(F.lit("accepted").alias("field"), F.when(F.col("incomplete"), "incomplete").otherwise("complete").alias("rule"))
    return found.select("field", "rule").unionByName(kinds).groupBy("field", "rule").agg(F.count(F.lit(1)).alias("n"))
