"""User-table and serving queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumenmart.operators import memory, serve
from lumenmart.plans import derived
from lumenmart.plans.derived import AS_OF, CATALOG_SQL, DECISION_SQL, OWNED_SQL, WATCH_SQL
from lumenmart.plans.market_queries import _SNAPSHOT, market_snapshots
from lumenmart.plans.registry import Tables, query

_LENSES_SQL = (
    f"catalog as materialized (select *, case when category = 'Camera' then p_name else concat(p_name, ' ', case when focal_high > focal_low then concat(cast(focal_low as varchar), '-', cast(focal_high as varchar)) "
    f"else cast(focal_low as varchar) end, 'mm') end as lens_model, category <> 'Camera' as lens, contains(product_type, 'Zoom') as zoom from ({CATALOG_SQL}))"
)


def lens_catalog(tables: Tables) -> DataFrame:
    """Catalog whose lens models name their focal lengths."""
    reach = F.when(F.col("focal_high") > F.col("focal_low"), F.concat_ws("-", F.col("focal_low").cast("string"), F.col("focal_high").cast("string"))).otherwise(F.col("focal_low").cast("string"))
    model = F.when(F.col("category") == "Camera", F.col("p_name")).otherwise(F.concat(F.col("p_name"), F.lit(" "), reach, F.lit("mm")))
    return derived.catalog(tables).withColumn("model", model)


@query(
    "inventory_coverage",
    f"""with {_LENSES_SQL}, items as (select product_id, count(*) as copies from ({OWNED_SQL}) where active group by product_id),
rows as (select catalog.*, copies from items join catalog on items.product_id = catalog.product_id),
entries as (
  select 'camera' as kind, product_id as value from rows where category = 'Camera' union all select 'cinema', product_id from rows where category = 'Cinema Lens'
  union all select 'accessory', product_id from rows where not lens union all select 'prime', product_id from rows where contains(product_type, 'Prime')
  union all select 'zoom', product_id from rows where zoom union all select 'duplicate', product_id from rows where copies > 1
  union all select 'family', concat(lower(brand), ':', lens_model) from rows
  union all select 'focal', 'ULTRA_WIDE' from rows where lens and focal_low < 24 union all select 'focal', 'STANDARD' from rows where lens and focal_low <= 69 and focal_high >= 24
  union all select 'focal', 'TELEPHOTO' from rows where lens and focal_high >= 70)
select kind, value, count(*) as products from entries group by all""",
)
def inventory_coverage(tables: Tables) -> DataFrame:
    """Classes, families and focal ranges the active inventory covers."""
    covered = memory.coverage(derived.owned(tables), lens_catalog(tables))
    return covered.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("products"))


def wishes(tables: Tables) -> DataFrame:
    rows = derived.watches(tables)
    return rows.withColumn("target_price", F.when(F.col("priority") != "CRITICAL", F.col("max_price"))).withColumn("target_date", F.col("created_on"))


@query(
    "wishlist_flags",
    f"""with {_LENSES_SQL}, wishes as (select *, case when priority <> 'CRITICAL' then max_price end as target_price from ({WATCH_SQL}) where active),
owned as (select distinct product_id from ({OWNED_SQL}) where active),
held as (select * from owned join catalog using (product_id)),
has as (select bool_or(lens and focal_low < 24) as wide, bool_or(lens and focal_low <= 69 and focal_high >= 24) as standard, bool_or(lens and focal_high >= 70) as tele,
   bool_or(zoom) as zooms, bool_or(contains(product_type, 'Prime')) as primes from held),
kinds as (select product_id, count(distinct condition_preference) as n from wishes group by product_id),
rows as (select w.*, c.lens, c.zoom, c.focal_low < 24 as w_wide, c.focal_low <= 69 and c.focal_high >= 24 as w_standard, c.focal_high >= 70 as w_tele, o.product_id is not null as is_owned, n, has.*
  from wishes w left join catalog c using (product_id) left join owned o using (product_id) left join kinds using (product_id), has),
flagged as (select watch_id, concat_ws(',', case when is_owned then 'ALREADY_OWNED' end, case when condition_preference = 'NEW' then 'CONDITION_CONFLICT' end,
  case when currency <> 'EUR' then 'CURRENCY_CONFLICT' end, case when created_on < date '{AS_OF}' then 'TARGET_DATE_PASSED' end,
  case when lens and ((w_wide and wide) or (w_standard and standard) or (w_tele and tele)) and (case when zoom then zooms else primes end) then 'POSSIBLE_REDUNDANCY' end,
  case when lens and ((w_wide and not wide) or (w_standard and not standard) or (w_tele and not tele)) then 'COMPLEMENTS_INVENTORY' end,
  case when n > 1 then 'DUPLICATE_PRODUCT' end, case when target_price is null then 'TARGET_PRICE_MISSING' end) as flags from rows)
select watch_id, case when flags = '' then 'NONE' else flags end as flags from flagged""",
)
def wishlist_flags(tables: Tables) -> DataFrame:
    """Context flags of every active wish against inventory and preferences."""
    flagged = memory.wishlist_flags(
        wishes(tables), derived.owned(tables), lens_catalog(tables), F.lit(AS_OF).cast("date"), preferred_condition="USED", preferred_currency="EUR")
    return flagged.select("watch_id", F.array_join("flags", ",").alias("flags"))


@query(
    "purchase_closes_watch",
    f"""with bought as (select distinct product_id, condition_at_purchase as c from ({OWNED_SQL})),
closed as (select watch_id from ({WATCH_SQL}) w where active and exists (select 1 from bought b where b.product_id = w.product_id and (w.condition_preference = 'EITHER' or b.c = w.condition_preference)))
select w.watch_id, case when closed.watch_id is not null then 'PURCHASED' when active then 'ACTIVE' else 'PAUSED' end as status from ({WATCH_SQL}) w left join closed on closed.watch_id = w.watch_id""",
)
def purchase_closes_watch(tables: Tables) -> DataFrame:
    """Wishes closed by what was bought in the meantime."""
    rows = derived.watches(tables).withColumn("status", F.when(F.col("active"), "ACTIVE").otherwise("PAUSED")).withColumn("updated_at", F.col("created_on"))
    return memory.close_purchased(rows, derived.owned(tables), F.lit(AS_OF).cast("date")).select("watch_id", "status")


@query(
    "latest_decision",
    f"select product_id, entry_id, decision, decision_score from (select *, row_number() over (partition by product_id order by created_on desc, entry_id desc) as rn from ({DECISION_SQL})) where rn = 1",
)
def latest_decision(tables: Tables) -> DataFrame:
    """Last decision of every product."""
    return memory.latest_decisions(derived.decision_log(tables)).select("product_id", "entry_id", "decision", "decision_score")


@query("recent_decisions", f"select entry_id, product_id, decision from ({DECISION_SQL}) order by created_on desc, entry_id desc limit 20")
def recent_decisions(tables: Tables) -> DataFrame:
    """The twenty newest decisions, a top-k report."""
    return memory.recent_decisions(derived.decision_log(tables)).select("entry_id", "product_id", "decision")


SEARCH = "red gear iv"


@query(
    "product_search",
    f"""with catalog as ({CATALOG_SQL}), fields as (select product_id, brand, model, version, lower(p_name) as name,
   [product_id, lower(brand), lower(model), lower(version), lower(category), lower(product_type), replace(native_mount, '-', ' '), lower(p_name)] as f from catalog),
hit as (select *, list_bool_and(list_transform(['red', 'gear', 'iv'], lambda t: list_bool_or(list_transform(f, lambda x: contains(x, t) or contains(regexp_replace(x, '[^a-z0-9]', '', 'g'), t))))) as ok from fields),
points as (select *, list_sum(list_transform(['red', 'gear', 'iv'], lambda t: coalesce(list_max(list_transform(f, lambda x: case when starts_with(x, t) then 50
    when regexp_matches(x, concat('\\b', t, '\\b')) then 35 when contains(x, t) then 20 end)), 0))) as term_points from hit where ok)
select product_id, cast(term_points + case when lower(version) = 'iv' then 60 when lower(version) in ('ii', 'iii', 'v') then -80 else -30 end
   + case when contains('red gear iv', lower(brand)) and contains('red gear iv', string_split(lower(model), ' ')[1]) then 20 else 0 end
   + case when regexp_replace(lower(concat_ws(' ', brand, model, nullif(version, ''))), '[^a-z0-9]', '', 'g') = 'redgeariv' then 100 else 0 end as bigint) as search_score from points""",
)
def product_search(tables: Tables) -> DataFrame:
    """Relevance search over the catalog, best first."""
    products = derived.catalog(tables).withColumn("aliases", F.array("p_name"))
    found = serve.sort_products(serve.search(products, SEARCH), "relevance")
    return found.select("product_id", F.col("search_score").cast("long").alias("search_score"))


@query(
    "facets",
    f"""with catalog as ({CATALOG_SQL}) select facet, value, count(*) as products from (select 'category' as facet, category as value from catalog
  union all select 'brand', brand from catalog union all select 'mount', native_mount from catalog) group by all""",
)
def facets(tables: Tables) -> DataFrame:
    """Distinct categories, brands and mounts with their product counts."""
    return serve.facets(derived.catalog(tables))


@query(
    "product_view",
    f"""with recursive {_SNAPSHOT}, catalog as ({CATALOG_SQL}),
wish as (select product_id, arg_max(priority, watch_id) as wishlist_priority, arg_max(max_price, watch_id) as target_price from ({WATCH_SQL}) where active group by product_id),
have as (select distinct product_id from ({OWNED_SQL}) where active),
last as (select product_id, decision from (select *, row_number() over (partition by product_id order by created_on desc, entry_id desc) as rn from ({DECISION_SQL})) where rn = 1),
per as (select product_id, currency, max(median_price) filter (where segment = 'NEW') as new_median, max(median_price) filter (where segment = 'USED') as used_median,
   count(distinct segment) as n, min(market_confidence) as market_confidence from snap group by product_id, currency),
chosen as (select * from (select *, row_number() over (partition by product_id order by case when n = 2 then 0 else 1 end, currency) as rn from per) where rn = 1)
select catalog.product_id, concat_ws(' ', brand, model, nullif(version, '')) as display_name, p_name as aliases, have.product_id is not null as owned, wish.product_id is not null as wishlist,
  wishlist_priority, round(target_price, 2) as target_price, last.decision as latest_decision, round(new_median, 4) as new_median, round(used_median, 4) as used_median, chosen.currency as market_currency, market_confidence
from catalog left join wish using (product_id) left join have using (product_id) left join last using (product_id) left join chosen using (product_id)""",
)
def product_view(tables: Tables) -> DataFrame:
    """Wide serving row of every product."""
    catalog = derived.catalog(tables)
    aliases = catalog.select("product_id", F.col("p_name").alias("alias"))
    latest = memory.latest_decisions(derived.decision_log(tables))
    view = serve.product_view(catalog, aliases, derived.owned(tables), derived.watches(tables), latest, tables.shared("snapshots", market_snapshots))
    return view.select(
        "product_id", "display_name", F.array_join("aliases", ",").alias("aliases"), "owned", "wishlist", "wishlist_priority",
        F.round("target_price", 2).alias("target_price"), "latest_decision", F.round("new_median", 4).alias("new_median"),
        F.round("used_median", 4).alias("used_median"), "market_currency", "market_confidence")


@query(
    "product_sort",
    f"with catalog as ({CATALOG_SQL}) select product_id, release_year, price_used from catalog where category = 'Camera' order by release_year desc nulls last, product_id desc",
)
def product_sort(tables: Tables) -> DataFrame:
    """Cameras, newest first."""
    rows = serve.filter_products(derived.catalog(tables), category="camera")
    return serve.sort_products(rows, "newest", descending=True).select("product_id", "release_year", "price_used")
