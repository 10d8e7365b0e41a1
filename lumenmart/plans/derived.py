"""Views of the given tables in the engine's own vocabulary.

Each view is a list of (column, expression); the expression text runs unchanged
on Spark SQL and in the SQL twins, so both sides read the same rows. Every view
covers its base table whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumenmart.plans.registry import Tables

TARGET_COUNTRY = "EUROPE"
TARGET_CURRENCY = "EUR"
AS_OF = "1999-06-30"

_FIRST_DEFECT = (
    "case when l_discount >= 0.09 then case when l_quantity > 40 then 'cracks:critical' "
    "when l_quantity > 20 then 'electronic_damage:major' else 'fungus:major' end "
    "when l_discount >= 0.06 then case when l_quantity > 25 then 'scratches:minor' "
    "else 'cosmetic_damage:minor' end else null end"
)
_SECOND_DEFECT = (
    "case when l_linenumber = 3 then 'dust:moderate' when l_linenumber = 5 then 'cosmetic_damage:unknown' "
    "when l_linenumber = 7 and l_tax > 0.06 then 'bogus:minor' else null end"
)
_ACCESSORIES = (
    "case l_linenumber when 1 then 'Sony original NP-FZ100 battery|Sony original NP-FZ100 battery|Sony original NP-FZ100 battery' "
    "when 2 then 'SmallRig 3277 cage|NiSi ND64 filter|filter' "
    "when 3 then 'Brand#7 original grip|Sony original battery|Nikon original EN-EL15 battery|Lowepro BP450 bag|SmallRig 4X cage' "
    "when 4 then 'Tiffen ND8 filter|unknown strap' when 5 then 'Canon LC-E6 charger|Canon original LP-E6 battery' "
    "else null end"
)

OBS = [
    ("listing_id", "concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string))"),
    ("product_id", "cast(l_partkey as string)"),
    ("title", "p_name"),
    ("brand", "p_brand"),
    ("url", "concat('https://shop.example/', cast(l_orderkey as string), '/', cast(l_partkey as string))"),
    ("source", "concat('S', cast(l_suppkey % 10 as string))"),
    ("seller", "cast(l_suppkey as string)"),
    ("location", "n_name"),
    ("source_country", "r_name"),
    ("currency", "case when n_nationkey = 7 then 'USD' else 'EUR' end"),
    ("segment", "case when l_returnflag = 'N' then 'NEW' else 'USED' end"),
    ("price", "case when l_quantity = 50 then null else floor(l_extendedprice / l_quantity / 50) * cast(50 as double) end"),
    ("landed_cost", "case when l_discount >= 0.03 then floor(l_extendedprice / l_quantity * (cast(1 as double) + l_tax) * 4) / cast(4 as double) else null end"),
    ("shutter_count", "case when l_quantity < 48 then cast(l_quantity * 4000 as bigint) else null end"),
    ("condition", "case when l_linestatus = 'F' then 'Used' else 'unknown' end"),
    ("defects_text", f"concat_ws('|', {_FIRST_DEFECT}, {_SECOND_DEFECT})"),
    ("accessories_text", f"coalesce({_ACCESSORIES}, '')"),
    ("recognition_confidence", "cast(100 - 5 * (l_linenumber - 1) as int)"),
    ("description_confidence", "cast(100 - 2 * (l_linenumber - 1) as int)"),
    ("missing_count", "cast(l_linenumber % 4 as int)"),
    ("evidence_count", "cast(l_linenumber % 3 as int)"),
    ("warranty_clear", "l_tax > 0.02"),
    ("accessories_complete", "l_tax > 0.04"),
    ("contradictory", "l_tax = 0.08"),
    ("warranty_until", "case when l_tax > 0.02 then cast(l_shipdate as date) + cast(l_quantity * 20 - 200 as int) else null end"),
    ("invoice_available", "case when l_discount > 0.05 then true when l_discount < 0.02 then false else null end"),
    ("original_box_available", "case when l_quantity > 25 then true else false end"),
    ("return_days", "case when l_linenumber <= 2 then 30 when l_linenumber <= 4 then 14 when l_linenumber = 5 then 0 else null end"),
    ("transferable", "case when l_linenumber <= 3 then true else null end"),
    ("seller_score", "sqrt(abs(s_acctbal))"),
    ("category", "case when p_type in ('STANDARD', 'MEDIUM', 'PROMO') then 'Camera' when p_type = 'SMALL' then 'Cinema Lens' else 'Lens' end"),
    ("liquidity_score", "case when p_size = 50 then null else cast(p_size * 2 as double) end"),
    ("catalog_price_used", "p_retailprice"),
    ("observed_at", "l_shipdate"),
]

# Severe means: some defect of the list is major or critical.
SEVERE_SQL = "(defects_text like '%:major%' or defects_text like '%:critical%')"
MISSING_ITEMS = ["shutter count", "warranty status", "condition details"]


def _columns(spec) -> str:
    return ", ".join(f"{expression} as {name}" for name, expression in spec)


OBS_SQL = (
    f"select {_columns(OBS)} from lineitem join part on l_partkey = p_partkey "
    "join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey "
    "join region on n_regionkey = r_regionkey"
)


def observations(tables: Tables) -> DataFrame:
    """One listing observation per lineitem row, with nested facts as arrays."""
    places = tables.supplier.join(
        tables.nation.join(tables.region, F.col("n_regionkey") == F.col("r_regionkey")),
        F.col("s_nationkey") == F.col("n_nationkey"),
    )
    flat = (
        tables.wide("lineitem").join(tables.part, F.col("l_partkey") == F.col("p_partkey"))
        .join(places, F.col("l_suppkey") == F.col("s_suppkey"))
        .selectExpr(*[f"{expression} as {name}" for name, expression in OBS])
    )
    defect = lambda item: F.struct(
        F.split_part(item, F.lit(":"), F.lit(1)).alias("category"),
        F.concat(F.lit("reported "), F.split_part(item, F.lit(":"), F.lit(1))).alias("description"),
        F.split_part(item, F.lit(":"), F.lit(2)).alias("severity"),
        F.lit("body").alias("affected_component"),
        item.alias("source_text"),
        F.lit(0.95).alias("confidence"),
    )
    parts = lambda column: F.filter(F.split(column, r"\|"), lambda item: item != "")
    return (
        flat.withColumn("defects", F.transform(parts(F.col("defects_text")), defect))
        .withColumn("accessories", parts(F.col("accessories_text")))
        .withColumn(
            "missing_information",
            F.slice(F.array(*[F.lit(item) for item in MISSING_ITEMS]), 1, F.col("missing_count")),
        )
        .withColumn(
            "recognized_product_id",
            F.when(F.col("recognition_confidence") >= 75, F.col("product_id")),
        )
    )


# Orders not yet fulfilled act as watches, fulfilled ones as owned items.
WATCH_SQL = (
    "select cast(o_orderkey as string) as watch_id, cast(o_custkey as string) as product_id, "
    "case o_orderpriority when '1-URGENT' then 'NEW' when '2-HIGH' then 'USED' else 'EITHER' end as condition_preference, "
    "floor(o_totalprice / 25) / cast(4 as double) as max_price, "
    "case when o_orderpriority = '5-LOW' then 'USD' else 'EUR' end as currency, "
    "case o_orderpriority when '1-URGENT' then 'CRITICAL' when '2-HIGH' then 'HIGH' when '3-MEDIUM' then 'MEDIUM' else 'LOW' end as priority, "
    "o_orderstatus = 'O' as active, cast(o_orderdate as date) as created_on "
    "from orders where o_orderstatus <> 'F'"
)
OWNED_SQL = (
    "select cast(o_orderkey as string) as item_id, cast(o_custkey as string) as product_id, "
    "cast(o_orderdate as date) as purchase_date, o_totalprice as purchase_price, 'EUR' as currency, "
    "case o_orderpriority when '1-URGENT' then 'NEW' when '2-HIGH' then 'USED' else null end as condition_at_purchase, "
    "o_orderpriority <> '5-LOW' as active from orders where o_orderstatus = 'F'"
)
DECISION_SQL = (
    "select cast(o_orderkey as string) as entry_id, cast(o_custkey as string) as product_id, "
    "cast(o_orderdate as date) as created_on, "
    "case o_orderstatus when 'F' then 'BUY_USED' when 'O' then 'MONITOR' else 'PASS' end as decision, "
    "cast(floor(o_totalprice / 5000) as int) as decision_score, o_totalprice as observed_price from orders"
)
CATALOG_SQL = (
    "select cast(p_partkey as string) as product_id, p_name, p_brand as brand, p_name as model, "
    "case p_type when 'STANDARD' then 'II' when 'PROMO' then 'IV' else '' end as version, "
    "case when p_type in ('STANDARD', 'MEDIUM', 'PROMO') then 'Camera' when p_type = 'SMALL' then 'Cinema Lens' else 'Lens' end as category, "
    "case when p_type in ('ECONOMY', 'SMALL') then 'Zoom lens' when p_type = 'LARGE' then 'Prime lens' else 'Mirrorless' end as product_type, "
    "concat('mount-', cast(p_size % 10 as string)) as native_mount, cast(1980 + p_size as int) as release_year, "
    "p_size as focal_low, case when p_type in ('ECONOMY', 'SMALL') then p_size + 30 else p_size end as focal_high, "
    "p_retailprice as price_used from part"
)
HEALTH_SQL = (
    "select event_id, concat('source-', cast(user_id as string)) as source_id, ts as checked_at, "
    "case event_type when 'error' then 'FAILED' when 'signup' then 'DEGRADED' else 'HEALTHY' end as status, "
    "cast(floor(value * 10) as bigint) as response_time_ms, event_type, {count} as result_count from events"
)


def _view(tables: Tables, sql: str, *names: str) -> DataFrame:
    return tables.spark.sql(
        sql.replace(f" from {names[0]}", " from {base}"), base=getattr(tables, names[0])
    )


def watches(tables: Tables) -> DataFrame:
    return _view(tables, WATCH_SQL, "orders")


def owned(tables: Tables) -> DataFrame:
    return _view(tables, OWNED_SQL, "orders")


def decision_log(tables: Tables) -> DataFrame:
    return _view(tables, DECISION_SQL, "orders")


def catalog(tables: Tables) -> DataFrame:
    return _view(tables, CATALOG_SQL, "part")


SPARK_HEALTH = HEALTH_SQL.format(count="cast(get_json_object(props, '$.k') as bigint)")
DUCK_HEALTH = HEALTH_SQL.format(count="cast(json_extract_string(props, '$.k') as bigint)")


def source_health(tables: Tables) -> DataFrame:
    return _view(tables, SPARK_HEALTH, "events")
