"""Owned items, wishes and decisions: coverage, flags, lifecycle."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import Column, DataFrame, functions as F

from lumenmart.functions.text import folded

# Wishlist flags in their order, focal classes.
FLAGS = (
    "ALREADY_OWNED", "CONDITION_CONFLICT", "CURRENCY_CONFLICT", "TARGET_DATE_PASSED", "POSSIBLE_REDUNDANCY",
    "COMPLEMENTS_INVENTORY", "DUPLICATE_PRODUCT", "TARGET_PRICE_MISSING", "NONE",
)
FOCAL_CLASSES = ("ULTRA_WIDE", "STANDARD", "TELEPHOTO")
_FOCAL = r"(?i)(?<![\d.])(\d{1,3})(?:\s*[-–]\s*(\d{1,3}))?\s*mm\b"


def focal_classes(model: Column, zoom: Column) -> Column:
    """Focal classes a lens covers by its millimetres; null when they do not fit its kind."""
    low = F.regexp_extract(model, _FOCAL, 1).try_cast("int")
    second = F.nullif(F.regexp_extract(model, _FOCAL, 2), F.lit(""))
    high = F.coalesce(second.try_cast("int"), low)
    usable = low.isNotNull() & (second.isNotNull() == zoom) & (low <= high)
    return F.when(usable, F.array_compact(F.array(
        F.when(low < 24, F.lit("ULTRA_WIDE")), F.when((low <= 69) & (high >= 24), F.lit("STANDARD")), F.when(high >= 70, F.lit("TELEPHOTO")))))


def is_lens(category: Column, product_type: Column) -> Column:
    return F.contains(folded(category), F.lit("lens")) | F.contains(folded(product_type), F.lit("lens"))


def is_zoom(product_type: Column) -> Column:
    return F.contains(folded(product_type), F.lit("zoom"))


def model_family(brand: Column, model: Column) -> Column:
    """Brand and model without a trailing version numeral."""
    stem = F.regexp_replace(model, r"(?i)\b(?:i{1,3}|iv|v)\b$", "")
    return F.concat(folded(brand), F.lit(":"), F.trim(F.regexp_replace(folded(stem), r"\s+", " ")))


def coverage(owned: DataFrame, catalog: DataFrame) -> DataFrame:
    """(kind, value, product_id, copies): every class each active owned product covers.

    Long form, so an inventory of any size stays distributed.
    """
    active = owned.where("active").groupBy("product_id").agg(F.count(F.lit(1)).alias("copies"))
    rows = active.join(catalog, "product_id")
    category, kind = folded(F.col("category")), folded(F.col("product_type"))
    has = lambda column, word: F.contains(column, F.lit(word))
    lens = is_lens(F.col("category"), F.col("product_type"))
    classes = focal_classes(F.col("model"), is_zoom(F.col("product_type")))
    entry = lambda flag, label, value: F.when(flag, F.struct(F.lit(label).alias("kind"), value.alias("value")))
    cinema = has(category, "cinema lens") | has(kind, "cinema lens")
    singles = F.array_compact(F.array(
        entry(category == "camera", "camera", F.col("product_id")), entry(cinema, "cinema", F.col("product_id")),
        entry(~cinema & ~lens, "accessory", F.col("product_id")), entry(has(kind, "prime"), "prime", F.col("product_id")),
        entry(has(kind, "zoom"), "zoom", F.col("product_id")), entry(F.col("copies") > 1, "duplicate", F.col("product_id")),
        entry(F.lit(True), "family", model_family(F.col("brand"), F.col("model"))),
        entry(lens & classes.isNull(), "unknown focal", F.col("product_id"))))
    focal = F.when(lens & classes.isNotNull(), F.transform(classes, lambda name: F.struct(F.lit("focal").alias("kind"), name.alias("value"))))
    entries = F.concat(singles, F.coalesce(focal, F.array().cast("array<struct<kind:string,value:string>>")))
    return rows.select("product_id", "copies", F.explode(entries).alias("e")).select("e.kind", "e.value", "product_id", "copies")


def covered_classes(covered: DataFrame) -> tuple[set[str], set[str]]:
    """(focal classes owned, shapes owned): at most three and two values reach the driver."""
    found = covered.where("kind in ('focal', 'zoom', 'prime')").select(
        F.when(F.col("kind") == "focal", F.col("value")).otherwise(F.col("kind")).alias("name")).distinct().collect()
    names = {row["name"] for row in found}
    return names & set(FOCAL_CLASSES), names & {"zoom", "prime"}


def wishlist_flags(
    wishes: DataFrame, owned: DataFrame, catalog: DataFrame, as_of: Column,
    preferred_condition: str = "EITHER", preferred_currency: Optional[str] = None,
) -> DataFrame:
    """Active wishes with their context flags in the fixed order."""
    focal_owned, shapes = covered_classes(coverage(owned, catalog))
    active = wishes.where("active")
    owned_ids = owned.where("active").select("product_id").distinct().withColumn("owned", F.lit(True))
    conditions = active.groupBy("product_id").agg(F.collect_set("condition_preference").alias("conditions"))
    rows = (
        active.join(catalog.select("product_id", "category", "product_type", "model"), "product_id", "left")
        .join(owned_ids, "product_id", "left").join(conditions, "product_id", "left")
    )
    zoom = is_zoom(F.col("product_type"))
    wanted = F.when(is_lens(F.col("category"), F.col("product_type")), focal_classes(F.col("model"), zoom))
    have = F.array(*[F.lit(name) for name in sorted(focal_owned)]).cast("array<string>")
    same_shape = F.when(zoom, F.lit("zoom" in shapes)).otherwise(F.lit("prime" in shapes))
    conflict = F.lit(preferred_condition != "EITHER") & ~F.col("condition_preference").isin(preferred_condition, "EITHER")
    foreign = F.lit(preferred_currency is not None) & (F.col("currency") != F.lit(preferred_currency))
    tests = {
        "ALREADY_OWNED": F.col("owned"),
        "CONDITION_CONFLICT": conflict,
        "CURRENCY_CONFLICT": foreign,
        "TARGET_DATE_PASSED": F.col("target_date") < as_of,
        "POSSIBLE_REDUNDANCY": F.arrays_overlap(wanted, have) & same_shape,
        "COMPLEMENTS_INVENTORY": F.size(F.array_except(wanted, have)) > 0,
        "DUPLICATE_PRODUCT": F.size("conditions") > 1,
        "TARGET_PRICE_MISSING": F.col("target_price").isNull(),
    }
    flags = F.array_compact(F.array(*[F.when(F.coalesce(tests[name], F.lit(False)), F.lit(name)) for name in FLAGS[:-1]]))
    return rows.withColumn("flags", F.when(F.size(flags) == 0, F.array(F.lit("NONE"))).otherwise(flags)).select(*wishes.columns, "flags")


def close_purchased(wishes: DataFrame, purchases: DataFrame, updated_at: Column) -> DataFrame:
    """Active wishes met by a purchase become PURCHASED.

    A wish for EITHER closes on any purchase; others on the same condition. The
    purchases shrink to one row per product first, so the join cannot multiply.
    """
    bought = purchases.groupBy("product_id").agg(F.collect_set("condition_at_purchase").alias("bought"))
    rows = wishes.join(bought, "product_id", "left")
    met = (F.col("status") == "ACTIVE") & F.col("bought").isNotNull() & (
        (F.col("condition_preference") == "EITHER") | F.array_contains("bought", F.col("condition_preference")))
    closes = F.coalesce(met, F.lit(False))
    return rows.withColumn("status", F.when(closes, "PURCHASED").otherwise(F.col("status"))).withColumn(
        "updated_at", F.when(closes, updated_at).otherwise(F.col("updated_at"))).select(*wishes.columns)


def record_items(inventory: DataFrame, purchases: DataFrame) -> DataFrame:
    """Inventory with purchased rows replacing those of the same id."""
    return inventory.join(purchases.select("item_id"), "item_id", "left_anti").unionByName(purchases)


def latest_decisions(log: DataFrame, at: str = "created_on") -> DataFrame:
    """Last decision per product."""
    return log.groupBy("product_id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "product_id"]), F.struct(at, "entry_id")).alias("row")).select("product_id", "row.*")


def recent_decisions(log: DataFrame, limit: int = 20, at: str = "created_on") -> DataFrame:
    """The newest decisions (a top-k report)."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    return log.orderBy(F.desc(at), F.desc("entry_id")).limit(limit)


def user_context(owned: DataFrame, wishes: DataFrame, log: DataFrame, catalog: DataFrame, flagged: DataFrame, target_country: Optional[str]) -> DataFrame:
    """One row of counts and gap flags about the user's tables."""
    covered = coverage(owned, catalog)
    one = F.lit(1).alias("one")  # every side below is a single aggregate row under one key
    summary = covered.groupBy(one).agg(
        F.max(F.when(F.col("kind") == "zoom", 1).otherwise(0)).alias("zooms"),
        F.max(F.when((F.col("kind") == "focal") & (F.col("value") == "STANDARD"), 1).otherwise(0)).alias("standard"),
        F.max(F.when(F.col("kind") == "duplicate", 1).otherwise(0)).alias("duplicates"))
    again = flagged.groupBy(one).agg(F.max(F.array_contains("flags", "ALREADY_OWNED").cast("int")).alias("again"))
    joined = owned.groupBy(one).agg(F.count_if("active").alias("active_items"))
    for side in (
        wishes.groupBy(one).agg(F.count_if("active").alias("active_wishes")), log.groupBy(one).agg(F.count(F.lit(1)).alias("decisions")), summary, again
    ):
        joined = joined.join(side, "one", "full_outer")
    joined = joined.fillna(0)
    gaps = F.array_compact(F.array(
        F.when(F.lit(not target_country), F.lit("target market missing")),
        F.when((F.coalesce("zooms", F.lit(0)) == 0) | (F.coalesce("standard", F.lit(0)) == 0), F.lit("no standard zoom owned")),
        F.when(F.col("duplicates") == 1, F.lit("duplicate products owned")),
        F.when(F.col("again") == 1, F.lit("wishlist product already owned"))))
    return joined.select("active_items", "active_wishes", "decisions", gaps.alias("gaps"))
