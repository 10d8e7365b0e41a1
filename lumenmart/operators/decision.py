"""Purchase decision per listing: factors, scores, confidence, recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenmart.operators.market import clamp, condition_unknown, half_even

# Domains of a reported defect.
DEFECT_CATEGORIES = (
    "cosmetic_damage", "optical_damage", "mechanical_damage", "electronic_damage", "fungus", "haze",
    "scratches", "cracks", "dust", "missing_parts", "water_damage", "unknown",
)
DEFECT_SEVERITIES = ("minor", "moderate", "major", "critical", "unknown")
# Defect families and points per severity.
OPTICAL_FAMILY = ("optical_damage", "fungus", "haze", "scratches", "cracks", "water_damage")
SEVERITY_POINTS = {
    "cosmetic": {"minor": -3, "moderate": -8, "major": -15, "critical": -30},
    "optical": {"minor": -25, "moderate": -30, "major": -40, "critical": -50},
    "dust": {"minor": -2, "moderate": -5, "major": -12, "critical": -25},
    "other": {"minor": -5, "moderate": -12, "major": -20, "critical": -30},
}
UNKNOWN_DEFECT_POINTS = -5
# Accessory brands that count as identifiable.
ACCESSORY_BRANDS = (
    "sony", "nikon", "canon", "panasonic", "sigma", "tamron", "smallrig",
    "nisi", "hoya", "tiffen", "b+w", "dji", "manfrotto", "lowepro",
)
ACCESSORY_TOTAL_CAP = 12
BATTERY_CAP = 6

FOLD_STATE = "struct<points:int,review:boolean,pass:boolean,severe:boolean>"
FACTOR = "struct<name:string,category:string,score_impact:int>"
DEFECT_ARRAY = (
    "array<struct<category:string,description:string,severity:string,"
    "affected_component:string,source_text:string,confidence:double>>"
)


def defects_or_empty(column: str = "defects") -> Column:
    return F.coalesce(F.col(column), F.array().cast(DEFECT_ARRAY))


def strings_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


def defect_invalid(defect: Column) -> Column:
    """True unless category, severity, description and confidence are all usable."""
    usable = (
        defect["category"].isin(*DEFECT_CATEGORIES)
        & defect["severity"].isin(*DEFECT_SEVERITIES)
        & (F.trim(defect["description"]) != "")
        & defect["confidence"].between(0, 1)
    )
    return ~F.coalesce(usable, F.lit(False))


def any_invalid_defect(column: str = "defects") -> Column:
    return F.exists(defects_or_empty(column), defect_invalid)


def defect_points(defect: Column) -> Column:
    """Score points of one valid defect."""
    def table(name: str) -> Column:
        expression = F.lit(None).cast("int")
        for severity, points in SEVERITY_POINTS[name].items():
            expression = F.when(defect["severity"] == severity, points).otherwise(expression)
        return expression

    unknown = (defect["category"] == "unknown") | (defect["severity"] == "unknown")
    return (
        F.when(defect_invalid(defect), 0)
        .when(unknown, UNKNOWN_DEFECT_POINTS)
        .when(defect["category"] == "cosmetic_damage", table("cosmetic"))
        .when(defect["category"].isin(*OPTICAL_FAMILY), table("optical"))
        .when(defect["category"] == "dust", table("dust"))
        .otherwise(table("other"))
    )


def defect_fold(column: str = "defects") -> Column:
    """Ordered fold of the defects; a later defect may clear an earlier flag."""
    start = F.struct(
        F.lit(0).alias("points"), F.lit(False).alias("review"), F.lit(False).alias("pass"), F.lit(False).alias("severe")
    )

    def step(state: Column, defect: Column) -> Column:
        invalid = defect_invalid(defect)
        critical = defect["severity"] == "critical"
        unknown = (defect["category"] == "unknown") | (defect["severity"] == "unknown")
        optical = defect["category"].isin(*OPTICAL_FAMILY)
        review = (
            F.when(invalid | unknown, True)
            .when(defect["category"] == "cosmetic_damage", critical)
            .when(optical, True)
            .otherwise(state["review"] | critical)
        )
        must_pass = F.when(~invalid & ~unknown & optical, critical).otherwise(state["pass"])
        severe = state["severe"] | (~invalid & defect["severity"].isin("major", "critical"))
        return F.struct(
            (state["points"] + defect_points(defect)).alias("points"),
            review.alias("review"), must_pass.alias("pass"), severe.alias("severe"),
        )

    return F.aggregate(defects_or_empty(column), start, step)


def accessory_points(accessories: Column, brand: Column) -> Column:
    """Applied points per accessory, in order, under the total and battery caps."""
    brands = "|".join(brand_name.replace("+", r"\+") for brand_name in ACCESSORY_BRANDS)

    def verified(text: Column, kind: str) -> Column:
        model = F.replace(text, F.lit(kind), F.lit(" ")).rlike(r"\b(?=\w*[a-z])(?=\w*\d)[a-z0-9+.-]+\b")
        return text.rlike(rf"\b(?:{brands})\b") & model

    def step(state: Column, item: Column) -> Column:
        text = F.lower(item)
        battery = text.contains("original") & text.contains("battery") & (state["battery"] < BATTERY_CAP)
        offered = (
            F.when(battery, F.least(F.lit(3), BATTERY_CAP - state["battery"]))
            .when(text.contains("grip") & text.contains("original") & text.contains(F.lower(brand)), 5)
            .when(text.contains("filter"), F.when(verified(text, "filter"), 2).otherwise(0))
            .when(text.contains("cage") & verified(text, "cage"), 3)
            .when(text.contains("charger") & verified(text, "charger"), 2)
            .when(text.contains("bag") & verified(text, "bag"), 1)
            .otherwise(0)
        )
        applied = F.least(offered, F.greatest(F.lit(0), ACCESSORY_TOTAL_CAP - state["total"]))
        return F.struct(
            (state["total"] + applied).alias("total"),
            (state["battery"] + F.when(battery, offered).otherwise(0)).alias("battery"),
            F.concat(state["applied"], F.array(applied)).alias("applied"),
        )

    start = F.struct(
        F.lit(0).alias("total"), F.lit(0).alias("battery"), F.array().cast("array<int>").alias("applied")
    )
    return F.aggregate(accessories, start, step, lambda state: state["applied"])


def warranty_date(text: Column) -> Column:
    """ISO date, or month name and year taken as day 28."""
    month = F.try_to_timestamp(F.concat(F.lit("28 "), text), F.lit("d MMMM yyyy")).cast("date")
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"), month)


def warranty_months_left(until: Column, as_of: Column) -> Column:
    """Calendar months between two dates, ignoring the day of the month."""
    return (F.year(until) - F.year(as_of)) * 12 + F.month(until) - F.month(as_of)


def shutter_points(count: Column) -> Column:
    return (
        F.when(count < 10_000, 5).when(count < 40_000, 2).when(count < 80_000, -5)
        .when(count < 150_000, -12).otherwise(-25)
    )


def price_points(difference: Column) -> Column:
    """Points for the percentage below (positive) or above the used median."""
    return (
        F.when(difference >= 20, 25).when(difference >= 10, 15).when(difference > 5, 7)
        .when(difference >= -5, 0).when(difference > -10, -8).when(difference > -20, -18).otherwise(-30)
    )


def resale_band(liquidity: Column) -> Column:
    return F.when(liquidity.isNotNull(), F.when(liquidity >= 80, 90).when(liquidity >= 60, 75).when(liquidity >= 40, 55).otherwise(30))


def wait_probability(price, lowest, trend, sample, replacement) -> Column:
    """Chance that waiting pays; unknown below three samples."""
    trend_part = (
        F.when(trend < 0, F.least(F.lit(30.0), F.abs(trend) * 2))
        .when(trend > 0, -F.least(F.lit(15.0), trend)).otherwise(0.0)
    )
    raw = (
        F.lit(25.0) + F.coalesce(trend_part, F.lit(0.0))
        - F.when(price < lowest, 15.0).otherwise(0.0)
        + F.when(replacement, 15.0).otherwise(0.0)
    )
    return F.when(sample >= 3, half_even(clamp(raw)))


def score_band(score: Column) -> Column:
    return F.when(score >= 75, "BUY_USED").when(score >= 60, "NEGOTIATE").when(score >= 45, "MONITOR").otherwise("PASS")


def same_currency(left: Column, right: Column) -> Column:
    return F.coalesce((left != "") & (F.lower(left) == F.lower(right)), F.lit(False))


def best_new_offers(offers: DataFrame) -> DataFrame:
    """Most certain, then cheapest NEW offer per product and currency.

    A minimum over a struct combines map-side, so one hot product costs no more
    than one partial row per task.
    """
    rank = offer_rank()
    payload = F.struct("listing_id", "price", "currency", "warranty_until", "observed_at")
    return (
        offers.where("segment = 'NEW'")
        .groupBy("product_id", F.col("currency").alias("offer_currency"))
        .agg(F.min_by(payload, rank).alias("offer"))
        .select(
            "product_id", "offer_currency",
            F.col("offer.listing_id").alias("new_listing_id"),
            F.col("offer.price").alias("new_price"),
            F.coalesce(warranty_months(F.col("offer.warranty_until"), F.to_date("offer.observed_at")), F.lit(0)).alias("new_warranty_months"),
        )
    )


def offer_rank() -> Column:
    """Sort key of an offer: certainty first, then price, then freshness."""
    return F.struct(
        -F.col("recognition_confidence"), -F.col("description_confidence"),
        F.coalesce(F.col("price"), F.lit(float("inf"))),
        -F.unix_micros(F.col("observed_at").cast("timestamp")), F.col("listing_id"),
    )


def warranty_months(until: Column, on: Column) -> Column:
    """Started 30-day months of warranty left, not below zero; unknown stays null."""
    return F.when(until.isNotNull(), F.greatest(F.lit(0), F.ceil(F.datediff(until, on) / 30))).cast("int")


def with_market(listings: DataFrame, snapshots: DataFrame, offers: DataFrame) -> DataFrame:
    """Join each listing with its USED and NEW market and the best NEW offer."""
    trend = F.col("trend_30d") if "trend_30d" in snapshots.columns else F.lit(None).cast("double")
    wide = snapshots.groupBy("product_id", "currency").agg(
        F.max(F.when(F.col("segment") == "USED", F.struct("median_price", "lowest_price", "valid_sample_size", trend.alias("trend_30d")))).alias("used"),
        F.max(F.when(F.col("segment") == "NEW", F.struct("median_price"))).alias("new"),
    ).select(
        "product_id", "currency", F.lit(True).alias("has_market"),
        F.col("used.median_price").alias("used_median"), F.col("used.lowest_price").alias("used_lowest"),
        F.coalesce("used.valid_sample_size", F.lit(0)).alias("market_samples"), F.col("used.trend_30d").alias("used_trend"),
        F.col("new.median_price").alias("new_median"), F.lit(None).cast("boolean").alias("replacement_released"),
    )
    best = best_new_offers(offers).withColumnRenamed("offer_currency", "currency")
    joined = listings.join(wide, ["product_id", "currency"], "left").join(best, ["product_id", "currency"], "left")
    offered = (F.col("segment") == "USED") & F.col("new_price").isNotNull()
    return (
        joined.withColumn("alternative_price", F.when(offered, F.col("new_price")))
        .withColumn("alternative_currency", F.when(offered, F.col("currency")))
        .withColumn("alternative_warranty", F.when(offered, F.col("new_warranty_months")))
        .withColumn("market_currency", F.when(F.col("has_market"), F.col("currency")))
        .withColumn("as_of", F.to_date("observed_at"))
    )


def evaluate(rows: DataFrame) -> DataFrame:
    """Add decision columns to listings joined with their market (``with_market``).

    Reads category, brand, liquidity_score, catalog_price_used, price, currency,
    condition, shutter_count, warranty_until, as_of, document flags, accessories,
    defects, the market columns and the alternative columns.
    """
    camera = F.lower("category") == "camera"
    usable = F.coalesce(F.col("has_market"), F.lit(False)) & same_currency(F.col("currency"), F.col("market_currency"))
    difference = (F.col("used_median") - F.col("price")) / F.col("used_median") * 100
    priced = usable & F.col("price").isNotNull() & (F.col("used_median") > 0)
    rows = (
        rows.withColumn("market_usable", usable)
        .withColumn("price_points", F.when(priced, price_points(difference)))
        .withColumn("condition_missing", condition_unknown(F.col("condition")))
        .withColumn("defect_state", defect_fold())
        .withColumn("shutter_points", F.when(camera & F.col("shutter_count").isNotNull(), shutter_points(F.col("shutter_count"))))
        .withColumn("warranty_active", F.coalesce(F.col("warranty_until") > F.col("as_of"), F.lit(False)))
        .withColumn("warranty_missing", F.col("warranty_until").isNull())
        .withColumn("warranty_points", F.when(
            F.col("warranty_active"),
            F.when(warranty_months_left(F.col("warranty_until"), F.col("as_of")) >= 12, 8).otherwise(4)).otherwise(0))
        .withColumn("accessory_points", accessory_points(strings_or_empty("accessories"), F.col("brand")))
        .withColumn("accessory_bonus", F.aggregate("accessory_points", F.lit(0), lambda total, item: total + item))
        .withColumn("defect_invalid", any_invalid_defect())
    )
    documents = F.when(F.col("invoice_available"), 3).otherwise(0) + F.when(F.col("original_box_available"), 2).otherwise(0)
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    condition_points = F.when(F.col("condition_missing"), -5).otherwise(0)
    total = (
        zero("price_points") + condition_points + F.col("defect_state.points") + zero("shutter_points")
        + F.col("warranty_points") + documents + F.col("accessory_bonus")
    )
    negatives = -condition_points - F.col("defect_state.points") - F.least(F.lit(0), zero("shutter_points"))
    deductions = [
        (~F.col("market_usable"), 25),
        (F.col("market_usable") & (F.col("market_samples") < 5), 10),
        (F.col("condition_missing"), 15),
        (F.col("warranty_missing"), 10),
        (camera & F.col("shutter_count").isNull(), 10),
        (F.exists(defects_or_empty(), lambda d: d["severity"] == "unknown"), 15),
        (F.col("liquidity_score").isNull(), 10),
        (F.col("price").isNull(), 30),
    ]
    confidence = F.lit(100)
    for flag, points in deductions:
        confidence = confidence - F.when(flag, points).otherwise(0)
    confidence = F.greatest(F.lit(10), F.least(F.lit(100), confidence))
    comparable = same_currency(F.col("currency"), F.col("alternative_currency"))
    has_alternative = F.col("alternative_price").isNotNull()
    confidence = F.when(has_alternative & ~comparable, F.greatest(F.lit(10), confidence - 15)).otherwise(confidence)
    rows = (
        rows.withColumn("buy_score", clamp(50 + total))
        .withColumn("risk_score", clamp(negatives))
        .withColumn("confidence", F.when(F.col("defect_invalid"), F.least(confidence, F.lit(35))).otherwise(confidence))
        .withColumn("alternative_usable", has_alternative & comparable & F.col("price").isNotNull() & (F.col("alternative_price") > 0))
        .withColumn("estimated_used_advantage", F.when(F.col("alternative_usable"), F.col("alternative_price") - F.col("price")))
        .withColumn("new_vs_used", F.when(F.col("alternative_usable"), _new_vs_used()).otherwise("INSUFFICIENT_DATA"))
    )
    band = score_band(F.col("buy_score"))
    chosen = (
        F.when(camera & (F.col("shutter_count") >= 150_000), "MANUAL_REVIEW")
        .when(F.col("price").isNull(), "INSUFFICIENT_DATA")
        .when(F.col("defect_state.pass"), "PASS")
        .when(F.col("defect_state.review") | F.col("defect_invalid"), "MANUAL_REVIEW")
        .when(F.col("new_vs_used").isin("BUY_NEW", "BUY_USED"), F.col("new_vs_used"))
        .when(~F.col("market_usable") & ~has_alternative, "INSUFFICIENT_DATA")
        .otherwise(band)
    )
    owning = zero("price_points") + F.col("warranty_points") + documents + F.col("accessory_bonus")
    return (
        rows.withColumn("recommendation", chosen)
        .withColumn("fair_price", F.when(F.col("market_usable") & (F.col("used_median") > 0), F.col("used_median")).otherwise(F.col("catalog_price_used")))
        .withColumn("ownership_cost_score", F.when(F.col("market_usable") | has_alternative, clamp(50 + owning)))
        .withColumn("resale_score", resale_band(F.col("liquidity_score")))
        .withColumn("wait_probability", F.when(F.col("market_usable"), wait_probability(
            F.col("price"), F.col("used_lowest"), F.col("used_trend"), F.col("market_samples"), F.col("replacement_released"))))
        .withColumn("factors", _factors())
        .withColumn("missing_information", F.array_distinct(F.concat(
            strings_or_empty("missing_information"),
            F.when(F.col("condition_missing"), F.array(F.lit("condition details"))).otherwise(F.array().cast("array<string>")),
            F.when(F.col("warranty_missing"), F.array(F.lit("warranty status"))).otherwise(F.array().cast("array<string>")),
        )))
        .withColumn("warnings", F.array_compact(F.array(
            F.when(F.coalesce(F.col("has_market"), F.lit(False)) & ~F.col("market_usable"), F.lit("market currency differs")),
            F.when(F.col("warranty_missing"), F.lit("warranty unknown")),
            F.when(F.col("defect_invalid"), F.lit("invalid defect data")),
            F.when(has_alternative & ~comparable, F.lit("alternative currency differs")),
            F.when(camera & (F.col("shutter_count") >= 150_000), F.lit("very high shutter count")),
        )))
    )


def _new_vs_used() -> Column:
    """Rule per discount band of the used price against the new alternative."""
    discount = (F.col("alternative_price") - F.col("price")) / F.col("alternative_price") * 100
    shutter_at_least = lambda limit: F.coalesce(F.col("shutter_count") >= limit, F.lit(False))
    active, bonus, severe = F.col("warranty_active"), F.col("accessory_bonus"), F.col("defect_state.severe")
    defects = F.size(defects_or_empty()) > 0
    contradictory = F.col("defect_invalid")
    exceptional = (bonus >= 8) & active & ~defects & (F.col("confidence") >= 75)
    worn = defects | shutter_at_least(40_000)
    prefer_new = (
        severe | (F.col("risk_score") >= 40) | shutter_at_least(80_000)
        | (~active & (F.col("alternative_warranty") >= 12) & (discount < 25)) | contradictory
    )
    prefer_used = (
        ~severe & (F.col("risk_score") < 25) & ~shutter_at_least(80_000) & (F.col("confidence") >= 65)
        & (active | (bonus >= 5) | (discount >= 25))
    )
    return (
        F.when(discount < 10, F.when(exceptional, "BUY_USED").otherwise("BUY_NEW"))
        .when(discount < 20, F.when(~active | worn, "BUY_NEW").otherwise(score_band(F.col("buy_score"))))
        .when(
            discount < 30,
            F.when(prefer_new, "BUY_NEW").when(prefer_used, "BUY_USED")
            .otherwise(F.when(F.col("buy_score") >= 60, "NEGOTIATE").otherwise("MONITOR")),
        )
        .otherwise(F.when(~severe & ~contradictory, "BUY_USED").otherwise("MANUAL_REVIEW"))
    )


def _factors() -> Column:
    """All scored factors in evaluation order."""
    one = lambda name, category, points: F.struct(
        F.lit(name).alias("name"), F.lit(category).alias("category"), points.cast("int").alias("score_impact"))
    single = lambda present, factor: F.when(present, F.array(factor)).otherwise(F.array().cast(f"array<{FACTOR}>"))
    defects = F.transform(defects_or_empty(), lambda d, i: F.struct(
        F.when(defect_invalid(d), F.concat(F.lit("invalid_defect_"), (i + 1).cast("string")))
        .otherwise(F.concat(F.lit("defect_"), (i + 1).cast("string"), F.lit("_"), d["category"])).alias("name"),
        F.lit("defect").alias("category"), defect_points(d).cast("int").alias("score_impact")))
    accessories = F.transform("accessory_points", lambda points, i: F.struct(
        F.concat(F.lit("accessory_"), (i + 1).cast("string")).alias("name"),
        F.lit("accessories").alias("category"), points.cast("int").alias("score_impact")))
    return F.concat(
        single(F.col("price_points").isNotNull(), one("price_vs_used_market", "price", F.col("price_points"))),
        single(F.col("condition_missing"), one("unknown_condition", "condition", F.lit(-5))),
        defects,
        single(F.col("shutter_points").isNotNull(), one("shutter_count", "condition", F.col("shutter_points"))),
        single(F.col("warranty_active"), one("active_warranty", "protection", F.col("warranty_points"))),
        single(F.coalesce("invoice_available", F.lit(False)), one("invoice", "documentation", F.lit(3))),
        single(F.coalesce("original_box_available", F.lit(False)), one("original_box", "documentation", F.lit(2))),
        accessories,
    )


def top_reasons(factors: Column, limit: int = 5) -> Column:
    """Names of the strongest non-zero factors; equal strength keeps the order."""
    keyed = F.filter(
        F.transform(factors, lambda f, i: F.struct(
            (-F.abs(f["score_impact"])).alias("strength"), i.alias("position"), f["name"].alias("name"))),
        lambda f: f["strength"] != 0,
    )
    return F.transform(F.slice(F.array_sort(keyed), 1, limit), lambda f: f["name"])
