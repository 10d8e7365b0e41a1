from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lumenmart.operators import decision, ownership
from tests.builders import day, defect, listings


def decide(spark, alternative=1595.0, median=1500.0, **row):
    frame = listings(spark, {"price": 1200.0, "warranty_until": day("2027-06-30"), **row})
    frame = frame.selectExpr(
        "*", f"cast({median} as double) as used_median", "cast(1000 as double) as used_lowest", "10 as market_samples", "cast(null as double) as used_trend",
        "true as has_market", "currency as market_currency", "cast(null as boolean) as replacement_released",
        f"cast({alternative if alternative is not None else 'null'} as double) as alternative_price", "'EUR' as alternative_currency", "24 as alternative_warranty",
        "cast(observed_at as date) as as_of")
    return decision.evaluate(frame).first()


def test_clear_used_advantage(spark):
    row = decide(spark, shutter_count=20000, invoice_available=True)
    assert row.recommendation == "BUY_USED" and row.estimated_used_advantage == 395


def test_cracked_front_element_is_passed(spark):
    assert decide(spark, defects=[defect("cracks", "critical")]).recommendation == "PASS"


def test_high_shutter_needs_review(spark):
    assert decide(spark, shutter_count=160000).recommendation == "MANUAL_REVIEW"


def test_currency_mismatch_is_not_compared(spark):
    row = decide(spark, currency="USD")
    assert row.new_vs_used == "INSUFFICIENT_DATA" and row.price_points is not None


def test_every_scored_factor_counts_once(spark):
    row = decide(spark, shutter_count=50000, invoice_available=True, defects=[defect("dust", "minor")], accessories=["Sony original NP-FZ100 battery"])
    assert row.buy_score == max(0, min(100, 50 + sum(f.score_impact for f in row.factors)))


def test_later_defect_may_clear_a_flag(spark):
    fold = lambda *items: listings(spark, {"defects": list(items)}).select(decision.defect_fold().alias("s")).first().s
    assert fold(defect("cracks", "critical"), defect("fungus", "minor"))["pass"] is False
    assert fold(defect("fungus", "minor"), defect("cosmetic_damage", "minor"))["review"] is False
    assert fold(defect("bogus", "minor"))["review"] is True


def test_accessory_caps(spark):
    points = lambda *items: listings(spark, {"accessories": list(items)}).select(
        decision.accessory_points(F.col("accessories"), F.lit("Sony")).alias("p")).first().p
    assert points(*["Sony original battery"] * 3) == [3, 3, 0]
    assert points("Sony original grip", "SmallRig 4x cage", "NiSi ND64 filter", "Sony original battery") == [5, 3, 2, 2]
    assert points("filter", "strap") == [0, 0]


def test_warranty_text_dates(spark):
    row = spark.range(1).select(
        decision.warranty_date(F.lit("2027-01-31")).alias("a"), decision.warranty_date(F.lit("March 2027")).alias("b"), decision.warranty_date(F.lit("soon")).alias("c")).first()
    assert (row.a, row.b, row.c) == (day("2027-01-31"), day("2027-03-28"), None)


def test_wait_probability(spark):
    value = lambda **kw: spark.range(1).select(decision.wait_probability(
        F.lit(kw.get("price", 1000.0)), F.lit(kw.get("low", 900.0)), F.lit(kw.get("trend")).cast("double"), F.lit(kw.get("n", 5)), F.lit(kw.get("new")).cast("boolean"))).first()[0]
    assert value() == 25 and value(trend=-20.0) == 55 and value(trend=30.0) == 10 and value(price=800.0) == 10 and value(new=True) == 40 and value(n=2) is None


SNAPSHOTS = "product_id string, currency string, segment string, market_confidence int, median_price double, estimated_12_month_depreciation double, estimated_24_month_depreciation double, trend_30d double"


def offers(spark, used=None, new=None, resale=True, months=12):
    base = {"price": 1200.0, "warranty_until": day("2027-01-01"), "transferable": True, "invoice_available": True, "return_days": 14, "seller_score": 90.0, "shutter_count": 5000}
    rows = [{**base, "segment": "NEW", "price": 1595.0, "listing_id": "new", "return_days": 30, **(new or {})}, {**base, "listing_id": "used", **(used or {})}]
    markets = spark.createDataFrame([("p", "EUR", "NEW", 90, 1600.0, None, None, 0.0), ("p", "EUR", "USED", 90, 1300.0, 20.0, 28.0, 0.0)], SNAPSHOTS)
    prices = spark.createDataFrame([("Sony original battery", 60.0)], "name string, price double")
    prepared = ownership.prepare_offers(listings(spark, *rows), F.lit("IT"), prices)
    return ownership.project(prepared, markets, months, resale)


def test_used_offer_is_preferred_and_breaks_even_inside_the_band(spark):
    row = ownership.default_comparisons(offers(spark)).first()
    assert row.recommendation == "PREFER_USED" and 1200 < row.break_even_price < 1595


def test_contradiction_and_damage_need_review(spark):
    for change in ({"contradictory": True}, {"defects": [defect("electronic_damage", "major")]}, {"shutter_count": 150000}):
        assert ownership.default_comparisons(offers(spark, used=change)).first().recommendation == "MANUAL_REVIEW"


def test_unknown_cost_is_insufficient(spark):
    row = ownership.default_comparisons(offers(spark, used={"source_country": "CN"})).first()
    assert row.recommendation == "INSUFFICIENT_DATA" and row.price_difference is None


def test_unknown_values_stay_unknown(spark):
    row = offers(spark, used={"source_country": "CN", "warranty_until": None}).where("segment = 'USED'").first()
    assert row.acquisition_cost is None and row.resale_value is None and row.warranty_months is None
    assert row.projection_confidence == 100 - 2 - 10 - 30  # market 90, warranty unknown, cost unknown


def test_requested_pairs_equal_default(spark):
    projected = offers(spark)
    wanted = spark.createDataFrame([("new", "used")], "new_listing_id string, used_listing_id string")
    columns = ["recommendation", "confidence", "break_even_price"]
    assert ownership.compare_requested(projected, wanted).select(columns).first() == ownership.default_comparisons(projected).select(columns).first()


def test_accessories_above_the_limit_get_no_value(spark):
    frame = listings(spark, {"accessories": ["Sony original battery"] * 3 + ["strap", "strap"]})
    row = ownership.accessory_values(frame, spark.createDataFrame([("sony  ORIGINAL battery", 60.0)], "name string, price double")).first()
    assert (row.accessory_reference, row.unvalued_accessories) == (120.0, 1)


def test_break_even_equals_search(spark):
    rng = random.Random(11)
    cases = [(rng.choice([0.0, rng.uniform(-0.4, 1.6), 1.0, 0.5]), rng.uniform(-300, 3000), rng.randint(0, 2500)) for _ in range(400)]
    frame = spark.createDataFrame(cases, "k double, cost double, n int")
    for row in frame.select("*", ownership.break_even(F.col("k"), F.col("cost"), F.col("n")).alias("found")).collect():
        fits = [c for c in range(1, row.n + 1) if c * row.k <= row.cost]
        assert row.found == (float(max(fits)) if fits else None)


def test_repeated_defects_count_once(spark):
    twice = [defect("dust", "minor", "Some  Dust"), defect("dust", "minor", "some dust")]
    assert len(listings(spark, {"defects": twice}).select(ownership.distinct_defects().alias("d")).first().d) == 1


def test_offers_are_valued_in_the_row(spark):
    """Looked-up values equal the joined ones, for listings that are present twice as well; no offer is shuffled for a small price table."""
    rows = [{"listing_id": "a", "accessories": ["Sony original battery"] * 3 + ["strap", "strap", None]}, {"listing_id": "b", "accessories": None},
            {"listing_id": "c", "accessories": ["strap", "sony original  battery"]}, {"listing_id": "c", "accessories": ["Sony original battery"]}]
    prices = spark.createDataFrame([("sony  ORIGINAL battery", 60.0), ("Sony original battery", 1.0), ("bag", None)], "name string, price double")
    frame = listings(spark, *rows)
    columns = ["listing_id", "accessory_reference", "unvalued_accessories"]
    want = sorted((r[0], r[1] or 0.0, r[2] or 0) for r in frame.join(ownership.accessory_values(frame, prices), "listing_id", "left").select(columns).collect())
    valued = ownership.with_accessory_values(frame, prices)
    assert sorted(tuple(r) for r in valued.select(columns).collect()) == want
    assert "Exchange hashpartitioning" not in valued._jdf.queryExecution().executedPlan().toString()


def test_top_reasons_works_factors_out_once(spark):
    """No filter on the finished names is pushed below them, where it would build all factors a second time."""
    import __spark_entry__ as contract

    frame = contract.queries()["top_reasons"](spark, contract.SMOKE_DIR)
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("array_join(") == 1
