from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenmart.operators import asof, dedupe, distribution, market
from tests.builders import defect, listings


def statistics(spark, values):
    rows = spark.createDataFrame([("g", float(value)) for value in values], "g string, v double")
    return distribution.price_statistics(distribution.ranked_values(rows, ["g"], "v"), ["g"]).first()


def test_statistics_golden(spark):
    row = statistics(spark, [10, 20, 30, 40, 50])
    assert (row.median_price, row.percentile_10, row.percentile_25, row.percentile_75, row.percentile_90) == (30, 14, 20, 40, 46)


def test_trimmed_mean_golden(spark):
    row = statistics(spark, [0] + [10] * 8 + [100])
    assert (row.mean_price, row.trimmed_mean) == (18, 10)


def test_quantiles_match_numpy_with_one_hot_group(spark):
    rng = random.Random(7)
    groups = {"hot": [rng.choice([5.0, 7.25, 1e-3, -4.0, 0.0, 900.5]) for _ in range(3000)]}
    groups.update({f"g{i}": [rng.uniform(-50, 5000) for _ in range(rng.randint(1, 40))] for i in range(40)})
    rows = spark.createDataFrame([(k, v) for k, values in groups.items() for v in values], "g string, v double")
    for row in distribution.price_statistics(distribution.ranked_values(rows, ["g"], "v"), ["g"]).collect():
        values = np.array(groups[row.g])
        assert row.valid_sample_size == len(values)
        for name, q in (("median_price", 50), ("percentile_10", 10), ("percentile_25", 25), ("percentile_75", 75), ("percentile_90", 90)):
            assert row[name] == pytest.approx(np.percentile(values, q), abs=1e-9)
        cut = int(len(values) * 0.1)
        kept = np.sort(values)[cut:len(values) - cut] if cut else values
        assert row.trimmed_mean == pytest.approx(kept.mean(), abs=1e-9)
        assert row.standard_deviation == pytest.approx(values.std(), abs=1e-6)


def observed(frame, country="IT", currency="EUR", segment="USED"):
    return market.with_observation(frame, F.lit(country), F.lit(currency), F.lit(segment))


def snapshot(frame, **kw):
    return market.snapshots(observed(frame, **kw), ["product_id"], F.max("observed_at")).first()


def test_outlier_golden(spark):
    rows = [{"price": 1000.0 + 10 * i if i < 7 else (1060.0 if i == 7 else 5000.0), "title": f"t{i}"} for i in range(7)] + [{"price": 5000.0, "title": "x"}]
    row = snapshot(listings(spark, *rows))
    assert (row.outlier_count, row.valid_sample_size, row.highest_price) == (1, 7, 1060.0)


def test_three_prices_have_no_fences(spark):
    row = snapshot(listings(spark, *[{"price": p, "title": str(p)} for p in (10.0, 11.0, 1000.0)]))
    assert (row.outlier_count, row.valid_sample_size) == (0, 3)


def test_same_url_winner(spark):
    base = {"url": "https://x.example/1", "landed_cost": 900.0}
    frame = listings(
        spark, {**base, "listing_id": "early", "price": 1.0, "observed_at": datetime(2025, 1, 1)},
        {**base, "listing_id": "rich", "price": 2.0, "evidence_count": 5}, {**base, "listing_id": "weak", "price": 3.0, "landed_cost": None, "source_country": "CN"})
    rows = dedupe.duplicates(observed(frame), ["product_id"]).collect()
    assert {row.winner_id for row in rows} == {"rich"} and sum(row.is_duplicate for row in rows) == 2


def test_confidence_golden(spark):
    start = datetime(2026, 1, 1)
    many = [{"title": f"t{i}", "price": 1000.0 + i, "observed_at": start + timedelta(days=i)} for i in range(21)]
    assert snapshot(listings(spark, *many)).market_confidence == 100
    assert snapshot(listings(spark, many[0])).market_confidence == 53


def test_quality_golden(spark):
    rows = market.with_quality(listings(spark, {"condition": "unknown"}, {"contradictory": True}, {"price": None}))
    assert [row.listing_quality for row in rows.orderBy("listing_id").collect()] == [85, 75, 0]


def test_quality_without_confidences(spark):
    rows = market.with_quality(listings(spark, {"recognition_confidence": None}, {"description_confidence": None}, {"recognition_confidence": None, "warranty_clear": None}))
    assert [row.listing_quality for row in rows.orderBy("listing_id").collect()] == [80, 85, 70]


def test_exclusion_reasons(spark):
    frame = listings(
        spark, {}, {"price": None}, {"currency": "USD"}, {"recognized_product_id": None}, {"segment": None}, {"segment": "NEW"}, {"source_country": None},
        {"source_country": "CN"}, {"source_country": "CN", "landed_cost": 900.0}, {"defects": [defect("cracks", "critical")]})
    found = [row.excluded_reason for row in observed(frame).orderBy("listing_id").collect()]
    assert found == [
        None, "MISSING_PRICE", "WRONG_CURRENCY", "PRODUCT_NOT_CONFIRMED", "INSUFFICIENT_INFORMATION", "SEGMENT_MISMATCH", "INSUFFICIENT_INFORMATION",
        "LANDED_COST_UNKNOWN", None, "SEVERE_DAMAGE"]


def brute_groups(rows):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b = rows[j]
            gap = abs((a["observed_at"] - b["observed_at"]).total_seconds())
            if ((a["url"] and a["url"].lower() == b["url"].lower())
                    or (a["title"].lower() == b["title"].lower() and a["price"] == b["price"] and a["source"] == b["source"])
                    or (a["price"] == b["price"] and a["location"] == b["location"] and a["seller"] == b["seller"] and gap <= 30 * 86400)):
                parent[find(i)] = find(j)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(find(i), set()).add(row["listing_id"])
    return {frozenset(group) for group in groups.values() if len(group) > 1}


def test_duplicate_groups_match_union_find(spark):
    rng = random.Random(3)
    rows = []
    for i in range(160):
        hot = i % 3 == 0
        rows.append({
            "listing_id": f"l{i:03d}", "url": rng.choice(["", f"https://u/{rng.randint(0, 120)}"]), "title": f"Title {rng.randint(0, 40)}",
            "price": 5.0 if hot else rng.choice([None, float(rng.randint(1, 12))]), "source": f"s{rng.randint(0, 2)}", "location": "IT",
            "seller": "hot" if hot else f"v{rng.randint(0, 4)}", "observed_at": datetime(2025, 1, 1) + timedelta(hours=rng.randint(0, 24 * 900))})
    found = dedupe.duplicate_groups(listings(spark, *rows), ["product_id"]).collect()
    groups = {}
    for row in found:
        groups.setdefault(row.component, set()).add(row.listing_id)
    assert {frozenset(group) for group in groups.values()} == brute_groups(rows)


def test_connected_keys_on_long_chain(spark):
    chain = spark.range(300).selectExpr("concat('k', lpad(id, 4, '0')) as a", "concat('k', lpad(id + 1, 4, '0')) as b")
    rows = dedupe.connected_keys(chain).collect()
    assert len(rows) == 301 and {row.component for row in rows} == {"k0000"}


def history(spark, *rows):
    return spark.createDataFrame([("p", "EUR", "USED", when, median, confidence) for when, median, confidence in rows],
                                 "product_id string, currency string, segment string, created_at timestamp, median_price double, market_confidence int")


NOW = datetime(2026, 8, 1)


@pytest.mark.parametrize("days,median,confidence,column,expected", [
    (365, 1000.0, 80, "estimated_12_month_depreciation", 10.0), (730, 1200.0, 80, "estimated_24_month_depreciation", 25.0),
    (411, 1000.0, 80, "estimated_12_month_depreciation", None), (365, 1000.0, 39, "estimated_12_month_depreciation", None),
    (30, 1000.0 * 900 / 1100, 80, "trend_30d", 10.0), (41, 1000.0, 80, "trend_30d", None)])
def test_history_golden(spark, days, median, confidence, column, expected):
    current = history(spark, (NOW, 900.0, 80))
    past = history(spark, (NOW - timedelta(days=days), median, confidence))
    value = asof.with_history(current, past, ["product_id", "currency", "segment"]).first()[column]
    assert value == (pytest.approx(expected) if expected is not None else None)


def test_only_shared_rule_keys_go_on(spark):
    """A listing that shares nothing, and one that is only present twice, leave before ids and whole keys are shuffled."""
    alone = {"listing_id": "alone", "title": "other", "price": 7.0}
    rows = [{"listing_id": "a", "url": "u"}, {"listing_id": "b", "url": "U ", "title": "x", "price": 5.0}, alone, alone]
    keys = dedupe.rule_keys(listings(spark, *rows), ["product_id"])
    assert {r.listing_id for r in dedupe.shared_keys(keys).collect()} == {"a", "b"} and dedupe.shared_keys(keys).count() == 2


def test_lone_listings_build_no_whole_keys(spark):
    """Hashes of the raw parts leave only listings that share a rule; a missing price equals a missing price."""
    alone = {"listing_id": "alone", "title": "other", "price": 7.0, "seller": "z"}
    rows = [{"listing_id": "a", "url": "u", "price": None, "title": "q"}, {"listing_id": "b", "price": None, "title": "Q!", "seller": "y"}, alone, alone]
    frame = listings(spark, *rows)
    found = dedupe.sharing(frame, ["product_id"])
    assert sorted(r.listing_id for r in found.collect()) == ["a", "b"]
    assert {r.listing_id for r in dedupe.duplicate_groups(frame, ["product_id"]).collect()} == {"a", "b"}


def test_days_of_a_market_without_currency(spark):
    """Groups with a missing key keep their days, as in SQL; no aggregate of sets reads single listings."""
    base = [{"currency": None, "observed_at": datetime(2025, 1, day), "title": str(day), "price": float(day)} for day in (1, 2, 2, 3)]
    rows = listings(spark, *base).withColumns({
        "listing_quality": F.lit(80), "excluded_reason": F.when(F.col("price") == 3.0, "OUTLIER"), "foreign_without_landed": F.lit(False)})
    row = market.accounting(rows, ["product_id", "currency"]).first()
    assert (row.sample_size, row.included_rows, row.outlier_count, row.distinct_days, row.listing_quality_average) == (4, 3, 1, 2, 80.0)


@pytest.mark.parametrize("name", ["iqr_outliers", "market_confidence"])
def test_outlier_rows_are_written_once(spark, name):
    """What ranks the prices and what is marked by them read staged rows, not the base tables twice."""
    import __spark_entry__ as contract

    files = contract.queries()[name](spark, contract.SMOKE_DIR).inputFiles()
    assert files and not any("lineitem" in file for file in files)
