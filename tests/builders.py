"""Small frames with the columns the operators read."""

from __future__ import annotations

from datetime import date, datetime

DEFECT = "struct<category:string,description:string,severity:string,affected_component:string,source_text:string,confidence:double>"
LISTING_SCHEMA = (
    "listing_id string, product_id string, recognized_product_id string, title string, brand string, category string, url string, source string, seller string, "
    "location string, source_country string, currency string, segment string, price double, landed_cost double, shutter_count bigint, condition string, "
    f"defects array<{DEFECT}>, accessories array<string>, missing_information array<string>, recognition_confidence int, description_confidence int, "
    "evidence_count int, warranty_clear boolean, accessories_complete boolean, contradictory boolean, warranty_until date, invoice_available boolean, "
    "original_box_available boolean, return_days int, transferable boolean, seller_score double, liquidity_score double, catalog_price_used double, observed_at timestamp"
)
_NAMES = [part.strip().split(" ")[0] for part in LISTING_SCHEMA.replace(DEFECT, "x").split(",") if part.strip()]
_DEFAULTS = {
    "product_id": "p", "recognized_product_id": "p", "title": "Sony A7 IV", "brand": "Sony", "category": "Camera", "url": None, "source": "s", "seller": None,
    "location": "IT", "source_country": "IT", "currency": "EUR", "segment": "USED", "price": 1000.0, "condition": "Used", "defects": [], "accessories": [],
    "missing_information": [], "recognition_confidence": 100, "description_confidence": 100, "evidence_count": 0, "warranty_clear": True,
    "accessories_complete": True, "contradictory": False, "observed_at": datetime(2026, 1, 1), "liquidity_score": 80.0,
}


def defect(category, severity, description="seen", component="body", confidence=0.95):
    return (category, description, severity, component, description, confidence)


def listings(spark, *rows):
    values = []
    for number, row in enumerate(rows):
        merged = {**_DEFAULTS, "listing_id": f"l{number}", "seller": f"seller{number}", **row}
        values.append(tuple(merged.get(name) for name in _NAMES))
    return spark.createDataFrame(values, LISTING_SCHEMA)


def day(text):
    return date.fromisoformat(text)
