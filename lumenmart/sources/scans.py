"""Typed scans of catalog, feed, configuration and user files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Optional

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lumenmart.functions.text import canonical_url, feed_price, url_allowed

# Columns of the file formats.
PRODUCT_FIELDS = (
    "id", "category", "product_type", "brand", "model", "version", "native_mount", "release_year", "price_new", "price_used",
    "price_good_deal", "price_max_buy", "liquidity_score", "future_interest_score", "creative_value_score", "notes",
)
ALIAS_FIELDS = ("alias", "product_id", "alias_type", "notes")
MANUFACTURER_FIELDS = ("id", "name", "normalized_name", "notes")
MOUNT_FIELDS = ("id", "name", "mount_type", "notes")
WATCH_FIELDS = (
    "watch_id", "product_id", "query", "condition_preference", "max_price", "currency", "source_ids", "active", "priority", "created_at", "updated_at",
)
INVENTORY_FIELDS = (
    "item_id", "product_id", "purchase_date", "purchase_price", "currency", "condition_at_purchase", "shutter_count_at_purchase",
    "current_shutter_count", "warranty_until", "accessories", "serial_reference", "notes", "active",
)
WISHLIST_FIELDS = (
    "wishlist_id", "product_id", "target_price", "currency", "priority", "purchase_condition_preference", "target_date", "reason", "status", "created_at", "updated_at",
)
HISTORY_FIELDS = (
    "entry_id", "product_id", "listing_url", "source", "decision", "decision_score", "ownership_recommendation", "observed_price", "currency", "reasons", "rejected_reason", "created_at",
)
MANUAL_FIELDS = (
    "manual_id", "url", "source_name", "title", "description", "price", "currency", "source_country", "segment", "detected_at", "active",
)
FEED_FIELDS = ("external_id", "url", "title", "description", "price", "currency", "source_country", "segment", "condition", "detected_at")
SOURCE_SCHEMA = (
    "sources array<struct<source_id:string,name:string,source_type:string,endpoint:string,enabled:boolean,country:string,currency:string,segment:string,"
    "request_timeout_seconds:double,retry_count:int,minimum_request_interval_seconds:double,mapping:map<string,string>,notes:string>>"
)
PREFERENCE_SCHEMA = (
    "preferred_brands array<string>, excluded_brands array<string>, preferred_sources array<string>, excluded_sources array<string>, "
    "default_purchase_condition string, preferred_currency string, target_market_country string, risk_tolerance string, minimum_confidence int"
)


def text_csv(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """All-text CSV scan: trimmed cells, empty ones null, header checked by name."""
    raw = spark.read.schema(T.StructType([T.StructField(name, T.StringType()) for name in fields])).csv(
        path, header=True, enforceSchema=False, multiLine=True, escape='"')
    return raw.select(*[F.nullif(F.trim(F.col(name)), F.lit("")).alias(name) for name in fields])


def _cast(frame: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return frame.withColumns({name: F.col(name).try_cast(kind) for name, kind in types.items()})


def load_products(spark: SparkSession, path: str) -> DataFrame:
    numbers = {name: "double" for name in PRODUCT_FIELDS if name.startswith("price_") or name.endswith("_score")}
    return _cast(text_csv(spark, path, PRODUCT_FIELDS), {"release_year": "int", **numbers}).withColumnRenamed("id", "product_id")


def load_aliases(spark: SparkSession, path: str) -> DataFrame:
    return text_csv(spark, path, ALIAS_FIELDS)


def load_manufacturers(spark: SparkSession, path: str) -> DataFrame:
    return text_csv(spark, path, MANUFACTURER_FIELDS)


def load_mounts(spark: SparkSession, path: str) -> DataFrame:
    return text_csv(spark, path, MOUNT_FIELDS)


def _flag(name: str) -> Column:
    lowered = F.lower(F.col(name))
    return F.when(lowered.isin("true", "1"), True).when(lowered.isin("false", "0"), False)


def _list(name: str) -> Column:
    return F.coalesce(F.from_json(F.col(name), "array<string>"), F.array().cast("array<string>"))


def load_watches(spark: SparkSession, path: str) -> DataFrame:
    rows = text_csv(spark, path, WATCH_FIELDS)
    return _cast(rows, {"max_price": "double", "created_at": "timestamp", "updated_at": "timestamp"}).withColumns(
        {"source_ids": _list("source_ids"), "active": _flag("active")})


def load_inventory(spark: SparkSession, path: str) -> DataFrame:
    rows = _cast(text_csv(spark, path, INVENTORY_FIELDS), {
        "purchase_date": "date", "purchase_price": "double", "shutter_count_at_purchase": "int", "current_shutter_count": "int", "warranty_until": "date"})
    return rows.withColumns({"accessories": _list("accessories"), "active": _flag("active"), "currency": F.upper("currency")})


def load_wishlist(spark: SparkSession, path: str) -> DataFrame:
    rows = _cast(text_csv(spark, path, WISHLIST_FIELDS), {"target_price": "double", "target_date": "date", "created_at": "timestamp", "updated_at": "timestamp"})
    return rows.withColumn("currency", F.upper("currency"))


def load_history(spark: SparkSession, path: str) -> DataFrame:
    rows = _cast(text_csv(spark, path, HISTORY_FIELDS), {"decision_score": "int", "observed_price": "double", "created_at": "timestamp"})
    return rows.withColumns({"reasons": _list("reasons"), "listing_url": canonical_url(F.col("listing_url")), "currency": F.upper("currency")})


def load_sources(spark: SparkSession, path: str) -> DataFrame:
    """One row per configured source of a JSON object with a ``sources`` array."""
    return spark.read.schema(SOURCE_SCHEMA).json(path, multiLine=True, mode="FAILFAST").select(F.explode("sources").alias("s")).select("s.*")


def load_preferences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREFERENCE_SCHEMA).json(path, multiLine=True)


def mapped(element: Column, mapping: Mapping[str, str]) -> list[Column]:
    """The feed fields of a JSON element by configured dotted paths; absent ones are null."""
    return [
        (F.get_json_object(element, f"$.{mapping[name]}") if mapping.get(name) else F.lit(None).cast("string")).alias(name)
        for name in FEED_FIELDS
    ]


def json_feed(spark: SparkSession, path: str, mapping: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of JSON feed files; elements that are no objects become errors.

    Feed documents are small and many: files are spread over tasks and each
    document is exploded where it is read.
    """
    root = f"$.{mapping['list_path']}" if mapping.get("list_path") else "$"
    documents = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    elements = documents.select("file", F.posexplode(F.from_json(F.get_json_object("value", root), "array<string>")).alias("position", "element"))
    is_object = F.ltrim("element").startswith("{")
    reference = F.concat(F.lit("record:"), (F.col("position") + 1).cast("string")).alias("reference")
    records = elements.where(is_object).select("file", reference, *mapped(F.col("element"), mapping))
    errors = elements.where(F.coalesce(~is_object, F.lit(True))).select("file", reference, F.lit("record is not an object").alias("problem"))
    return records, errors


def file_import(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of a local import: CSV with header or a JSON array."""
    if kind == "json":
        return json_feed(spark, path, {name: name for name in FEED_FIELDS})
    schema = T.StructType([T.StructField(name, T.StringType()) for name in (*FEED_FIELDS, "_corrupt")])
    rows = spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", multiLine=True, escape='"')
    rows = rows.select("*", F.col("_metadata.file_name").alias("file"))
    return rows.where("_corrupt is null").drop("_corrupt"), rows.where("_corrupt is not null").select("file", F.lit("malformed row").alias("problem"), F.col("_corrupt").alias("value"))


def rss_feed(spark: SparkSession, path: str, price_format: Optional[Mapping[str, object]] = None, row_tag: str = "item") -> DataFrame:
    """RSS items (row_tag item) or Atom entries (row_tag entry) with the same columns.

    A link's href attribute wins over its text. With a price format, the price is
    read from the description or ``problem`` says that it could not be.
    """
    text = "struct<_VALUE:string,_href:string,_isPermaLink:string,_type:string>"
    names = ("guid", "id", "link", "title", "description", "summary", "pubDate", "updated")
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(", ".join(f"`{name}` {text}" for name in names)).load(path)
    pick = lambda *names: F.coalesce(*[F.coalesce(F.col(f"{name}._href"), F.col(f"{name}._VALUE")) for name in names], F.lit(""))
    rows = rows.select(
        pick("guid", "id").alias("external_id"), pick("link").alias("url"), pick("title").alias("title"),
        pick("description", "summary").alias("description"), pick("pubDate", "updated").alias("detected_at"))
    if not price_format:
        return rows.withColumn("price", F.lit(None).cast("double")).withColumn("problem", F.lit(None).cast("string"))
    markers = [str(value) for key in ("allowed_prefixes", "allowed_suffixes") for value in price_format.get(key, [])]
    markers += [str(price_format[key]) for key in ("currency_symbol", "currency_code") if price_format.get(key)]
    price = feed_price(F.col("description"), markers, str(price_format.get("decimal_separator", ".")), str(price_format.get("thousands_separator", ",")))
    return rows.withColumn("price", price).withColumn("problem", F.when(F.col("price").isNull(), "price text not readable"))


def manual_listings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of hand-kept listings: active rows, canonical address, first of equals."""
    rows = text_csv(spark, path, MANUAL_FIELDS).select("*").where(F.lower("active").isin("true", "1"))
    rows = rows.withColumn("bad", ~F.coalesce(url_allowed(F.col("url")), F.lit(False)) | (F.col("price").isNotNull() & F.col("price").try_cast("double").isNull()))
    good = rows.where("not bad").drop("bad").withColumns({"url": canonical_url(F.col("url")), "price": F.col("price").try_cast("double")})
    first = good.groupBy(F.lower("manual_id").alias("id_key"), F.col("url").alias("url_key")).agg(
        F.min_by(F.struct(*good.columns), F.struct("manual_id", "title")).alias("row")).select("row.*")
    return first, rows.where("bad").select("manual_id", F.lit("invalid manual record").alias("problem"))


def union_sources(*frames: DataFrame) -> DataFrame:
    """All sources in one frame; missing columns are null."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def count_rows(frames: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows) counted in one job."""
    counted = [frame.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, frame in frames.items()]
    return union_sources(*counted)
