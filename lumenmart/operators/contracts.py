"""Data contracts: every broken rule becomes one violation row."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Optional

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lumenmart.functions import text
from lumenmart.operators.decision import defect_invalid, defects_or_empty

COLUMNS = ("table", "row_key", "field", "rule", "value")


def check(field: str, rule: str, broken: Column, value: Optional[Column] = None) -> Column:
    """A violation struct where ``broken`` holds, else null."""
    shown = F.col(field) if value is None else value
    return F.when(F.coalesce(broken, F.lit(False)), F.struct(
        F.lit(field).alias("field"), F.lit(rule).alias("rule"), shown.cast("string").alias("value")))


def violations(rows: DataFrame, table: str, row_key: Column, checks: Sequence[Column]) -> DataFrame:
    """All row-level checks of a table in one pass without a shuffle."""
    return rows.select(
        F.lit(table).alias("table"), row_key.cast("string").alias("row_key"),
        F.explode(F.array_compact(F.array(*checks))).alias("v"),
    ).select("table", "row_key", "v.field", "v.rule", "v.value")


def header(columns: Sequence[str], expected: Sequence[str], exact_order: bool = False) -> list[tuple[str, str]]:
    """(field, rule) for missing, unknown or reordered columns."""
    found = [(name, "missing column") for name in expected if name not in columns]
    found += [(name, "unknown column") for name in columns if name not in expected]
    if exact_order and not found and list(columns) != list(expected):
        found.append((columns[0], "column order"))
    return found


def header_violations(spark: SparkSession, path: str, table: str, expected: Sequence[str], exact_order: bool = False) -> DataFrame:
    """Violation rows of the header line of every CSV file below ``path``: row_key is the file, value its header.

    The same rules as ``header``; an empty file has no column at all. Only the first block of a file is looked
    at, and of its lines one is carried per task.
    """
    content = spark.read.text(path)
    # the listing and the scan write the slashes after the scheme differently
    named = lambda name: F.regexp_replace(name, "^(\\w+):/+", "$1:/").alias("file")
    lines = content.where("_metadata.file_block_start = 0").select(named(F.col("_metadata.file_path")), "value", F.monotonically_increasing_id().alias("line"))
    first = lines.groupBy("file").agg(F.min_by("value", "line").alias("header"))
    # scans skip files without a byte, so the names come from the listing
    files = spark.createDataFrame([(name,) for name in content.inputFiles()], "name string").select(named(F.col("name")))
    cells = F.transform(F.split(F.regexp_replace("header", "^\ufeff", ""), ","), lambda cell: F.trim(F.regexp_replace(cell, '"', "")))
    rows = files.join(first, "file", "left").withColumn("header", F.coalesce("header", F.lit(""))).withColumn(
        "columns", F.filter(cells, lambda cell: cell != "")).withColumn("expected", F.array(*[F.lit(name) for name in expected]))
    told = lambda names, rule: F.transform(names, lambda name: F.struct(name.alias("field"), F.lit(rule).alias("rule")))
    wrong = F.concat(told(F.array_except("expected", "columns"), "missing column"), told(F.array_except("columns", "expected"), "unknown column"))
    if exact_order:
        misplaced = (F.size(wrong) == 0) & (F.col("columns") != F.col("expected"))
        wrong = F.when(misplaced, told(F.slice("columns", 1, 1), "column order")).otherwise(wrong)
    return rows.select(F.lit(table).alias("table"), F.col("file").alias("row_key"), F.explode(wrong).alias("v"), F.col("header").alias("value")).select(
        "table", "row_key", "v.field", "v.rule", "value")


def required(field: str) -> Column:
    return check(field, "required", F.coalesce(F.trim(F.col(field).cast("string")), F.lit("")) == "")


def typed(field: str, kind: str) -> Column:
    """Non-empty text that does not parse as int, double, date, boolean."""
    raw = F.trim(F.col(field))
    if kind == "boolean":
        bad = ~F.lower(raw).isin("true", "false", "1", "0")
    elif kind == "double":
        number = raw.try_cast("double")
        bad = number.isNull() | F.isnan(number) | number.isin(float("inf"), float("-inf"))
    elif kind == "date":
        bad = ~raw.rlike(r"^\d{4}-\d{2}-\d{2}$") | raw.try_cast("date").isNull()
    else:
        bad = raw.try_cast(kind).isNull()
    return check(field, f"not {kind}", (raw != "") & bad)


def one_of(field: str, allowed: Sequence[str]) -> Column:
    return check(field, "domain", F.col(field).isNotNull() & ~F.col(field).isin(*allowed))


def in_range(field: str, low=None, high=None) -> Column:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(field) < low)
    if high is not None:
        bad = bad | (F.col(field) > high)
    return check(field, "range", bad)


def canonical_alias(field: str) -> Column:
    return check(field, "canonical form", F.col(field) != text.normalize_alias(F.col(field)))


def unique(rows: DataFrame, table: str, field: str, row_key: str) -> DataFrame:
    """Later rows of a case-insensitive key; ``value`` names the first row seen.

    The key counts combine map-side; only keys seen twice are joined back.
    """
    keyed = rows.select(F.col(row_key).alias("row_key"), F.lower(F.col(field).cast("string")).alias("folded"))
    repeated = keyed.groupBy("folded").agg(F.min("row_key").alias("first_row"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(repeated, "folded").where("row_key <> first_row").select(
        F.lit(table).alias("table"), F.col("row_key").cast("string").alias("row_key"), F.lit(field).alias("field"),
        F.lit("unique").alias("rule"), F.col("first_row").cast("string").alias("value"))


def foreign_key(rows: DataFrame, table: str, field: str, row_key: str, parent: DataFrame, parent_field: str) -> DataFrame:
    """Rows whose key is absent from the parent, ignoring case; nulls pass."""
    known = parent.select(F.lower(F.col(parent_field).cast("string")).alias("folded")).distinct()
    keyed = rows.where(F.col(field).isNotNull()).select(
        F.col(row_key).alias("row_key"), F.col(field).cast("string").alias("value"), F.lower(F.col(field).cast("string")).alias("folded"))
    return keyed.join(known, "folded", "left_anti").select(
        F.lit(table).alias("table"), F.col("row_key").cast("string").alias("row_key"), F.lit(field).alias("field"),
        F.lit("foreign key").alias("rule"), "value")


def conditional_unique(rows: DataFrame, condition: Column, keys: Sequence[Column]) -> DataFrame:
    """Keys used by more than one row that meets the condition."""
    named = [key.alias(f"key_{i}") for i, key in enumerate(keys)]
    return rows.where(condition).groupBy(*named).agg(F.count(F.lit(1)).alias("active_rows")).where("active_rows > 1")


def disjoint(left: str, right: str) -> Column:
    lowered = lambda name: F.transform(F.col(name), text.folded)
    return check(left, "overlap", F.arrays_overlap(lowered(left), lowered(right)), F.array_join(F.array_intersect(lowered(left), lowered(right)), ","))


def private_text(rows: DataFrame, table: str, row_key: str, field: str) -> DataFrame:
    """One violation per kind of private data found in a text."""
    return rows.select(
        F.lit(table).alias("table"), F.col(row_key).cast("string").alias("row_key"), F.lit(field).alias("field"),
        F.explode(text.private_kinds(F.col(field))).alias("rule"))


def serial_policy(field: str) -> list[Column]:
    """Short internal labels or masked suffixes only, never full serial numbers."""
    value = F.col(field)
    return [
        check(field, "too long", F.length(value) > 20),
        check(field, "full serial", value.rlike(r"(?iU)\b(?:serial|seriale|s/n)\b\s*[:#-]?\s*[A-Z0-9]{6,}")),
        check(field, "unmasked", ~value.contains("*") & value.rlike(r"(?i)^(?=.*\d)[A-Z0-9-]{10,}$")),
    ]


def manual_listing() -> list[Column]:
    """Checks of a hand-entered listing."""
    limited = lambda field, limit: check(
        field, f"1..{limit} characters", ~F.coalesce(F.length(F.trim(F.col(field))).between(1, limit), F.lit(False)), F.length(F.trim(F.col(field))))
    price = F.replace(F.col("price").cast("string"), F.lit(","), F.lit(".")).try_cast("double")
    detected = F.col("detected_at")
    return [
        limited("source_name", 80), limited("title", 300), limited("description", 20_000),
        check("url", "http address", ~F.coalesce(text.url_allowed(F.col("url")), F.lit(False))),
        check("price", "positive number", ~F.coalesce((price > 0) & ~F.isnan(price) & (price < float("inf")), F.lit(False))),
        check("currency", "three capitals", ~F.coalesce(F.col("currency").rlike("^[A-Z]{3}$"), F.lit(False))),
        check("source_country", "two capitals", ~F.coalesce(F.col("source_country").rlike("^[A-Z]{2}$"), F.lit(False))),
        check("segment", "domain", ~F.coalesce(F.col("segment").isin("NEW", "USED"), F.lit(False))),
        check("detected_at", "ISO date", detected.isNotNull() & F.try_to_timestamp(detected).isNull()),
    ]


# Allowed keys of a source's field mapping and price format.
MAPPING_KEYS = (
    "list_path", "external_id", "url", "title", "description", "price", "currency", "source_country",
    "segment", "condition", "detected_at", "header_environment", "price_extraction",
)
SOURCE_TYPES = ("JSON_FEED", "RSS_FEED", "FILE_IMPORT", "MANUAL_URL")
PRICE_KEYS = ("currency_symbol", "currency_code", "decimal_separator", "thousands_separator")
PART_LIMIT = 20


def source_config(mapping: str = "mapping") -> list[Column]:
    """Checks of a configured source; ``mapping`` is a map<string,string>."""
    unknown = F.array_except(F.map_keys(F.col(mapping)), F.array(*[F.lit(key) for key in MAPPING_KEYS]))
    return [
        check("source_type", "domain", ~F.coalesce(F.col("source_type").isin(*SOURCE_TYPES), F.lit(False))),
        check("segment", "domain", ~F.col("segment").isin("NEW", "USED")),
        check("country", "two capitals", ~F.col("country").rlike("^[A-Z]{2}$")),
        check("currency", "three capitals", ~F.col("currency").rlike("^[A-Z]{3}$")),
        check(mapping, "unknown mapping key", F.size(unknown) > 0, F.array_join(unknown, ",")),
    ]


# Keys of a configured source.
SOURCE_KEYS = (
    "source_id", "name", "source_type", "endpoint", "enabled", "country", "currency", "segment", "request_timeout_seconds",
    "retry_count", "minimum_request_interval_seconds", "mapping", "notes",
)


def object_keys(element: str, expected: Sequence[str]) -> Column:
    """array<struct<field,rule,value>> of a JSON text: no object, or its missing and unknown keys in name order."""
    keys, wanted = F.json_object_keys(F.col(element)), F.array(*[F.lit(name) for name in expected])
    told = lambda names, rule: F.transform(F.array_sort(names), lambda name: F.struct(
        name.alias("field"), F.lit(rule).alias("rule"), F.lit(None).cast("string").alias("value")))
    no_object = F.array(F.struct(F.lit("").alias("field"), F.lit("not an object").alias("rule"), F.left(F.col(element), F.lit(80)).alias("value")))
    return F.when(keys.isNull(), no_object).otherwise(F.concat(
        told(F.array_except(wanted, keys), "missing key"), told(F.array_except(keys, wanted), "unknown key")))


def source_file_violations(spark: SparkSession, path: str) -> DataFrame:
    """Violation rows of JSON source files; row_key is the file, "#" and the record's number from 1 (0: the file itself).

    A file must be an object with a ``sources`` array and nothing else, a source an object with exactly the known
    keys, a ``mapping`` object, valid domains and an id no earlier source of the file has. A missing or null field
    breaks no rule on its value. Files are spread over tasks; only ids and places are shuffled.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    listed = F.get_json_object("value", "$.sources")
    is_list = F.coalesce(F.ltrim(listed).startswith("["), F.lit(False))
    no_list = F.when(~is_list & F.array_contains(F.json_object_keys("value"), "sources"), F.array(F.struct(
        F.lit("sources").alias("field"), F.lit("not an array").alias("rule"), F.left(listed, F.lit(80)).alias("value"))))
    roots = files.select(F.concat("file", F.lit("#0")).alias("row_key"), F.inline(
        F.concat(object_keys("value", ("sources",)), F.coalesce(no_list, F.array().cast("array<struct<field:string,rule:string,value:string>>")))))
    elements = files.where(is_list).select("file", F.posexplode(F.from_json(listed, "array<string>")).alias("place", "element")).withColumn(
        "row_key", F.concat("file", F.lit("#"), (F.col("place") + 1).cast("string")))
    # a mapping that is no object would make the whole record unreadable, so it is read by itself
    texts = ("source_id", "source_type", "country", "currency", "segment")
    parsed = elements.withColumns({name: F.get_json_object("element", f"$.{name}") for name in texts}).withColumn("given", F.get_json_object("element", "$.mapping"))
    parsed = parsed.withColumn("mapping", F.when(F.ltrim("given").startswith("{"), F.from_json("given", "map<string,string>")))
    checks = [*source_config(), check("mapping", "not an object", F.col("given").isNotNull() & F.col("mapping").isNull(), F.left("given", F.lit(80)))]
    broken = parsed.select("row_key", F.inline(F.concat(object_keys("element", SOURCE_KEYS), F.when(
        F.json_object_keys("element").isNotNull(), F.array_compact(F.array(*checks))).otherwise(F.array().cast("array<struct<field:string,rule:string,value:string>>")))))
    earlier = Window.partitionBy("file", "source_id").orderBy("place")
    repeated = parsed.where("source_id is not null").select("row_key", "source_id", F.row_number().over(earlier).alias("time")).where("time > 1").select(
        "row_key", F.lit("source_id").alias("field"), F.lit("repeated id").alias("rule"), F.col("source_id").alias("value"))
    return roots.unionByName(broken).unionByName(repeated).select(F.lit("sources").alias("table"), "row_key", "field", "rule", "value")


def price_format(field: str = "price_extraction") -> list[Column]:
    """Checks of a price format, a map<string,string> of short literal parts; no free patterns."""
    keys, parts = F.map_keys(F.col(field)), F.map_values(F.col(field))
    unknown = F.array_except(keys, F.array(*[F.lit(key) for key in PRICE_KEYS]))
    missing = F.array_except(F.array(*[F.lit(key) for key in PRICE_KEYS]), keys)
    long = F.filter(parts, lambda part: F.length(part) > PART_LIMIT)
    return [
        check(field, "unknown price key", F.size(unknown) > 0, F.array_join(F.array_sort(unknown), ",")),
        check(field, "missing price key", F.col(field).isNotNull() & (F.size(missing) > 0), F.array_join(F.array_sort(missing), ",")),
        check(field, f"part over {PART_LIMIT} characters", F.size(long) > 0, F.array_join(F.array_sort(long), ",")),
    ]


def defects_valid(field: str = "defects") -> Column:
    return check(field, "invalid defect", F.exists(defects_or_empty(field), defect_invalid), F.size(F.col(field)))


REQUIRED_LISTING = ("external_id", "source", "title", "url", "currency", "connector_name")


def listing_rules() -> list[Column]:
    return [required(field) for field in REQUIRED_LISTING]


def accepted_listings(listings: DataFrame, order: Column, connector: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, violations): complete-enough listings, the first per connector and case-folded id, and why others are not.

    With ``connector``, the name a row must carry, rows of another connector are violations too. Every row left
    out has at least one violation row. Accepted rows tell whether an optional field is missing (``incomplete``).
    """
    rules = listing_rules()
    if connector is not None:
        rules.append(check("connector_name", "wrong connector", ~F.lower("connector_name").eqNullSafe(F.lower(connector))))
    keyed = listings.withColumn("_found", F.array_compact(F.array(*rules)))
    valid = keyed.where(F.size("_found") == 0).withColumn("_order", order)
    place = Window.partitionBy(F.lower("connector_name"), F.lower("external_id")).orderBy("_order")
    placed = valid.withColumn("_place", F.row_number().over(place))
    broken = keyed.where(F.size("_found") > 0).select(F.col("external_id").cast("string").alias("row_key"), F.explode("_found").alias("v"))
    repeated = placed.where("_place > 1").select(F.col("external_id").cast("string").alias("row_key"), F.struct(
        F.lit("external_id").alias("field"), F.lit("repeated id").alias("rule"), F.col("external_id").cast("string").alias("value")).alias("v"))
    optional = F.col("price").isNull()
    for field in ("condition", "location", "seller", "description"):
        optional = optional | (F.coalesce(F.col(field).cast("string"), F.lit("")) == "")
    accepted = placed.where("_place = 1").drop("_found", "_order", "_place").withColumn("incomplete", optional)
    found = broken.unionByName(repeated).select(F.lit("listings").alias("table"), "row_key", "v.field", "v.rule", "v.value")
    return accepted, found
