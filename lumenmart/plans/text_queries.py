"""Contract, URL and privacy queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumenmart.functions import text
from lumenmart.operators import contracts
from lumenmart.plans import derived
from lumenmart.plans.derived import CATALOG_SQL, OBS_SQL, OWNED_SQL, WATCH_SQL
from lumenmart.plans.registry import Tables, query


@query(
    "catalog_contracts",
    f"""with catalog as ({CATALOG_SQL}),
names as (select lower(p_name) as k, min(p_partkey) as first_row, count(*) as n from part group by 1)
select 'part' as "table", cast(p_partkey as varchar) as row_key, 'p_name' as field, 'unique' as rule, cast(first_row as varchar) as value
  from part join names on lower(p_name) = k where n > 1 and p_partkey <> first_row
union all select 'part', product_id, 'version', 'required', version from catalog where trim(version) = ''
union all select 'part', product_id, 'brand', 'canonical form', brand from catalog where brand <> lower(brand)
union all select 'customer', cast(c_custkey as varchar), 'c_acctbal', 'range', cast(c_acctbal as varchar) from customer where c_acctbal < 0
union all select 'customer', cast(c_custkey as varchar), 'c_mktsegment', 'domain', c_mktsegment from customer where c_mktsegment not in ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
union all select 'orders', cast(o_orderkey as varchar), 'o_orderpriority', 'not int', o_orderpriority from orders where try_cast(o_orderpriority as int) is null
union all select 'supplier', cast(s_suppkey as varchar), 's_suppkey', 'foreign key', cast(s_suppkey as varchar) from supplier where s_suppkey not in (select n_nationkey from nation)""",
)
def catalog_contracts(tables: Tables) -> DataFrame:
    """Required, unique, foreign-key, typed, canonical and range rules over the catalog."""
    catalog = derived.catalog(tables)
    pieces = [
        contracts.unique(tables.part, "part", "p_name", "p_partkey"),
        contracts.violations(catalog, "part", F.col("product_id"), [contracts.required("version"), contracts.canonical_alias("brand")]),
        contracts.violations(tables.customer, "customer", F.col("c_custkey"), [
            contracts.in_range("c_acctbal", low=0), contracts.one_of("c_mktsegment", ("BUILDING", "MACHINERY", "HOUSEHOLD"))]),
        contracts.violations(tables.orders, "orders", F.col("o_orderkey"), [contracts.typed("o_orderpriority", "int")]),
        contracts.foreign_key(tables.supplier, "supplier", "s_suppkey", "s_suppkey", tables.nation, "n_nationkey"),
    ]
    result = pieces[0]
    for piece in pieces[1:]:
        result = result.unionByName(piece)
    return result


@query(
    "active_uniqueness",
    f"select product_id, condition_preference, count(*) as active_rows from ({WATCH_SQL}) where active group by all having count(*) > 1",
)
def active_uniqueness(tables: Tables) -> DataFrame:
    """Products watched more than once under one condition preference."""
    found = contracts.conditional_unique(
        derived.watches(tables), F.col("active"), [F.lower("product_id"), F.col("condition_preference")])
    return found.select(F.col("key_0").alias("product_id"), F.col("key_1").alias("condition_preference"), "active_rows")


@query(
    "repeated_watch_targets",
    f"select product_id, '' as query, '' as sources, count(*) as active_rows from ({WATCH_SQL}) where active group by product_id having count(*) > 1",
)
def repeated_watch_targets(tables: Tables) -> DataFrame:
    """Targets (product, query, sources) that several active watches share."""
    rows = derived.watches(tables).withColumns({"query": F.lit(None).cast("string"), "source_ids": F.array().cast("array<string>")})
    target = [F.lower(F.coalesce("product_id", F.lit(""))), F.lower(F.coalesce("query", F.lit(""))), F.array_join(F.array_sort("source_ids"), ",")]
    found = contracts.conditional_unique(rows, F.col("active"), target)
    return found.select(F.col("key_0").alias("product_id"), F.col("key_1").alias("query"), F.col("key_2").alias("sources"), "active_rows")


@query(
    "invalid_defects",
    f"select 'obs' as \"table\", listing_id as row_key, 'defects' as field, 'invalid defect' as rule, cast(len(string_split(defects_text, '|')) as varchar) as value "
    f"from ({OBS_SQL}) where defects_text like '%bogus%'",
)
def invalid_defects(tables: Tables) -> DataFrame:
    """Listings that carry a defect outside the allowed domains."""
    return contracts.violations(derived.observations(tables), "obs", F.col("listing_id"), [contracts.defects_valid()])


@query(
    "serial_policy",
    f"""with items as (select item_id, case condition_at_purchase when 'NEW' then concat('SN-', item_id, '-', product_id, '-000') when 'USED' then concat('***', item_id)
  else concat('serial: ', lpad(item_id, 14, '7')) end as serial_reference from ({OWNED_SQL}))
select 'owned' as "table", item_id as row_key, 'serial_reference' as field, rule, serial_reference as value from (
  select *, 'too long' as rule from items where length(serial_reference) > 20
  union all select *, 'full serial' from items where regexp_matches(serial_reference, '(?i)\\b(?:serial|seriale|s/n)\\b\\s*[:#-]?\\s*[A-Z0-9]{{6,}}')
  union all select *, 'unmasked' from items where not contains(serial_reference, '*') and regexp_matches(serial_reference, '[0-9]') and regexp_matches(serial_reference, '(?i)^[A-Z0-9-]{{10,}}$'))""",
)
def serial_policy(tables: Tables) -> DataFrame:
    """Owned items whose serial reference is too long, complete or unmasked."""
    item, product = F.col("item_id"), F.col("product_id")
    serial = (
        F.when(F.col("condition_at_purchase") == "NEW", F.concat(F.lit("SN-"), item, F.lit("-"), product, F.lit("-000")))
        .when(F.col("condition_at_purchase") == "USED", F.concat(F.lit("***"), item))
        .otherwise(F.concat(F.lit("serial: "), F.lpad(item, 14, "7")))
    )
    rows = derived.owned(tables).withColumn("serial_reference", serial)
    return contracts.violations(rows, "owned", item, contracts.serial_policy("serial_reference"))


@query(
    "manual_listing_contract",
    """with entries as (select doc_id, source as source_name, string_split(text, chr(10))[1] as title, text as description,
   case when lang = 'en' then 'EUR' else lang end as currency, upper(lang) as source_country, n_chars - 500 as price from documents)
select 'manual' as "table", cast(doc_id as varchar) as row_key, field, rule, value from (
  select doc_id, 'title' as field, '1..300 characters' as rule, cast(length(trim(title)) as varchar) as value from entries where length(trim(title)) not between 1 and 300
  union all select doc_id, 'description', '1..20000 characters', cast(length(trim(description)) as varchar) from entries where length(trim(description)) not between 1 and 20000
  union all select doc_id, 'price', 'positive number', cast(price as varchar) from entries where price <= 0
  union all select doc_id, 'currency', 'three capitals', currency from entries where not regexp_full_match(currency, '[A-Z]{3}')
  union all select doc_id, 'source_country', 'two capitals', source_country from entries where not regexp_full_match(source_country, '[A-Z]{2}'))""",
)
def manual_listing_contract(tables: Tables) -> DataFrame:
    """Hand-entry rules applied to every document taken as a listing."""
    rows = tables.wide("documents").select(
        "doc_id", F.col("source").alias("source_name"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("description"), F.when(F.col("lang") == "en", "EUR").otherwise(F.col("lang")).alias("currency"),
        F.upper("lang").alias("source_country"), (F.col("n_chars") - 500).alias("price"), F.lit("USED").alias("segment"),
        F.lit("https://shop.example/").alias("url"), F.lit(None).cast("string").alias("detected_at"))
    return contracts.violations(rows, "manual", F.col("doc_id"), contracts.manual_listing())


_W = "\\p{L}\\p{N}_"
_REJECTED_SQL = {
    "email address": f"[{_W}][{_W}.+-]*@[{_W}.-]+\\.[A-Za-z]{{2,}}($|[^{_W}])",
    "telephone number": f"(^|[^{_W}])(?:\\+?\\d[\\s().-]*){{8,15}}($|[^{_W}])",
    "payment-card-like value": "(^|[^0-9])(?:\\d[ -]*){12,18}\\d($|[^0-9])",
    "precise street address": f"(?i)(^|[^{_W}])(?:via|viale|piazza|corso|street|st\\.|road|rd\\.)\\s+[A-Za-zÀ-ÿ'' -]+\\s+\\d{{1,5}}($|[^{_W}])",
    "credential or token": f"(?i)(^|[^{_W}])(?:api[_ -]?key|token|password|passwd|secret)\\s*[:=]\\s*\\S+",
}


@query(
    "private_text",
    " union all ".join(
        f"select 'documents' as \"table\", cast(doc_id as varchar) as row_key, 'text' as field, '{label}' as rule from documents where regexp_matches(text, '{pattern}')"
        for label, pattern in _REJECTED_SQL.items()),
)
def private_text(tables: Tables) -> DataFrame:
    """Every kind of private data found in every document."""
    return contracts.private_text(tables.wide("documents"), "documents", "doc_id", "text")


_C = "[A-Z0-9._%+-]*"
_PRIVATE_SQL = [
    f"(?i)(^|[^{_W}])[A-Z0-9_]{_C}@[A-Z0-9.-]+\\.[A-Z]{{2,}}($|[^{_W}])",
    f"(?i)[{_W}][.%+-]{_C}@[A-Z0-9.-]+\\.[A-Z]{{2,}}($|[^{_W}])",
    _REJECTED_SQL["telephone number"],
    f"(^|[^{_W}])(?:\\d[ -]*){{12,18}}\\d($|[^{_W}])",
    f"(?i)(^|[^{_W}])(?:password|passwd|api[_ -]?key|token)\\s*[:=]\\s*\\S+",
    f"(?i)(^|[^{_W}])(?:via|viale|piazza|corso)\\s+[A-Za-zÀ-ÿ.'' -]{{2,40}}\\s+\\d{{1,4}}($|[^{_W}])",
]


@query(
    "pii_redaction",
    "with flagged as (select source, lang, "
    + " or ".join(f"regexp_matches(text, '{pattern}')" for pattern in _PRIVATE_SQL)
    + " as removed from documents) select source, lang, count(*) as documents, count(*) filter (where removed) as redacted from flagged group by all",
)
def pii_redaction(tables: Tables) -> DataFrame:
    """Documents per source whose text changes when personal data is removed."""
    changed = text.redact(F.col("text")) != F.col("text")
    return tables.wide("documents").groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(changed).alias("redacted"))


@query("redacted_texts")
def redacted_texts(tables: Tables) -> DataFrame:
    """Every document with personal data replaced; lookaround keeps this off the SQL twin."""
    cleaned = text.redact(F.col("text"))
    return tables.wide("documents").select("doc_id", cleaned.alias("text"), (cleaned != F.col("text")).alias("removed"))


@query(
    "url_canonical",
    """with parts as (select page_id, string_split(url, '#')[1] as u from pages),
split as (select page_id, string_split(u, '?')[1] as base, case when contains(u, '?') then substr(u, strpos(u, '?') + 1) end as q from parts),
pairs as (select page_id, unnest(string_split(q, '&')) as pair, generate_subscripts(string_split(q, '&'), 1) as pos from split where q is not null),
kept as (select page_id, string_agg(pair, '&' order by pos) as q from pairs
  where pair <> '' and lower(string_split(pair, '=')[1]) not in ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'ref', 'tracking') group by page_id)
select split.page_id, base || case when kept.q is not null then '?' || kept.q else '' end as canonical_url from split left join kept on kept.page_id = split.page_id""",
)
def url_canonical(tables: Tables) -> DataFrame:
    """Page addresses without tracking parameters and fragments."""
    return tables.pages.select("page_id", text.canonical_url(F.col("url")).alias("canonical_url"))
