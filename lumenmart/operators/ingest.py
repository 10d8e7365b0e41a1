"""One run over new feed records, from raw fields to stored live listings and counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lumenmart.functions.text import digest
from lumenmart.operators import facts, health, listings, resolve
from lumenmart.operators.decision import DEFECT_ARRAY
from lumenmart.session import stage

FACT_COLUMNS = {
    "shutter_count": "bigint", "warranty_until": "date", "invoice_available": "boolean", "original_box_available": "boolean",
    "missing_information": "array<string>", "accessories": "array<string>", "seller_claims": "array<string>", "defects": DEFECT_ARRAY,
}
LIVE = (
    "source_id", "source_name", "source_type", "external_id", "url", "title", "description", "price", "currency", "source_country",
    "segment", "condition", "detected_at", "raw_record_reference", "product_id", "recognition_confidence", "ambiguous", "warnings",
    "evidence_count", *FACT_COLUMNS,
)


@dataclass
class Run:
    """``live``: all stored listings after the run; ``batch``: the relevant ones of this run; ``errors``; ``outcomes``: one row per record."""

    live: DataFrame
    batch: DataFrame
    errors: DataFrame
    outcomes: DataFrame


def recognized(rows: DataFrame, catalog: DataFrame, aliases: DataFrame, as_of: Column, known: resolve.Known | None = None) -> DataFrame:
    """Rows with product_id, recognition_confidence, ambiguous, warnings and the facts of the whole, still unredacted text laid over them.

    Every distinct text is recognized and read once; what was found meets the rows in one join.
    """
    for name, kind in FACT_COLUMNS.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    read = {name: F.coalesce(F.col(name), F.lit("")) for name in ("title", "description")}
    keyed = rows.withColumn("text_id", digest(*read.values()))
    texts = stage(keyed.select("text_id", *[value.alias(name) for name, value in read.items()]).distinct())
    _, chosen = resolve.recognize(texts.withColumnRenamed("text_id", "listing_id"), catalog, aliases, known)
    placed = chosen.join(catalog.select("product_id", "category"), "product_id", "left").withColumnRenamed("listing_id", "text_id").join(texts, "text_id")
    found = facts.analyze(placed, as_of).select(
        F.col("text_id").alias("found_id"), "product_id", "recognition_confidence", "ambiguous", "warnings", *facts.LAID)
    laid = facts.overlay(keyed.drop("warnings").join(stage(found), F.col("text_id") == F.col("found_id")))
    return laid.withColumn("evidence_count", listings.evidence_count()).drop("text_id", "found_id", *facts.LAID)


def run(
    records: DataFrame, sources: DataFrame, catalog: DataFrame, aliases: DataFrame, watches: DataFrame, stored: DataFrame | None,
    now: Column, requested: list[str] | None = None, known: resolve.Known | None = None,
) -> Run:
    """Normalize, recognize, read facts, match watches, filter, redact, key, merge; nothing is dropped without an outcome.

    ``records`` has source_id and the feed fields as text. Facts are read before personal data goes, keys are
    made after. The same function serves a stored folder and the batch of a stream. ``known``: the catalog's facts, where they are there already.
    """
    chosen = listings.enabled_sources(sources, requested)
    fetched = records.join(chosen.select("source_id"), "source_id", "left_semi")
    normal, errors = listings.normalize(fetched, chosen, now)
    rows = stage(normal.withColumn("listing_id", F.col("duplicate_key")).withColumn("source", F.col("source_id")))
    found = stage(recognized(rows, catalog, aliases, F.to_date(now), known))
    text = F.concat_ws("\n", "title", "description")
    wanted = stage(listings.watch_pairs(found, watches, text).select("listing_id").distinct())
    # not written: stored rows are made of it at once, outcomes read two of its columns
    judged = listings.relevance(found, wanted)
    kept = listings.with_keys(listings.without_private_data(judged.where("relevant")))
    batch = stage(listings.collapse(kept.select("duplicate_key", *LIVE), "detected_at", "raw_record_reference").select(
        "duplicate_key", F.col("duplicate_key").alias("listing_id"), "first_seen_at", "last_seen_at", *LIVE))
    live = batch if stored is None else listings.upsert(stored, batch)
    outcomes = (
        judged.select("source_id", F.lit(True).alias("normalized"), "relevant", F.lit(False).alias("error"))
        .unionByName(errors.select("source_id", F.lit(False).alias("normalized"), F.lit(False).alias("relevant"), F.lit(True).alias("error")))
        .withColumn("source_failed", F.lit(False))
    )
    return Run(live, batch, errors, outcomes)


def counters(done: Run, stored: DataFrame | None, run_id: str) -> DataFrame:
    """One row per run: outcomes of records and sources, and how many listings are new or updated."""
    base = health.run_summary(done.outcomes.withColumn("run_id", F.lit(run_id)))
    known = done.batch.select("duplicate_key") if stored is None else done.batch.select("duplicate_key").join(
        stored.select("duplicate_key", F.lit(True).alias("stored")), "duplicate_key", "left")
    seen = F.coalesce(F.col("stored"), F.lit(False)) if stored is not None else F.lit(False)
    merged = known.agg(F.count_if(~seen).alias("new"), F.count_if(seen).alias("updated")).withColumn("run_id", F.lit(run_id))
    return base.join(merged, "run_id")
