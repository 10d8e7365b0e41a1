"""Pipeline stages: each takes (spark, docs, sf_dir) and lets one operator decide on the documents.

All but the last return the columns of `docs`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lumenmart.llm import bpe, chosen_path, mixing, stream_dedup, toxicity
from lumenmart.llm.common import table, tune, whole_row
from lumenmart.llm.queries import vocabulary_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier does not call toxic. Null texts count as empty; columns of any other name pass through."""
    tune(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = toxicity.fit(own, table(spark, sf_dir, "labels"))
    # neutral names, so that a column called score or predicted is no other than the rest
    plain = [name if name == "text" else f"c{number}" for number, name in enumerate(docs.columns)]
    return toxicity.score(docs.toDF(*plain), model).where("predicted = 0").select(*plain).toDF(*docs.columns)


def _named(doc_id: str = "doc_id") -> Column:
    """The id as a key that is never null."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def _one_each(docs: DataFrame, digest: Column, kept: DataFrame) -> DataFrame:
    """Rows of `docs` whose id and digest are in `kept` (name, digest); of rows equal in both one. Both steps share one shuffle.

    The row travels as one column, so none of its names meets the keys.
    """
    packed = docs.select(whole_row(docs), _named().alias("name"), digest.alias("digest"))
    order = [F.col("row")[name] for name in ("source", "lang", "n_chars") if name in docs.columns] or [F.lit(1)]
    place = F.row_number().over(Window.partitionBy("name", "digest").orderBy(*order))
    return packed.join(kept.select("name", "digest"), ["name", "digest"], "left_semi").withColumn("place", place).where("place = 1").select("row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal texts; null texts are empty ones. An empty table stays empty."""
    tune(spark)
    kept = stream_dedup.exact_groups(docs).where("kept").select(_named().alias("name"), F.col("text_sha256").alias("digest"))
    return _one_each(docs, F.sha2(stream_dedup.normalised(F.col("text")), 256), kept)


def near_deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per class: the one that gives it the name, told from others with its id by its text.

    Texts too short for a word n-gram are classes of their own, null texts among them.
    """
    tune(spark)
    kept = chosen_path.class_firsts(docs).select(_named().alias("name"), F.col("text_key").alias("digest"))
    return _one_each(docs, chosen_path.text_key(F.col("text")), kept)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: one row per document and copy, cut to the words taken."""
    tune(spark)
    return mixing.mixed_documents(docs, mixing.mix(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the digest of the decoded text of every document; lang and source stay where there are such columns.

    Null texts have no tokens; an empty table gives no rows.
    """
    tune(spark)
    known = [name for name in ("doc_id", "lang", "source") if name in docs.columns]
    tokens = bpe.transcode(docs.select(*known, "text"), vocabulary_path())
    return tokens.select(*known, "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
