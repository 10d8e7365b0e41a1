"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from lumenmart.llm import (
    bpe, brown, chosen_path, filter_audit, imatch, mixing, periodic, permutation, shards, stream_dedup, suffix_levels, toxicity, warc,
)
from lumenmart.llm.common import scratch, stage, table, tune

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """A public vocabulary file; the folder may be set by TOKENIZER_DIR."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark, sf_dir):
    tune(spark)
    return toxicity.scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_brown_classes(spark, sf_dir):
    return brown.scored_documents(table(tune(spark), sf_dir, "documents"))


def op3_permutation_index(spark, sf_dir):
    return permutation.nearest(table(tune(spark), sf_dir, "embeddings"))


def op4_token_shards(spark, sf_dir):
    docs = table(tune(spark), sf_dir, "documents")
    written = stage(shards.write_shards(docs, vocabulary_path("byte_bpe_50k.tiktoken"), scratch(spark, "shards")))
    return shards.read_shards(written).select("slot", "shard", "sequence", "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"))


def op5_chosen_path(spark, sf_dir):
    return chosen_path.similar_classes(table(tune(spark), sf_dir, "documents"))


def op6_suffix_dedup(spark, sf_dir):
    return suffix_levels.without_repeats(table(tune(spark), sf_dir, "documents"))


def op7_mixing(spark, sf_dir):
    return mixing.taken_words(mixing.mix(table(tune(spark), sf_dir, "documents")))


def op8_bpe(spark, sf_dir):
    return bpe.round_trip(table(tune(spark), sf_dir, "documents"), vocabulary_path())


def op9_warc(spark, sf_dir):
    return warc.archive_round_trip(table(tune(spark), sf_dir, "pages"), scratch(spark, "archives"))


def op10_exact_dedup(spark, sf_dir):
    return stream_dedup.exact_groups(table(tune(spark), sf_dir, "documents"))


def op11_periodic_runs(spark, sf_dir):
    return periodic.digests(table(tune(spark), sf_dir, "documents"))


def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(tune(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_imatch(spark, sf_dir):
    return imatch.compared(table(tune(spark), sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity, "op2_brown_classes": op2_brown_classes, "op3_permutation_index": op3_permutation_index,
    "op4_token_shards": op4_token_shards, "op5_chosen_path": op5_chosen_path, "op6_suffix_dedup": op6_suffix_dedup,
    "op7_mixing": op7_mixing, "op8_bpe": op8_bpe, "op9_warc": op9_warc, "op10_exact_dedup": op10_exact_dedup,
    "op11_periodic_runs": op11_periodic_runs, "op12_filter_audit": op12_filter_audit, "op13_imatch": op13_imatch,
}

ORACLES = {
    "op9_warc": r"""
        with bodies as (select page_id, encode(coalesce(html, '')) as payload from pages),
             holders as (select payload, min(page_id) as holder from bodies group by payload)
        select page_id, octet_length(payload) as payload_bytes, sha256(payload) as payload_digest,
               case when octet_length(payload) >= 100 and page_id <> holder then 'revisit' else 'response' end as record_type,
               case when octet_length(payload) >= 100 and page_id <> holder then holder end as refers_to
        from bodies join holders using (payload)""",
    "op10_exact_dedup": r"""
        with normal as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as full_text from documents),
             groups as (select full_text, min(doc_id) as keep_id, count(*) as group_size from normal group by full_text)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(full_text) as text_sha256
        from normal join groups using (full_text)""",
    "op12_filter_audit": r"""
        with flat as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as body from documents),
             words as (select *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') as w from flat),
             flagged as (
                 select words.doc_id, part,
                        case when len(w) < 200 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
                        || case when 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) then 'C' else '' end
                        || case when regexp_matches(body, '[#$%&*|]') then 'D' else '' end
                        || case when words.doc_id > min(words.doc_id) over (partition by body) then 'E' else '' end as fails,
                        coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as toxic
                 from words left join labels using (doc_id)),
             cells as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from flagged group by all),
             letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as letter),
             orders as (
                 select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order
                 from letters a, letters b, letters c, letters d, letters e
                 where len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5),
             steps as (
                 select filter_order, step, substr(filter_order, step, 1) as letter, '[' || filter_order[1:step] || ']' as upto,
                        case when step = 1 then '[!]' else '[' || filter_order[1:step - 1] || ']' end as before
                 from orders, (select unnest([1, 2, 3, 4, 5]) as step)),
             counted as (
                 select part, filter_order, step, letter,
                        sum(case when not regexp_matches(fails, upto) then n else 0 end) as kept,
                        sum(case when contains(fails, letter) and not regexp_matches(fails, before) then n else 0 end) as removed,
                        sum(case when contains(fails, letter) and regexp_matches(fails, before) then n else 0 end) as redundant,
                        sum(case when fails = letter then n else 0 end) as unique_fails,
                        sum(case when contains(fails, letter) and not regexp_matches(fails, before) then good else 0 end) as good_lost,
                        sum(case when contains(fails, letter) and not regexp_matches(fails, before) then toxic else 0 end) as toxic_lost
                 from cells, steps group by all)
        select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
               cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
               cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, letter) as bigint) as shapley
        from counted""",
}
