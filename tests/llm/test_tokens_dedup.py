"""Encoding against the tokenizers library; exact dedup against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenmart.llm import bpe, stream_dedup
from lumenmart.llm.common import scratch
from lumenmart.llm.queries import vocabulary_path
from lumenmart.session import stage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, full string"
ODD = [
    None, "", " ", "a", "a  b", "a b", "\ta\nb ", "x<|endoftext|>y", "<|endoftext|>", "don't WE'LL it's", "  lead", "trail  \n\n ", "12³ ½ Ⅻ一二", "naïve café ñandú ß ſ",
    "日本語 テスト 🙂🙂 é", "\x1c\x1d a\x85b\xa0c　d", "a" * 5000, "ab" * 3000 + " " + "=" * 900, "\x00\x07", "word " * 3000,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None, "k", "f") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def test_encoding_equals_library(spark, library):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABC  \n\t'.,0123456789é日🙂½_-<|>"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(400))) for _ in range(300)]
    rows = {r.doc_id: r for r in bpe.round_trip(frame(spark, texts), vocabulary_path()).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids), repr(text)[:80]
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encoding_of_a_table_equals_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r.ids_sha256 for r in bpe.round_trip(docs, vocabulary_path()).collect()}
    for r in docs.collect():
        assert rows[r.doc_id] == hashlib.sha256(np.array(library.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()


def test_columns_of_encode_and_decode(spark):
    tokens = bpe.encode(frame(spark, ["one two", None]).withColumn("ids", F.lit(1)), vocabulary_path())
    back = bpe.decode(tokens, vocabulary_path()).orderBy("doc_id").collect()
    assert [r.decoded for r in back] == ["one two", ""] and [r.n_tokens for r in back] == [2, 0]
    assert bpe.round_trip(frame(spark, []), vocabulary_path()).count() == 0


def test_long_and_short_words_merge_alike():
    codec = bpe.Codec(open(vocabulary_path(), encoding="utf-8").read())
    for word in ("thththth" * 12, "=" * 150, "abcabcab" * 20, "zß日" * 20):
        parts = [codec.single[b] for b in word.encode()]
        assert codec._rank_array(list(parts)) == codec._heap(list(parts))


def brute(texts, ids):
    full = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    groups = collections.defaultdict(list)
    for t, i in zip(full, ids, strict=True):
        groups[t].append(i)
    least = {t: min(g, key=lambda i: (i is None, i or 0)) for t, g in groups.items()}
    return sorted(((i, least[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for t, i in zip(full, ids, strict=True)), key=repr)


def test_exact_groups_equal_brute_force(spark):
    texts = ["a b", "a\t\n b", "a  b ", "", None, " ", "\x0b", "x", "x", "x", "A b", "a b", "x", "long " * 5000]
    ids = [9, 3, 4, 5, 6, 7, 8, 2, 1, 1, 11, 12, None, None]
    for files in (None, 1):
        got = stream_dedup.exact_groups(frame(spark, texts, ids).repartition(5), files_per_batch=files).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(texts, ids)
        kept = collections.Counter(r.text_sha256 for r in got if r.kept)
        assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in got})
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_groups_of_nothing(spark):
    assert stream_dedup.exact_groups(frame(spark, [])).count() == 0


def fingerprint_rows(spark, texts):
    return stream_dedup.fingerprints(stream_dedup.located(frame(spark, texts).repartition(3)))


def test_state_grows_over_batches(spark):
    folder = scratch(spark, "fp")
    fingerprint_rows(spark, ["same"] * 40 + ["other"]).repartition(8).write.parquet(folder)
    state = stream_dedup.state_log(spark, folder, files_per_batch=1).collect()
    assert sorted(r.n for r in state) == [1, 40] and sorted(r.first.doc_id for r in state) == [0, 40]


def test_locators_find_the_rows_again(spark):
    texts = [f"text {n}" for n in range(50)]
    found = stage(stream_dedup.located(frame(spark, texts).repartition(4)))
    assert all(r.file for r in found.collect()) and len({(r.file, r.row) for r in found.collect()}) == 50
    docs = stream_dedup.located(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    wanted = docs.where("doc_id % 7 = 3").select("file", "row")
    got = {r.doc_id: r.text for r in stream_dedup.fetched(docs, wanted).collect()}
    assert got == {r.doc_id: r.text for r in docs.where("doc_id % 7 = 3").collect()}
    assert stream_dedup.fetched(docs, wanted.limit(0)).count() == 0


def test_hit_on_state_of_an_earlier_batch(spark, tmp_path):
    """Every digest comes again in a later batch, with a smaller id: state, not the batch, must tell the group."""
    frame(spark, ["a  b", "c", "d"], [30, 31, 32]).coalesce(1).write.parquet(str(tmp_path / "docs"))
    frame(spark, ["a b", "c", "e"], [20, 41, 22]).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    folder = scratch(spark, "fp")
    for part in (docs.where("doc_id >= 30 and doc_id < 40"), docs.where("doc_id < 30 or doc_id > 40")):
        stream_dedup.fingerprints(stream_dedup.located(part)).coalesce(1).write.mode("append").parquet(folder)
    state = {(r.first.doc_id, r.n) for r in stream_dedup.state_log(spark, folder, files_per_batch=1).collect()}
    assert state == {(20, 2), (31, 2), (32, 1), (22, 1)}
    got = stream_dedup.exact_groups(docs, files_per_batch=1).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [
        (20, 20, 2, True), (22, 22, 1, True), (30, 20, 2, False), (31, 31, 2, True), (32, 32, 1, True), (41, 31, 2, False)]


def test_clashing_digests_are_told_apart_by_full_bytes(spark):
    """A digest that knows two values only: every group must come from the bytes."""
    texts = [f"text {n % 9}" for n in range(40)] + ["text  1", None, ""]
    forged = lambda full: F.unhex(F.when(F.length(full) > 0, F.lit("00")).otherwise("01"))
    got = stream_dedup.exact_groups(frame(spark, texts).repartition(6), files_per_batch=2, digest=forged).collect()
    want = {(i, keep, size) for i, keep, size, _ in brute(texts, range(len(texts)))}
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == want and len(got) == len(texts)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_registered_query_takes_several_batches(spark):
    folder = "/root/testdata/sf0.1"
    batches = []
    real = stream_dedup.state_log

    def watched(session, place, per_batch):
        batches.append(-(-len([f for f in spark.read.parquet(place).inputFiles()]) // per_batch))
        return real(session, place, per_batch)

    stream_dedup.state_log = watched
    try:
        rows = stream_dedup.exact_groups(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    finally:
        stream_dedup.state_log = real
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert batches[0] >= 4
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=repr) == brute([r.text for r in docs], [r.doc_id for r in docs])
