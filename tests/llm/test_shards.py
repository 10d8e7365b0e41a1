"""Shards: every sequence once, in the order of the permutation, with all tokens of all documents."""

import numpy as np

from lumenmart.llm import shards
from lumenmart.llm.common import scratch
from lumenmart.llm.feistel import permute
from lumenmart.llm.queries import vocabulary_path
from lumenmart.session import stage
from tests.llm.test_tokens_dedup import frame

RANKS = vocabulary_path("byte_bpe_50k.tiktoken")


def written(spark, docs, **options):
    return stage(shards.write_shards(docs, RANKS, scratch(spark, "shards"), **options))


def test_all_tokens_in_training_order(spark):
    texts = [None, "", "one two", "x" * 3000, "word " * 900, "é日 " * 300] + [f"text {i} of many" * (i % 9) for i in range(200)]
    ids = [None, 5, 5, *range(10, 10 + len(texts) - 3)]
    docs = stage(frame(spark, texts, ids).repartition(5))
    ranks = shards.Ranks(spark, RANKS)
    table = written(spark, docs, sequence=64, shard_bytes=40 * shards.stride(64))
    rows = shards.read_shards(table, 64).orderBy("sequence").collect()
    total = len(rows)
    assert [r.sequence for r in rows] == list(range(total)) and sorted(r.slot for r in rows) == list(range(total))
    assert [r.slot for r in rows] == permute(np.arange(total), total, shards.SEED).tolist()
    assert all(r.shard == r.slot // 40 for r in rows) and table.count() == -(-total // 40)
    have = np.concatenate([np.frombuffer(r.ids, "<u2") for r in rows]).tolist()
    cut = np.flatnonzero(np.array(have) == ranks.separator)
    documents = sorted(tuple(have[a:z]) for a, z in zip([0, *(cut + 1)], cut, strict=False))
    assert documents == sorted(tuple(shards.token_ids(ranks, t)[:-1].tolist()) for t in texts)
    assert documents == sorted(tuple(ranks.encoding.encode_ordinary(t or "")) for t in texts)
    later = shards.read_shards(table, 64, from_slot=total - 57).collect()
    assert sorted(r.slot for r in later) == list(range(total - 57, total))
    path, first = table.where("shard = 1").select("path", "first_slot").first()
    found = shards.read_records(path, 64, 3, 2)
    by_slot = {r.slot: r for r in rows}
    assert [f[2].tobytes() for f in found] == [by_slot[first + 3].ids, by_slot[first + 4].ids]


def test_beginning_documents(spark):
    table = written(spark, stage(frame(spark, ["word " * 300, "b", "c " * 200], [4, None, 6]).coalesce(1)), sequence=32)
    rows = shards.read_shards(table, 32).orderBy("sequence").collect()
    assert rows[0].doc_id == 4 and rows[-1].doc_id == 6 and {r.doc_id for r in rows} <= {4, 6, None}


def test_nothing_to_write(spark):
    table = written(spark, frame(spark, []))
    assert table.count() == 0 and shards.read_shards(table).count() == 0


def test_ids_come_as_arrays_and_equal_plain_encoding(spark):
    ranks = shards.Ranks(spark, RANKS)
    for text in (None, "", "one two", f"a {shards.SEPARATOR} b{shards.SEPARATOR}", shards.SEPARATOR * 3, "é日\U0001f600 \n\n x\x00", "x" * 500, " \t\r\n "):
        found = ranks.ids(text)
        assert isinstance(found, np.ndarray) and found.tolist() == ranks.encoding.encode_ordinary(text or "")
        assert shards.token_ids(ranks, text).tolist() == [*found.tolist(), ranks.separator]
