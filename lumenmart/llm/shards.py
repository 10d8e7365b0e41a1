"""Token sequences in training order, as fixed-stride binary shards.

Documents become token ids; the ids of an input split are strung together (each document ends with the
separator) and cut into sequences of fixed length. A first pass counts the sequences of every split, so
each sequence has a global number. A keyed Feistel permutation with cycle-walking turns numbers into
slots: the training order. Rows then go to the range partition of their slot, and each partition writes
one shard whose record k sits at byte k times the stride. A reader can start at any slot.

Both passes read the same splits; the second pass checks that it sees the counts of the first.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenmart.llm.bpe import PATTERN
from lumenmart.llm.common import tune
from lumenmart.llm.feistel import permute
from lumenmart.llm.files import read_range, write_file

SEQUENCE = 1024
SHARD_BYTES = 16 << 20
SEED = 77_003
# Record: sequence number, id of the document it begins in (NO_ID if none), valid tokens, then the ids as 16-bit integers.
HEADER = "<qqI"
HEADER_BYTES = struct.calcsize(HEADER)
NO_ID = -(1 << 63)
# Name of the separator in the encoder, which cannot search for no special token at all.
SEPARATOR = "<|separator|>"


def stride(sequence: int = SEQUENCE) -> int:
    return HEADER_BYTES + 2 * sequence


class Ranks:
    """Encoder of a rank file, sent once to each executor; ids fit 16 bits and the first free id separates documents."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        with open(path, "rb") as file:
            data = file.read()
        self.separator = data.count(b"\n") + (not data.endswith(b"\n"))
        if self.separator > 65_535:
            raise ValueError("the vocabulary has more ids than 16 bits hold")
        self._sent, self.key = spark.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()

    @property
    def encoding(self):
        if self.key not in _ENCODINGS:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in self._sent.value.splitlines() if line)}
            _ENCODINGS[self.key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={SEPARATOR: self.separator})
        return _ENCODINGS[self.key]

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a text (null: none), without a Python number for each; the separator's name in a text is text like any other."""
        return self.encoding.encode_to_numpy(text or "", disallowed_special=())

    def __getstate__(self):
        return {"separator": self.separator, "_sent": self._sent, "key": self.key}


_ENCODINGS: dict[str, object] = {}


def token_ids(ranks: Ranks, text: str | None) -> np.ndarray:
    """Ids of a text (null: none) and the separator."""
    ids = ranks.ids(text)
    out = np.empty(len(ids) + 1, "<u2")
    out[:-1], out[-1] = ids, ranks.separator
    return out


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def split_counts(docs: DataFrame, ranks: Ranks) -> dict[int, int]:
    """Tokens of each input split; one number per split."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        for part in parts:
            for text in part.column(1).to_pylist():
                count += len(ranks.ids(text)) + 1
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([count], pa.int64())], names=["split", "tokens"])

    return {r.split: r.tokens for r in _rows(docs).mapInArrow(run, "split int, tokens long").collect()}


def _records(docs: DataFrame, ranks: Ranks, tokens: dict[int, int], sequence: int, seed: int, per_shard: int) -> tuple[DataFrame, int]:
    """All sequences as records with their slot, and how many there are."""
    splits = sorted(tokens)
    sizes = np.array([-(-tokens[s] // sequence) for s in splits], dtype=np.int64)
    total, base = int(sizes.sum()), dict(zip(splits, (np.cumsum(sizes) - sizes).tolist(), strict=True))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen, made = TaskContext.get().partitionId(), 0, 0
        held, begins = np.zeros(0, "<u2"), [(0, NO_ID)]

        def out(upto: int):
            """Records of the whole sequences in `held`, or of the rest, too."""
            nonlocal held, begins, made
            numbers, payloads = [], []
            for at in range(0, upto, sequence):
                ids = held[at : at + sequence]
                while len(begins) > 1 and begins[1][0] <= at:
                    begins.pop(0)
                numbers.append(base[split] + made)
                payloads.append(struct.pack(HEADER, base[split] + made, begins[0][1], len(ids)) + ids.tobytes() + b"\0" * (2 * (sequence - len(ids))))
                made += 1
            held, begins = held[upto:], [(p - upto, d) for p, d in begins]
            slots = permute(np.array(numbers, dtype=np.int64), total, seed)
            return pa.RecordBatch.from_arrays([pa.array(slots), pa.array(slots // per_shard), pa.array(payloads, pa.binary())], names=["slot", "shard", "record"])

        for part in parts:
            fresh, size = [held], len(held)
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = token_ids(ranks, text)
                begins.append((size, NO_ID if doc_id is None else doc_id))
                fresh.append(ids)
                size, seen = size + len(ids), seen + len(ids)
            held = np.concatenate(fresh)
            yield out(len(held) // sequence * sequence)
        if len(held):
            yield out(len(held))
        if seen != tokens.get(split, 0):
            raise RuntimeError(f"split {split} changed between the passes: {tokens.get(split, 0)} and {seen} tokens")

    return _rows(docs).mapInArrow(run, "slot long, shard long, record binary"), total


def write_shards(docs: DataFrame, vocabulary_path: str, folder: str, sequence: int = SEQUENCE, shard_bytes: int = SHARD_BYTES, seed: int = SEED) -> DataFrame:
    """Write all documents (doc_id, text) as shards; the shards: shard, path, first_slot, records.

    Every document gives its ids and one separator, null and empty texts only the separator; repeated
    rows and null ids are documents like others. Other columns are ignored. An empty table writes nothing.
    """
    spark = tune(docs.sparkSession)
    ranks = Ranks(spark, vocabulary_path)
    tokens = split_counts(docs, ranks)
    per_shard = max(1, shard_bytes // stride(sequence))
    records, total = _records(docs, ranks, tokens, sequence, seed, per_shard)
    shards = max(1, -(-total // per_shard))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first, held = -1, 0, []
        done: list[tuple] = []

        def close():
            path = f"{folder}/shard-{shard:08d}.bin"
            write_file(path, b"".join(held))
            done.append((shard, path, first, len(held)))

        for part in parts:
            for slot, number, record in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                if number != shard:
                    if held:
                        close()
                    shard, first, held = number, slot, []
                held.append(record)
        if held:
            close()
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(types)], names=["shard", "path", "first_slot", "records"])

    ranged = records.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("slot")
    return ranged.mapInArrow(run, "shard long, path string, first_slot long, records long")


def read_records(path: str, sequence: int, start: int, count: int) -> list[tuple[int, int, np.ndarray]]:
    """`count` records from record `start` of a shard on: sequence number, document id, token ids."""
    width, out = stride(sequence), []
    data = read_range(path, start * width, count * width)
    for at in range(0, len(data), width):
        number, doc_id, valid = struct.unpack_from(HEADER, data, at)
        out.append((number, doc_id, np.frombuffer(data, "<u2", valid, at + HEADER_BYTES)))
    return out


READ = 4096
MOST_TASKS = 100_000


def read_shards(shards: DataFrame, sequence: int = SEQUENCE, from_slot: int = 0) -> DataFrame:
    """Sequences from a slot on: slot, shard, sequence, doc_id (of the document it begins in), n_tokens, ids (16-bit, little-endian)."""
    runs = shards.where(F.col("first_slot") + F.col("records") > from_slot).select(
        "*", F.explode(F.sequence(F.greatest(F.lit(0), F.lit(from_slot) - F.col("first_slot")), F.col("records") - 1, F.lit(READ))).alias("start")
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for shard, path, first, records, start in zip(*(part.column(k).to_pylist() for k in range(5)), strict=True):
                found = read_records(path, sequence, start, min(READ, records - start))
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(first + start, first + start + len(found)), pa.int64()), pa.array([shard] * len(found), pa.int64()), pa.array([f[0] for f in found], pa.int64()),
                    pa.array([None if f[1] == NO_ID else f[1] for f in found], pa.int64()), pa.array([len(f[2]) for f in found], pa.int64()), pa.array([f[2].tobytes() for f in found], pa.binary()),
                ], names=["slot", "shard", "sequence", "doc_id", "n_tokens", "ids"])

    wanted = runs.select("shard", "path", "first_slot", "records", "start").repartition(min(MOST_TASKS, max(1, runs.count())), "shard", "start")
    return wanted.mapInArrow(run, "slot long, shard long, sequence long, doc_id long, n_tokens long, ids binary")
