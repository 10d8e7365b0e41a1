"""Byte-level BPE by a contiguous rank array.

A short word is held as two small arrays: its parts (one token id between two boundaries) and the
merge ranks of adjacent parts. The smallest rank is looked up, the boundary it stands for goes, and
only the two neighbouring ranks are refreshed. Words beyond `SHORT` bytes use a heap over a linked
list, so one endless word stays near-linear.

Texts split at special tokens and then at the tokenizer's word pattern. Words repeat, so each Python
worker keeps a bounded memory of word encodings. Rows are independent: there is no shuffle.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from lumenmart.llm.common import lean, spread

SHORT = 192
MEMORY = 250_000
NO_RANK = 1 << 40

# The word pattern of the byte-level tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same pattern where a text holds only Latin letters and plain ASCII; the built-in engine is faster there.
LATIN = r"A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN_TEXT = re.compile(rf"[\t\n\r -~{LATIN}]*")
PLAIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\t\n\r 0-9{LATIN}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+"


def byte_letters() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes in vocabulary files: printable bytes keep their code point."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in kept}
    for place, b in enumerate(sorted(set(range(256)) - set(kept))):
        letters[b] = chr(256 + place)
    return letters


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model = spec["model"]
        back = {letter: b for b, letter in byte_letters().items()}
        vocabulary = model["vocab"]
        self.token: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in vocabulary.items() if all(c in back for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token.update({i: t.encode() for t, i in self.special.items()})
        self.single = [vocabulary[letter] for _, letter in sorted(byte_letters().items())]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for place, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocabulary[left] << 32 | vocabulary[right]] = place
            self.merged.append(vocabulary[left + right])
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern, self.plain_pattern = regex.compile(PATTERN), re.compile(PLAIN_PATTERN)
        self.memory: dict[str, bytes] = {}
        self.flat = [self.token.get(i, b"") for i in range(max(self.token) + 1)]

    def word(self, data: bytes) -> list[int]:
        """Token ids of one word."""
        parts = [self.single[b] for b in data]
        return self._rank_array(parts) if len(parts) <= SHORT else self._heap(parts)

    def _rank_array(self, parts: list[int]) -> list[int]:
        look = self.rank.get
        ranks = [look(a << 32 | b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            at = ranks.index(least)
            parts[at] = self.merged[least]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = look(parts[at - 1] << 32 | parts[at], NO_RANK)
            if at < len(ranks):
                ranks[at] = look(parts[at] << 32 | parts[at + 1], NO_RANK)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        size, look = len(parts), self.rank.get
        after, before = [*range(1, size), -1], [*range(-1, size - 1)]
        heap = [(r, i) for i in range(size - 1) if (r := look(parts[i] << 32 | parts[i + 1], NO_RANK)) != NO_RANK]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            right = after[at]
            if parts[at] < 0 or right < 0 or look(parts[at] << 32 | parts[right], NO_RANK) != rank:
                continue  # an entry from before a merge
            parts[at], parts[right] = self.merged[rank], -1
            after[at] = after[right]
            if after[right] >= 0:
                before[after[right]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] >= 0:
                    found = look(parts[left] << 32 | parts[after[left]], NO_RANK)
                    if found != NO_RANK:
                        heapq.heappush(heap, (found, left))
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        memory, out = self.memory, []
        for piece in self.splitter.split(text) if self.splitter else [text]:
            if piece in self.special:
                out.append(np.uint32(self.special[piece]).tobytes())
                continue
            words = (self.plain_pattern if PLAIN_TEXT.fullmatch(piece) else self.pattern).findall(piece)
            try:
                out.append(b"".join([memory[w] for w in words]))
            except KeyError:
                out.append(b"".join([memory.get(w) or self._learn(w) for w in words]))
        return b"".join(out)

    def _learn(self, word: str) -> bytes:
        data = word.encode("utf-8", "surrogatepass")
        ids = np.array(self.word(data), dtype="<u4").tobytes()
        if len(data) <= SHORT:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[word] = ids
        return ids

    def decode(self, ids: bytes) -> str:
        """Text of the ids; bytes that are no UTF-8 become replacement characters."""
        flat = self.flat
        return b"".join([flat[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def codec_of(spec) -> Codec:
    """One codec per worker and vocabulary, however many tasks it serves."""
    if spec.id not in _CODECS:
        _CODECS.clear()
        _CODECS[spec.id] = Codec(spec.value)
    return _CODECS[spec.id]


class _Spec:
    """A vocabulary file sent once to each executor; its size does not depend on the data."""

    def __init__(self, spark, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            self._sent = spark.sparkContext.broadcast(file.read())
        self.id = hash(path)

    @property
    def value(self) -> str:
        return self._sent.value


def _batches(frame: DataFrame, text_col: str, added: T.StructType, make) -> DataFrame:
    """Append columns computed from the text column, batch by batch."""
    kept = [c for c in frame.columns if c not in added.names]
    schema = T.StructType([*frame.select(*kept).schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = make(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *columns], names=schema.names)

    return frame.mapInArrow(lean(run), schema)


def encode(docs: DataFrame, vocabulary_path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Add `out_col`: the ids as little-endian unsigned 32-bit integers, and `n_tokens`. Null texts count as empty."""
    spec = _Spec(docs.sparkSession, vocabulary_path)

    def make(texts):
        ids = [codec_of(spec).encode(t or "") for t in texts]
        return [pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())]

    return _batches(docs, text_col, T.StructType([T.StructField(out_col, T.BinaryType()), T.StructField("n_tokens", T.LongType())]), make)


def decode(tokens: DataFrame, vocabulary_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add `out_col`: the text of the ids; null ids give an empty text."""
    spec = _Spec(tokens.sparkSession, vocabulary_path)
    return _batches(
        tokens, ids_col, T.StructType([T.StructField(out_col, T.StringType())]),
        lambda ids: [pa.array([codec_of(spec).decode(i or b"") for i in ids], pa.string())],
    )


def transcode(docs: DataFrame, vocabulary_path: str, text_col: str = "text") -> DataFrame:
    """Add ids, n_tokens and decoded (the text decoded from the ids) in one pass, hence with one worker per task."""
    spec = _Spec(docs.sparkSession, vocabulary_path)
    added = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])

    def make(texts):
        codec = codec_of(spec)
        ids = [codec.encode(t or "") for t in texts]
        return [pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([codec.decode(i) for i in ids], pa.string())]

    return _batches(docs, text_col, added, make)


DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def round_trip(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, digest of the ids, digest of the decoded text.

    One row per input row, repeated rows and null ids included. Null and empty texts have no tokens.
    Ids and texts stay inside the task, only the digests leave it.
    """
    spec = _Spec(docs.sparkSession, vocabulary_path)
    columns = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def make(texts):
        codec, rows = codec_of(spec), []
        for text in texts:
            ids = codec.encode(text)
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()))
        return [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]

    return _batches(spread(columns), "text", DIGEST, make).drop("text")
