"""Long repeated byte strings by a logarithmic family of suffix arrays.

Arrays are sparse: of every `length` bytes the suffix at one content-defined place is indexed (the
smallest hash of `GRAM` bytes among the places of that string, the leftmost of equals). Equal strings
pick the same place, so two equal strings always meet in the index, at about one entry per 85 bytes.
An entry orders by the first four bytes of its suffix, then by a fingerprint of its first `GRAM`.

The input splits form batches. A batch is sorted into an array, merge-scanned against every level the
family holds, and inserted as the smallest level; two levels of equal size merge into one of twice the
size, so a suffix is rewritten a logarithmic number of times. The scan marks the entries whose suffix
occurs elsewhere.

Around marked entries the long strings themselves are compared. The strings that picked one place
form its context. A context that occurs twice is covered whole; of the others every string of
`length` bytes is looked up among the contexts of the same entry (128-bit hashes of all of them).
Contexts shared by many rows fold into one row before any shuffle, and entries with very many
different contexts are spread over the cluster string by string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenmart.llm.common import fold, lean, plain, row_key, scratch, spread, stage, tune

LENGTH = 200
GRAM = 32
BATCHES = 4
#: Bits of the filter of marked entries: 16 MB whatever the input. It only saves work: a false hit ships a context in vain.
FILTER_BITS = 27
#: Contexts of one entry that a task compares; entries with more are spread string by string.
TOGETHER = 16_384
CHUNK = 1 << 18
BUFFER = 4 << 20

_MIX, _STEP, _STEP_2 = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_TOP, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def rolling(data: np.ndarray, size: int, step: int = _STEP) -> np.ndarray:
    """Polynomial hash of the `size` bytes from each place on, put together from powers of two."""
    hashes = (data.astype(np.uint64) + np.uint64(1)) * _MIX
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(step)
    out, covered, width, power = None, 0, 1, step
    while width <= size:
        if size & width:
            if out is None:
                out = hashes
            else:
                n = len(hashes) - covered
                out = out[:n] * np.uint64(power) + hashes[covered:] if n > 0 else hashes[:0]
            covered += width
        n = len(hashes) - width
        hashes = hashes[:n] * np.uint64(power) + hashes[width:] if n > 0 else hashes[:0]
        power = power * power & 0xFFFFFFFFFFFFFFFF
        width *= 2
    out = out ^ (out >> np.uint64(31))
    out *= _MIX
    return out ^ (out >> np.uint64(32))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return values if done == width else np.minimum(values[: len(values) - (width - done)], values[width - done :])


def picked_places(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """Per chunk: document number, picked place, first and last string start that picked it, gram hash.

    `data` holds documents back to back, `ends` where each ends. Strings never cross documents. A chunk
    border may cut one context in two, which changes no result.
    """
    starts_of = np.concatenate(([0], ends[:-1]))
    for at in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[at : at + CHUNK + length - 1]
        grams = rolling(part, GRAM)
        least = _sliding_least((grams & _TOP) | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1)
        first_doc = int(np.searchsorted(ends, at, side="right"))
        inside = starts_of[first_doc + 1 :]
        inside = inside[inside < at + len(least)] - at
        number = np.cumsum(np.bincount(inside, minlength=len(least))[: len(least)]) + first_doc
        start = np.arange(len(least)) + at
        valid = np.flatnonzero(start + length <= ends[number])
        if not len(valid):
            continue
        place, docs = (least[valid] & _LOW).astype(np.int64), number[valid]
        new = np.flatnonzero(np.concatenate(([True], (np.diff(place) != 0) | (np.diff(docs) != 0) | (np.diff(valid) != 1))))
        last = np.concatenate((new[1:], [len(valid)])) - 1
        yield docs[new], place[new] + at, valid[new] + at, valid[last] + at, grams[place[new]]


def entry_keys(data: np.ndarray, place: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """First four bytes of the suffix, then 32 bits of its fingerprint; signed order is byte order."""
    head = np.zeros(len(place), dtype=np.uint64)
    for k in range(4):
        head = head << np.uint64(8) | data[place + k]
    return ((head << np.uint64(32) | (grams & _LOW)) ^ np.uint64(1 << 63)).view(np.int64)


def filter_bit(keys: np.ndarray) -> np.ndarray:
    mixed = keys.view(np.uint64) * _MIX
    return (mixed >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column back to back, and the end of each row; no copy of the texts."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return whole, offsets[1:] - offsets[0]


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def suffix_arrays(docs: DataFrame, length: int, batches: int) -> DataFrame:
    """Entries of every batch: batch, key, how often it occurs there, one document that has it."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() % batches
        for part in parts:
            data, ends = _buffer(_column(part, "text"))
            ids = _column(part, "doc_id")
            found = [(entry_keys(data, place, grams), docs_) for docs_, place, _, _, grams in picked_places(data, ends, length)]
            if not found:
                continue
            keys, first, counts = np.unique(np.concatenate([k for k, _ in found]), return_index=True, return_counts=True)
            owner = ids.take(pa.array(np.concatenate([d for _, d in found])[first]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), number, np.int32)), pa.array(keys), pa.array(counts.astype(np.int64)), owner], names=["batch", "key", "n", "doc_id"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "batch int, key long, n long, doc_id long")
    return rows.groupBy("batch", "key").agg(F.sum("n").alias("n"), F.min("doc_id").alias("doc_id"))


class Family:
    """Suffix arrays of geometrically growing sizes, as tables in the shared folder."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.levels, self.folders = spark, {}, []

    def _write(self, entries: DataFrame) -> DataFrame:
        folder = scratch(self.spark, "suffix-level")
        entries.sortWithinPartitions("key").write.parquet(folder)
        self.folders.append(folder)
        return self.spark.read.schema(entries.schema).parquet(folder)

    def insert(self, batch: DataFrame) -> DataFrame:
        """Scan a batch against all levels, then add it; keys whose suffix occurs more than once so far."""
        seen = [batch.join(level.select("key"), "key").select("key") for level in self.levels.values()]
        hits = stage(reduce(DataFrame.unionByName, seen, batch.where("n > 1").select("key")).distinct())
        rank, carried = 0, batch
        while rank in self.levels:
            carried = self._write(carried.unionByName(self.levels.pop(rank)).groupBy("key").agg(F.sum("n").alias("n"), F.min("doc_id").alias("doc_id")))
            rank += 1
        self.levels[rank] = carried
        return hits

    def drop(self) -> None:
        """Remove the level tables; the marks are stored by then."""
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        for folder in self.folders:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)
        self.folders, self.levels = [], {}


def marked_entries(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """Keys of the entries that occur at several places, found by growing the family batch by batch."""
    family = Family(docs.sparkSession)
    arrays = stage(suffix_arrays(docs, length, batches))
    marks = [family.insert(arrays.where(F.col("batch") == number).drop("batch")) for number in range(batches)]
    family.drop()
    return stage(reduce(DataFrame.unionByName, marks).distinct())


def filter_words(marks: DataFrame) -> np.ndarray:
    """The filter of marked keys, or-ed on the cluster; at most 2^FILTER_BITS bits reach the driver."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            bit = filter_bit(_column(part, "key").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array((np.uint64(1) << (bit & 63).astype(np.uint64)).view(np.int64))], names=["slot", "bits"])

    words = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    found = marks.mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    words[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return words


PIECES = "kind string, doc_id long, text_key long, key long, context long, first int, n long, bytes binary"


def _pieces(docs: DataFrame, words, length: int) -> DataFrame:
    """Two kinds of rows around marked entries: every place ("place") and, once per task batch, every distinct context ("context")."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = words.value
        for part in parts:
            data, ends = _buffer(_column(part, "text"))
            begins = np.concatenate(([0], ends[:-1]))
            raw = data.tobytes()
            docs_, firsts, keys_, contexts = [], [], [], []
            once: dict[tuple[int, int], list] = {}
            for numbers, place, first, last, grams in picked_places(data, ends, length):
                keys = entry_keys(data, place, grams)
                bit = filter_bit(keys)
                keep = np.flatnonzero(marked[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1))
                hashed = []
                for key, a, z in zip(keys[keep].tolist(), first[keep].tolist(), last[keep].tolist(), strict=True):
                    text = raw[a : z + length]
                    digest = xxhash.xxh3_64_intdigest(text) - (1 << 63)
                    hashed.append(digest)
                    if (key, digest) in once:
                        once[key, digest][0] += 1
                    else:
                        once[key, digest] = [1, text]
                docs_.append(numbers[keep])
                firsts.append(first[keep] - begins[numbers[keep]])
                keys_.append(keys[keep])
                contexts.append(np.array(hashed, dtype=np.int64))
            if not once:
                continue
            rows, owner = sum(map(len, docs_)), pa.array(np.concatenate(docs_))
            nothing = pa.nulls(rows)
            yield pa.RecordBatch.from_arrays([
                pa.array(["place"] * rows), _column(part, "doc_id").take(owner), _column(part, "text_key").take(owner), pa.array(np.concatenate(keys_)),
                pa.array(np.concatenate(contexts)), pa.array(np.concatenate(firsts).astype(np.int32)), nothing.cast(pa.int64()), nothing.cast(pa.binary()),
            ], names=_NAMES)
            rows = len(once)
            nothing = pa.nulls(rows)
            yield pa.RecordBatch.from_arrays([
                pa.array(["context"] * rows), nothing.cast(pa.int64()), nothing.cast(pa.int64()), pa.array([k for k, _ in once], pa.int64()), pa.array([c for _, c in once], pa.int64()),
                nothing.cast(pa.int32()), pa.array([v[0] for v in once.values()], pa.int64()), pa.array([v[1] for v in once.values()], pa.binary()),
            ], names=_NAMES)

    return docs.select(*row_key(), "text").mapInArrow(lean(run), PIECES)


_NAMES = [field.split()[0] for field in PIECES.split(", ")]


def _string_hashes(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all strings of `length` bytes in the texts: text number, offset, two hashes."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    begins = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    number = np.repeat(np.arange(len(texts)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begins[number] + offset
    return number, offset, rolling(data, length)[at], rolling(data, length, _STEP_2)[at]


def _runs(offsets: np.ndarray, length: int) -> list[int]:
    """Covered byte ranges, as a flat list of starts and ends, of sorted string offsets."""
    cut = np.flatnonzero(np.diff(offsets) > length)
    return np.stack([offsets[np.concatenate(([0], cut + 1))], offsets[np.concatenate((cut, [len(offsets) - 1]))] + length], 1).ravel().tolist()


def _resolve(group: list[tuple], length: int) -> list[tuple[int, int, list[int]]]:
    """Covered ranges of contexts; all contexts of a key are in one group. Rows: key, context, n, bytes."""
    total: dict[tuple[int, int], int] = {}
    text: dict[tuple[int, int], bytes] = {}
    for key, context, n, data in group:
        total[key, context] = total.get((key, context), 0) + n
        text[key, context] = data
    per_key: dict[int, int] = {}
    for key, _ in total:
        per_key[key] = per_key.get(key, 0) + 1
    out = [(k, c, [0, len(text[k, c])]) for (k, c), n in total.items() if n > 1]
    several = [kc for kc in total if per_key[kc[0]] > 1]
    if several:
        number, offset, one, two = _string_hashes([text[kc] for kc in several], length)
        order = np.lexsort((two, one))
        same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        hit = np.zeros(len(order), dtype=bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        found = np.flatnonzero(hit)
        for part in np.split(found, np.flatnonzero(np.diff(number[found])) + 1) if len(found) else []:
            kc = several[number[part[0]]]
            if total[kc] == 1:
                out.append((*kc, _runs(offset[part], length)))
    return out


def _covered_together(contexts: DataFrame, length: int) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done(rows):
            found = _resolve(rows, length)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))], names=["key", "context", "spans"])

        for part in parts:
            for row in zip(*(_column(part, c).to_pylist() for c in ("key", "context", "n", "bytes")), strict=True):
                if size > BUFFER and held[-1][0] != row[0]:
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield done(held)

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(lean(run), "key long, context long, spans array<int>")


def _covered_apart(contexts: DataFrame, length: int) -> DataFrame:
    """The same for keys with very many contexts: one row per string, counted by the cluster."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 64):
                some = part.slice(at, 64)
                number, offset, one, two = _string_hashes(_column(some, "bytes").to_pylist(), length)
                owner = pa.array(number)
                yield pa.RecordBatch.from_arrays([_column(some, "key").take(owner), _column(some, "context").take(owner), pa.array(offset.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), _column(some, "n").take(owner)], names=["key", "context", "at", "one", "two", "n"])

    distinct = contexts.groupBy("key", "context").agg(F.sum("n").alias("n"), F.first("bytes").alias("bytes"))
    strings = distinct.mapInArrow(run, "key long, context long, at int, one long, two long, n long")
    repeated = strings.groupBy("one", "two").agg(F.sum("n").alias("times")).where("times > 1").select("one", "two")
    hits = strings.join(repeated, ["one", "two"]).select("key", "context", F.array(F.col("at"), F.col("at") + length).alias("span"))
    return hits.groupBy("key", "context").agg(F.flatten(F.sort_array(F.collect_list("span"))).alias("spans"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """Byte ranges that repeat: doc_id, text_key (a hash of the text), spans (starts and ends, flat, may overlap).

    `docs` has doc_id and text; rows equal in both share one result, and each of them counts as an
    occurrence. Documents without a repeat have no row.
    """
    spark = docs.sparkSession
    marks = marked_entries(docs, length, batches)
    words = spark.sparkContext.broadcast(filter_words(marks))
    folder = scratch(spark, "suffix-pieces")
    _pieces(docs, words, length).write.partitionBy("kind").option("compression", "zstd").parquet(folder)
    pieces = spark.read.schema(PIECES).parquet(folder)
    contexts = pieces.where("kind = 'context'").select("key", "context", "n", "bytes")
    crowded = stage(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > TOGETHER).select("key"))
    if crowded.isEmpty():
        covered = _covered_together(contexts, length)
    else:
        covered = _covered_together(contexts.join(crowded, "key", "left_anti"), length).unionByName(_covered_apart(contexts.join(crowded, "key", "left_semi"), length))
    places = pieces.where("kind = 'place'").select("doc_id", "text_key", "key", "context", "first")
    return (
        places.join(covered, ["key", "context"])
        .select("doc_id", "text_key", F.transform("spans", lambda x: x + F.col("first")).alias("spans"))
        .groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    )


def _merged(spans: list[int] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(zip(spans[::2], spans[1::2], strict=True)) if spans else []:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, batches: int = BATCHES, keep_bytes: bool = False) -> DataFrame:
    """Remove every byte covered by a `length`-byte string that also starts elsewhere.

    One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256; with
    `keep_bytes` also the remaining bytes (`kept`) and the removed runs (`spans`). Texts shorter than
    `length`, null and empty ones lose nothing; null ids and repeated rows are rows like others.
    """
    tune(docs.sparkSession)
    rows = spread(plain(docs, id_col, text_col))
    spans = repeated_spans(rows, length, batches)
    joined = fold(rows.select(*row_key(), "text"), spans, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans")
    extra = ", kept binary, spans array<struct<start: int, end: int>>" if keep_bytes else ""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for text, spans_ in zip(_column(part, "text").cast(pa.binary()).to_pylist(), _column(part, "spans").to_pylist(), strict=True):
                runs = _merged(spans_)
                edges = [0, *(x for run_ in runs for x in run_), len(text)]
                kept = b"".join([text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)]) if runs else text
                out.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "end": z} for a, z in runs]) if keep_bytes else (len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"][: 6 if keep_bytes else 4]
            yield pa.RecordBatch.from_arrays([_column(part, "doc_id"), *(pa.array([r[k] for r in out], types[k]) for k in range(len(names)))], names=["doc_id", *names])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + extra)
