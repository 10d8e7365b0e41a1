"""Set similarity join on word n-grams by chosen paths.

A text is the set of its word n-grams; texts with equal sets form one class and take part once. A set is
embedded as `SKETCH` minhashes, and a path is a series of sampled (coordinate, value) tokens. All sets
with a path form a bucket. Buckets above `SMALL` sets are split: every node samples `BRANCH` coordinates
from its own hash, so two sets in a node share a child with probability 1 - (1 - J)^BRANCH, and the chance
of meeting at any depth stays above the fixed point of that recursion. Runs repeat with other samples until
the chance of missing a pair at the least similarity is below 1 - RECALL.

Small buckets are searched by brute force on the sketches; candidate pairs are verified on the exact sets,
each pair only in the first bucket both share, so links are counted once and never leave the task as pairs:
a bucket returns link counts and a spanning forest. Buckets that are still large after `DEPTH` splits are
cut into blocks, and every pair of blocks is a bucket of its own: nothing is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lumenmart.llm.common import lean, plain, small_slices, spread, stage, tune
from lumenmart.llm.suffix_levels import filter_bit, filter_words
from lumenmart.operators.dedupe import connected_keys

WORDS = 5
SIMILARITY = (4, 5)
SKETCH = 64
BRANCH = 2
SMALL = 2048
DEPTH = 3
RECALL = 0.99999
#: Equal minhashes of a candidate pair: five standard deviations below what the least similarity gives, rounded down.
AGREE = 35
#: Bytes of text hashed at once.
TOGETHER = 1 << 18

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def runs_needed(similarity: float = SIMILARITY[0] / SIMILARITY[1], branch: int = BRANCH, recall: float = RECALL) -> int:
    """Runs after which a pair of the least similarity was missed by all with probability 1 - recall at most."""
    meet = 1.0
    for _ in range(1000):
        meet = 1 - (1 - similarity * meet) ** branch
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text; a shorter text with words is one n-gram, one without has none."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        yield from (np.zeros(0, np.uint64) for _ in range(len(column)))
        return
    solid = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins = np.flatnonzero(solid & (np.concatenate(([True], ~solid[:-1])) | edge[:-1]))
    ends = np.flatnonzero(solid & (np.concatenate((~solid[1:], [True])) | edge[1:])) + 1
    # hash of each word: sum of its bytes times powers of its places, from running sums
    length = ends - begins
    if len(begins):
        place = np.arange(len(data)) - np.repeat(begins, np.diff(np.append(begins, len(data))))[: len(data)] if begins[0] == 0 else np.concatenate((np.zeros(begins[0], np.int64), np.arange(begins[0], len(data)) - np.repeat(begins, np.diff(np.append(begins, len(data))))))
        powers = np.cumprod(np.full(int(length.max()) + 1, 0xD6E8FEB86659FD93, np.uint64))
        value = _mixed((data.astype(np.uint64) + np.uint64(1)) * _MIX) * powers[np.minimum(place, len(powers) - 1)]
        value[~solid] = 0
        hashes = _mixed(np.add.reduceat(value, begins) + length.astype(np.uint64) * _MIX)
    else:
        hashes = np.zeros(0, np.uint64)
    bounds = np.searchsorted(begins, offsets)
    grams, step = hashes.copy(), np.uint64(1)
    for k in range(1, words):
        step = np.uint64(int(step) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)
        grams[: max(0, len(grams) - k)] += hashes[k:] * step
    grams = _mixed(grams)
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        n = z - a
        if n >= words:
            yield np.unique(grams[a : z - words + 1])
        elif n:
            yield np.array([xxhash.xxh3_64_intdigest(hashes[a:z].tobytes())], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def _functions(size: int = SKETCH) -> tuple[np.ndarray, np.ndarray]:
    seeds = _mixed(np.arange(1, 2 * size + 1, dtype=np.uint64) * _MIX)
    return seeds[:size] | np.uint64(1), seeds[size:]


def sketch(grams: np.ndarray, functions) -> np.ndarray:
    """Minhashes of a set, 32 bits each."""
    times, plus = functions
    out = np.full(len(times), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(grams), 4096):
        part = grams[at : at + 4096, None] * times + plus
        out = np.minimum(out, ((part ^ (part >> np.uint64(29))) * _MIX >> np.uint64(32)).astype(np.uint32).min(0))
    return out


def _children(path: int, branch: int = BRANCH, size: int = SKETCH) -> list[int]:
    """Coordinates that the node of a path samples."""
    out, salt = [], 0
    while len(out) < branch:
        coordinate = xxhash.xxh3_64_intdigest((path & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little"), seed=salt) % size
        if coordinate not in out:
            out.append(coordinate)
        salt += 1
    return out


def _child(path: int, coordinate: int, value: int) -> int:
    return xxhash.xxh3_64_intdigest((path & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little") + coordinate.to_bytes(4, "little") + value.to_bytes(4, "little")) - (1 << 63)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _set_id(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def described(docs: DataFrame, words: int) -> DataFrame:
    """Per row: doc_id (and text_key, where `docs` has it), set_id (null without words), n, sketch."""
    functions, named = _functions(), [c for c in ("doc_id", "text_key") if c in docs.columns]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (small for whole in parts for small in small_slices(whole, "text", TOGETHER)):
            sets = list(shingle_sets(_column(part, "text"), words))
            yield pa.RecordBatch.from_arrays([
                *(_column(part, c) for c in named), pa.array([_set_id(s) if len(s) else None for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([sketch(s, functions).tobytes() if len(s) else None for s in sets], pa.binary()),
            ], names=[*named, "set_id", "n", "sketch"])

    schema = ", ".join({"doc_id": "doc_id long", "text_key": "text_key binary"}[c] for c in named)
    return docs.select(*named, "text").mapInArrow(lean(run), f"{schema}, set_id binary, n long, sketch binary")


def _paths(rows: DataFrame, roots: int | None) -> DataFrame:
    """Next paths of rows of (path,) set_id, sketch; with `roots`, the first ones of so many runs."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, sketches = _column(part, "set_id").to_pylist(), [np.frombuffer(s, np.uint32) for s in _column(part, "sketch").to_pylist()]
            nodes = [range(roots)] * len(ids) if roots else [(p,) for p in _column(part, "path").to_pylist()]
            out = [(_child(p, c, int(s[c])), i) for i, s, ps in zip(ids, sketches, nodes, strict=True) for p in ps for c in _children(p)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], names=["path", "set_id"])

    return rows.mapInArrow(run, "path long, set_id binary").distinct()


def leaves(sets: DataFrame, small: int = SMALL, depth: int = DEPTH, runs: int | None = None) -> DataFrame:
    """Buckets to search: path, set_id, size. `sets`: set_id, sketch."""
    level, done = _paths(sets, runs or runs_needed()), []
    for step in range(depth + 1):
        level = stage(level)
        sizes = level.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        counted = stage(level.join(sizes, "path"))
        large = counted.where(F.col("size") > small)
        if step == depth or large.isEmpty():
            done.append(counted)
            break
        done.append(counted.where(F.col("size") <= small))
        level = _paths(large.join(sets, "set_id").select("path", "set_id", "sketch"), None)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _blocked(rows: DataFrame, small: int) -> DataFrame:
    """One row per bucket and set; in too large a bucket one per pair of blocks the set belongs to. cross: only pairs between the blocks count."""
    blocks = F.ceil(F.col("size") / F.lit(small)).cast("int")
    own = F.pmod(F.xxhash64("set_id", "path"), blocks).cast("int")
    crowded = rows.where(F.col("size") > small).withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.where(F.col("size") <= small).select("path", "set_id", F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("side")).unionByName(
        crowded.select("path", "set_id", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    )


def _candidates(rows: list[dict], agree: int) -> list[tuple[int, np.ndarray]]:
    """For each row of a bucket the later rows that look similar and share no earlier bucket with it."""
    sketches = np.stack([np.frombuffer(r["sketch"], np.uint32) for r in rows])
    size = np.array([r["n"] for r in rows])
    cross = rows[0]["low"] != rows[0]["high"]
    side = np.array([r["side"] for r in rows])
    shared = [set(r["paths"]) for r in rows]
    path, out = rows[0]["path"], []
    part, whole = SIMILARITY
    for i in range(len(rows) - 1):
        near = (sketches[i + 1 :] == sketches[i]).sum(1) >= agree
        near &= (whole * size[i + 1 :] >= part * size[i]) & (whole * size[i] >= part * size[i + 1 :])
        if cross:
            near &= side[i + 1 :] != side[i]
        found = np.flatnonzero(near) + i + 1
        found = [j for j in found.tolist() if min(shared[i] & shared[j]) == path]
        if found:
            out.append((i, np.array(found)))
    return out


def _links(rows: list[dict], pairs: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Exact links among the candidate pairs: how many per row, and a spanning forest of them."""
    sets = [np.frombuffer(r["grams"], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    grams = np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    count, root, forest = np.zeros(len(rows), np.int64), list(range(len(rows))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    part, whole = SIMILARITY
    for i, others in pairs:
        lo, hi = np.searchsorted(grams, sets[i], "left"), np.searchsorted(grams, sets[i], "right")
        width = hi - lo
        at = np.repeat(lo - np.cumsum(width) + width, width) + np.arange(width.sum())
        common = np.bincount(owner[at], minlength=len(rows))[others]
        linked = others[whole * common >= part * (sizes[i] + sizes[others] - common)]
        count[i] += len(linked)
        count[linked] += 1
        for j in linked.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[b] = a
                forest.append((i, j))
    return count, forest


BUCKET = ("path", "low", "high")


def _per_bucket(rows: DataFrame, columns: tuple[str, ...], make: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """Apply `make` to the rows of each bucket; buckets are bounded, tasks stream over them."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done():
            found = make(held) if len(held) > 1 else []
            return pa.RecordBatch.from_pylist([dict(zip(names, f, strict=True)) for f in found], schema=shape)

        shape = pa.schema([(f.split()[0], {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}[f.split()[1]]) for f in schema.split(", ")])
        for part in parts:
            for at in range(0, part.num_rows, 1024):
                for row in part.slice(at, 1024).to_pylist():
                    if held and any(held[0][c] != row[c] for c in BUCKET):
                        yield done()
                        held.clear()
                    held.append(row)
        if held:
            yield done()

    return rows.select(*columns).repartition(*BUCKET).sortWithinPartitions(*BUCKET, "set_id").mapInArrow(lean(run), schema)


def links(docs: DataFrame, sets: DataFrame, words: int = WORDS, small: int = SMALL, depth: int = DEPTH, agree: int = AGREE) -> DataFrame:
    """Verified links of each set: set_id, n_links, and spanning edges (other). `sets`: set_id, n, sketch, one row each."""
    spark = docs.sparkSession
    found = stage(leaves(sets.select("set_id", "sketch"), small, depth))
    own = found.groupBy("set_id").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    about = stage(sets.join(own, "set_id"))
    buckets = stage(_blocked(found, small))
    columns = (*BUCKET, "side", "set_id", "n", "sketch", "paths")

    def involved(rows: list[dict]) -> list[tuple]:
        pairs = _candidates(rows, agree)
        some = {i for i, _ in pairs}.union(*(js.tolist() for _, js in pairs))
        return [(rows[i]["path"], rows[i]["low"], rows[i]["high"], rows[i]["side"], rows[i]["set_id"]) for i in sorted(some)]

    chosen = stage(_per_bucket(buckets.join(about, "set_id"), columns, involved, "path long, low int, high int, side int, set_id binary"))
    # the exact sets of these, read again from the texts; the filter only saves work, the join decides
    wanted = chosen.select("set_id").distinct()
    sent = spark.sparkContext.broadcast(filter_words(wanted.select(F.xxhash64("set_id").alias("key"))))

    def exact(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, seed = sent.value, 42
        for part in (small for whole in parts for small in small_slices(whole, "text", TOGETHER)):
            ids, grams = [], []
            for s in shingle_sets(_column(part, "text"), words):
                if len(s):
                    name = _set_id(s)
                    bit = filter_bit(np.array([xxhash.xxh64_intdigest(name, seed=seed)], np.uint64).view(np.int64))[0]
                    if marked[bit >> 6] >> np.uint64(bit & 63) & np.uint64(1):
                        ids.append(name)
                        grams.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(grams, pa.binary())], names=["set_id", "grams"])

    texts = docs.select("text").mapInArrow(lean(exact), "set_id binary, grams binary").join(wanted, "set_id", "left_semi").dropDuplicates(["set_id"])
    full = chosen.join(about, "set_id").join(texts, "set_id")

    def verify(rows: list[dict]) -> list[tuple]:
        count, forest = _links(rows, _candidates(rows, agree))
        return [(rows[i]["set_id"], int(n), None) for i, n in enumerate(count) if n] + [(rows[i]["set_id"], 0, rows[j]["set_id"]) for i, j in forest]

    return _per_bucket(full, (*columns, "grams"), verify, "set_id binary, n_links long, other binary")


def _by_class(rows: DataFrame, least: Column, words: int, small: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """The described rows; and per set its component, the smallest `least` of its rows, n_links (null without links) and n_copies."""
    members = stage(described(rows, words))
    sets = stage(members.where("set_id is not null").groupBy("set_id").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min(least).alias("least"), F.count(F.lit(1)).alias("n_copies")))
    found = stage(links(rows, sets, words, small, depth))
    counts = found.groupBy("set_id").agg(F.sum("n_links").alias("n_links"))
    edges = found.where("other is not null").select(F.col("set_id").alias("a"), F.col("other").alias("b"))
    component = connected_keys(edges).select(F.col("key").alias("set_id"), "component")
    named = sets.select("set_id", "least", "n_copies").join(counts, "set_id", "left").join(component, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    return members, named


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, n_copies.

    Words end at blanks; case and punctuation count. Texts are linked when the Jaccard similarity of their
    word n-grams is at least 0.8. class_id is the smallest id that is linked, directly or through others
    (null ids only if there is no other). n_links counts the different n-gram sets linked directly, n_copies
    the rows with the same set. Rows without words stand alone, as their own class. An empty table has no rows.
    """
    tune(docs.sparkSession)
    members, named = _by_class(spread(plain(docs, id_col, text_col)), F.col("doc_id"), words, small, depth)
    smallest = named.groupBy("component").agg(F.min("least").alias("class_id"))
    per_set = stage(named.join(smallest, "component").select("set_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"))
    with_words = members.where("set_id is not null").select("doc_id", "set_id").join(per_set, "set_id").select("doc_id", "class_id", "n_links", "n_copies")
    without = members.where("set_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return with_words.unionByName(without)


def text_key(text: Column) -> Column:
    """Digest of a whole text as it stands; null as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def class_firsts(docs: DataFrame, words: int = WORDS, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """doc_id and text_key of one row per class of `similar_classes`: the smallest id (null only if there is no other), then the smallest key."""
    tune(docs.sparkSession)
    rows = spread(plain(docs)).withColumn("text_key", text_key(F.col("text")))
    members, named = _by_class(rows, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"), words, small, depth)
    firsts = named.groupBy("component").agg(F.min("least").alias("first")).select("first.doc_id", "first.text_key")
    return firsts.unionByName(members.where("set_id is null").select("doc_id", "text_key"))
