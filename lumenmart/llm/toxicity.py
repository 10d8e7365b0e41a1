"""Toxicity by compression distance.

Two zstandard dictionaries hold what is typical: the ordinary one the most widespread words of ordinary
training texts, the toxic one the same and, nearest to the data, the words that toxic training texts have
significantly more often. A window (one word, written `REPEAT` times, as the compressor gains nothing on
a few bytes) that compresses shorter with the toxic dictionary speaks for toxicity; the gain is the
difference of the two lengths. The gain a window must reach, the number of toxic words and the weights
that turn the gains of a document into a probability are calibrated on training rows left out of the
dictionaries.

Dictionaries and calibration use a bounded sample of labelled rows (`SAMPLE`); scoring reads whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lumenmart.llm.common import BLANK, lean, spread, stage, tune

#: Most labelled rows of each class that dictionaries and calibration use: the smallest hashes of the ids.
SAMPLE = {1: 4000, 0: 8000}
FOLDS, HELD_FOLD = 5, 0
ORDINARY_BYTES = 16_384
TOXIC_WORDS = (16, 32, 64, 128, 256, 512)
MIN_DOCUMENTS, MIN_EVIDENCE = 3, 12.0
REPEAT = 3
#: Windows, or counted words, that a worker holds at once.
MEMORY = 200_000
#: Lengths of word beginnings that may enter the toxic dictionary beside whole words.
BEGINNINGS = (4, 5, 6)
STRIP = b".,;:!?\"'()[]"


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_FOLD, F.lit(False))


def windows(text: str) -> list[bytes]:
    return [w for w in (raw.strip(STRIP) for raw in text.encode("utf-8", "surrogatepass").lower().split()) if w]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    threshold: int = 3
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    @property
    def key(self) -> int:
        return hash((self.ordinary, self.toxic))

    def probability(self, features: np.ndarray) -> np.ndarray:
        x = (features - np.array(self.mean)) / np.array(self.scale)
        return 1.0 / (1.0 + np.exp(-np.clip(x @ np.array(self.weights[1:]) + self.weights[0], -30, 30)))


class Gains:
    """Window gains under the two dictionaries, with a bounded memory of windows seen."""

    def __init__(self, model: Model) -> None:
        self.plain, self.toxic, self.known = self._machine(model.ordinary), self._machine(model.toxic), {}

    @staticmethod
    def _machine(content: bytes) -> zstandard.ZstdCompressor:
        store = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        options = zstandard.ZstdCompressionParameters.from_level(
            3, source_size=64, dict_size=len(content), min_match=3, strategy=zstandard.STRATEGY_BTULTRA,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        store.precompute_compress(compression_params=options)
        return zstandard.ZstdCompressor(dict_data=store, compression_params=options)

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words], dtype=np.int32)
        except KeyError:
            return np.array([known[w] if w in known else self._learn(w) for w in words], dtype=np.int32)

    def _learn(self, word: bytes) -> int:
        window = (b" " + word + b" ") * REPEAT
        gain = len(self.plain.compress(window)) - len(self.toxic.compress(window))
        if len(self.known) >= MEMORY:
            self.known.clear()
        self.known[word] = gain
        return gain


_GAINS: dict[int, Gains] = {}


def gains_of(model: Model) -> Gains:
    if model.key not in _GAINS:
        _GAINS.clear()
        _GAINS[model.key] = Gains(model)
    return _GAINS[model.key]


def features(gains: np.ndarray, threshold: int) -> list[float]:
    """Three largest gains, how many windows reach the threshold, and their share."""
    if not len(gains):
        return [0.0] * 5
    top = np.sort(gains[np.argpartition(-gains, min(2, len(gains) - 1))[:3]])[::-1].tolist() + [0, 0]
    hits = int((gains >= threshold).sum())
    return [float(top[0]), float(max(0, top[1])), float(max(0, top[2])), math.log1p(hits), 100.0 * hits / len(gains)]


def _filled(words: list[bytes], limit: int) -> bytes:
    """Words, best last (near the data), within the limit."""
    out, size = [], 0
    for word in words:
        if size + len(word) + 1 > limit:
            break
        out.append(word)
        size += len(word) + 1
    return b" " + b" ".join(reversed(out)) + b" "


def _telling(words: list[bytes]) -> list[bytes]:
    """The strongest of words that begin alike, in order of evidence."""
    chosen: dict[bytes, None] = {}
    begun: set[bytes] = set()
    for word in words:
        if word not in begun and not any(word[:n] in chosen for n in range(BEGINNINGS[0], len(word))):
            chosen[word] = None
            begun.update(word[:n] for n in range(BEGINNINGS[0], len(word)))
    return [*chosen][: max(TOXIC_WORDS)]


def _document_counts(sample: DataFrame) -> DataFrame:
    """Per word and beginning of a word: toxic and ordinary documents that have it."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, list[int]] = {}

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(counts, pa.binary()), *(pa.array([v[k] for v in counts.values()], pa.int64()) for k in (0, 1))], names=["word", "ordinary", "toxic"])
            counts.clear()
            return batch

        for part in parts:
            for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = set(windows(text))
                for word in words.union(w[:n] for w in words for n in BEGINNINGS if n < len(w)):
                    counts.setdefault(word, [0, 0])[label] += 1
                if len(counts) > MEMORY:
                    yield out()
        if counts:
            yield out()

    return sample.select("text", "label").mapInArrow(lean(run), "word binary, ordinary long, toxic long").groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _evidence(toxic: Column, ordinary: Column, n_toxic: int, n_ordinary: int) -> Column:
    """Log-likelihood ratio of "more frequent in toxic texts" against "equally frequent"; 0 where less frequent."""
    rate = (toxic + ordinary) / F.lit(float(n_toxic + n_ordinary))

    def part(hits: Column, of: int) -> Column:
        own = hits / F.lit(float(of))
        return F.when(hits > 0, hits * F.log(own / rate)).otherwise(0.0) + F.when(hits < of, (F.lit(of) - hits) * F.log((1 - own) / (1 - rate))).otherwise(0.0)

    return F.when(toxic * n_ordinary > ordinary * n_toxic, 2 * (part(toxic, n_toxic) + part(ordinary, n_ordinary))).otherwise(0.0)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first weight is the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sample(docs: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Bounded labelled rows outside the held-out fold: text, label, fold (0: calibration)."""
    known = (
        labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("label")).where("label in (0, 1) and _id is not null")
        .groupBy("_id").agg(F.max("label").alias("label")).where(~held_out("_id"))
    )
    chosen = None
    for label, most in SAMPLE.items():
        some = known.where(F.col("label") == label).orderBy(F.xxhash64("_id"), "_id").limit(most)
        chosen = some if chosen is None else chosen.unionByName(some)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    return stage(rows.select("text", "label", F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(3)).alias("fold")))


def _distinct(rows: DataFrame) -> DataFrame:
    """One row of each label and whole text, but for case and blanks: copies prove nothing."""
    whole = F.sha2(F.trim(F.regexp_replace(F.lower("text"), BLANK, " ")), 256)
    return rows.groupBy("label", whole).agg(F.min("text").alias("text")).select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> Model | None:
    """Dictionaries and calibration; None where a class has no labelled row."""
    sample = _sample(docs, labels, id_col)
    sizes: dict[tuple[int, bool], int] = {}
    for r in sample.groupBy("label", (F.col("fold") > 0).alias("fitting")).count().collect():
        sizes[r.label, r.fitting] = r["count"]
    if not (sizes.get((0, True)) and sizes.get((1, True)) and sizes.get((0, False)) and sizes.get((1, False))):
        return None
    distinct = stage(_distinct(sample.where("fold > 0")))
    of = {r.label: r["count"] for r in distinct.groupBy("label").count().collect()}
    counts = stage(_document_counts(distinct))
    ordinary = [bytes(r.word) for r in counts.orderBy(F.desc("ordinary"), "word").limit(4096).collect()]
    evidence = _evidence(F.col("toxic"), F.col("ordinary"), of[1], of.get(0, 1))
    typical = counts.withColumn("evidence", evidence).where((F.col("toxic") >= MIN_DOCUMENTS) & (F.col("evidence") >= MIN_EVIDENCE) & (F.length("word") > 2))
    toxic = _telling([bytes(r.word) for r in typical.orderBy(F.desc("evidence"), F.desc(F.length("word")), "word").limit(8 * max(TOXIC_WORDS)).collect()])
    base = _filled(ordinary, ORDINARY_BYTES)
    models = [Model(base, base + _filled(toxic[:n], 1 << 20)[1:]) for n in TOXIC_WORDS if n == TOXIC_WORDS[0] or n // 2 < len(toxic)]
    return _calibrated(sample.where("fold = 0"), models)


def _calibrated(sample: DataFrame, models: list[Model]) -> Model:
    """Threshold, weights and number of toxic words that explain the calibration rows best."""
    steps = range(2, 7)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = [Gains(m) for m in models]
        for part in parts:
            out = []
            for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = windows(text)
                gains = [m.of(words) for m in machines]
                out.append((label, [x for g in gains for t in steps for x in features(g, t)]))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.list_(pa.float64()))], names=["label", "x"])

    rows = spread(sample.select("text", "label")).mapInArrow(lean(run), "label int, x array<double>").collect()
    rows.sort(key=lambda r: (r.label, r.x))
    y, every = np.array([r.label for r in rows], dtype=float), np.array([r.x for r in rows]).reshape(len(rows), len(models), len(steps), 5)
    best, lowest = models[0], math.inf
    for m, model in enumerate(models):
        for t, threshold in enumerate(steps):
            x = every[:, m, t]
            mean, scale = x.mean(0), x.std(0) + 1e-6
            weights = _logistic((x - mean) / scale, y)
            candidate = Model(model.ordinary, model.toxic, threshold, mean.tolist(), scale.tolist(), weights.tolist())
            p = np.clip(candidate.probability(x), 1e-6, 1 - 1e-6)
            loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
            if loss < lowest - 1e-9:
                best, lowest = candidate, loss
    return best


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 if score >= 0.5). Null texts count as empty; without a model the score is 0."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    frame = docs.select(*kept)
    if model is None:
        return frame.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    schema = T.StructType([*frame.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for part in parts:
            texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
            x = np.array([features(gains_of(own).of(windows(t or "")), own.threshold) for t in texts]).reshape(len(texts), 5)
            p = own.probability(x)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)
        gains_of(own).known.clear()

    return frame.mapInArrow(lean(run), schema)


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score, predicted.

    Learns from labelled rows outside the held-out fold (crc32 of the id, modulo 5). Null ids are not held
    out, repeated rows get equal scores, labels that are null or not 0/1 are ignored, of several labels of
    an id the larger holds. Nothing but the text enters a score.
    """
    tune(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(own, labels)
    return score(spread(own), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
