"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's grade is 0 (poor), 1 (well written but toxic) or 2 (good). One
score z, a sum of shared weights of hashed text features, is compared with
ordered thresholds t1 < t2: P(grade >= k) = 1 / (1 + exp(t_k - z)). From it
come the expected grade and the tail probability P(grade = 2) that decides
what is kept.

Features: for each distinct word its stem (edge punctuation off, lower case),
its first four to six letters, its trailing symbols and whether it is all
capitals; and in steps the variety of the words, the shares of capitals and of
trailing symbols among the distinct words, and the length. Only features whose
share differs clearly between grades are used, and their weights are held at
or below zero: text is good until something speaks against it, so that no
frequent passage of good documents can buy back an insult.

The model is fitted on the driver on at most ``SAMPLE`` labelled documents (in
hash order; the documented bound); everything else reads all documents, in one
pass and without a shuffle. The model is at most 2^18 numbers.

Nulls and odd rows: a null text is an empty one; labels without a document,
without an id or without ``quality`` are not used, a document labelled twice
counts with its lower grade; without any label (or with one grade only) there is nothing to learn,
and all documents are kept with tail probability 1; repeated rows are scored
alike; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import bound_batches, fresh, release_memory, table

SAMPLE = 16_384
BITS = 18
SCREEN_Z = 4.0
SCREEN_MIN = 4
EPOCHS, BATCH, RATE, L2 = 30, 256, 0.05, 1e-5
KEEP_FROM = 0.5
GRADES = 3
CACHE_WORDS = 40_000

SCORED = "expected_grade double, p_grade_1 double, p_grade_2 double"


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


class Features:
    """Feature ids of texts. ``used``: only these ids are returned."""

    def __init__(self, used: np.ndarray | None = None):
        self.used = None if used is None else set(used.tolist())
        self.words: dict[str, tuple[tuple[int, ...], bool, bool]] = {}

    def _kept(self, ids) -> tuple[int, ...]:
        return tuple(ids if self.used is None else (i for i in ids if i in self.used))

    def _word(self, word: str) -> tuple[tuple[int, ...], bool, bool]:
        core = word.strip(".,;:!?").lower()
        ids = [_hash("w" + core)] + [_hash(f"p{n}{core[:n]}") for n in (4, 5, 6) if len(core) > n]
        tail = "".join(c for c in word[-4:] if not (c.isalnum() or c == "_"))
        capitals = len(word) > 1 and word.isupper()
        if tail:
            ids.append(_hash("t" + tail))
        if capitals:
            ids.append(_hash("U"))
        return self._kept(ids), capitals, not word[-1].isalnum() and word[-1] not in ".,"

    def of(self, text: str) -> list[int]:
        words = text.split()
        distinct = set(words)
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        known = self.words
        found: set[int] = set()
        capitals = symbols = 0
        for w in distinct:
            entry = known.get(w)
            if entry is None:
                entry = known[w] = self._word(w)
            ids, upper, symbol = entry
            if ids:
                found.update(ids)
            capitals += upper
            symbols += symbol
        n, kinds = max(len(words), 1), max(len(distinct), 1)
        steps = [f"n{min(12, len(words).bit_length())}"]
        if len(words) >= 5:
            steps += [f"d{i}" for i in range(10) if len(distinct) / n < (i + 1) / 10]
        steps += [f"u{i}" for i in range(1, 6) if capitals / kinds > i / 6]
        steps += [f"s{i}" for i in range(1, 6) if symbols / kinds > i / 6]
        found.update(self._kept(_hash(s) for s in steps))
        return sorted(found)


@dataclass
class Model:
    ids: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def scorer(self):
        """Text to (expected grade, P(grade >= 1), P(grade >= 2))."""
        features = Features(self.ids)
        weight = dict(zip(self.ids.tolist(), self.weights.tolist(), strict=True))
        thresholds = self.thresholds

        def score(text: str) -> tuple[float, float, float]:
            z = sum(weight[i] for i in features.of(text))
            tails = 1.0 / (1.0 + np.exp(np.clip(thresholds - z, -700, 700)))
            return float(tails.sum()), float(tails[0]), float(tails[1])

        return score


def _differs(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> np.ndarray:
    """Two-proportion z scores of features."""
    if not n_a or not n_b:
        return np.zeros(len(a))
    p = (a + b) / (n_a + n_b)
    return np.abs(a / n_a - b / n_b) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n_a + 1 / n_b))


def fit(rows: list[np.ndarray], grades: np.ndarray, seed: int = 7) -> Model:
    """Maximum likelihood by projected Adam steps over ``rows`` of feature ids."""
    size = 1 << BITS
    if len(np.unique(grades)) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.full(GRADES - 1, -1e9))
    counts = np.zeros((GRADES, size), np.int64)
    for r, g in zip(rows, grades, strict=True):
        counts[g, r] += 1  # a row holds an id once
    n = [(grades == k).sum() for k in range(GRADES)]
    clear = (_differs(counts[0], n[0], counts[1] + counts[2], n[1] + n[2]) > SCREEN_Z) | (_differs(counts[1], n[1], counts[2], n[2]) > SCREEN_Z)
    ids = np.flatnonzero(clear & (counts.sum(axis=0) >= SCREEN_MIN))
    place = np.full(size, -1, np.int32)
    place[ids] = np.arange(len(ids), dtype=np.int32)
    rows = [p[p >= 0] for p in (place[r] for r in rows)]

    w, t = np.zeros(len(ids)), np.array([-3.0, -1.0])
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    rng, step = np.random.default_rng(seed), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            batch = order[at:at + BATCH]
            step += 1
            of = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            ids_of = np.concatenate([rows[i] for i in batch])
            z, y = np.bincount(of, weights=w[ids_of], minlength=len(batch)), grades[batch]
            s = 1.0 / (1.0 + np.exp(np.clip(t[None, :] - z[:, None], -60, 60)))
            # derivative of -log P(grade) by z - t_k, for both k
            middle = np.maximum(s[:, 0] - s[:, 1], 1e-9)
            slope = s * (1 - s)
            d = np.zeros_like(s)
            d[:, 0] = np.where(y == 0, s[:, 0], np.where(y == 1, -slope[:, 0] / middle, 0.0))
            d[:, 1] = np.where(y == 2, s[:, 1] - 1, np.where(y == 1, slope[:, 1] / middle, 0.0))
            d /= len(batch)
            grads = (np.bincount(ids_of, weights=d.sum(axis=1)[of], minlength=len(w)) + L2 * w, -d.sum(axis=0))
            for i, (x, g) in enumerate(zip((w, t), grads, strict=True)):
                m, v = moments[2 * i], moments[2 * i + 1]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
            np.minimum(w, 0.0, out=w)
            t[1] = max(t[1], t[0] + 0.1)
    used = w < 0
    return Model(ids[used], w[used], t)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents (labels: doc_id, quality, toxic)."""
    bound_batches(docs.sparkSession)
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) != 0, 1).otherwise(2)
    chosen = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            ids = [np.array(features.of(v.as_py() or ""), dtype=np.int32).tobytes() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["grade", "ids"])

    # at most ``sample`` rows of two numbers
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .select(F.col("grade").cast("int"), "text").mapInArrow(run, "grade int, ids binary").toArrow())
    # the ids stay in Arrow's memory, without a copy
    found = [(grade, zlib.crc32(ids.as_buffer()), np.frombuffer(ids.as_buffer(), dtype=np.int32)) for grade, ids in zip(rows.column("grade").to_pylist(), rows.column("ids"), strict=True)]
    found.sort(key=lambda r: r[:2])  # the same fit however the rows arrive
    model = fit([ids for *_, ids in found], np.array([grade for grade, *_ in found], dtype=np.int64))
    del rows, found
    release_memory()  # the driver goes on without the rows of the fit
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with expected_grade, p_grade_1 and p_grade_2 (names returned)."""
    bound_batches(docs.sparkSession)
    names = fresh(docs, *(f.split()[0] for f in SCORED.split(", ")))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            found = [scorer(v.as_py() or "") for v in batch.column(at)]
            columns = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.float64()) for c in columns)], [*batch.schema.names, *names])
        release_memory()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, " + ", ".join(f"{n} double" for n in names)), names


def keep_good(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents whose probability of the best grade is ``keep_from`` or more."""
    scored, names = score(docs, train(docs, labels))
    return scored.where(F.col(names[2]) >= keep_from).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored, names = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", *names, (F.col(names[2]) >= KEEP_FROM).alias("keep"))
