"""Document fingerprints by randomised edit embedding and bit sampling.

A pointer walks over a text's characters. At every step the character under it
is emitted and the pointer moves on if a random bit, fixed by the step number
and the character, says so. All texts share these bits, so two texts walk in
step until their first difference and tend to fall into step again after it:
a small edit distance becomes a small Hamming distance between the emitted
strings. The walk runs over the whole text, for all texts of a batch at once.

The fingerprint samples the emitted string: the steps are split into octaves
[2^k, 2^(k+1)) with the same number of sampled steps each (all, while there
are no more), and a sampled character is kept as one hexadecimal digit, ``.``
where the walk had ended. A text of any length thus has a fingerprint of a few
hundred digits. The likeness of two fingerprints is the share of equal digits,
each octave weighing as many steps as it stands for: an estimate of
1 - Hamming distance / length.

For near duplicates, digits sampled from an octave form bands; fingerprints
that share a band are compared with the smallest id that has it, and verified.

Nulls and odd rows: a null text is an empty one, whose fingerprint is the empty
string; two empty fingerprints have likeness 1; equal texts have equal
fingerprints. In the edited-text query rows follow each other by descending
doc_id, null ids last, and rows of one id by descending text; the only row of a
table is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslens.llm.common import bound_batches, pieces, table

SEED = 0x5EED
SLOTS = 64
OCTAVES = 40
PAD = 255
NONE = 16
BLOCK = 64
BUCKET_ROWS = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (splitmix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _layout() -> tuple[np.ndarray, np.ndarray]:
    """Sampled steps in order (from 0) and the weight of each."""
    steps, weights = [], []
    for k in range(OCTAVES):
        size = 1 << k
        if size <= SLOTS:
            at = np.arange(size, dtype=np.int64)
        else:  # one step in each of SLOTS equal parts
            part = size // SLOTS
            at = np.arange(SLOTS, dtype=np.int64) * part + (_mix(np.arange(SLOTS) + SEED + 1000 * k) % np.uint64(part)).astype(np.int64)
        steps.append(at + size - 1)
        weights.append(np.full(len(at), size / len(at)))
    return np.concatenate(steps), np.concatenate(weights)


STEPS, WEIGHTS = _layout()
_SYMBOLS = np.arange(256, dtype=np.uint64)
_DIGIT = (_mix(_SYMBOLS + np.uint64(SEED)) % np.uint64(16)).astype(np.uint8)
_DIGIT[PAD] = NONE


def _moves(block: int) -> np.ndarray:
    """Random bits of ``BLOCK`` steps: a row per step, a column per symbol."""
    bits = _mix(_mix(_SYMBOLS + np.uint64(SEED)) ^ np.uint64(block))
    out = ((bits[None, :] >> np.arange(BLOCK, dtype=np.uint64)[:, None]) & np.uint64(1)).astype(np.int64)
    out[:, PAD] = 0
    return out


def digits(texts: list[str]) -> np.ndarray:
    """Sampled digits: a row per text, a column per slot up to the last used."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes + 1)
    buffer = np.full(int(ends[-1]) if len(texts) else 0, PAD, dtype=np.uint8)
    for text, end in zip(texts, ends, strict=True):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        # code points spread over 255 symbols; neighbours stay apart
        buffer[end - 1 - len(points):end - 1] = (points * np.uint64(2654435761) >> np.uint64(8)) % np.uint64(255)
    out = np.full((len(texts), len(STEPS)), NONE, dtype=np.uint8)
    rows = np.flatnonzero(sizes)
    pos = (ends - 1 - sizes)[rows]
    used, step = 0, 0
    while len(rows):
        moves = _moves(step // BLOCK)
        for s in range(BLOCK):
            symbol = buffer[pos]
            if STEPS[used] == step:
                out[rows, used] = _DIGIT[symbol]
                used += 1
            pos += moves[s][symbol]
            step += 1
        live = buffer[pos] != PAD
        if not live.all():
            rows, pos = rows[live], pos[live]
    return out[:, :used]


_HEX = np.frombuffer(b"0123456789abcdef.", dtype=np.uint8)


def strings(found: np.ndarray) -> list[str]:
    last = np.where((found != NONE).any(axis=1), found.shape[1] - np.argmax((found != NONE)[:, ::-1], axis=1), 0) if found.shape[1] else np.zeros(len(found), int)
    text = _HEX[found]
    return [r[:n].tobytes().decode() for r, n in zip(text, last, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, for two arrays of digits of the same shape."""
    w = WEIGHTS[:a.shape[1]]
    either = ((a != NONE) | (b != NONE)) @ w
    same = ((a == b) & (a != NONE)) @ w
    return np.where(either > 0, same / np.maximum(either, 1e-300), 1.0)


def parse(fingerprints: list[str]) -> np.ndarray:
    """Digits of fingerprint strings."""
    width = max(map(len, fingerprints), default=0)
    raw = np.frombuffer("".join(f.ljust(width, ".") for f in fingerprints).encode(), dtype=np.uint8).reshape(len(fingerprints), width)
    value = np.full(256, NONE, dtype=np.uint8)
    value[_HEX] = np.arange(17)
    return value[raw]


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every document, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [v.as_py() or "" for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(strings(digits(texts)), pa.string())],
                                             ["doc_id", "n_chars", "fingerprint"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


@F.pandas_udf(T.DoubleType())
def likeness_of(a: pd.Series, b: pd.Series) -> pd.Series:
    both = parse([*a, *b])
    return pd.Series(likeness(both[:len(a)], both[len(a):]))


def near_duplicates(fingerprints: DataFrame, min_likeness: float = 0.8, band: int = 4) -> DataFrame:
    """Verified links (a, b, likeness), a < b, of fingerprints (doc_id,
    fingerprint). Equal ones are one class, linked to its smallest id; classes
    are linked with the smallest class that shares one of their bands."""
    classes = fingerprints.groupBy("fingerprint").agg(F.min("doc_id").alias("a"))

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                octave = max(0, (len(text) - 127) // SLOTS) if len(text) > 127 else -1
                for k in {max(octave - 1, -1), octave}:
                    part = text[:127] if k < 0 else text[127 + SLOTS * k:127 + SLOTS * (k + 1)]
                    found = {f"{k}:{i}:{part[i:i + band]}" for i in range(0, len(part), band) if "." not in part[i:i + band]} or {f"{k}:{part}"}
                    ids += [doc] * len(found)
                    keys += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], ["b", "band"])

    banded = classes.select(F.col("a").cast("long"), "fingerprint").mapInArrow(bands, "b long, band string")
    first = banded.groupBy("band").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    links = banded.join(first, "band").where("a < b").select("a", "b").distinct()
    texts = classes.select(F.col("a").alias("id"), "fingerprint")
    between = (links.join(texts.withColumnsRenamed({"id": "a", "fingerprint": "fa"}), "a").join(texts.withColumnsRenamed({"id": "b", "fingerprint": "fb"}), "b")
               .withColumn("likeness", likeness_of("fa", "fb")).where(F.col("likeness") >= min_likeness).select("a", "b", "likeness"))
    members = fingerprints.join(classes, "fingerprint").where("doc_id > a").select("a", F.col("doc_id").alias("b"), F.lit(1.0).alias("likeness"))
    return between.unionByName(members)


EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _edited_group(t: pa.Table) -> pa.Table:
    """Results of the rows of a bucket; halo rows only serve as the next ones."""
    rows = sorted(zip(t.column("key").to_pylist(), t.column("text").to_pylist(), t.column("halo").to_pylist(), t.column("doc_id").to_pylist(), strict=True),
                  key=lambda r: (r[0], r[1] is not None, r[1] or ""), reverse=True)
    own = [r for r in rows if not r[2]]
    halo = [r for r in rows if r[2]][:1]
    texts = [r[1] or "" for r in own + halo]
    nexts = texts[1:]
    edited = [text[:len(text) - len(text) // 3] + following[:len(text) // 3] for text, following in zip(texts, nexts, strict=False)]
    found = digits(texts + edited)
    n = len(own)
    mine, other = found[:n], found[len(texts):]
    return pa.table([
        pa.array([r[3] for r in own], pa.int64()), pa.array([len(x) for x in texts[:n]], pa.int64()),
        pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
        pa.array(strings(mine), pa.string()), pa.array(strings(other), pa.string()),
        pa.array(likeness(mine, other), pa.float64()), pa.array(likeness(mine, found[1:n + 1]), pa.float64())],
        names=[f.split()[0] for f in EDITED.split(", ")])


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form (``EDITED``).

    Rows are dealt into ranges of doc_id (bounds: quantiles); the first row of
    a range also goes to the range before it, whose last row it follows. So
    the texts are shuffled once, and the driver sees two ids per range.
    """
    bound_batches(docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    ids = docs.select(key.alias("key"))
    n = pieces(ids, BUCKET_ROWS)
    bounds = np.unique(np.array(ids.approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n), dtype=np.float64))

    def buckets(keys: pd.Series) -> np.ndarray:
        return np.searchsorted(bounds, keys.to_numpy().astype(np.float64), side="right")

    bucket_of = F.pandas_udf(lambda keys: pd.Series(buckets(keys)), T.LongType())
    heads = sorted((r["b"], r["head"]) for r in ids.groupBy(bucket_of("key").alias("b")).agg(F.max("key").alias("head")).collect())
    head = np.array([h for _, h in heads], dtype=np.int64)
    after = np.array([heads[(i + 1) % len(heads)][0] for i in range(len(heads))], dtype=np.int64)

    def deal(keys: pd.Series) -> pd.Series:
        own = buckets(keys)
        at = np.minimum(np.searchsorted(head, keys.to_numpy()), len(head) - 1)
        return pd.Series([[b, after[i]] if head[i] == k else [b] for b, i, k in zip(own, at, keys, strict=True)])

    dealt = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), "text")
             .withColumn("to", F.pandas_udf(deal, T.ArrayType(T.LongType()))("key"))
             .select("doc_id", "key", "text", F.posexplode("to").alias("halo", "bucket")).withColumn("halo", F.col("halo") == 1))
    return dealt.groupBy("bucket").applyInArrow(lambda t: _edited_group(t), EDITED)


def query(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
