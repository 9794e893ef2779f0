"""Hard negatives by threshold joins over partial inverted indexes.

Vectors become integers, floor(256 x) per component. An anchor's positives are
its best rows of the same label; for each positive, the negatives are the best
rows of other labels whose score lies in a window below the positive's. Both are
windows (lowest and highest score) that ask for their first k rows, and both are
filled the same way, block of rows by block of rows:

* Index. For a threshold, every row leaves out its smallest components as long as
  their norm times the anchor's cannot reach the threshold; the others are
  postings (row, value) under their dimension. A row without a posting in any of
  the anchor's dimensions cannot reach the threshold and is never touched.
* Search. An anchor's dimensions are taken in order of falling magnitude and
  their postings added to the scores. Rows whose partial score, with the norms of
  what remains on both sides, stays below the threshold are out; as soon as few
  are left, these are scored exactly.
* Thresholds fall from step to step until an anchor's windows are full or nothing
  lower can be in them; an index is made once a step and block.

An anchor first meets one block. Where that fills a window, its k-th score is a
proven lower bound, and in all other blocks the join starts and ends at it. So
few rows come back from a block, and the best k of all blocks are the answer.

Anchors are a stated set of queries; every block of anchors meets every block of
rows. Rows are dealt by a hash that includes their place in the input, so neither
a common vector nor a common label or id fills a block. Blocks of anchors, much
the smaller table, are repeated, rows only once for every ``SHARE`` blocks of
anchors.

Nulls and odd rows: rows with a null id or label, or whose vector is null or holds
a null or non-finite component, take no part; missing trailing components of
shorter vectors count as 0, and an empty vector scores 0; a repeated row is a
candidate as often as it occurs and, as an anchor, asked once (of different rows
with an anchor's id, the smallest by label and vector asks); rows with the
anchor's id are not its candidates; equal scores go by the smaller id; components
and scores beyond 64 bits stop at the largest number of 64 bits; a window above
its own top (of a positive with a score below 0) holds nothing; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.llm.common import cut, table

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: The window of negatives, in hundredths of the positive's score.
LOWEST, HIGHEST = 50, 95
LARGEST = (1 << 63) - 1
BLOCK_ROWS = 4096
ANCHOR_ROWS = 256
#: Blocks of anchors that share one copy of a block of rows.
SHARE = 32
#: Thresholds as shares of the product of the anchor's and the block's largest norm, falling; then none at all.
STEPS = (0.6, 0.45, 0.35, 0.275, 0.2, 0.125, 0.05)
#: Dimensions between two looks at which rows are still in; a share of rows small enough to be scored outright.
LOOK_EVERY, FEW = 8, 1 / 16
#: Sums of products below this are whole numbers in doubles, and a hundred times them in 64 bits.
EXACT = 2.0 ** 52

HITS = "anchor_id long, window int, vec_id long, score long"


def prepare(vectors: DataFrame, label: Column | None = None) -> DataFrame:
    """vec_id, label and the integer vector ``v`` of every row that takes part;
    ``label`` replaces the column of that name."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"),
                          x.cast("array<double>").alias("embedding"))
    return (rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~bad)
            .select("vec_id", "label", F.transform(x, lambda c: F.floor(c * SCALE)).alias("v")))


class Index:
    """The rows of a block that can reach ``reach`` times an anchor's norm, by
    dimension: ``at[d]`` rows and ``value[d]`` their components."""

    def __init__(self, rows: np.ndarray, reach: float):
        self.rows = rows
        self.norm = np.sqrt((rows * rows).sum(axis=1))
        kept = rows
        self.rest = np.zeros(len(rows))
        if reach > 0 and rows.size:
            order = np.argsort(np.abs(rows), axis=1, kind="stable")
            below = np.sqrt(np.cumsum(np.take_along_axis(rows * rows, order, axis=1), axis=1))
            left_out = below < reach * (1 - 1e-9)
            self.rest = np.where(left_out, below, 0).max(axis=1)
            mask = np.zeros(rows.shape, bool)
            np.put_along_axis(mask, order, left_out, axis=1)
            kept = np.where(mask, 0, rows)
        self.at = [np.flatnonzero(c) for c in kept.T]
        self.value = [c[i] for c, i in zip(kept.T, self.at, strict=True)]

    def search(self, anchor: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows with a score of at least ``threshold``, their scores, and the
        number of components of rows looked at."""
        scores, looked = np.zeros(len(self.rows)), 0
        order = np.argsort(-np.abs(anchor), kind="stable")
        size = np.abs(anchor[order])
        to_come = np.sqrt(np.append(np.cumsum((size * size)[::-1])[::-1], 0.0))  # norm of the anchor from here on
        missing = to_come[0] * self.rest
        alive = np.arange(len(self.rows))
        for step, d in enumerate(order, 1):
            if anchor[d]:
                scores[self.at[d]] += anchor[d] * self.value[d]
                looked += len(self.at[d])
            if step % LOOK_EVERY == 0 or step == len(order):
                # a little more for rounding of the norms
                best = scores + (to_come[step] * self.norm + missing) * (1 + 1e-9) + 1e-6
                alive = np.flatnonzero(best >= threshold)
                if len(alive) <= len(self.rows) * FEW:
                    break
        exact = self.rows[alive] @ anchor
        held = exact >= threshold
        return alive[held], exact[held], looked + alive.size * len(order)


def _all(rows: np.ndarray, anchor: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a score of at least ``threshold`` and their scores, without an
    index; whole numbers of any size stop at 64 bits."""
    scores = rows @ anchor if rows.shape[1] else np.zeros(len(rows), np.int64)
    if scores.dtype == object:
        scores = np.minimum(np.maximum(scores, -LARGEST), LARGEST)
    held = np.flatnonzero(scores >= threshold)
    return held, scores[held]


def _firsts(ids: np.ndarray, scores: np.ndarray, windows: list[tuple], k: int, threshold: float) -> tuple[list[tuple], bool]:
    """The first k of each window among rows of at least ``threshold``: (window,
    id, score), and whether no lower threshold can add any. A window is its
    number, its lowest and highest score, and a proven bound of its k-th."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    out, full = [], True
    for number, low, high, bound in windows:
        least = max(low, bound)
        at = np.flatnonzero((scores <= high) & (scores >= least))[:k]
        out += [(number, int(ids[i]), int(scores[i])) for i in at]
        full &= len(at) == k or threshold <= least
    return out, full


def fill(anchors: list[tuple], ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, k: int, same: bool) -> Iterator[tuple]:
    """(anchor id, window, row id, score): the first k rows of a block in every
    window of every anchor (id, label, vector, windows); of its own label if
    ``same``, of all others if not."""
    width = max([rows.shape[1], *(len(a[2]) for a in anchors)])
    rows = np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
    largest = max([0.0, *(float(np.abs(a[2].astype(float)).max(initial=0)) for a in anchors)])
    whole = largest * float(np.abs(rows.astype(float)).max(initial=0)) * max(width, 1) < EXACT
    rows = rows.astype(np.float64 if whole else object)
    parts = {label: np.flatnonzero(labels == label) for label in {a[1] for a in anchors}} if same else {None: np.arange(len(rows))}
    parts = {label: (ids[at], labels[at], rows[at]) for label, at in parts.items()}
    longest = {label: float(np.sqrt((p[2] * p[2]).sum(axis=1)).max(initial=0)) if whole else 0.0 for label, p in parts.items()}
    made: dict[tuple, Index] = {}
    for anchor_id, label, vector, windows in anchors:
        part = label if same else None
        row_ids, row_labels, vectors = parts[part]
        windows = [w for w in windows if w[1] <= w[2]]
        if not windows or not len(vectors):
            continue
        vector = np.pad(vector, (0, width - len(vector))).astype(rows.dtype)
        norm = float(np.sqrt(vector @ vector)) if whole else 0.0
        floor = min(max(low, bound) for _, low, _, bound in windows)
        top = max(high for _, _, high, _ in windows)
        proven = all(bound > -LARGEST for _, _, _, bound in windows)
        # steps between the windows' top and their proven end, then the end itself
        steps = [s * longest[part] for s in STEPS if s * longest[part] * norm <= top and norm] if whole else []
        if proven:
            steps = [s for s in steps if s * norm <= floor][:1]
        for reach in [*steps, None]:
            if reach is None:
                threshold = floor
                at, scores = _all(vectors, vector, floor)
            else:
                if (part, reach) not in made:
                    made[part, reach] = Index(vectors, reach)
                threshold = max(reach * norm, floor)
                at, scores, _ = made[part, reach].search(vector, threshold)
            if whole:
                scores = scores.astype(np.int64)
            ok = (row_ids[at] != anchor_id) & (same | (row_labels[at] != label))
            found, full = _firsts(row_ids[at][ok], scores[ok], windows, k, threshold)
            if full:
                break
        for number, row_id, score in found:
            yield anchor_id, number, row_id, score


WINDOWS = "array<struct<number:int,low:long,high:long,bound:long>>"


def _blocks(rows: DataFrame, n: int, name: str, also: str = "") -> DataFrame:
    """``n`` blocks of rows: number and ``name``, a list of structs."""
    def gather(t: pa.Table) -> pa.Table:
        structs = pa.StructArray.from_arrays([t.column(c).combine_chunks().cast(types[c]) for c in names], names)
        return pa.table([t.column("block").slice(0, 1), pa.ListArray.from_arrays(pa.array([0, len(structs)], pa.int32()), structs)], names=["block", name])

    window = pa.struct([("number", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("bound", pa.int64())])
    types = {"vec_id": pa.int64(), "label": pa.int64(), "v": pa.list_(pa.int64()), also: pa.list_(window)}  # Spark's own are marked as never null
    names = ["vec_id", "label", "v", *([also] if also else [])]
    fields = "vec_id:long,label:long,v:array<long>" + (f",{also}:{WINDOWS}" if also else "")
    place = F.monotonically_increasing_id()  # only deals; the answer does not depend on it
    return (rows.select(*names).withColumn("block", F.pmod(F.xxhash64("vec_id", place), F.lit(n)))
            .groupBy("block").applyInArrow(gather, f"block long, {name} array<struct<{fields}>>"))


def _matrix(structs: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and vectors, padded with zeros to the longest."""
    lists = structs.field("v")
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(structs), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = lists.flatten().to_numpy()
    return structs.field("vec_id").to_numpy(), structs.field("label").to_numpy(), out


def _meet(k: int, same: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, rows in zip(batch.column("anchors"), batch.column("rows"), strict=True):
                ids, labels, vectors = _matrix(asked.values)
                windows = [[tuple(w.values()) for w in ws] for ws in asked.values.field("windows").to_pylist()]
                found = fill(list(zip(ids.tolist(), labels.tolist(), vectors, windows, strict=True)), *_matrix(rows.values), k, same)
                columns = list(zip(*found, strict=True)) or [[], [], [], []]
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["anchor_id", "window", "vec_id", "score"])

    return run


def _best(hits: DataFrame, k: int) -> DataFrame:
    """``hits`` that are among the first k of their window, with their ``rank``."""
    rank = F.row_number().over(Window.partitionBy("anchor_id", "window").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def fill_windows(anchors: DataFrame, blocks: DataFrame, n_blocks: int, k: int, same: bool) -> DataFrame:
    """anchor_id, window, rank, vec_id, score: the first ``k`` rows in every window
    of ``anchors`` (vec_id, label, v, windows), over all ``blocks`` of rows."""
    n_asked = max(1, -(-anchors.count() // ANCHOR_ROWS))

    def join(asked: DataFrame, meets: Column) -> DataFrame:
        a = _blocks(asked, n_asked, "anchors", also="windows").select("anchors", F.floor(F.col("block") / SHARE).alias("share"), F.explode(meets).alias("block"))
        shares = F.sequence(F.lit(0), F.lit((n_asked - 1) // SHARE)).cast("array<long>")
        return (a.join(blocks.withColumn("share", F.explode(shares)).hint("shuffle_merge"), ["block", "share"])
                .select("anchors", "rows").mapInArrow(_meet(k, same), HITS))

    # one block each: its k-th score in a full window bounds the whole table's
    first = cut(_best(join(anchors, F.array(F.pmod(F.col("block"), F.lit(n_blocks)))), k))
    bounds = (first.where(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("bounds"))
              .select(F.col("anchor_id").alias("vec_id"), "bounds"))
    known = anchors.join(bounds, "vec_id", "left").withColumn("windows", F.transform("windows", lambda w: w.withField(
        "bound", F.coalesce(F.try_element_at("bounds", w["number"]), w["bound"])))).drop("bounds")
    return _best(join(known, F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>")), k)


def _window(number: Column, low: Column, high: Column) -> Column:
    return F.struct(number.cast("int").alias("number"), low.cast("long").alias("low"), high.cast("long").alias("high"), F.lit(-LARGEST).cast("long").alias("bound"))


def _share(score: Column, hundredths: int) -> Column:
    """That share of a score, exact."""
    return score.cast("decimal(19,0)") * hundredths / 100


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
         lowest: int = LOWEST, highest: int = HIGHEST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` (vec_id, label, v) are all rows; ``anchors``, rows of it, ask. An
    anchor's ``positives`` best rows of its label each get the first ``negatives``
    rows of other labels with a score of ``lowest`` to ``highest`` hundredths of
    theirs."""
    n_blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    blocks = cut(_blocks(rows, n_blocks, "rows"))
    anchors = cut(anchors.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.*"))
    whole = F.array(_window(F.lit(0), F.lit(-LARGEST), F.lit(LARGEST)))
    found = cut(fill_windows(anchors.withColumn("windows", whole), blocks, n_blocks, positives, same=True))
    below = F.collect_list(_window(F.col("rank"), F.ceil(_share(F.col("score"), lowest)), F.floor(_share(F.col("score"), highest))))
    asked = anchors.join(found.groupBy("anchor_id").agg(below.alias("windows")).withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    hits = fill_windows(asked, blocks, n_blocks, negatives, same=False)
    of = found.select("anchor_id", F.col("rank").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hits.join(of, ["anchor_id", "window"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = prepare(table(spark, sf_dir, "embeddings"), moved)
    return mine(rows, rows.where(F.col("vec_id") % 50 == 0))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
             list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i]))::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""
