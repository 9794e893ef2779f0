"""Exact top-k inner-product search over an impact-ordered index.

Vectors become integers, floor(256 x) per component. The rows are dealt into
blocks; in a block's index every component is a posting whose impact is its
magnitude, and postings are grouped into segments by quantised impact (powers
of two). A block of queries is processed score at a time: segments in
descending impact are added to the accumulators of all rows they touch. After
each segment the part of a row not yet added has a known norm, so a row's score
is known up to |query| * |rest of the row|. Processing stops once the k-th best
lower bound proves that all but a few rows are out; those few are rescored with
their whole vectors. So the answer is exact, ties included.

Every block of queries meets every block of rows once (a stated query set
against all rows); each pair of blocks returns at most k rows per query, and
the best k of these are the answer. Blocks are rows of the two tables, so both
sides stay distributed and grow by more blocks, not larger ones.

Nulls and odd rows: rows whose vector is null or holds a null or a non-finite
component, or whose id is null, take no part; an empty vector scores 0;
missing trailing components of shorter vectors count as 0; a repeated row is a
candidate as often as it occurs, and a repeated query row is asked once; rows
with the query's id are not its candidates; components and scores beyond 64
bits stop at the largest number of 64 bits; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslens.llm.common import table

SCALE = 256
TOP = 5
LARGEST = (1 << 63) - 1
QUERY_ROWS = 512
BLOCK_ROWS = 8192
#: Rows per query that may be left for rescoring before another segment is added.
RESCORE = 16
BLOCK = "block long, ids array<long>, dim int, data array<long>"
HITS = "query_id long, vec_id long, score long"


def quantise(vectors: DataFrame) -> DataFrame:
    """vec_id and the integer vector ``v`` of every row that takes part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))
            .where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad)
            .select("vec_id", F.transform(x, lambda c: F.floor(c * SCALE)).alias("v")))


def _blocks(rows: DataFrame, n: int) -> DataFrame:
    """``n`` blocks of rows (``BLOCK``), dealt by a hash of the row."""
    def gather(t):
        vectors = t.column("v").to_pylist()
        dim = max(map(len, vectors))
        data = [c for v in vectors for c in (*v, *[0] * (dim - len(v)))]
        return pa.table([pa.array([t.column("block")[0].as_py()], pa.int64()), pa.array([t.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                         pa.array([dim], pa.int32()), pa.array([data], pa.list_(pa.int64()))], names=["block", "ids", "dim", "data"])

    return rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n))).groupBy("block").applyInArrow(gather, BLOCK)


def _segments(rows: np.ndarray) -> list[np.ndarray]:
    """Posting segments in descending impact: matrices that hold the postings
    with 2^s <= magnitude < 2^(s+1), two bits of magnitude to a segment."""
    size = np.abs(rows)
    top = int(size.max(initial=0)).bit_length()
    out = []
    while top > 0:
        low = 0 if top <= 2 else 1 << (top - 2)
        held = (size >= max(low, 1)) & (size < (1 << top))
        if held.any():
            out.append(np.where(held, rows, 0))
        top -= 2
    return out


def search_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The k best rows of a block for each query: (query id, row id, score)."""
    width = max(queries.shape[1], rows.shape[1])
    queries, rows = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (queries, rows))
    largest = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(rows.astype(float)).max(initial=0)) * max(width, 1)
    if largest >= 2.0 ** 52:  # sums that doubles don't hold exactly: whole numbers of any size
        scores = queries.astype(object) @ rows.astype(object).T if width else np.zeros((len(queries), len(rows)), object)
        maybe = np.ones(scores.shape, bool)
    else:
        q, left = queries.astype(np.float64), rows.astype(np.float64)
        scores = np.zeros((len(q), len(rows)))
        q_norm = np.sqrt((q * q).sum(axis=1))[:, None]
        maybe = np.ones(scores.shape, bool)
        same = query_ids[:, None] == row_ids[None, :]
        for segment in _segments(rows):
            scores += q @ segment.T
            left = left - segment
            # what the rest of a row can add or take away, a little above for rounding
            slack = q_norm * (np.sqrt((left * left).sum(axis=1)) * (1 + 1e-9))[None, :]
            low = np.where(same, -np.inf, scores - slack)
            bar = np.partition(low, -k, axis=1)[:, -k][:, None] if low.shape[1] >= k else np.full((len(q), 1), -np.inf)
            maybe = scores + slack >= bar - 1e-6
            if maybe.sum() <= RESCORE * len(q):
                break
        maybe &= ~same
    out = []
    for i in range(len(queries)):
        at = np.flatnonzero(maybe[i])
        at = at[row_ids[at] != query_ids[i]]
        exact = [int(s) for s in (rows[at] @ queries[i] if largest < 2.0 ** 52 else scores[i, at])]
        best = sorted(zip((-s for s in exact), row_ids[at].tolist(), strict=True))[:k]
        out += [(int(query_ids[i]), r, max(-LARGEST, min(LARGEST, -s))) for s, r in best]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of ``vectors`` with the
    highest inner products for each row of ``queries`` (both vec_id, embedding),
    ties to the smaller vec_id."""
    rows, asked = quantise(vectors), quantise(queries).distinct()
    n_rows = max(1, -(-rows.count() // BLOCK_ROWS))
    n_asked = max(1, -(-asked.count() // QUERY_ROWS))
    a = _blocks(asked, n_asked).select(F.col("block").alias("q"), F.col("ids").alias("q_ids"), F.col("dim").alias("q_dim"), F.col("data").alias("q_data"),
                                       F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)).cast("array<long>")).alias("r"))
    b = _blocks(rows, n_rows).select(F.col("block").alias("r"), "ids", "dim", "data",
                                     F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1)).cast("array<long>")).alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def matrix(row, ids, dim, data):
            ids = row[ids].values.to_numpy(zero_copy_only=False)
            return row[data].values.to_numpy(zero_copy_only=False).reshape(len(ids), row[dim].as_py()), ids

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                found = search_block(*matrix(row, "q_ids", "q_dim", "q_data"), *matrix(row, "ids", "dim", "data"), k)
                columns = list(zip(*found, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    hits = a.join(b.hint("shuffle_merge"), ["q", "r"]).mapInArrow(run, HITS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
