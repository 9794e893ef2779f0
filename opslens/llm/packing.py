"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents become token ids plus an end token; those longer than a sequence are
cut into full pieces, the remainder first. Only the histogram of piece lengths
(one count per length, at most ``seq_len`` of them) decides the plan: patterns
of one to three lengths that fill a sequence exactly are enumerated, their
repeat counts fitted to the histogram by non-negative least squares, rounded,
and what is left is packed best-fit, longest first, still as counts. Pieces
then find their place by their rank among the pieces of their length.

The driver holds the histogram and the plan, both bounded by ``seq_len`` and
not by the data. Ranks are computed in two levels (inside slices of a few
thousand pieces, then over the slices), so a length that a third of all pieces
share is no single task. Token ids never leave the task that made them.

Nulls and odd rows: a null text is an empty one, which packs as its end token
alone; repeated rows are packed one by one; an empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslens.llm.common import bound_batches, cut, release_memory, table

SEQ_LEN = 1024
END_ID = 2
SLICE_ROWS = 2048
FIT_STEPS = 400


def _encoder(path: str):
    """Text to an array of ids, for a byte-level BPE file of ``tokenizers``.

    The vocabulary runs in tiktoken, which gives the same ids several times
    faster; a text on which it fails goes to ``tokenizers`` itself. Special
    tokens' strings are ordinary text.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"].pop("vocab")
    # the printable stand-ins that byte-level BPE files use for bytes
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain}
    byte_of.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if all(c in byte_of for c in token)}
    special = [t for t in ranks if t.startswith(b"<|") and t.endswith(b"|>")]
    for t in special:
        del ranks[t]
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    slow: list[Tokenizer] = []  # loaded only if needed: it takes as much memory again

    def encode(text: str) -> np.ndarray:
        try:
            return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
        except Exception:  # noqa: BLE001 - its regex engine gives up on some very long runs
            if not slow:
                slow.append(Tokenizer.from_file(path))
                slow[0].encode_special_tokens = True
            return np.asarray(slow[0].encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode


def cut_points(n: int, seq_len: int = SEQ_LEN) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    first = n if n <= seq_len else (n % seq_len or seq_len)
    return [(0, first), *((s, seq_len) for s in range(first, n, seq_len))]


def tokenize(docs: DataFrame, tokenizer: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch in batches:
            out = defaultdict(list)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for k, (start, n) in enumerate(cut_points(len(ids), seq_len)):
                    part = ids[start:start + n]
                    for name, value in (("doc_id", doc), ("piece", k), ("start", start), ("length", n), ("ids_crc32", zlib.crc32(part.tobytes()))):
                        out[name].append(value)
                    if with_ids:
                        out["ids"].append(part.astype(np.int32))
            yield pa.RecordBatch.from_pydict({f.name: pa.array(out[f.name], f.type) for f in arrow})
        release_memory()

    bound_batches(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    arrow = pa.schema([*fields, *([("ids", pa.list_(pa.int32()))] if with_ids else [])])
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, schema)


def _fit(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that minimise |A x - counts|, where
    column j of A counts the lengths of pattern j (0: no length). Projected
    gradient steps with momentum; A stays sparse."""
    n = len(counts)
    scale = counts.max() or 1.0
    goal = counts / scale
    uses = np.bincount(patterns.ravel(), minlength=n)[1:].max()
    step = 1.0 / (patterns.shape[1] * max(uses, 1))  # one over a bound of the largest eigenvalue of A'A
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(FIT_STEPS):
        made = np.bincount(patterns.ravel(), weights=np.repeat(y, patterns.shape[1]), minlength=n)
        off = made - goal
        off[0] = 0.0
        nxt = np.maximum(0.0, y - step * off[patterns].sum(axis=1))
        t_nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = nxt + (t - 1) / t_nxt * (nxt - x), nxt, t_nxt
    return x * scale


def _full_patterns(lengths: list[int], seq_len: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c, of lengths that sum to ``seq_len``; 0 stands
    for no further document."""
    have = np.zeros(seq_len + 1, dtype=bool)
    have[[0, *lengths]] = True
    b, c = np.meshgrid(np.flatnonzero(have), np.flatnonzero(have), indexing="ij")
    a = seq_len - b - c
    ok = (a >= b) & (b >= c) & have[np.clip(a, 0, seq_len)] & (a > 0)
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def _best_fit(counts: dict[int, int], seq_len: int, bins: dict[tuple, int]) -> dict[tuple, int]:
    """Best-fit, longest first, over counts: adds patterns to ``bins``."""
    by_free: dict[int, dict[tuple, int]] = defaultdict(lambda: defaultdict(int))
    free_list: list[int] = []
    import bisect

    def put(pattern: tuple, k: int) -> None:
        free = seq_len - sum(pattern)
        if free not in by_free or not by_free[free]:
            bisect.insort(free_list, free)
        by_free[free][pattern] += k

    def take(free: int, pattern: tuple, k: int) -> None:
        by_free[free][pattern] -= k
        if not by_free[free][pattern]:
            del by_free[free][pattern]
        if not by_free[free]:
            free_list.remove(free)

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            at = bisect.bisect_left(free_list, n)
            if at < len(free_list):
                free = free_list[at]
                pattern, k = next(iter(by_free[free].items()))
                k = min(k, left)
                take(free, pattern, k)
                put((*pattern, n), k)
                left -= k
            else:
                each = seq_len // n
                if left >= each:
                    put((n,) * each, left // each)
                    left %= each
                else:
                    put((n,) * left, 1)
                    left = 0
    for patterns in by_free.values():
        for pattern, k in patterns.items():
            bins[pattern] += k
    return bins


def plan(counts: dict[int, int], seq_len: int = SEQ_LEN) -> dict[tuple, int]:
    """Patterns (tuples of lengths) and how often each is used; every piece of
    the histogram is in exactly one. The fitted plan, or plain best fit over
    the whole histogram where that happens to need fewer sequences."""
    counts = {n: c for n, c in counts.items() if c > 0}
    plain = _best_fit(counts, seq_len, defaultdict(int))
    patterns = _full_patterns([n for n in counts if n < seq_len], seq_len)
    bins: dict[tuple, int] = defaultdict(int)
    left = dict(counts)
    if seq_len in left:
        bins[(seq_len,)] = left.pop(seq_len)
    if len(patterns) and left:
        goal = np.zeros(seq_len + 1)
        for n, c in left.items():
            goal[n] = c
        fitted = _fit(patterns, goal)
        for j in np.argsort(-fitted, kind="stable"):
            k = int(fitted[j] + 0.5)
            if not k:
                break
            pattern = tuple(int(v) for v in patterns[j] if v)
            for n in set(pattern):
                k = min(k, left.get(n, 0) // pattern.count(n))
            if k:
                bins[pattern] += k
                for n in pattern:
                    left[n] -= k
    fitted_bins = _best_fit({n: c for n, c in left.items() if c}, seq_len, bins)
    return dict(min((fitted_bins, plain), key=lambda b: sum(b.values())))


def _slots(bins: dict[tuple, int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank, first sequence and offset of each run of places."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, k in bins.items():
        at = 0
        for n in pattern:
            runs[n].append((used[n], sequence, at))
            used[n] += k
            at += n
        sequence += k
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for n, r in runs.items()}


def place(pieces: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset.
    Read more than once, so it should be materialised."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(plan(counts, seq_len))
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    # ranks among the pieces of a length: slice counts, their running sums, ranks inside the slice
    slices = F.element_at(F.create_map(*[F.lit(int(v)) for n, c in counts.items() for v in (n, -(-c // SLICE_ROWS))]), F.col("length").cast("int"))
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), slices))
    per_slice = sliced.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")
    first = per_slice.select("length", "slice", before.alias("before"))
    ranked = (sliced.withColumn("rank", F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece")) - 1)
              .join(first, ["length", "slice"]).withColumn("rank", F.col("rank") + F.col("before")).drop("slice", "before"))
    names = [c for c in ranked.columns if c not in ("rank",)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                first_rank, first_seq, at = slots[int(n)]
                rows = np.flatnonzero(length == n)
                run_no = np.searchsorted(first_rank, rank[rows], side="right") - 1
                sequence[rows] = first_seq[run_no] + rank[rows] - first_rank[run_no]
                offset[rows] = at[run_no]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name in names)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Every piece with its sequence and offset (and, unless turned off, its ids)."""
    return place(cut(tokenize(docs, tokenizer, seq_len, end_id, with_ids)), seq_len)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digest(docs: DataFrame) -> DataFrame:
    return pack(docs, tokenizer_path(), with_ids=False).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
