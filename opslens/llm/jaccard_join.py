"""Exact n-gram Jaccard self-join by set relations.

A document's set holds its distinct five-word shingles; two documents link when
100 * intersection >= 80 * union. Links make components.

Index. Sets are ordered by one global order of shingles, rare ones first (the
frequent shingles, counted over all documents, at the end). Similar sets share
a shingle in their prefixes, at positions that leave enough overlap behind
them. So only prefixes are indexed; a shingle's list is sorted by set size, and
entries outside the size window, or whose positions leave too little overlap,
are skipped.

Relations between sets. Equal sets are one class and indexed once. Of a set's
candidates the closest (by bitmaps of the sets' shingles, which bound how much
two sets differ) are verified first; sets so linked have their answers in
common as far as components go, so all candidates inside a component are
skipped without being verified, and only candidates across components are.
Long lists (large families of near copies) are first searched from entry to a
few others. Their sets are indexed anew among themselves, by what sets them
apart: shingles that few of them have come first. Lists that are still long are
then searched across the components that are left. No link between different
texts is lost: every candidate is verified, ruled out by its bitmaps, or lies
inside a component already.

Lists travel as arrays, one row per slice of documents and bucket of shingles;
frequent shingles are a table of bounded size; texts are joined only for the
sets that have candidates.

Nulls and odd rows: a null or blank text has the empty set, links with nothing
and is its own component; texts of fewer than five words have one shingle, the
whole sequence; a repeated row is one more document of its class; rows without
an id link nothing and have no component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.llm.common import bound_batches, cut, fresh, pieces, release_memory, table
from opslens.llm.components import components
from opslens.llm.shingles import mix, shingle_sets, signatures, slices

THRESHOLD = 80
#: Shingles in this many sets or more are ordered last, at most this many of them.
FREQUENT_FROM, FREQUENT_MAX = 16, 1 << 18
#: Lists up to this length are searched at once.
SHORT_LIST = 16
#: In longer ones an entry is first compared with so many others.
NEIGHBOURS = 4
#: Words of 64 bits in a bitmap.
BITMAP = 16
WORDS_OF_BITMAP = [f"w{k}" for k in range(BITMAP)]
#: Candidates of a set that are verified first.
CLOSEST = 4
BUCKET_DOCS = 8192
#: Entries of lists that a task packs at once.
GATHER = 400_000
#: Sets with candidates are picked from the documents by a broadcast up to this many.
BROADCAST_SETS = 1_000_000


def _needed(size: np.ndarray) -> np.ndarray:
    """Least overlap of a set with any similar set."""
    return -(-THRESHOLD * size // 100)


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least overlap of two similar sets of these sizes."""
    return -(-THRESHOLD * (a + b) // (100 + THRESHOLD))


def _sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for at, end, data, offsets in slices(column):
        doc, value, size = shingle_sets(data, offsets)
        yield at, end, doc, value, size, signatures(doc, value, end - at)


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, sig, n_shingles of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, size = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for at, end, _, _, n, s in _sets(batch.column(1)):
                sig[at:end], size[at:end] = s.view(np.int64), n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sig), pa.array(size)], ["doc_id", "sig", "n_shingles"])
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, sig long, n_shingles long")


def _once(doc: np.ndarray, sig: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which entries belong to the first document with its signature here."""
    first = np.zeros(len(sig), bool)
    for i, s in enumerate(sig.tolist()):
        if s not in seen:
            seen.add(s)
            first[i] = True
    return first[doc]


def _by_bucket(value: np.ndarray, buckets: int, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    bucket = (value % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    for b in range(buckets):
        rows = order[(ends[b - 1] if b else 0):ends[b]]
        if len(rows):
            yield b, [c[rows].tobytes() for c in columns]


def _gathered(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Parts joined to about ``GATHER`` entries, to bound a task's memory."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= GATHER:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def frequent_shingles(docs: DataFrame, buckets: int) -> np.ndarray:
    """Shingles that occur in many sets, the most frequent last. Counted over
    the third of every set that a prefix can reach, so a shingle is counted in
    all sets in which its place matters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def reached(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray]]:
            seen: set[int] = set()
            for _, _, doc, value, size, sig in _sets(batch.column(0)):
                start = np.cumsum(size) - size
                reach = np.minimum(size, np.maximum(-(-size // 3), size - _needed(size) + 9))
                yield (value[(np.arange(len(doc)) - start[doc] < reach[doc]) & _once(doc, sig, seen)],)

        for batch in batches:
            for (found,) in _gathered(reached(batch)):
                value, n = np.unique(found, return_counts=True)
                rows = list(_by_bucket(value, buckets, value, n.astype(np.uint16 if n.max(initial=0) < 65536 else np.uint32)))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), *(pa.array([c[k] for _, c in rows], pa.binary()) for k in (0, 1))],
                                                 ["bucket", "value", "n"])
        release_memory()

    def count(t):
        values, counts = [], []
        for v, n in zip(t.column("value"), t.column("n"), strict=True):
            v, n = np.frombuffer(v.as_py(), np.uint64), n.as_py()
            values.append(v)
            counts.append(np.frombuffer(n, np.uint16 if len(n) == 2 * len(v) else np.uint32))
        value, of = np.unique(np.concatenate(values), return_inverse=True)
        n = np.bincount(of, weights=np.concatenate(counts)).astype(np.int64)
        many = n >= FREQUENT_FROM
        return pa.table([pa.array(value[many].view(np.int64)), pa.array(n[many])], names=["value", "n"])

    packed = docs.select("text").mapInArrow(run, "bucket int, value binary, n binary")
    top = packed.groupBy("bucket").applyInArrow(count, "value long, n long").orderBy(F.col("n").desc(), "value").limit(FREQUENT_MAX).toArrow()
    return np.ascontiguousarray(top.column("value").to_numpy()[::-1]).view(np.uint64)


def _prefixes(batch: pa.RecordBatch, frequent: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(shingle, signature, size, position) of the prefix entries of a batch."""
    by_value = np.argsort(frequent)
    ordered = frequent[by_value]
    seen: set[int] = set()
    for _, _, doc, value, size, sig in _sets(batch.column(0)):
        rank = np.zeros(len(value), np.int64)
        if len(frequent):
            at = np.minimum(np.searchsorted(ordered, value), len(ordered) - 1)
            known = ordered[at] == value
            rank[known] = by_value[at[known]] + 1
            last = np.flatnonzero(known)
            if len(last):  # only sets with frequent shingles change their order
                order = np.lexsort((value, rank, doc))
                value, rank = value[order], rank[order]
        start = np.cumsum(size) - size
        position = np.arange(len(doc)) - start[doc]
        keep = (position < (size - _needed(size) + 1)[doc]) & _once(doc, sig, seen)
        yield value[keep], sig[doc[keep]], size[doc[keep]].astype(np.uint32), position[keep].astype(np.uint32)


PAIR = "a long, b long, shingle long, size long, position long"


def _search(t, entries: bool):
    """Candidates (a, b) from the lists of a bucket, and rows (a, null) for the
    lists too long to be searched at once: their entries, or just their sets."""
    columns = [np.concatenate([np.frombuffer(v.as_py(), kind) for v in t.column(name)])
               for name, kind in (("value", np.uint64), ("sig", np.uint64), ("size", np.uint32), ("position", np.uint32))]
    value, sig, size, position = columns
    order = np.lexsort((sig, size, value))
    value, sig, size, position = value[order], sig[order], size[order].astype(np.int64), position[order].astype(np.int64)
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (sig[1:] != sig[:-1])  # equal sets met from several slices
    value, sig, size, position = value[new], sig[new], size[new], position[new]

    # an entry whose neighbours in the list are both outside the size window has no partner
    near = (value[1:] == value[:-1]) & (100 * size[:-1] >= THRESHOLD * size[1:]) if len(value) else np.zeros(0, bool)
    keep = np.zeros(len(value), bool)
    keep[1:] |= near
    keep[:-1] |= near
    value, sig, size, position = value[keep], sig[keep], size[keep], position[keep]

    def possible(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        least = _overlap(size[i], size[j])
        return (100 * size[i] >= THRESHOLD * size[j]) & (position[i] <= size[i] - least) & (position[j] <= size[j] - least)

    starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.zeros(0, np.int64)
    length = np.diff(np.r_[starts, len(value)])
    of = np.repeat(np.arange(len(starts)), length)
    long_list = (length > SHORT_LIST)[of] if len(value) else np.zeros(0, bool)
    pairs = []
    ends = (starts + length)[of] if len(value) else of
    for step in range(1, SHORT_LIST):
        i = np.flatnonzero(~long_list & (np.arange(len(value)) + step < ends))
        if not len(i):
            break
        ok = possible(i, i + step)
        pairs.append((i[ok], i[ok] + step))
    # long lists: the next few entries in an order of each list's own
    rest = np.flatnonzero(long_list)
    rest = rest[np.lexsort((mix(sig[rest] ^ value[rest]), value[rest]))]
    for step in range(1, NEIGHBOURS + 1):
        i, j = rest[:-step], rest[step:]
        same = value[i] == value[j]
        i, j = np.minimum(i, j)[same], np.maximum(i, j)[same]  # places are in order of size and signature
        ok = possible(i, j)
        pairs.append((i[ok], j[ok]))
    i = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
    j = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
    both = np.stack([sig[i], sig[j]], axis=1).view(np.int64)
    found = np.unique(both, axis=0) if len(both) else both
    if not entries:
        rest = rest[np.unique(sig[rest], return_index=True)[1]]
    none = [None] * len(found)
    return pa.table([pa.array([*found[:, 0].tolist(), *sig[rest].view(np.int64).tolist()], pa.int64()), pa.array([*found[:, 1].tolist(), *[None] * len(rest)], pa.int64()),
                     pa.array([*none, *value[rest].view(np.int64).tolist()], pa.int64()), pa.array([*none, *size[rest].tolist()], pa.int64()),
                     pa.array([*none, *position[rest].tolist()], pa.int64())], names=[f.split()[0] for f in PAIR.split(", ")])


def _searched(lists: DataFrame, entries: bool) -> tuple[DataFrame, DataFrame]:
    """From packed lists: candidates (a, b), a before b by size and signature,
    and what is left of long lists (shingle, sig, size, position)."""
    found = cut(lists.groupBy("bucket").applyInArrow(lambda t: _search(t, entries), PAIR))
    return found.where("b is not null").select("a", "b").distinct(), found.where("b is null").select("shingle", F.col("a").alias("sig"), "size", "position")


LISTS = "bucket int, value binary, sig binary, size binary, position binary"
_LIST_KINDS = (pa.int32(), *[pa.binary()] * 4)


def candidates(docs: DataFrame, frequent: np.ndarray, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Candidates from the prefixes of all documents, and the sets that stand
    in long lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in _gathered(_prefixes(batch, frequent)):
                rows = list(_by_bucket(columns[0], buckets, *columns))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), *(pa.array([c[k] for _, c in rows], pa.binary()) for k in range(4))],
                                                 ["bucket", "value", "sig", "size", "position"])
        release_memory()

    return _searched(docs.select("text").mapInArrow(run, LISTS), entries=False)


def close_candidates(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates among the sets of long lists (sig, text), and the entries of
    lists that are still long.

    Such sets are mostly large families of near copies. Here all their shingles
    are counted among them, so each set's prefix starts with what sets it
    apart: shingles that no other has fill it, unless the set is close to the
    family's middle.
    """
    n = pieces(texts, BUCKET_DOCS)
    sliced = texts.select("sig", "text").withColumn("slice", F.pmod(F.xxhash64("sig"), F.lit(n)).cast("int")).repartition(n, "slice")

    def values(t):
        found = [value for _, _, _, value, _, _ in _sets(t.column("text").combine_chunks())]
        value, count = np.unique(np.concatenate(found), return_counts=True)
        rows = list(_by_bucket(value, n, value, count.astype(np.uint32)))
        return pa.table([pa.array([b for b, _ in rows], pa.int32()), pa.array([t.column("slice")[0].as_py()] * len(rows), pa.int32()),
                         *(pa.array([c[k] for _, c in rows], pa.binary()) for k in (0, 1))], names=["bucket", "slice", "value", "n"])

    def counted(t):
        own = [np.frombuffer(v.as_py(), np.uint64) for v in t.column("value")]
        value, of = np.unique(np.concatenate(own), return_inverse=True)
        count = np.bincount(of, weights=np.concatenate([np.frombuffer(v.as_py(), np.uint32) for v in t.column("n")])).astype(np.uint32)
        rows, at = [], 0
        for v in own:
            n_own = count[of[at:at + len(v)]]
            at += len(v)
            rows.append((v[n_own > 1].tobytes(), n_own[n_own > 1].tobytes()))
        return pa.table([t.column("slice"), *(pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1))], names=["slice", "value", "n"])

    def lists(known, t):
        value_of, n_of = (np.concatenate([np.frombuffer(v.as_py(), kind) for v in known.column(c)] or [np.zeros(0, kind)]) for c, kind in (("value", np.uint64), ("n", np.uint32)))
        order = np.argsort(value_of)
        value_of, n_of = value_of[order], n_of[order].astype(np.int64)
        found = [[np.zeros(0, k)] * 1 for k in (np.uint64, np.uint64, np.uint32, np.uint32)]
        for _, _, doc, value, size, sig in _sets(t.column("text").combine_chunks()):
            n_own = np.ones(len(value), np.int64)
            if len(value_of):
                at = np.minimum(np.searchsorted(value_of, value), len(value_of) - 1)
                n_own = np.where(value_of[at] == value, n_of[at], 1)
            order = np.lexsort((value, n_own, doc))
            value, n_own = value[order], n_own[order]
            position = np.arange(len(doc)) - (np.cumsum(size) - size)[doc]
            keep = (position < (size - _needed(size) + 1)[doc]) & (n_own > 1)
            for column, part in zip(found, (value[keep], sig[doc[keep]], size[doc[keep]].astype(np.uint32), position[keep].astype(np.uint32)), strict=True):
                column.append(part)
        columns = [np.concatenate(c) for c in found]
        rows = list(_by_bucket(columns[0], n, *columns))
        return pa.table([pa.array([b for b, _ in rows], pa.int32()), *(pa.array([c[k] for _, c in rows], pa.binary()) for k in range(4))],
                        names=["bucket", "value", "sig", "size", "position"])

    known = (sliced.groupBy("slice").applyInArrow(values, "bucket int, slice int, value binary, n binary")
             .groupBy("bucket").applyInArrow(counted, "slice int, value binary, n binary"))
    return _searched(known.groupBy("slice").cogroup(sliced.groupBy("slice")).applyInArrow(lists, LISTS), entries=True)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per set, its size and the parity of its shingles in each of 64 *
    ``BITMAP`` places. Two bitmaps differ in no more places than their sets
    differ in shingles."""
    for batch in batches:
        bits = np.zeros((batch.num_rows, BITMAP * 64), np.uint8)
        sizes = np.zeros(batch.num_rows, np.int64)
        for at, end, doc, value, size, _ in _sets(batch.column(1)):
            np.add.at(bits, (doc + at, (value >> np.uint64(32)).astype(np.int64) % (BITMAP * 64)), 1)
            sizes[at:end] = size
        words = np.packbits(bits & 1, axis=1).view(np.int64).reshape(batch.num_rows, BITMAP)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(BITMAP))],
                                         ["sig", "size", *WORDS_OF_BITMAP])


def bitmaps_of(texts: DataFrame) -> DataFrame:
    """sig, size and the words of the bitmap of every set (sig, text)."""
    found = texts.select("sig", "text").mapInArrow(_bitmaps, "sig long, size long, " + ", ".join(f"{w} long" for w in WORDS_OF_BITMAP))
    return _never_null(found, "size", *WORDS_OF_BITMAP)


def _never_null(df: DataFrame, *names: str) -> DataFrame:
    """``df`` whose columns ``names``, which hold no null, are known to hold none."""
    return df.withColumns({c: F.coalesce(c, F.lit(False) if kind == "boolean" else F.lit(0)) for c, kind in df.dtypes if c in names})


def _number(name: str) -> Column:
    """A size, place or count as a double, which holds it exactly. Sums of whole
    numbers are checked for overflow, and columns for null; where a join's
    condition has dozens of them, the JIT compiler takes some 460 MB of the
    executor for that one method and then gives it up."""
    return F.col(name).cast("double")


def _differ(x: str, y: str) -> Column:
    """Places in which two bitmaps differ, as a double."""
    return reduce(lambda a, b: a + b, (F.bit_count(F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}"))).cast("double") for w in WORDS_OF_BITMAP))


def _close(differ: Column, x: str, y: str) -> Column:
    """Whether bitmaps that differ in so many places leave sets of these sizes
    enough overlap. (Half of what sizes and difference leave is the most that
    is shared; a difference is odd or even as the sum of the sizes is.)"""
    return (100 + THRESHOLD) * differ <= (100 - THRESHOLD) * (_number(f"{x}.size") + _number(f"{y}.size"))


def by_bitmap(pairs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """a, b, differ of the pairs whose bitmaps do not rule them out."""
    x, y = bitmaps.alias("x"), bitmaps.alias("y")
    differ = _differ("x", "y")
    return (pairs.join(x, F.col("a") == F.col("x.sig")).join(y, F.col("b") == F.col("y.sig"))
            .where(_close(differ, "x", "y")).select("a", "b", differ.cast("int").alias("differ")))


def across_long_lists(entries: DataFrame, labels: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Candidates (a, b) in long lists (shingle, sig, size, position) whose sets
    are in different components: every entry outside its list's largest
    component with all entries of other components. Pairs that their bitmaps
    rule out are left out at once."""
    listed = entries.join(labels.select(F.col("node").alias("sig"), "component"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    main = (listed.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("shingle")
            .agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("shingle", "main"))
    listed = listed.join(main, "shingle").withColumn("minor", F.col("component") != F.col("main")).drop("main").join(bitmaps.drop("size"), "sig")
    listed = cut(_never_null(listed, "minor", "size", "position"))
    x, y = listed.where("minor").alias("x"), listed.alias("y")
    size_x, size_y = _number("x.size"), _number("y.size")
    needed = THRESHOLD * (size_x + size_y)  # the least overlap, times 100 + THRESHOLD
    pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") != F.col("y.component"))
                   & (~F.col("y.minor") | (F.col("x.sig") < F.col("y.sig")))
                   & (100 * size_x >= THRESHOLD * size_y) & (100 * size_y >= THRESHOLD * size_x)
                   & (needed <= (100 + THRESHOLD) * (size_x - _number("x.position"))) & (needed <= (100 + THRESHOLD) * (size_y - _number("y.position")))
                   & _close(_differ("x", "y"), "x", "y"))
    ordered = (size_x < size_y) | ((size_x == size_y) & (F.col("x.sig") < F.col("y.sig")))
    return pairs.select(F.when(ordered, F.col("x.sig")).otherwise(F.col("y.sig")).alias("a"), F.when(ordered, F.col("y.sig")).otherwise(F.col("x.sig")).alias("b"))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of rows (a, b, text_a, text_b) that link."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        step = 64
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            m = part.num_rows
            docs, values, total = [], [], np.zeros(m, np.int64)
            for name in ("text_a", "text_b"):
                for first, _, doc, value, size, _ in _sets(part.column(name)):
                    docs.append(doc + first)
                    values.append(value)
                    total[first:first + len(size)] += size
            doc, value = np.concatenate(docs), np.concatenate(values)
            order = np.lexsort((value, doc))
            doc, value = doc[order], value[order]
            twice = (doc[1:] == doc[:-1]) & (value[1:] == value[:-1])
            common = np.bincount(doc[1:][twice], minlength=m)
            keep[at:at + m] = (100 * common >= THRESHOLD * (total - common)) & (total > 0)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])
    release_memory()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts (sig, text) link, materialised."""
    joined = (pairs.select("a", "b").join(texts.select(F.col("sig").alias("a"), F.col("text").alias("text_a")), "a")
              .join(texts.select(F.col("sig").alias("b"), F.col("text").alias("text_b")), "b"))
    return cut(joined.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long"))


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``pairs`` with the components of both sides."""
    for side in ("a", "b"):
        own = labels.select(F.col("node").alias(side), F.col("component").alias(f"in_{side}"))
        pairs = pairs.join(own, side, "left").withColumn(f"in_{side}", F.coalesce(f"in_{side}", side))
    return pairs


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document (doc_id, text)."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = cut(document_sets(docs))
    buckets = pieces(sets, BUCKET_DOCS)
    pairs, crowd = candidates(docs, frequent_shingles(docs, buckets), buckets)
    crowd = cut(crowd.select("sig").distinct())

    # one text for every set that has a candidate or stands in a long list
    wanted = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).union(crowd).distinct()
    holders = cut(sets.where("doc_id is not null and n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id")).join(wanted, "sig"))
    few = holders.count() <= BROADCAST_SETS  # counted before it is broadcast; more are joined as usual
    # a repeated id can have several texts: the one with the signature is meant
    texts = cut(docs.join(F.broadcast(holders) if few else holders, "doc_id").mapInArrow(_matching, "sig long, text string").dropDuplicates(["sig"]))

    bitmaps = cut(bitmaps_of(texts))

    # first each set's closest candidates
    close, entries = close_candidates(texts.join(crowd, "sig"))
    pairs = by_bitmap(pairs.unionByName(close).distinct(), bitmaps)
    nearest = [F.row_number().over(Window.partitionBy(one).orderBy("differ", other)) for one, other in (("a", "b"), ("b", "a"))]
    pairs = cut(pairs.withColumn("first", (nearest[0] <= CLOSEST) | (nearest[1] <= CLOSEST)))
    links = verified(pairs.where("first"), texts)
    labels = cut(components(links))

    # then the other candidates, and those in lists that are still long, as far as they lie across the components
    others = _labelled(pairs.where("not first").select("a", "b"), labels).where("in_a != in_b").select("a", "b")
    listed = across_long_lists(entries, labels, bitmaps).distinct().join(pairs, ["a", "b"], "left_anti")
    labels = components(links.unionByName(verified(others.unionByName(listed), texts)))

    placed = sets.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    placed = placed.where("n_shingles > 0 and doc_id is not null")
    smallest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    alone = sets.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.join(smallest, "component").select("doc_id", "n_shingles", "component_id").unionByName(alone)


def _matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = np.zeros(batch.num_rows, np.int64)
        for at, end, _, _, _, s in _sets(batch.column("text")):
            sig[at:end] = s.view(np.int64)
        keep = pa.array(sig == batch.column("sig").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([batch.column("sig").filter(keep), batch.column("text").filter(keep)], ["sig", "text"])
    release_memory()


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents whose id is their component's smallest, one row for each
    id (of rows that share it, the first by all columns); documents without an
    id stay."""
    kept, repeated, first = fresh(docs, "kept_id", "repeated", "nth")
    chosen = cut(link_components(docs).where("doc_id = component_id").groupBy(F.col("doc_id").alias(kept))
                 .agg((F.count(F.lit(1)) > 1).alias(repeated)))
    few = chosen.count() <= BROADCAST_SETS  # counted before it is broadcast; larger ones are joined as usual
    joined = docs.join(F.broadcast(chosen) if few else chosen, F.col("doc_id").cast("long") == F.col(kept))
    names = [F.col(f"`{c}`") for c in docs.columns]
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(*names))
    ties = joined.where(F.col(repeated)).select(*names).withColumn(first, nth).where(F.col(first) == 1).drop(first)
    return joined.where(~F.col(repeated)).select(*names).unionByName(ties).unionByName(docs.where("doc_id is null"))


def query(spark, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))
