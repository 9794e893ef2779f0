"""Removal of long substrings that an earlier document has, by suffix arrays.

Every byte covered by a ``WINDOW``-byte string that also starts in a document
with a smaller id is removed. Which strings recur is read off suffix arrays of
shards: runs of suffixes whose common prefix is ``WINDOW`` bytes or more.

Shards are made by content, so that equal strings meet in one. A string of
``WINDOW`` bytes has a leading gram, the one of its ``GRAM``-byte grams with
the smallest hash; strings with the same leading gram at one place of a text
lie side by side and make one segment. Grams that only one document has cannot
lead a recurring string, so first the grams' hashes are counted (per chunk of
documents, then over all), and only segments around recurring grams go to
their gram's shard: one per chunk and distinct content, with the smallest id
there. A shard joins equal segments, and sorts those whose gram others share,
some grams at a time.

A gram at the edge of a common passage leads other segments in every document.
Grams with more than ``HOT_SEGMENTS`` of them are hot: their segments are not
sent, only their strings' hashes, each with the smallest id of its chunk, to
shards made by those hashes. A string's copies have one leading gram, so they
are hot together.

What returns to a chunk is, per segment, the smallest id that each of its
strings starts in. Groups of copies are thus one entry per chunk everywhere;
no group of equal strings is gathered as its occurrences. Documents are
shuffled once, into chunks that stay in id order inside.

Nulls and odd rows: a null text is an empty one; texts shorter than
``WINDOW`` keep all; an id that is null counts as larger than all others;
rows with the same id do not count as earlier than each other; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import pieces, table
from opslens.llm.shingles import mix
from opslens.llm.suffix_array import common_prefixes, suffix_array

WINDOW = 50
GRAM = 25
CHUNK_DOCS = 8192
SLICE_BYTES = 1_000_000
#: Distinct segments of one gram, beyond one per chunk, that a shard sorts.
HOT_SEGMENTS = 4096
#: Bytes sorted at once, up to a gram's end; a gram has at most
#: (chunks + HOT_SEGMENTS) * 76, so positions stay far below 32 bits.
SORT_BYTES = 1 << 24
NULL_ID = (1 << 63) - 1
#: Ends every segment in a shard's string; no UTF-8 text has it.
END = 0xFF

_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(256, dtype=np.uint64))
_LOW32 = np.uint64(0xFFFFFFFF)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(n, SLICE_BYTES * 2), base, dtype=np.uint64)
        steps[0] = 1
        held = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return held[:n]


class _Slice:
    """Texts of whole documents in one array, with prefix sums that give the
    hash of any stretch of it."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=self.sums[1:])
        self.inverse = _power(pow(_BASE, -1, 1 << 64), len(data) + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def _content(piece: _Slice, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return piece.hash(start, end) ^ mix((end - start).astype(np.uint64))


def _segments(piece: _Slice, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start, end, gram hash) of the segments of a slice."""
    n = len(piece.data)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none, none.astype(np.uint64)
    at = np.arange(n - GRAM + 1)
    gram = piece.hash(at, at + GRAM)
    # smallest (hash, place) over the grams of every window; equal hashes: the first
    low = (gram & ~_LOW32) | at.astype(np.uint64)
    span, width = 1, WINDOW - GRAM + 1
    while 2 * span <= width:
        low = np.minimum(low[:len(low) - span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
    lead = (low & _LOW32).astype(np.int64)
    # windows inside one document
    size = np.diff(offsets)
    first, count = offsets[:-1], np.maximum(size - WINDOW + 1, 0)
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, first[count > 0], 1)
    np.add.at(inside, (first + count)[count > 0], -1)
    ok = np.cumsum(inside[:len(lead)]) > 0
    window = np.flatnonzero(ok)
    if not len(window):
        return none, none, none, none.astype(np.uint64)
    lead = lead[window]
    new = np.ones(len(window), bool)
    new[1:] = (lead[1:] != lead[:-1]) | (window[1:] != window[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.r_[begin[1:], len(window)] - 1
    start, end = window[begin], window[last] + WINDOW
    return np.searchsorted(offsets, start, side="right") - 1, start, end, gram[lead[begin]]


def _chunk(t) -> tuple[list, np.ndarray, list[bytes]]:
    """Documents of a chunk in order of id: (ids, keys, texts)."""
    rows = sorted(zip((NULL_ID if i is None else i for i in t.column("doc_id").to_pylist()), t.column("text").to_pylist(), t.column("doc_id").to_pylist(), strict=True),
                  key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    return [r[2] for r in rows], np.array([r[0] for r in rows], np.int64), [(r[1] or "").encode("utf-8", "surrogatepass") for r in rows]


def _pieces(texts: list[bytes]):
    """(first document, slice, offsets, bytes before it) of a chunk's texts."""
    at = before = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE_BYTES):
            size += len(texts[end])
            end += 1
        offsets = np.r_[0, np.cumsum([len(x) for x in texts[at:end]])].astype(np.int64)
        yield at, _Slice(np.frombuffer(b"".join(texts[at:end]), np.uint8)), offsets, before
        at, before = end, before + size


def _home(gram: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """A gram's shard and the five bytes that name it there."""
    return ((gram >> np.uint64(40)) % np.uint64(shards)).astype(np.int64), gram & np.uint64((1 << 40) - 1)


def _short(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view(np.uint64)


def _zip(data) -> bytes:
    data = data if isinstance(data, bytes) else data.tobytes()
    return len(data).to_bytes(8, "little") + (pa.compress(data, codec="zstd", asbytes=True) if data else b"")


def _unzip(data: bytes, kind=None):
    size = int.from_bytes(data[:8], "little")
    plain = pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b""
    return plain if kind is None else np.frombuffer(plain, kind)


def _by_shard(shard: np.ndarray, shards: int):
    order = np.argsort(shard, kind="stable")
    ends = np.cumsum(np.bincount(shard, minlength=shards))
    for s in range(shards):
        rows = order[(ends[s - 1] if s else 0):ends[s]]
        if len(rows):
            yield s, rows


GRAMS = "shard int, chunk int, once binary, often binary, more binary"


def _grams(shards: int):
    """Per chunk and shard: hashes of the grams that lead a segment in one
    document, and in several, and how many distinct segments beyond one each
    of the latter leads."""
    def run(t):
        _, _, texts = _chunk(t)
        docs, grams, contents = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for first, piece, offsets, _ in _pieces(texts):
            doc, begin, stop, gram = _segments(piece, offsets)
            docs.append(doc + first)
            grams.append(gram)
            contents.append(_content(piece, begin, stop))
        doc, gram, content = np.concatenate(docs), np.concatenate(grams), np.concatenate(contents)
        order = np.argsort(gram, kind="stable")  # documents stay in order
        doc, gram, content = doc[order], gram[order], content[order]
        new = np.ones(len(gram), bool)
        new[1:] = gram[1:] != gram[:-1]
        start = np.flatnonzero(new)
        end = np.r_[start[1:], len(gram)][:len(start)]
        several = doc[start] != doc[end - 1]
        which = np.repeat(np.arange(len(start)), np.where(several, end - start, 0))
        held = content[np.repeat(several, end - start)]
        held = held[np.lexsort((held, which))]
        differs = (held[1:] != held[:-1]) & (which[1:] == which[:-1])
        more = np.bincount(which[1:][differs], minlength=len(start)).astype(np.uint32)
        shard, name = _home(gram[start], shards)
        chunk, out = t.column("chunk")[0].as_py() if t.num_rows else 0, []
        for s, rows in _by_shard(shard, shards):
            many = several[rows]
            out.append((s, chunk, _short(name[rows[~many]]), _short(name[rows[many]]), _zip(more[rows[many]])))
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 5, (pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)],
                        names=[f.split()[0] for f in GRAMS.split(", ")])

    return run


RECURRING = "shard int, chunk int, grams binary, hot binary"


def _recurring(t):
    """Of a shard's grams, those that several documents have, for every chunk:
    all of them, and the hot ones among them."""
    once, often = ([_long(v.as_py()) for v in t.column(c)] for c in ("once", "often"))
    value = np.concatenate([*once, *often])
    order = np.argsort(value, kind="stable")
    ordered = value[order]
    new = np.ones(len(value), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    # in two chunks, or in several documents of one
    several = np.zeros(len(value), bool)
    several[:-1] = ~new[1:]
    several |= ~new | (order >= sum(map(len, once)))
    start = np.flatnonzero(new)
    shared = np.zeros(len(value), bool)
    shared[order] = np.repeat(np.logical_or.reduceat(several, start), np.diff(np.r_[start, len(value)])) if len(value) else several
    more = np.concatenate([np.zeros(sum(map(len, once)), np.int64), *[_unzip(v.as_py(), np.uint32) for v in t.column("more")]])
    hot = np.zeros(len(value), bool)
    hot[order] = np.repeat(np.add.reduceat(more[order], start) > HOT_SEGMENTS, np.diff(np.r_[start, len(value)])) if len(value) else hot
    rows, hot_rows, at = [], [], [0, sum(map(len, once))]
    for own in zip(once, often, strict=True):
        parts, hot_parts = [], []
        for k in (0, 1):
            here = slice(at[k], at[k] + len(own[k]))
            parts.append(own[k][shared[here]])
            hot_parts.append(own[k][hot[here]])
            at[k] += len(own[k])
        rows.append(_short(np.concatenate(parts)))
        hot_rows.append(_short(np.concatenate(hot_parts)))
    return pa.table([t.column("shard"), t.column("chunk"), pa.array(rows, pa.binary()), pa.array(hot_rows, pa.binary())], names=[f.split()[0] for f in RECURRING.split(", ")])


def _shared_segments(shared, texts: list[bytes], shards: int):
    """The segments of a chunk whose gram recurs and is not hot: (document,
    start and end in the chunk's bytes, shard, name of the gram, hash of the
    content); the strings of the hot ones: (document, hash); the hot grams."""
    def listed(column: str) -> np.ndarray:
        keys = [(np.uint64(s) << np.uint64(40)) | _long(grams.as_py()) for s, grams in zip(shared.column("shard").to_pylist(), shared.column(column), strict=True)]
        return np.sort(np.concatenate([np.zeros(0, np.uint64), *keys]))

    def among(known: np.ndarray, key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
        return known[at] == key if len(known) else np.zeros(len(key), bool)

    known, hot = listed("grams"), listed("hot")
    found, strings, hot_grams = [], [], [np.zeros(0, np.uint64)]
    for first, piece, offsets, before in _pieces(texts):
        doc, start, end, gram = _segments(piece, offsets)
        shard, name = _home(gram, shards)
        key = (shard.astype(np.uint64) << np.uint64(40)) | name
        split = among(hot, key)
        if split.any():
            at, n = _strings(start[split], end[split])
            strings.append((np.repeat(doc[split] + first, n), piece.hash(at, at + WINDOW)))
            hot_grams.append(gram[split])
        keep = among(known, key) & ~split
        doc, start, end = doc[keep], start[keep], end[keep]
        found.append((doc + first, start + before, end + before, shard[keep], name[keep], _content(piece, start, end)))
    empty = [np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64)]
    return ([np.concatenate(c) for c in zip(empty, *found, strict=True)],
            [np.concatenate(c) for c in zip([empty[0], empty[4]], *strings, strict=True)], np.unique(np.concatenate(hot_grams)))


def _strings(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the strings of segments, and how many each segment has."""
    n = end - start - WINDOW + 1
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n), n


SEGMENTS = "shard int, chunk int, gram binary, content binary, key binary, size binary, bytes binary, string binary, string_key binary, hot binary"
_SEGMENT_KINDS = (pa.int32(), pa.int32(), *[pa.binary()] * 8)


def _send(shards: int):
    """Segments to their shards: per chunk one for each distinct content, and
    one hash for each distinct string of the hot ones."""
    def run(shared, t):
        _, keys, texts = _chunk(t)
        (doc, start, end, shard, name, content), (string_doc, string), hot = _shared_segments(shared, texts, shards)
        _, first = np.unique(content, return_index=True)  # documents are in order: the smallest id
        string, first_string = np.unique(string, return_index=True)
        string_key = keys[string_doc[first_string]]
        data = np.frombuffer(b"".join(texts), np.uint8)
        chunk, out = t.column("chunk")[0].as_py() if t.num_rows else 0, []
        segments, strings = dict(_by_shard(shard[first], shards)), dict(_by_shard(_home(string, shards)[0], shards))
        none = np.zeros(0, np.int64)
        for s in sorted(segments.keys() | strings.keys()):
            rows, own = first[segments.get(s, none)], strings.get(s, none)
            size = end[rows] - start[rows]
            out.append((s, chunk, _zip(name[rows]), _zip(content[rows]), _zip(keys[doc[rows]]), _zip(size.astype(np.uint32)), _zip(_take(data, start[rows], size)),
                        _zip(string[own]), _zip(string_key[own]), _zip(hot[:0] if out else hot)))
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 10, _SEGMENT_KINDS, strict=True)], names=[f.split()[0] for f in SEGMENTS.split(", ")])

    return run


def _take(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of ``data``, one after the other."""
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)
    return data[at]


ANSWERS = "chunk int, content binary, first binary, last binary, key binary, string binary, string_key binary, hot binary"


def _answer(t):
    """For every chunk's segments: runs of windows (first, last) with the
    smallest id that they start in; for its hot strings that id alone."""
    parts = [[_unzip(v.as_py(), kind) for v in t.column(c)] for c, kind in
             (("gram", np.uint64), ("content", np.uint64), ("key", np.int64), ("size", np.uint32))]
    counts = [len(p) for p in parts[0]]
    gram, content, key, size = (np.concatenate(p) for p in parts)
    size = size.astype(np.int64)
    data = np.frombuffer(b"".join(_unzip(v.as_py()) for v in t.column("bytes")), np.uint8)
    start = np.cumsum(size) - size
    # equal segments are one; theirs is the smallest id
    _, one, of = np.unique(content, return_index=True, return_inverse=True)
    least = np.full(len(one), NULL_ID)
    np.minimum.at(least, of, key)
    windows = size[one] - WINDOW + 1
    # segments whose gram others have too are sorted
    _, gram_of, n = np.unique(gram[one], return_inverse=True, return_counts=True)
    sort = np.flatnonzero(n[gram_of] > 1)
    row, first, last, smallest = [np.flatnonzero(n[gram_of] == 1)], [], [], []
    first.append(np.zeros(len(row[0]), np.int64))
    last.append(windows[row[0]] - 1)
    smallest.append(least[row[0]])
    sort = sort[np.argsort(gram_of[sort], kind="stable")]
    before = np.cumsum(size[one[sort]] + 1) - size[one[sort]] - 1
    new_gram = np.diff(gram_of[sort], prepend=-1) != 0
    part = before[new_gram][np.cumsum(new_gram) - 1] // SORT_BYTES  # by where its gram begins
    for own in np.split(sort, np.flatnonzero(np.diff(part)) + 1) if len(sort) else []:
        length = size[one[own]] + 1
        ends = np.cumsum(length)
        text = np.full(int(ends[-1]), END, np.uint8)
        within = np.arange(int(ends[-1])) - np.repeat(ends - length, length)
        segment = np.repeat(np.arange(len(own)), length)
        inner = within < length[segment] - 1
        text[inner] = _take(data, start[one[own]], size[one[own]])
        order = suffix_array(text)
        group = np.cumsum(common_prefixes(text, order) < WINDOW)
        whole = within[order] < windows[own][segment[order]]  # the window ends inside its segment
        place, group = order[whole], group[whole]
        best = np.full(int(group.max(initial=0)) + 1, NULL_ID)
        np.minimum.at(best, group, least[own][segment[place]])
        per = np.empty(len(text), np.int64)
        per[place] = best[group]
        place = np.sort(place)
        value = per[place]
        new = np.ones(len(place), bool)
        new[1:] = (segment[place[1:]] != segment[place[:-1]]) | (value[1:] != value[:-1])
        begin = np.flatnonzero(new)
        stop = np.r_[begin[1:], len(place)] - 1
        row.append(own[segment[place[begin]]])
        first.append(within[place[begin]])
        last.append(within[place[stop]])
        smallest.append(value[begin])
    row, first, last, smallest = (np.concatenate(x) for x in (row, first, last, smallest))
    by_row = np.argsort(row, kind="stable")
    row, first, last, smallest = row[by_row], first[by_row], last[by_row], smallest[by_row]
    runs = np.bincount(row, minlength=len(one))
    run_start = np.cumsum(runs) - runs
    string, string_key = ([_unzip(v.as_py(), kind) for v in t.column(c)] for c, kind in (("string", np.uint64), ("string_key", np.int64)))
    distinct, same = np.unique(np.concatenate(string), return_inverse=True)
    string_least = np.full(len(distinct), NULL_ID)
    np.minimum.at(string_least, same, np.concatenate(string_key))
    out, at, string_at = [], 0, 0
    for chunk, count, strings, hot in zip(t.column("chunk").to_pylist(), counts, string, t.column("hot").to_pylist(), strict=True):
        answer = string_least[same[string_at:string_at + len(strings)]]
        string_at += len(strings)
        mine = of[at:at + count]
        at += count
        take = _take(np.arange(len(row)), run_start[mine], runs[mine])
        out.append((chunk, _zip(content[one][row[take]]), _zip(first[take].astype(np.uint32)), _zip(last[take].astype(np.uint32)), _zip(smallest[take]), _zip(strings), _zip(answer), hot))
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 7), strict=True)], names=[f.split()[0] for f in ANSWERS.split(", ")])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _remove(keep_bytes: bool):
    """Apply the answers to a chunk's documents."""
    def run(answers, t):
        ids, keys, texts = _chunk(t)
        parts = [[_unzip(v.as_py(), kind) for v in answers.column(c)] for c, kind in
                 (("content", np.uint64), ("first", np.uint32), ("last", np.uint32), ("key", np.int64), ("string", np.uint64), ("string_key", np.int64), ("hot", np.uint64))]
        content, first, last, smallest, string, string_least, hot = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts)
        by_string = np.argsort(string, kind="stable")
        string, string_least = string[by_string], string_least[by_string]
        by_content = np.argsort(content, kind="stable")
        content, first, last, smallest = content[by_content], first[by_content].astype(np.int64), last[by_content].astype(np.int64), smallest[by_content]
        total = sum(len(x) for x in texts)
        change = np.zeros(total + 1, np.int64)
        for at, piece, offsets, before in _pieces(texts):
            if not len(content) and not len(hot):
                break
            doc, start, end, gram = _segments(piece, offsets)
            split = np.isin(gram, hot)
            if split.any():
                place, n = _strings(start[split], end[split])
                found = string_least[np.searchsorted(string, piece.hash(place, place + WINDOW))]
                place = place[found < np.repeat(keys[doc[split] + at], n)] + before
                np.add.at(change, place, 1)
                np.add.at(change, place + WINDOW, -1)
                doc, start, end = doc[~split], start[~split], end[~split]
            own = _content(piece, start, end)
            lo, hi = np.searchsorted(content, own, side="left"), np.searchsorted(content, own, side="right")
            n = hi - lo
            run_no = _take(np.arange(len(content)), lo, n)
            begin, who = np.repeat(start + before, n), np.repeat(keys[doc + at], n)
            earlier = smallest[run_no] < who
            begin, run_no = begin[earlier], run_no[earlier]
            np.add.at(change, begin + first[run_no], 1)
            np.add.at(change, begin + last[run_no] + WINDOW, -1)
        gone = np.cumsum(change[:-1]) > 0
        out, at = [], 0
        for doc_id, text in zip(ids, texts, strict=True):
            mask = gone[at:at + len(text)]
            at += len(text)
            removed = int(mask.sum())
            spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if removed else 0
            kept = np.frombuffer(text, np.uint8)[~mask].tobytes() if removed else text
            out.append((doc_id, len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 6, kinds, strict=True)], names=[f.split()[0] for f in RESULT.split(", ")])

    return run


def remove_repeats(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """Every document (doc_id, text) with its removal (``RESULT``); ``kept``,
    the remaining bytes, is null unless asked for."""
    n = pieces(docs.select("doc_id"), CHUNK_DOCS)
    chunks = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
              .withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")).repartition(n, "chunk"))
    shared = chunks.groupBy("chunk").applyInArrow(_grams(n), GRAMS).groupBy("shard").applyInArrow(_recurring, RECURRING)
    sent = shared.groupBy("chunk").cogroup(chunks.groupBy("chunk")).applyInArrow(_send(n), SEGMENTS)
    answers = sent.groupBy("shard").applyInArrow(_answer, ANSWERS)
    return answers.groupBy("chunk").cogroup(chunks.groupBy("chunk")).applyInArrow(_remove(keep_bytes), RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False).drop("kept")
