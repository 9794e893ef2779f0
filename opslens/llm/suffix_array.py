"""Suffix arrays by induced sorting, and their common prefixes, on numpy arrays.

Suffixes are classified as smaller or larger than the one after them; those at
the left end of a smaller run (LMS) are sorted by their substrings, recursively
where substrings repeat, and induce the order of all others: larger ones from
left to right, smaller ones from right to left, each in time linear in the
string. A bucket (suffixes of one first letter) is induced as a whole: what it
induces in other buckets is appended there in order, and what it induces in
itself forms its next portion.
"""

from __future__ import annotations

import numpy as np

#: A recursion whose string has fewer letters per distinct letter than this is finished by prefix doubling.
LETTERS_EACH = 64


def _smaller(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (the last: yes)."""
    out = np.ones(len(s), bool)
    changes = s[:-1] != s[1:]
    # each letter of a run compares like the run's last one
    up = np.append((s[:-1] < s[1:])[changes], True)
    out[0] = up[0]
    out[1:] = up[np.cumsum(changes)]
    return out


def _append(buckets: list[list[np.ndarray]], at: np.ndarray, letters: np.ndarray) -> None:
    """Positions to the ends of their letters' buckets, in the given order."""
    if not len(at):
        return
    order = np.argsort(letters, kind="stable")
    at, letters = at[order], letters[order]
    ends = np.flatnonzero(letters[1:] != letters[:-1]) + 1
    start = 0
    for end in [*ends.tolist(), len(at)]:
        buckets[letters[start]].append(at[start:end])
        start = end


#: Positions: half the memory of the usual integers, for strings below 2 GB.
_INT = np.int32
_NONE = np.zeros(0, _INT)


def _induce(s: np.ndarray, smaller: np.ndarray, lms: list[np.ndarray], k: int) -> np.ndarray:
    """The order of all suffixes that the given orders of LMS suffixes (one
    array for each first letter) induce."""
    large: list[list[np.ndarray]] = [[] for _ in range(k)]
    small: list[list[np.ndarray]] = [[] for _ in range(k)]

    def before(at: np.ndarray, kind: bool) -> np.ndarray:
        at = at[at > 0] - 1
        return at[smaller[at] == kind]

    for c in range(k):
        portion = np.concatenate(large[c]) if large[c] else _NONE
        done = [portion]
        while len(portion):
            found = before(portion, False)
            same = s[found] == c
            _append(large, found[~same], s[found[~same]])
            portion = found[same]
            done.append(portion)
        large[c] = [np.concatenate(done)]
        found = before(lms[c], False)
        _append(large, found, s[found])
    for c in range(k - 1, -1, -1):
        portion = np.concatenate(small[c]) if small[c] else _NONE
        done = [portion]
        while len(portion):
            found = before(portion, True)
            same = s[found] == c
            _append(small, found[~same], s[found[~same]])
            portion = found[same]
            done.append(portion)
        small[c] = [np.concatenate(done)]
        found = before(large[c][0][::-1], True)
        _append(small, found, s[found])
    # the last suffix has no successor to induce it: it is the smallest of all
    out = [np.array([len(s) - 1], _INT)]
    for c in range(k):
        out += [large[c][0], small[c][0][::-1]]
    return np.concatenate(out)


def _doubling(rank: np.ndarray) -> np.ndarray:
    """The suffix array of a string of numbers, by doubling the sorted prefix."""
    n = len(rank)
    _, rank = np.unique(rank, return_inverse=True)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[:n - step] = rank[step:] + 1
        key = rank * np.int64(n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        if new[order[-1]] == n - 1 or step >= n:
            return order
        rank, step = new, 2 * step


def _same_substrings(s: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each LMS substring (in order) equals the one before it."""
    same = np.zeros(len(at), bool)
    pair = np.flatnonzero(length[1:] == length[:-1]) + 1
    k = 0
    while len(pair):
        equal = s[at[pair] + k] == s[at[pair - 1] + k]
        pair = pair[equal]
        ended = length[pair] == k + 1
        same[pair[ended]] = True
        pair = pair[~ended]
        k += 1
    return same


def _sort(s: np.ndarray, k: int) -> np.ndarray:
    """The suffix array of ``s`` over letters 0 .. k - 1, whose last letter
    stands for the end: it is smaller than all others and occurs once."""
    n = len(s)
    if n <= 2:
        return np.arange(n, dtype=_INT)[::-1]
    smaller = _smaller(s)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = smaller[1:] & ~smaller[:-1]
    lms = np.flatnonzero(is_lms).astype(_INT)

    def by_letter(at: np.ndarray) -> list[np.ndarray]:
        buckets: list[list[np.ndarray]] = [[] for _ in range(k)]
        _append(buckets, at, s[at])
        return [np.concatenate(b) if b else _NONE for b in buckets]

    order = _induce(s, smaller, by_letter(lms), k)
    order = order[1:][order[1:] < n - 1]
    # LMS substrings in order; each is named by its rank, equal ones alike
    by_substring = np.concatenate([np.array([n - 1], _INT), order[is_lms[order]]])
    place = np.zeros(n, _INT)
    place[lms] = np.arange(len(lms), dtype=_INT)
    length = np.ones(len(lms), np.int64)
    length[:-1] = lms[1:] - lms[:-1] + 1
    same = _same_substrings(s, by_substring, length[place[by_substring]])
    names = np.cumsum(~same) - 1
    reduced = np.zeros(len(lms), np.int64)
    reduced[place[by_substring]] = names
    kinds = int(names[-1]) + 1
    if kinds == len(lms):
        sorted_lms = by_substring
    elif kinds * LETTERS_EACH > len(lms):
        sorted_lms = lms[_doubling(reduced)]
    else:
        sorted_lms = lms[_sort(reduced, kinds)]
    full = _induce(s, smaller, by_letter(sorted_lms), k)
    return np.concatenate([full[:1], full[1:][full[1:] < n - 1]])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of ``text`` (bytes) in order."""
    if not len(text):
        return _NONE
    s = np.zeros(len(text) + 1, np.int16)
    s[:-1] = text
    s[:-1] += 1
    return _sort(s, 257)[1:]


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For every place in ``order``, the length of the prefix its suffix has in
    common with the one before it.

    Worked out in text order (permuted). Where the letters before a suffix and
    its predecessor agree, the value is that of the preceding text position
    less one; only the others are compared, eight bytes at a time.
    """
    n = len(text)
    if not n:
        return _NONE
    previous = np.full(n, -1, _INT)
    previous[order[1:]] = order[:-1]
    at = np.arange(n, dtype=_INT)
    follows = np.zeros(n, bool)
    inner = (at[1:] > 0) & (previous[1:] > 0) & (previous[:-1] >= 0)
    follows[1:] = inner & (text[at[1:] - 1] == text[np.maximum(previous[1:] - 1, 0)])
    start = np.flatnonzero(~follows)
    padded = np.r_[text, np.zeros(16, np.uint8)]
    words = sum(padded[i:i + n + 8].astype(np.uint64) << np.uint64(8 * (7 - i)) for i in range(8))
    value = np.zeros(len(start), np.int64)
    live = np.flatnonzero(previous[start] >= 0)
    while len(live):
        a, b = start[live] + value[live], previous[start[live]] + value[live]
        room = np.minimum(n - a, n - b)
        differ = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        # whole bytes in common, from the highest bit that differs
        bits = np.zeros(len(live), np.int64)
        nonzero = differ > 0
        exact = differ[nonzero]
        low = exact < np.uint64(1 << 52)  # doubles hold these exactly
        top = np.where(low, np.frexp(exact.astype(np.float64))[1], np.frexp((exact >> np.uint64(12)).astype(np.float64))[1] + 12)
        bits[nonzero] = 64 - top
        got = np.where(nonzero, bits // 8, 8)
        got = np.minimum(got, room)
        value[live] += got
        live = live[(got == 8) & (room > 8)]
    of = np.cumsum(~follows) - 1
    permuted = value[of] - (at - start[of])
    return permuted[order]
