"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as S (smaller than the next one) or L (larger). A position is leftmost smaller
when it is S and the one before it is L. The substrings between such positions are put in order a few letters at
a time, named, and sorted by recursion on the string of their names; from their true order two
linear sweeps induce the whole array: L suffixes left to right, then S suffixes right to left.

Common prefixes are kept in text order (permuted). Where the letters before a suffix and before its
neighbour in the array agree, the prefix is that of the suffix before less one letter; only the others are counted.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

import numpy as np


def _small(text: np.ndarray) -> np.ndarray:
    """Which suffixes are S: by the next letter that differs; the last suffix is L."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int64)))
    place = np.where(step != 0, np.arange(n - 1), n - 1)
    following = np.minimum.accumulate(place[::-1])[::-1]
    return np.append(np.append(step, -1)[following] > 0, False)


def _induce(text: Sequence[int], large_before: bytes, small_before: bytes, ends: list[int], lms: list[int]) -> list[int]:
    """Sorts all suffixes, given the leftmost smaller ones in an order that decides the rest.

    The two byte strings say of each suffix whether the one before it is L or S (neither for suffix 0, which also stands for an empty place).
    """
    n = len(text)
    out = [0] * n
    tail = ends[:]
    for p in reversed(lms):
        c = text[p]
        at = tail[c] - 1
        tail[c] = at
        out[at] = p
    head = [0, *ends[:-1]]
    c = text[n - 1]  # the last suffix is larger than the empty one behind it
    out[head[c]] = n - 1
    head[c] += 1
    for p in out:
        if large_before[p]:
            p -= 1
            c = text[p]
            at = head[c]
            out[at] = p
            head[c] = at + 1
    tail = ends[:]
    for p in reversed(out):
        if small_before[p]:
            p -= 1
            c = text[p]
            at = tail[c] - 1
            tail[c] = at
            out[at] = p
    return out


def _names(codes: np.ndarray, lms: np.ndarray, letters: int) -> np.ndarray:
    """Ranks of the substrings from each leftmost smaller position to the next, both included, the last one to the end of the text.

    Letters count from 1 and 0 is the end of the text. Where one substring begins another, its last letter starts a larger
    suffix than the same letter does there, so the places behind an end count as a letter beyond all others.
    """
    n, m = len(codes), len(lms)
    size = np.append(np.diff(lms) + 1, n - lms[-1] + 1)
    bits = int(letters + 1).bit_length()
    width = max(1, 62 // bits)
    padded = np.append(codes.astype(np.int64) + 1, 0)
    rank, live, done = np.zeros(m, np.int64), np.arange(m), 0
    while len(live):
        key = np.zeros(len(live), np.int64)
        for j in range(done, done + width):
            inside = j < size[live]
            key = (key << bits) | np.where(inside, padded[np.where(inside, lms[live] + j, 0)], letters + 1)
        order = np.lexsort((key, rank[live]))
        r, k = rank[live][order], key[order]
        group = np.append(True, r[1:] != r[:-1])
        new = group | np.append(True, k[1:] != k[:-1])
        at = np.arange(len(live))
        start, base = (np.maximum.accumulate(np.where(x, at, 0)) for x in (new, group))
        rank[live[order]] = r + start - base
        tied = ~(new & np.append(new[1:], True))
        done += width
        live = live[order[tied]]
        live = live[size[live] > done]
    return np.unique(rank, return_inverse=True)[1]


def suffix_array(text: Sequence[int], letters: int = 256) -> list[int]:
    """Starts of all suffixes in ascending order; letters are 0 to letters - 1."""
    n = len(text)
    if n < 2:
        return list(range(n))
    codes = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else np.asarray(text)
    small = _small(codes)
    ends = list(accumulate(np.bincount(codes, minlength=letters).tolist()))
    large_before = np.append(False, ~small[:-1]).tobytes()
    small_before = np.append(False, small[:-1]).tobytes()
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        names = _names(codes, lms, letters)
        top = int(names.max()) + 1
        lms = lms[suffix_array(names.tolist(), top) if top < len(lms) else np.argsort(names)]
    return _induce(text, large_before, small_before, ends, lms.tolist())


def common_prefixes(text: bytes, order: Sequence[int], enough: int | None = None) -> np.ndarray:
    """plcp[p]: the common prefix of suffix p with the one before it in order (0 for the first).

    With ``enough`` given, prefixes that long or longer are only known to be so.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(text + bytes(8), np.uint8)
    words = codes[:n].astype(np.uint64)
    for i in range(1, 8):
        words = (words << np.uint64(8)) | codes[i : n + i]
    order = np.asarray(order)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    here = np.arange(n)
    counted = (before < 1) | (here == 0) | (codes[here - 1] != codes[before - 1])
    if enough is not None:
        counted |= here % 1024 == 0  # so that none is counted far beyond enough
    heads = np.flatnonzero(counted)
    # a counted prefix stands for all the positions up to the next one
    need = np.diff(np.append(heads, n)) + (n if enough is None else enough)
    have, live = np.zeros(len(heads), np.int64), np.flatnonzero(before[heads] >= 0)
    while len(live):
        i, j = heads[live] + have[live], before[heads[live]] + have[live]
        room = n - np.maximum(i, j)
        inside = room > 0
        live, i, j, room = live[inside], i[inside], j[inside], room[inside]
        differ = words[i] ^ words[j]
        same = np.full(len(live), 8)
        odd = np.flatnonzero(differ)
        if len(odd):  # equal letters before the first one that differs
            byte = differ[odd].byteswap().view(np.uint8).reshape(-1, 8) != 0
            same[odd] = byte.argmax(1)
        same = np.minimum(same, room)
        have[live] += same
        live = live[(same == 8) & (have[live] < need[live])]
    return have[np.cumsum(counted) - 1] - (here - heads[np.cumsum(counted) - 1])
