"""Whole-batch numpy views of Arrow string columns: words, word hashes, shingles.

Every helper works on the UTF-8 bytes of a run of rows at once, so the cost per word is a few
vector operations and not a Python call. Runs are cut at row borders and hold about ``RUN_BYTES``
bytes; a longer text is a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (two multiply-xorshift rounds) for uint64 arrays."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


BYTE_CODE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words in the benchmark sense: digits, a-z and everything beyond ASCII.
IS_ALNUM = np.ones(256, bool)
IS_ALNUM[0x00:0x30] = IS_ALNUM[0x3A:0x61] = IS_ALNUM[0x7B:0x80] = False


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, _U)
    while len(have) < n:
        have = np.concatenate([have, have * _U(pow(base, len(have), 1 << 64))])
    _powers[base] = have if len(have) <= 4 * RUN_BYTES else have[: 4 * RUN_BYTES]
    return have[:n]


def as_strings(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """The column as one large_string array in which null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def runs(column, limit: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them), whole rows in order."""
    column = as_strings(column)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, end, raw[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def spans(member: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal True runs of ``member`` that stay inside one row."""
    n = len(member)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = after[-1] = False
        before[1:] = member[:-1]
        after[:-1] = member[1:]
        before &= ~edge[:-1]
        after &= ~edge[1:]
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """H with H[e] - H[s] standing for bytes s..e (scale it by ``unshift(s)``)."""
    out = np.zeros(len(buf) + 1, _U)
    np.cumsum(BYTE_CODE[buf] * powers(_BASE, len(buf)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, equal for equal bytes wherever they stand."""
    inv = powers(_BASE_INV, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(_U))


def rows_of(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.searchsorted(offs, starts, "right") - 1


_NEAR = 64
_PLACED = mix(BYTE_CODE[None, :] + np.arange(_NEAR, dtype=_U)[:, None] * _U(0xDA942042E4DD58B5)).ravel()


def word_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans that do not touch, each the sum of codes drawn for (place in the span, byte): no polynomial, whose periodic texts collide."""
    if not len(starts):
        return np.zeros(0, _U)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    byte = buf[place + np.repeat(starts, size)].astype(np.int64)
    code = _PLACED[np.minimum(place, _NEAR - 1) * 256 + byte]
    far = np.flatnonzero(place >= _NEAR)
    code[far] = mix(BYTE_CODE[byte[far]] + place[far].astype(_U) * _U(0xDA942042E4DD58B5))
    return mix(np.add.reduceat(code, first) + size.astype(_U))


def words(buf: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, 64-bit hashes, row) of the words made of bytes in ``member``; ``buf`` is lower-cased already."""
    starts, ends = spans(member[buf], offs)
    return starts, ends, word_hash(buf, starts, ends), rows_of(starts, offs)


def shingles(hashes: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every k-word shingle; a row of 1 to k-1 words gives its whole sequence as one."""
    out = np.zeros(0, _U)
    at = np.zeros(0, np.int64)
    if len(hashes) >= k:
        full = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :])
        acc = np.full(len(full), _U(k))
        for j in range(k):
            acc = mix(acc + hashes[full + j] * _U(0xA0761D6478BD642F)) + _U(j)
        out, at = acc, row[full]
    count = np.bincount(row, minlength=n_rows)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        first = np.searchsorted(row, few)
        extra = np.empty(len(few), _U)
        for i, (r, f) in enumerate(zip(few, first, strict=True)):
            acc = np.full(1, _U(count[r]))
            for j in range(count[r]):
                acc = mix(acc + hashes[f + j : f + j + 1] * _U(0xA0761D6478BD642F)) + _U(j)
            extra[i] = acc[0]
        out, at = np.concatenate([out, extra]), np.concatenate([at, few])
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, at
