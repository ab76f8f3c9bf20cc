"""Words and word n-grams of Arrow string columns as 64-bit hashes, many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_PI = pow(_P, -1, 1 << 64)
#: Bytes hashed at once; a longer word makes a longer block.
BLOCK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: list[np.ndarray] = []


def _tabled(n: int) -> list[np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        _tables[:] = [_powers(_P, max(n, BLOCK + 1)), _powers(_PI, max(n, BLOCK + 1))]
    return _tables


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 one)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def class_table(low: bool, word: bytes | None = None, space: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, byte after lower-casing A-Z if low)."""
    to = np.arange(256, dtype=np.uint8)
    if low:
        to[65:91] += 32
    inside = np.ones(256, bool)
    if space is not None:
        inside[list(space)] = False
    if word is not None:
        inside[:] = False
        inside[list(word)] = True
    return inside, to


#: Words are what ASCII white space separates.
SPACED = class_table(False, space=b" \t\n\v\f\r")
SPACED_LOW = class_table(True, space=b" \t\n\v\f\r")
#: Words of digits, letters (A-Z lower-cased) and all that isn't ASCII.
ALNUM_LOW = class_table(True, word=bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and n + 1 offsets; a null is an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return (data[off[0] : off[-1]], off - off[0]) if len(column) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))


def words(data: np.ndarray, off: np.ndarray, kind: tuple[np.ndarray, np.ndarray], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """(hash, first byte, end byte) of each word, and n + 1 offsets into those for the texts; then the hashes of the words' first so many bytes, for each of prefixes."""
    inside, to = kind
    n, at = len(data), 0
    hashes, starts, ends, heads = [], [], [], [[] for _ in prefixes]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    while at < n:
        end = min(n, at + BLOCK)
        while end < n and not edge[end] and inside[data[end]] and inside[data[end - 1]]:  # on to the end of a word
            step = np.flatnonzero(~inside[data[end : end + 4096]] | edge[end : end + 4096][: len(data[end : end + 4096])])
            end = end + int(step[0]) if len(step) else min(n, end + 4096)
        part = data[at:end]
        w, cut = inside[part], edge[at : end + 1]
        before = np.empty(len(w), bool)
        before[0], before[1:] = False, w[:-1]
        s = np.flatnonzero(w & (~before | cut[:-1]))
        after = np.empty(len(w), bool)
        after[-1], after[:-1] = False, w[1:]
        e = np.flatnonzero(w & (~after | cut[1:])) + 1
        if len(s):
            power, inverse = _tabled(len(part) + 1)
            total = np.empty(len(part) + 1, np.uint64)
            total[0] = 0
            np.cumsum((to[part].astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=total[1:])
            hashes.append(mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            for head, size in zip(heads, prefixes, strict=True):
                head.append(mix((total[np.minimum(e, s + size)] - total[s]) * inverse[s] + np.uint64(size)))
            starts.append(s + at)
            ends.append(e + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64), *(np.zeros(0, np.uint64) for _ in prefixes)
    s = np.concatenate(starts)
    return np.concatenate(hashes), s, np.concatenate(ends), np.searchsorted(s, off), *map(np.concatenate, heads)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, len(h) - k + 1 of them (those over two texts too)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, c = np.zeros(n, np.uint64), 0x2545F4914F6CDD1D
    for j in range(k):
        out += h[j : j + n] * np.uint64(c)
        c = (c * 0x5851F42D4C957F2D + 2 * j + 0x14057B7EF767814E | 1) & _MASK
    return mix(out)


def whole(woff: np.ndarray, k: int, total: int) -> np.ndarray:
    """For the starts 0 .. total - k: whether the run of k words lies in one text."""
    n = max(0, total - k + 1)
    ok = np.ones(n, bool)
    for j in range(1, k):  # a run may not start less than k words before the end of its text
        at = woff[1:] - j
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def owner(woff: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(woff) - 1), np.diff(woff))


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Slices of a batch with about most bytes of text each (one row at least)."""
    if not batch.num_rows:
        return
    texts = batch.column(column)
    size = np.asarray(pc.binary_length(texts).fill_null(0)).astype(np.int64)
    block = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
