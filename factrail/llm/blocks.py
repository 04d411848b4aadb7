"""Vectorised words of whole texts: Arrow string columns are cut into blocks of rows and hashed word by word with numpy.

Words are runs of bytes other than space and 0x09-0x0D; A-Z is lower-cased on request by the hash table, so no text is copied.
A block holds at most BLOCK_ROWS rows and about BLOCK_BYTES bytes; one longer text is a block of its own and is hashed in windows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_ROWS = 4096
BLOCK_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
WORD = ~SPACE
_BASE = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_EXACT = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_LOWER = _EXACT[_FOLD]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _M, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, BLOCK_BYTES + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), BLOCK_BYTES + 1)


def _ramps(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n < len(_UP):
        return _UP, _DOWN
    return _powers(_BASE, n + 1), _powers(pow(_BASE, -1, 1 << 64), n + 1)


def text_blocks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, byte offsets of the rows, bytes) of each block; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    rows = len(column)
    if not rows:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + rows + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + BLOCK_ROWS, rows)
        yield lo, offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
        lo = hi


def spans(offsets: np.ndarray, data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each maximal run of bytes for which the table inside is true; runs end with their row."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    w = inside[data]
    head = w.copy()
    head[1:] &= ~w[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    head[first] = w[first]
    tail = w.copy()
    tail[:-1] &= ~w[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    tail[last] = w[last]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans (ascending, disjoint): a polynomial over scrambled bytes, scrambled again."""
    return hash_nested(data, starts, ends, (), fold)[0]


def hash_nested(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inner: tuple[np.ndarray, ...], fold: bool = True) -> list[np.ndarray]:
    """Hashes of spans and of spans with the same starts that end earlier."""
    table = _LOWER if fold else _EXACT
    out = [np.empty(len(starts), np.uint64) for _ in range(1 + len(inner))]
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(int(np.searchsorted(ends, a + BLOCK_BYTES, side="right")), i + 1)
        b = ends[j - 1]
        up, down = _ramps(int(b - a))
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(table[data[a:b]] * up[: b - a], out=total[1:])
        for result, stop in zip(out, (ends, *inner)):
            result[i:j] = (total[stop[i:j] - a] - total[starts[i:j] - a]) * down[starts[i:j] - a]
        i = j
    return [mix(x + np.uint64(0x5851F42D4C957F2D)) for x in out]


def word_hashes(offsets: np.ndarray, data: np.ndarray, fold: bool = True, inside: np.ndarray = WORD):
    row, starts, ends = spans(offsets, data, inside)
    return row, starts, ends, hash_spans(data, starts, ends, fold)


LETTERS = np.zeros(256, bool)
LETTERS[97:123] = True
LETTERS[128:] = True


def lowered(column: pa.Array) -> pa.Array:
    """Lower-cased text; words are then runs of LETTERS (a-z and all bytes of other scripts)."""
    return pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))


HASH_BITS = 52


def shingle_sets(offsets: np.ndarray, data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, 52-bit shingle) of a block's rows, distinct and ascending by row and shingle, and the set sizes.

    A row with fewer words than width has its whole sequence as the only shingle; one without words has none.
    """
    rows = len(offsets) - 1
    row, _, _, h = word_hashes(offsets, data)
    count = np.bincount(row, minlength=rows)
    n = len(h)
    q = 0xD6E8FEB86659FD93
    acc = np.zeros(n, np.uint64)
    first = np.concatenate(([0], np.cumsum(count)))
    place = np.arange(n) - first[row]
    left = count[row] - place
    for j in range(width):
        if j < n:
            part = h[j:] * np.uint64(pow(q, j, 1 << 64))
            acc[: n - j] += np.where(left[: n - j] > j, part, np.uint64(0)) if j else part
    keep = (left >= width) | (place == 0)
    value = mix(acc[keep] + mix(np.minimum(count[row[keep]], width).astype(np.uint64))) >> np.uint64(64 - HASH_BITS)
    key = np.sort((row[keep].astype(np.uint64) << np.uint64(HASH_BITS)) | value)
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    doc = (key >> np.uint64(HASH_BITS)).astype(np.int64)
    return doc, key & np.uint64((1 << HASH_BITS) - 1), np.bincount(doc, minlength=rows)


def row_sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Sums of values (wrapping uint64) by ascending row."""
    out = np.zeros(rows, np.uint64)
    if len(values):
        at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        out[row[at]] = np.add.reduceat(values, at)
    return out


def batches_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema, strict=True)], schema=schema)
