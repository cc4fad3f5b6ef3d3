"""Vectorised word and shingle hashes over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes hashed at a time (a longer text is taken whole): bounds a task's memory.
CHUNK = 1 << 21

_rng = np.random.default_rng(77003)
_TABLE = _rng.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + _rng.integers(2, size=256, dtype=np.uint64)
_TABLE[65:91] = _TABLE[97:123]  # A-Z hash as a-z
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_ODD = (_rng.integers(1 << 63, size=64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK * 2, 1 << (n + 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        both = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[size] = tuple(both)
    return _POWERS[size]


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of the words ``[^\\x20\\x09-\\x0D]+`` in A-Z lower case, word offsets by row) for runs of rows.

    Null texts have no words.
    """
    if not len(column):
        return
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        raw = data[offsets[row] : offsets[end]]
        starts_of = offsets[row : end + 1] - offsets[row]
        n = len(raw)
        if n == 0:
            yield row, np.empty(0, np.uint64), np.zeros(end - row + 1, np.int64)
            row = end
            continue
        word = _IS_WORD[raw]
        cut = np.zeros(n + 1, bool)
        cut[starts_of] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = word[:-1]
        starts = np.flatnonzero(word & (~before | cut[:-1]))
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = word[1:]
        ends = np.flatnonzero(word & (~after | cut[1:])) + 1
        up, down = _powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[raw] * up[:n], out=sums[1:])
        yield row, mixed((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, starts_of)
        row = end


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word shingles; fewer words are one shingle, none are none."""
    for _, words, at in word_hashes(column):
        every = np.empty(0, np.uint64)
        if len(words) >= k:
            every = words[: len(words) - k + 1] * _ODD[0]
            for i in range(1, k):
                every = every + words[i : len(words) - k + 1 + i] * _ODD[i]
            every = mixed(every)
        for a, b in zip(at[:-1], at[1:], strict=True):
            n = b - a
            if n >= k:
                yield np.unique(every[a : b - k + 1])
            elif n:
                yield mixed((words[a:b] * _ODD[k : k + n]).sum(keepdims=True) + np.uint64(n))
            else:
                yield np.empty(0, np.uint64)


#: Cells whose parities sketch a set, and their columns (64 to one).
CELLS = 512
CELL_COLUMNS = [f"b{i}" for i in range(CELLS // 64)]


def parities(grams: np.ndarray) -> np.ndarray:
    """int64 [CELLS / 64]: of each cell, whether an odd number of the distinct hashes falls into it.

    The sketches of two sets differ in at most as many cells as there are
    members of only one of them.
    """
    odd = np.bincount((grams >> np.uint64(65 - CELLS.bit_length())).astype(np.int64), minlength=CELLS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def similar_enough(x: str, y: str, percent: int) -> Column:
    """Whether sizes (n) and sketches of two rows (aliases) leave a Jaccard similarity of ``percent`` possible."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in CELL_COLUMNS), F.lit(0))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * apart <= (100 - percent) * (n + m))


def wide_parities(grams: np.ndarray) -> np.ndarray:
    """int64 [cells / 64]: as ``parities``, by the last bits, of as many cells as members at least (a power of two).

    Long texts, whose sketches of ``CELLS`` cells are all alike, stay apart; half the cells are the others xor-ed in halves.
    """
    cells = 1 << (max(CELLS, len(grams)) - 1).bit_length()
    odd = np.bincount((grams & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def apart(x: str, y: str) -> Column:
    """Cells in which two columns of ``wide_parities`` differ, the longer one folded to the cells of the other."""
    fewer = f"least(size({x}), size({y}))"
    halved = "CASE WHEN size({0}) > {1} THEN aggregate(sequence(1, cast(size({0}) div {1} - 1 AS int)), slice({0}, 1, {1}), (f, i) -> zip_with(f, slice({0}, i * {1} + 1, {1}), (p, q) -> p ^ q)) ELSE {0} END"
    return F.expr(f"aggregate(zip_with({halved.format(x, fewer)}, {halved.format(y, fewer)}, (p, q) -> bit_count(p ^ q)), 0, (t, n) -> t + n)")
