"""Moving text between Arrow columns and numpy code-point arrays, a whole batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Code points that one numpy step handles at most, unless a single text is longer.
CHUNK = 1_500_000


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts in a row, n + 1 starts). A null is a text of length 0."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.offset:
        column = pa.concat_arrays([column])
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32, count=n + 1).astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and n else np.zeros(0, np.uint8)
    at = at - at[0]
    if not len(raw):
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    if raw.max() < 128:
        return raw.astype(np.uint32), at
    text = raw.tobytes().decode("utf-8", "surrogatepass")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    before = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return points, before[at]


def strings(points: np.ndarray, starts: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The texts as an Arrow string column; rows that are not valid become null."""
    n = len(starts) - 1
    data = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    size = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    at = np.concatenate(([0], np.cumsum(size)))[starts]
    out = pa.LargeStringArray.from_buffers(n, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data)).cast(pa.string())
    return out if valid is None or valid.all() else _masked(out, valid)


def _masked(column: pa.Array, valid: np.ndarray) -> pa.Array:
    import pyarrow.compute as pc

    return pc.if_else(pa.array(valid), column, pa.scalar(None, column.type))


def slices(lengths: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths add up to ``most`` at the utmost; a longer row stands alone."""
    n, i, ends = len(lengths), 0, np.cumsum(lengths)
    while i < n:
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield i, min(j, n)
        i = min(j, n)
