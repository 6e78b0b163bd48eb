"""Exact inner products of integer vectors of any size, held as small as they fit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Below this, sums of products are exact in double precision.
EXACT = float(1 << 53)
_KINDS = ("i1", "i2", "i4", "f8")


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Lists of numbers as rows of d doubles; shorter lists are filled up with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (size == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(size), d))
    out[np.arange(d) < size[:, None]] = flat
    return out


def packed(x: np.ndarray) -> tuple[str, bytes]:
    """The narrowest kind that holds whole numbers in doubles, and their bytes."""
    most = np.abs(x).max(initial=0.0)
    kind = next(k for k in _KINDS if k == "f8" or most <= np.iinfo(k).max)
    return kind, x.astype("<" + kind).tobytes()


def unpacked(kind: str, data: bytes, d: int) -> np.ndarray:
    return np.frombuffer(data, "<" + kind).reshape(-1, d).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of the rows of a and b, as 64-bit integers or, if those may not hold
    them, as Python integers."""
    d = a.shape[1]
    if np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * d < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(v) for v in row] for row in m], object).reshape(len(m), d) for m in (a, b)]
    return whole[0] @ whole[1].T


def long_scores(scores: list[int]) -> pa.Array:
    """Scores as 64-bit integers; one that does not fit is an error, not a wrong number."""
    return pa.array([int(s) for s in scores], pa.int64())
