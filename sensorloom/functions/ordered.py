"""Order statistics of frames that move along a series.

``percentile`` over a moving or growing frame sorts the frame anew for every row.  Here a frame is a
multiset kept in order: a row that enters or leaves costs one binary search, and any order statistic
is a look-up, so a series costs rows times the logarithm of the frame.  The frame a block starts
with is sorted at once.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable
from itertools import accumulate
from math import ceil, floor

import numpy as np

#: Values of a part before it is cut in two; more for large multisets.
_LOAD = 1024


class OrderedValues:
    """A multiset of numbers in order, in parts of about the square root of its size."""

    def __init__(self, values: np.ndarray | list[float] = ()) -> None:
        ordered = np.sort(np.asarray(values, float))
        self.size = len(ordered)
        self.load = max(_LOAD, int(self.size**0.5))
        at = range(0, max(self.size, 1), self.load)
        self.parts = [ordered[a : a + self.load].tolist() for a in at]
        self._starts: list[int] | None = None

    def _part(self, x: float) -> int:
        """The first part whose last value is not below x, or the last part."""
        if len(self.parts) == 1:
            return 0
        return min(bisect_left(self.parts, x, key=lambda p: p[-1]), len(self.parts) - 1)

    def add(self, x: float) -> None:
        k = self._part(x)
        part = self.parts[k]
        insort(part, x)
        self.size += 1
        self._starts = None
        if len(part) > 2 * self.load:
            half = len(part) // 2
            self.parts[k : k + 1] = [part[:half], part[half:]]

    def remove(self, x: float) -> None:
        k = self._part(x)
        part = self.parts[k]
        at = bisect_left(part, x)
        if at == len(part) or part[at] != x:
            raise KeyError(x)
        del part[at]
        self.size -= 1
        self._starts = None
        if not part and len(self.parts) > 1:
            del self.parts[k]

    def _offsets(self) -> list[int]:
        if self._starts is None:
            self._starts = [0, *accumulate(map(len, self.parts))]
        return self._starts

    def __getitem__(self, rank: int) -> float:
        if len(self.parts) == 1:
            return self.parts[0][rank]
        starts = self._offsets()
        k = bisect_right(starts, rank, hi=len(self.parts)) - 1
        return self.parts[k][rank - starts[k]]

    def at_most(self, x: float) -> int:
        """How many values are not above x."""
        if len(self.parts) == 1:
            return bisect_right(self.parts[0], x)
        k = bisect_right(self.parts, x, key=lambda p: p[0]) - 1
        return 0 if k < 0 else self._offsets()[k] + bisect_right(self.parts[k], x)

    def quantile(self, p: float) -> float:
        """The interpolated quantile."""
        place = (self.size - 1) * p
        low = self[floor(place)]
        return low + (self[ceil(place)] - low) * (place - floor(place))

    def deviation(self, centre: float) -> float:
        """The median distance to the centre.

        The nearest values on both sides are two sorted sequences; a binary search finds how many of
        the first come from below.
        """
        at = self.parts[0].__getitem__ if len(self.parts) == 1 else self.__getitem__
        inside, rank = self.at_most(centre), (self.size - 1) // 2
        low, high = max(0, rank + 1 - (self.size - inside)), min(rank + 1, inside)
        while low < high:
            below = (low + high) // 2
            if centre - at(inside - 1 - below) < at(inside + rank - below) - centre:
                low = below + 1
            else:
                high = below
        above = rank + 1 - low
        first = max(centre - at(inside - low) if low else 0.0, at(inside + above - 1) - centre if above else 0.0)
        if self.size % 2:
            return first
        left = [centre - at(inside - 1 - low)] if low < inside else []
        right = [at(inside + above) - centre] if inside + above < self.size else []
        return first + (min(left + right) - first) * 0.5


def walk_frames(
    values: np.ndarray, begins: np.ndarray, ends: np.ndarray, visit: Callable[[int, OrderedValues], None]
) -> None:
    """Calls ``visit(i, frame)`` with the multiset ``values[begins[i]:ends[i]]`` for each i in order.

    Neither ends of the frames move backwards.  A frame that shares nothing with the one before, or
    of which more changes than stays, is sorted anew.
    """
    held, begin, end = OrderedValues(), 0, 0
    for i, (b, e) in enumerate(zip(begins.tolist(), ends.tolist())):
        e = max(b, e)
        if b >= end or (e - end) + (b - begin) > (end - b) // 4 + 64:
            held = OrderedValues(values[b:e])
        else:
            for x in values[end:e].tolist():
                held.add(x)
            for x in values[begin:b].tolist():
                held.remove(x)
        begin, end = b, e
        visit(i, held)


def frame_medians(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int = 1) -> np.ndarray:
    """Medians of the frames; NaN for frames of fewer than ``least`` values."""
    out = np.full(len(begins), np.nan)

    def visit(i: int, frame: OrderedValues) -> None:
        if frame.size >= max(least, 1):
            out[i] = frame.quantile(0.5)

    walk_frames(values, begins, ends, visit)
    return out


def frame_scales(
    values: np.ndarray, begins: np.ndarray, ends: np.ndarray, quarters: bool = False
) -> dict[str, np.ndarray]:
    """Median and unscaled median absolute deviation of the frames, and both quartiles if asked."""
    names = ["median", "mad", *(["q1", "q3"] if quarters else [])]
    out = {n: np.full(len(begins), np.nan) for n in names}

    def visit(i: int, frame: OrderedValues) -> None:
        if not frame.size:
            return
        out["median"][i] = centre = frame.quantile(0.5)
        out["mad"][i] = frame.deviation(centre)
        if quarters:
            out["q1"][i], out["q3"][i] = frame.quantile(0.25), frame.quantile(0.75)

    walk_frames(values, begins, ends, visit)
    return out


def steady_starts(values: np.ndarray, places: np.ndarray, firsts: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """For each of ``places`` (not falling) the start of the stretch up to it, not before its
    ``firsts``, of which all values lie within ``limits`` of the value at the place.

    The last value too high and the last one too low are found by binary search on the stacks of
    the values that nothing later exceeds.
    """
    high: list[int] = []
    low: list[int] = []
    out = []
    x, known = values.tolist(), 0
    for place, first, limit in zip(places.tolist(), firsts.tolist(), limits.tolist()):
        for j in range(known, place + 1):
            while high and x[high[-1]] <= x[j]:
                high.pop()
            while low and x[low[-1]] >= x[j]:
                low.pop()
            high.append(j)
            low.append(j)
        known = max(known, place + 1)
        now = x[place]
        above = bisect_left(high, True, key=lambda j: not x[j] - now > limit)
        below = bisect_left(low, True, key=lambda j: not now - x[j] > limit)
        out.append(max(first, high[above - 1] + 1 if above else 0, low[below - 1] + 1 if below else 0))
    return np.array(out, np.int64)


def frame_statistics(
    values: np.ndarray, begins: np.ndarray, ends: np.ndarray, stats: list[str]
) -> dict[str, np.ndarray]:
    """``mean median std var min max sum count`` of the frames of present values (NaN for absent ones).

    Sums are differences of running sums in extended precision, so they cost nothing per frame, except
    for frames whose spread is lost in them.
    """
    present = ~np.isnan(values)
    before = np.concatenate([[0], np.cumsum(present)])
    x = values[present]
    begins, ends = before[begins], before[np.maximum(begins, ends)]
    n = ends - begins
    out: dict[str, np.ndarray] = {"count": n}
    if {"mean", "sum", "std", "var"} & set(stats):
        shift = np.longdouble(x.mean()) if len(x) else np.longdouble(0)
        apart = x - shift
        one, two = (np.concatenate([[np.longdouble(0)], np.cumsum(a)]) for a in (apart, apart * apart))
        total = one[ends] - one[begins]
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = total / n
            square = np.maximum((two[ends] - two[begins]) - total * mean, 0)
            var = square / (n - 1)
        # Where running sums cancel, the values themselves decide; equal values have no spread.
        turns = np.concatenate([[0], np.cumsum(x[1:] != x[:-1])])
        cancelled = (n > 1) & (square <= two[ends] * 1e-9)
        for i in np.flatnonzero(cancelled):
            b, e = begins[i], ends[i]
            var[i] = x[b:e].var(ddof=1) if turns[b] != turns[e - 1] else 0
        out["mean"] = np.where(n > 0, mean + shift, np.nan).astype(float)
        out["sum"] = np.where(n > 0, total + n * shift, np.nan).astype(float)
        out["var"] = np.where(n > 1, var, np.nan).astype(float)
        out["std"] = np.sqrt(out["var"])
    ranked = [s for s in ("median", "min", "max") if s in stats]
    if ranked:
        out |= {s: np.full(len(n), np.nan) for s in ranked}

        def visit(i: int, frame: OrderedValues) -> None:
            if frame.size:
                for s in ranked:
                    out[s][i] = frame.quantile(0.5) if s == "median" else frame[0 if s == "min" else frame.size - 1]

        walk_frames(x, begins, ends, visit)
    return {s: out[s] for s in stats}
