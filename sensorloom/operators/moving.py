"""Statistics of frames that move along a series, the median among them, in one Arrow pass.

A part of a series arrives with the rows its first frames look back to.  Frames are kept in order
(``functions.ordered``), so a part costs its rows times the logarithm of the frame, where
``percentile`` over a window sorts every frame.  Parts may be shorter than the frame.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sensorloom.functions.ordered import frame_medians, frame_statistics
from sensorloom.operators.series import MINUTE, Series, row_halo, time_halo, with_ordinal

#: A frame meets at most this many parts.
_PARTS_PER_FRAME = 8


def _numbers(table: pa.Table, column: str) -> np.ndarray:
    return table[column].to_numpy(zero_copy_only=False).astype(float)


def _group_starts(table: pa.Table, column: str | None) -> np.ndarray:
    """For each row the place of the first row of its group of neighbours."""
    place = np.arange(table.num_rows)
    if column is None:
        return np.zeros_like(place)
    values = table[column].to_numpy(zero_copy_only=False)
    opens = np.concatenate([[True], values[1:] != values[:-1]])
    return np.maximum.accumulate(np.where(opens, place, 0))


def _column(values: np.ndarray) -> pa.Array:
    return pa.array(values) if values.dtype.kind == "i" else pa.array(values, from_pandas=True)


def moving_statistics(
    df: DataFrame, s: Series, wanted: dict[str, tuple[str, int, str]], segment: str | None = None
) -> DataFrame:
    """Left-open backward time windows; ``wanted`` maps name to (column, minutes, stat).

    Windows do not reach over the start of a ``segment``.  Nulls and NaN are absent.
    """
    back = max(minutes for _, minutes, _ in wanted.values())
    size = max(s.block_us, back * MINUTE // _PARTS_PER_FRAME)
    spread = time_halo(df, s, back, heavy=True, size=size)
    kept = [c for c in spread.columns if c not in ("_part", "_home")]
    frames: dict[tuple[str, int], dict[str, str]] = {}
    for name, (column, minutes, stat) in wanted.items():
        frames.setdefault((column, minutes), {})[name] = stat

    def roll(table: pa.Table) -> pa.Table:
        rows = table.sort_by("_us")
        us, first = rows["_us"].to_numpy(), _group_starts(rows, segment)
        home = np.flatnonzero(rows["_home"].to_numpy(zero_copy_only=False))
        out = {}
        for (column, minutes), names in frames.items():
            begins = np.maximum(first[home], np.searchsorted(us, us[home] - minutes * MINUTE, "right"))
            ends = np.searchsorted(us, us[home], "right")
            if segment is not None:
                # Rows of the next segment may share the timestamp.
                ends = np.minimum(ends, _ends(first)[home])
            found = frame_statistics(_numbers(rows, column), begins, ends, sorted(set(names.values())))
            out |= {name: _column(found[stat]) for name, stat in names.items()}
        own = rows.select(kept).take(pa.array(home))
        return pa.table([*own.columns, *(out[name] for name in wanted)], names=[*kept, *wanted])

    types = dict(spread.dtypes)
    added = [f"{name} {'bigint' if stat == 'count' else 'double'}" for name, (_, _, stat) in wanted.items()]
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + added)
    return spread.groupBy(*s.keys, "_part").applyInArrow(roll, schema)


def _ends(first: np.ndarray) -> np.ndarray:
    """For each row the end of its group, from the groups' first places."""
    starts = np.unique(first)
    ends = np.append(starts[1:], len(first))
    return ends[np.searchsorted(starts, first)]


def rolling_deviation(
    long: DataFrame, s: Series, rows: int, minimum: int, factor: float, out: str, part_rows: int = 1024
) -> DataFrame:
    """Distance of each value to the median of the last ``rows`` rows, in scaled medians of such distances.

    The second median looks at distances up to ``rows - 1`` rows back, each of which has a median of
    its own, so a part gets twice that many rows of context.
    """
    spread = row_halo(with_ordinal(long, s), s, back=2 * (rows - 1), rows=part_rows, heavy=True)
    kept = list(long.columns)

    def medians(values: np.ndarray) -> np.ndarray:
        present = ~np.isnan(values)
        before = np.concatenate([[0], np.cumsum(present)])
        ends = np.arange(1, len(values) + 1)
        return frame_medians(values[present], before[np.maximum(ends - rows, 0)], before[ends], minimum)

    def roll(table: pa.Table) -> pa.Table:
        ordered = table.sort_by("_ord")
        value = _numbers(ordered, "value")
        distance = np.abs(value - medians(value))
        scale = medians(distance) * factor
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(scale != 0, distance / scale, np.nan)
        full = ordered.append_column(out, pa.array(score, from_pandas=True))
        return full.filter(ordered["_home"]).select([*kept, out])

    types = dict(spread.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"{out} double"])
    return spread.groupBy(*s.keys, "_part").applyInArrow(roll, schema)
