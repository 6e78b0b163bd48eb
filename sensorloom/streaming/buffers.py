"""Keyed state: history buffers with live features, and the alert lifecycle."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from sensorloom.functions.ordered import frame_statistics
from sensorloom.operators.features import FeaturePlan
from sensorloom.operators.series import MINUTE, Series, micros

# Readings a model needs before it predicts.
HISTORY_REQUIREMENTS = {
    "persistence": 1, "prophet": 1, "random_forest": 25, "xgboost": 25, "lightgbm": 25,
    "lstm": 36, "gru": 36, "tft": 121,
}


def history_gate(count: Column, model: str) -> Column:
    """Whether a model may predict with this many buffered readings."""
    return count >= HISTORY_REQUIREMENTS[model]


def live_table(
    times: np.ndarray, columns: dict[str, np.ndarray], first: int, plan: FeaturePlan, cadence_minutes: int
) -> dict[str, np.ndarray]:
    """Planned lags and rolling statistics of the rows from ``first`` on, NaN where there is none.

    ``times`` are rising microseconds of one segment and ``columns`` arrays of values.  Lags are
    looked up and windows cut by binary search for all rows at once.
    """
    now, ends = times[first:], np.arange(first + 1, len(times) + 1)
    out = {}
    for name, (channel, minutes) in plan.lag_names().items():
        at = np.minimum(np.searchsorted(times, now - minutes * MINUTE), len(times) - 1)
        out[name] = np.where(times[at] == now - minutes * MINUTE, columns[channel][at], np.nan)
    windows: dict[tuple[str, int], list[tuple[str, str]]] = {}
    for name, (channel, minutes, stat) in plan.rolling_names().items():
        windows.setdefault((channel, minutes), []).append((name, stat))
    parts = {"range": ["min", "max"], "cv": ["mean", "std"]}
    for (channel, minutes), names in windows.items():
        begins = np.searchsorted(times, now - minutes * MINUTE, "right")
        wanted = sorted({p for _, stat in names for p in parts.get(stat, [stat])} | {"count"})
        got = frame_statistics(columns[channel], begins, ends, wanted)
        enough = got["count"] >= max(2, math.ceil(minutes / cadence_minutes * 0.5))
        for name, stat in names:
            if stat == "range":
                value = got["max"] - got["min"]
            elif stat == "cv":
                mean = np.where(got["mean"] == 0, np.nan, np.abs(got["mean"]))
                value = got["std"] / mean
            else:
                value = got[stat].astype(float)
            out[name] = np.where(enough, value, np.nan)
    return out


def _plan_channels(plan: FeaturePlan) -> list[str]:
    return sorted({*plan.lags, *plan.rolling})


class HistoryBuffer(StatefulProcessor):
    """Bounded history of one sensor; reset by a gap or by time not advancing.

    With ``lateness_minutes`` readings wait, by their time, until the watermark has passed them, and
    are then taken in the order of time; of readings with equal times the last arrival counts.  So
    neither the order of arrival nor the cuts between micro-batches change the result.  Without it
    every batch is taken at once, in its own order of time.
    """

    def __init__(self, plan: FeaturePlan, s: Series, max_hours: int, lateness_minutes: int | None = None):
        self.plan, self.s, self.reach = plan, s, max_hours * 60 * MINUTE
        self.channels, self.lateness = _plan_channels(plan), lateness_minutes

    def init(self, handle) -> None:
        values = [T.StructField(c, T.DoubleType()) for c in self.channels]
        time = T.StructField("us", T.LongType())
        self.handle = handle
        self.rows = handle.getListState("rows", T.StructType([time, *values]))
        self.segment = handle.getValueState(
            "segment", T.StructType([T.StructField("number", T.IntegerType())])
        )
        if self.lateness is not None:
            self.pending = handle.getMapState("pending", T.StructType([time]), T.StructType(values))
            self.timer = handle.getValueState("timer", T.StructType([T.StructField("ms", T.LongType())]))

    def _await(self, earliest: int) -> None:
        """Sees to a call once the watermark has passed the earliest waiting reading."""
        due = earliest // 1000 + 1
        if not self.timer.exists() or due < self.timer.get()[0]:
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        if self.lateness is None:
            import pandas as pd

            arrived = pd.concat(list(rows), ignore_index=True).sort_values("us", kind="stable")
            yield self._advance(key, arrived["us"].to_numpy(), arrived[self.channels].to_numpy(float))
            return
        # One bounded piece of the batch at a time goes to the state.
        for piece in rows:
            for us, *values in piece[["us", *self.channels]].itertuples(index=False):
                self.pending.updateValue((int(us),), tuple(None if v is None or v != v else float(v) for v in values))
            self._await(int(piece["us"].min()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready, earliest = [], None
        for (us,), values in self.pending.iterator():
            if us < passed:
                ready.append((us, *values))
            else:
                earliest = us if earliest is None else min(earliest, us)
        for us, *_ in ready:
            self.pending.removeKey((us,))
        if earliest is not None:
            self._await(earliest)
        if ready:
            table = np.array(sorted(ready, key=lambda r: r[0]), object)
            yield self._advance(key, table[:, 0].astype(np.int64), table[:, 1:].astype(float))

    def _advance(self, key, us: np.ndarray, values: np.ndarray):
        """Appends readings in the order given and returns their features."""
        import pandas as pd

        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        number = self.segment.get()[0] if self.segment.exists() else 0
        old = np.array([h[0] for h in held], np.int64)
        old_values = np.array([h[1:] for h in held], float).reshape(len(held), len(self.channels))
        step = np.diff(us, prepend=old[-1] if len(old) else us[0])
        reset = (step > self.s.gap_minutes * MINUTE) | (step <= 0)
        out = []
        edges = [0, *(np.flatnonzero(reset[1:]) + 1).tolist(), len(us)]
        for a, b in zip(edges, edges[1:]):
            if reset[a]:
                old, old_values, number = old[:0], old_values[:0], number + 1
            first = len(old)
            times, all_values = np.concatenate([old, us[a:b]]), np.concatenate([old_values, values[a:b]])
            columns = {c: all_values[:, i] for i, c in enumerate(self.channels)}
            # By time, not by rows: a sensor may report faster than its cadence.
            oldest = np.searchsorted(times, times[first:] - self.reach)
            part = pd.DataFrame(live_table(times, columns, first, self.plan, self.s.cadence_minutes))
            part.insert(0, "reset", reset[a:b])
            part.insert(0, "buffered", np.arange(first + 1, len(times) + 1) - oldest)
            part.insert(0, "segment", number)
            part.insert(0, "us", us[a:b])
            part.insert(0, "sensor_id", key[0])
            out.append(part)
            old, old_values = times[oldest[-1] :], all_values[oldest[-1] :]
        self.rows.put([(int(t), *(None if v != v else float(v) for v in row)) for t, row in zip(old, old_values)])
        self.segment.update((int(number),))
        return pd.concat(out, ignore_index=True).astype({"segment": "int32", "buffered": "int32"})

    def close(self) -> None:
        pass


def live_features(
    stream: DataFrame, plan: FeaturePlan, s: Series, max_hours: int = 30, lateness_minutes: int | None = None
) -> DataFrame:
    """Each arriving reading with its segment, buffer size and live features.

    With ``lateness_minutes`` a reading comes out once the watermark, that far behind the latest time
    seen, has passed it; readings that arrive later than that are dropped, and the result does not
    depend on the order of arrival or on micro-batches.  Without it rows of a micro-batch are taken
    in time order, and a reading that is not newer than the last one resets the buffer.
    """
    channels = _plan_channels(plan)
    names = [*plan.lag_names(), *plan.rolling_names()]
    kind = stream.schema["sensor_id"].dataType
    output = T.StructType(
        [
            T.StructField("sensor_id", kind),
            T.StructField("us", T.LongType()),
            T.StructField("segment", T.IntegerType()),
            T.StructField("buffered", T.IntegerType()),
            T.StructField("reset", T.BooleanType()),
            *[T.StructField(n, T.DoubleType()) for n in names],
        ]
    )
    if lateness_minutes is not None:
        stream = stream.withWatermark("ts", f"{lateness_minutes} minutes")
    rows = stream.select("sensor_id", "ts", micros("ts").alias("us"), *channels)
    live = rows.groupBy("sensor_id").transformWithStateInPandas(
        statefulProcessor=HistoryBuffer(plan, s, max_hours, lateness_minutes),
        outputStructType=output,
        outputMode="Append",
        timeMode="None" if lateness_minutes is None else "EventTime",
    )
    return live.withColumn("ts", F.timestamp_micros("us")).drop("us")


class AlertState(StatefulProcessor):
    """One alert key: active or not, its severity, last notification and birth."""

    def __init__(self, cooldown_minutes: int):
        self.cooldown = cooldown_minutes * MINUTE

    def init(self, handle) -> None:
        self.state = handle.getValueState(
            "alert",
            T.StructType(
                [
                    T.StructField("active", T.BooleanType()),
                    T.StructField("sev", T.IntegerType()),
                    T.StructField("pri", T.IntegerType()),
                    T.StructField("notified", T.LongType()),
                    T.StructField("created", T.LongType()),
                ]
            ),
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        arrived = pd.concat(list(rows), ignore_index=True).sort_values("us", kind="stable")
        current = self.state.get() if self.state.exists() else (False, -1, -1, 0, 0)
        active, sev, pri, notified, created = current
        out = []
        for us, present, new_sev, new_pri in arrived[
            ["us", "present", "sev", "pri"]
        ].itertuples(index=False):
            us = int(us)
            if not present:
                if active:
                    active = False
                    out.append((key[0], us, "resolved", False, created))
                continue
            new_sev, new_pri = int(new_sev), int(new_pri)
            if not active:
                active, created, notified, step, notify = True, us, us, "new", True
            else:
                raised = new_sev > sev or new_pri > pri
                step = "escalated" if raised else "updated"
                notify = raised or us - notified >= self.cooldown
                notified = us if notify else notified
            sev, pri = new_sev, new_pri
            out.append((key[0], us, step, notify, created))
        self.state.update((active, sev, pri, notified, created))
        yield pd.DataFrame(
            out, columns=["dedup_key", "us", "transition", "notification_recommended", "created_us"]
        )

    def close(self) -> None:
        pass


def live_alerts(stream: DataFrame, cooldown_minutes: int = 60) -> DataFrame:
    """The alert lifecycle on a stream of key evaluations.

    ``stream`` has ``dedup_key``, ``ts``, ``present``, ``sev`` and ``pri``.
    """
    from sensorloom.functions.text import alert_id

    output = T.StructType(
        [
            T.StructField("dedup_key", T.StringType()),
            T.StructField("us", T.LongType()),
            T.StructField("transition", T.StringType()),
            T.StructField("notification_recommended", T.BooleanType()),
            T.StructField("created_us", T.LongType()),
        ]
    )
    rows = stream.select(
        "dedup_key", micros("ts").alias("us"), "present",
        F.coalesce("sev", F.lit(-1)).alias("sev"), F.coalesce("pri", F.lit(-1)).alias("pri"),
    )
    folded = rows.groupBy("dedup_key").transformWithStateInPandas(
        statefulProcessor=AlertState(cooldown_minutes),
        outputStructType=output,
        outputMode="Append",
        timeMode="None",
    )
    born = F.timestamp_micros("created_us")
    text = F.date_format(born, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return folded.select(
        "dedup_key",
        F.timestamp_micros("us").alias("ts"),
        alert_id(F.col("dedup_key"), text).alias("id"),
        born.alias("created_at"),
        "transition",
        "notification_recommended",
    )
