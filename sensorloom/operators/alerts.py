"""Alert conditions and the alert lifecycle.

The lifecycle of one alert key is a fold over its evaluations.  Everything that
only depends on the previous evaluation (new, escalated, resolved) comes from
windows over time blocks.  The cooldown depends on the last notification; it is
followed by doubling pointers from each row to the one that would notify next.  A
key that holds a large share of the rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.text import alert_id, dedup_key
from sensorloom.operators.series import (
    MINUTE, Series, frame_window, home_rows, islands, time_halo,
)
from sensorloom.sources.staging import stage

COOLDOWN_MINUTES = 60

# Fixed values: (severity, priority) by risk level and horizon, and by alert type.
HIGH_PM_POLICY = {
    "Elevated": {"1h": ("warning", "high"), "3h": ("warning", "medium"), "6h": ("warning", "medium")},
    "High": {"1h": ("critical", "urgent"), "3h": ("warning", "high"), "6h": ("warning", "high")},
}
STATIC_POLICY = {
    "who_exceedance": ("warning", "medium"),
    "sensor_offline": ("critical", "urgent"),
    "possible_drift": ("warning", "high"),
}
HEALTH_POLICY = {
    "info": ("info", "low"), "warning": ("warning", "high"), "critical": ("critical", "urgent"),
}
CATEGORIES = {
    "high_pm_risk": "forecast", "who_exceedance": "health_guideline",
    "sensor_offline": "sensor_health", "possible_drift": "sensor_health",
    "suspicious_reading": "sensor_health",
}
SEVERITIES = ["info", "warning", "critical"]
PRIORITIES = ["low", "medium", "high", "urgent"]
ABOVE = "Above WHO Guideline"

CONDITION_COLUMNS = [
    "sensor_id", "ts", "source", "type", "severity", "priority", "horizon", "channel",
    "condition_level", "evidence",
]


def _rank(value: Column, order: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in order]), value).cast("int") - 1


def _policy(pairs: list[tuple[Column, tuple[str, str]]]) -> Column:
    out = F.lit(None).cast("struct<severity:string,priority:string>")
    for cond, (severity, priority) in pairs:
        out = F.when(
            cond, F.struct(F.lit(severity).alias("severity"), F.lit(priority).alias("priority"))
        ).otherwise(out)
    return out


def forecast_conditions(forecasts: DataFrame) -> DataFrame:
    """Risk and guideline conditions; ``forecasts`` has one row per sensor, time, horizon."""
    level, horizon = F.col("risk_level"), F.col("horizon")
    risk = _policy(
        [
            ((level == name) & (horizon == h), value)
            for name, by_horizon in HIGH_PM_POLICY.items()
            for h, value in by_horizon.items()
        ]
    )
    above = _policy([(F.col("who_status") == ABOVE, STATIC_POLICY["who_exceedance"])])

    def option(kind: str, policy: Column, level: Column, evidence: dict[str, Column]) -> Column:
        pairs = [x for k, v in evidence.items() for x in (F.lit(k), v.cast("double"))]
        return F.when(
            policy.isNotNull(),
            F.struct(
                F.lit(kind).alias("type"),
                policy["severity"].alias("severity"),
                policy["priority"].alias("priority"),
                level.alias("condition_level"),
                F.create_map(*pairs).alias("evidence"),
            ),
        )

    found = F.array_compact(
        F.array(
            option(
                "high_pm_risk", risk, level,
                {
                    "forecast_pm25": F.col("forecast"),
                    "safety_upper_estimate": F.col("safety_upper_estimate"),
                    "safety_margin": F.col("safety_margin"),
                },
            ),
            option(
                "who_exceedance", above, F.col("who_status"),
                {
                    "predicted_24h_average": F.col("future_24h_average"),
                    "ratio_to_guideline": F.col("ratio_to_guideline"),
                },
            ),
        )
    )
    return forecasts.select(
        "sensor_id", "ts", "horizon", F.explode(found).alias("_c")
    ).select(
        "sensor_id", "ts", F.col("horizon").alias("source"), "_c.type", "_c.severity",
        "_c.priority", "horizon", F.lit("pm25").alias("channel"), "_c.condition_level",
        "_c.evidence",
    )


def health_conditions(issues: DataFrame) -> DataFrame:
    """Offline, drift and suspicious-reading conditions from health issues."""
    kind, severity = F.col("type"), F.col("severity")
    alert = (
        F.when(kind == "offline", "sensor_offline")
        .when(kind == "possible_drift", "possible_drift")
        .when(kind == "suspicious_value", "suspicious_reading")
    )
    policy = _policy(
        [
            *[((kind == "suspicious_value") & (severity == s), p) for s, p in HEALTH_POLICY.items()],
            (kind == "possible_drift", STATIC_POLICY["possible_drift"]),
            (kind == "offline", STATIC_POLICY["sensor_offline"]),
        ]
    )
    level = (
        F.when(kind == "offline", "Offline")
        .when(kind == "possible_drift", "possible_drift")
        .otherwise(severity)
    )
    return issues.where(kind.isin("offline", "possible_drift", "suspicious_value")).select(
        "sensor_id", "ts", F.lit("health").alias("source"), alert.alias("type"),
        policy["severity"].alias("severity"), policy["priority"].alias("priority"),
        F.lit(None).cast("string").alias("horizon"), "channel", level.alias("condition_level"),
        "evidence",
    )


def alert_conditions(forecasts: DataFrame, issues: DataFrame) -> DataFrame:
    """All conditions with their key, category and ranks."""
    rows = forecast_conditions(forecasts).unionByName(health_conditions(issues))
    category = F.element_at(
        F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), F.col("type")
    )
    return rows.select(
        dedup_key(F.col("sensor_id"), F.col("type"), F.col("horizon"), F.col("channel")).alias(
            "dedup_key"
        ),
        *CONDITION_COLUMNS,
        category.alias("category"),
        category.isin("forecast", "health_guideline").alias("is_early_warning"),
        _rank(F.col("severity"), SEVERITIES).alias("severity_rank"),
        _rank(F.col("priority"), PRIORITIES).alias("priority_rank"),
    )


def forecast_health_merge(forecasts: DataFrame, health: DataFrame) -> DataFrame:
    """Keys of either side with what each one supplies."""
    left = forecasts.groupBy("sensor_id", "ts").agg(
        F.sort_array(F.collect_set("horizon")).alias("horizons")
    )
    right = health.select("sensor_id", "ts", F.lit(True).alias("has_health")).distinct()
    return left.join(right, ["sensor_id", "ts"], "full_outer").select(
        "sensor_id", "ts", "horizons", F.coalesce("has_health", F.lit(False)).alias("has_health")
    )


def evaluations(forecasts: DataFrame, health: DataFrame) -> DataFrame:
    """What was supplied when: a row per sensor, time and source (horizon or health)."""
    return (
        forecasts.select("sensor_id", "ts", F.col("horizon").alias("source"))
        .unionByName(health.select("sensor_id", "ts", F.lit("health").alias("source")))
        .distinct()
    )


def key_evaluations(conditions: DataFrame, supplied: DataFrame) -> DataFrame:
    """Each key's evaluations, present or not; only supplied sources can clear a key."""
    keys = conditions.select("dedup_key", "sensor_id", "source").distinct()
    # A sensor has a handful of keys per source, fixed by types and channels.
    slots = supplied.join(keys, ["sensor_id", "source"]).select("dedup_key", "ts")
    details = [c for c in conditions.columns if c not in ("dedup_key", "ts")]
    # One condition per key and time; the most severe wins if a source repeats it.
    best = conditions.groupBy("dedup_key", "ts").agg(
        F.max_by(F.struct(*details), F.struct("severity_rank", "priority_rank")).alias("_c")
    )
    return slots.join(best, ["dedup_key", "ts"], "left").select(
        "dedup_key", "ts", F.col("_c").isNotNull().alias("present"), "_c"
    )


ALERTS = Series(keys=("dedup_key",), ts="ts")


def _mark(s: Series, rows: DataFrame, cooldown: int) -> DataFrame:
    """Transitions that follow from the previous evaluation, and the episode number."""
    flat = rows.select(
        "dedup_key", "ts", "present",
        F.col("_c.severity_rank").alias("sev"), F.col("_c.priority_rank").alias("pri"), "_c",
    )
    opens = islands(
        flat, s, ["present", "sev", "pri"],
        lambda p, c: c["present"] & ~p["present"], "episode",
    )
    prev = F.col("_prev")
    was = F.coalesce(prev["present"], F.lit(False))
    raised = F.coalesce(
        (F.col("sev") > prev["sev"]) | (F.col("pri") > prev["pri"]), F.lit(False)
    )
    overdue = F.col("_us") - prev["_us"] >= cooldown * MINUTE
    change = (
        F.when(F.col("present") & ~was, "new")
        .when(~F.col("present") & was, "resolved")
        .when(F.col("present") & raised, "escalated")
        .when(F.col("present"), "updated")
    )
    return (
        opens.withColumn("transition", change)
        .where(F.col("transition").isNotNull())
        .withColumn(
            "_certain",
            F.col("transition").isin("new", "escalated")
            | ((F.col("transition") == "updated") & F.coalesce(overdue, F.lit(False))),
        )
        .drop("_prev")
    )


def notifications(marked: DataFrame, s: Series, cooldown: int) -> DataFrame:
    """Add ``notify`` to the rows where the alert is active.

    A certain row notifies whatever came before, so each opens a stretch of its own; in a stretch the
    next row to notify is the first one a cooldown after the last.  Every row points to the row that
    would follow it.  Pointers are doubled: after k rounds a row points 2**k notifications ahead, and
    the rows within 2**k of a certain one are reached, so a key of any length takes a logarithm of
    rounds and no task of its own.
    """
    span = cooldown * MINUTE
    active = marked.where("present").select("dedup_key", "ts", "_certain")
    stretches = islands(active, s, ["_certain"], lambda p, c: c["_certain"], "stretch").drop("_prev", "_blk")
    # Rows of a stretch are less than a cooldown apart, or the later one would be certain.
    spread = time_halo(stretches, s, ahead_minutes=2 * cooldown)
    following = F.min("_us").over(frame_window(s, "stretch").rangeBetween(span, 2 * span))
    linked = stage(home_rows(spread.withColumn("to", following)))
    lengths = linked.groupBy("dedup_key", "stretch").agg((F.max("_us") - F.min("_us")).alias("_l"))
    longest = lengths.agg(F.max("_l")).first()[0] or 0
    state = linked.select("dedup_key", "ts", "_us", "to", F.col("_certain").alias("notify"))
    for _ in range((longest // span).bit_length()):
        reached = state.where("notify AND to IS NOT NULL").select(
            "dedup_key", F.col("to").alias("_us"), F.lit(True).alias("_hop")
        )
        onward = state.where("to IS NOT NULL").select("dedup_key", F.col("_us").alias("to"), F.col("to").alias("_next"))
        state = stage(
            state.join(onward, ["dedup_key", "to"], "left")
            .join(reached, ["dedup_key", "_us"], "left")
            .select(
                "dedup_key", "ts", "_us", F.col("_next").alias("to"),
                (F.col("notify") | F.coalesce("_hop", F.lit(False))).alias("notify"),
            )
        )
    return state.select("dedup_key", "ts", "notify")


def alert_lifecycle(
    conditions: DataFrame,
    supplied: DataFrame,
    cooldown: int = COOLDOWN_MINUTES,
    s: Series = ALERTS,
) -> DataFrame:
    """Every evaluation that touches an alert: transition, notification, identity.

    ``created_at`` and the id are those of the episode, so a key that comes back
    after it was resolved gets a new id.
    """
    # Read for the block summaries and again for the rows themselves.
    judged = stage(key_evaluations(conditions, supplied))
    # Read by the block maps, the folds and the final join.
    marked = stage(_mark(s, judged, cooldown))
    notify = notifications(marked, s, cooldown)
    born = marked.where(F.col("transition") == "new").select(
        "dedup_key", "episode", F.col("ts").alias("created_at")
    )
    text = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return (
        marked.join(notify, ["dedup_key", "ts"], "left")
        .join(born, ["dedup_key", "episode"])
        .select(
            "dedup_key",
            "ts",
            alert_id(F.col("dedup_key"), text).alias("id"),
            "created_at",
            "transition",
            F.when(F.col("transition") == "resolved", F.lit(False))
            .otherwise(F.col("notify"))
            .alias("notification_recommended"),
            "_c.sensor_id", "_c.type", "_c.category", "_c.severity", "_c.priority", "_c.horizon",
            "_c.channel", "_c.condition_level",
        )
    )


def alert_table(lifecycle: DataFrame) -> DataFrame:
    """One row per alert with its latest state."""
    raised = F.when(F.col("transition") != "resolved", F.col("ts"))
    latest = F.struct("severity", "priority")
    active = F.max_by("transition", "ts") != "resolved"
    return lifecycle.groupBy("id", "dedup_key", "created_at").agg(
        F.max("sensor_id").alias("sensor_id"),
        F.max("type").alias("type"),
        F.max("ts").alias("updated_at"),
        F.when(active, "active").otherwise("resolved").alias("status"),
        F.max_by(latest, raised).alias("_l"),
        F.count_if(F.col("transition") == "escalated").alias("escalations"),
        F.count_if(
            F.col("transition").isin("updated", "escalated") & ~F.col("notification_recommended")
        ).alias("suppressed"),
        F.count_if(F.col("notification_recommended")).alias("notifications"),
    ).select("*", "_l.severity", "_l.priority").drop("_l")


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Counts by severity, type, sensor and status in one pass over the alerts."""
    options = F.array(
        *[
            F.struct(F.lit(name).alias("dimension"), F.col(name).cast("string").alias("value"))
            for name in ("severity", "type", "sensor_id", "status")
        ]
    )
    rows = alerts.withColumn("_d", F.explode(options))
    return rows.groupBy("_d.dimension", "_d.value").agg(
        F.count(F.lit(1)).alias("alerts"),
        F.sum("suppressed").alias("suppressed"),
        F.sum("escalations").alias("escalations"),
    )
