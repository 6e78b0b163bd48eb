"""Small text and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_horizon(value: Column) -> Column:
    """``1``, ``1hr``, ``1 hour`` and ``1 hours`` to ``1h``; other text lower-cased."""
    text = F.lower(F.trim(value.cast("string")))
    digits = F.regexp_extract(text, r"^([136])(?:h|hr| hours?)?$", 1)
    return F.when(digits != "", F.concat(digits, F.lit("h"))).otherwise(text)


def same_text(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def strip_prefix(value: Column, prefix: str) -> Column:
    return F.when(value.startswith(prefix), F.substring(value, len(prefix) + 1, 1 << 20)).otherwise(
        value
    )


# UTF-8 text read in a one-byte encoding, and its plain replacement.
MOJIBAKE = {
    "\u00e2\u20ac\u201d": "-",
    "\u00e2\u2020\u201d": "<->",
    "\u00e2\u2020\u2019": "->",
}


def repair_text(value: Column) -> Column:
    for wrong, right in MOJIBAKE.items():
        value = F.replace(value, F.lit(wrong), F.lit(right))
    return value


def dedup_key(sensor: Column, kind: Column, horizon: Column, channel: Column) -> Column:
    """``sensor:type[:horizon][:channel]``; absent parts are skipped."""
    return F.concat_ws(":", sensor.cast("string"), kind, horizon, channel)


def alert_id(key: Column, created_at: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", key, created_at), 256)
    return F.concat(F.lit("alert_"), F.substring(digest, 1, 16))
