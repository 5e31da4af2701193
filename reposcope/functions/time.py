"""Time helpers: explicit reference times, never the wall clock."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_datetime(value) -> datetime:
    """Accept datetime, date or ISO text; return a naive UTC datetime."""
    if isinstance(value, datetime):
        return value.replace(tzinfo=None) if value.tzinfo is None else \
            (value - value.utcoffset()).replace(tzinfo=None)
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    text = str(value).strip().replace("T", " ").rstrip("Z")
    return datetime.fromisoformat(text)


def ts_text(value) -> str:
    return to_datetime(value).strftime("%Y-%m-%d %H:%M:%S.%f")


def ts_lit(value, like: T.DataType | None = None) -> Column:
    """Timestamp literal typed like the column it is compared with.

    Built from text so the Python process time zone plays no part.
    """
    target = "timestamp_ntz" if isinstance(like, T.TimestampNTZType) else "timestamp"
    return F.lit(ts_text(value)).cast(target)


def col_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def minus_days(as_of, days: float) -> datetime:
    return to_datetime(as_of) - timedelta(days=days)


def parse_duration(text: str) -> timedelta:
    """Duration text as configured for the recompute jobs.

    ``"N months"`` counts 30 days per month, ``"N years"`` 365 days per
    year; anything else is a Go-style duration such as ``1h30m`` or
    ``720h``.
    """
    text = text.strip()
    m = re.fullmatch(r"(-?\d+) months", text)
    if m:
        return timedelta(days=30 * int(m.group(1)))
    m = re.fullmatch(r"(-?\d+) years", text)
    if m:
        return timedelta(days=365 * int(m.group(1)))
    units = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|h|m|s)", text)
    if not parts or "".join(a + b for a, b in parts) != text.lstrip("-+"):
        raise ValueError(f"invalid duration: {text!r}")
    seconds = sum(float(a) * units[b] for a, b in parts)
    return timedelta(seconds=-seconds if text.startswith("-") else seconds)


#: Microseconds of each unit of a duration text.
UNIT_MICROS = {"ns": 1e-3, "us": 1.0, "µs": 1.0, "ms": 1e3, "s": 1e6, "m": 60e6, "h": 3600e6, "months": 30 * 86400e6, "years": 365 * 86400e6}
_PART = r"(\d+(?:\.\d+)?)(ns|us|µs|ms|h|m|s)"


def duration_micros(text: Column) -> Column:
    """``parse_duration`` of a column, in microseconds; null for null and invalid texts."""
    t = F.trim(text)
    calendar = t.rlike(r"^-?\d+ (months|years)$")
    clock = t.rlike(f"^[-+]?(?:{_PART})+$")
    micros = F.create_map(*[F.lit(x) for pair in UNIT_MICROS.items() for x in pair])
    of_calendar = F.split_part(t, F.lit(" "), F.lit(1)).try_cast("double") * micros[F.split_part(t, F.lit(" "), F.lit(2))]
    parts = F.zip_with(F.regexp_extract_all(t, F.lit(_PART), F.lit(1)), F.regexp_extract_all(t, F.lit(_PART), F.lit(2)),
                       lambda n, unit: n.try_cast("double") * micros[unit])
    of_clock = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) * F.when(t.startswith("-"), -1).otherwise(1)
    return F.round(F.when(calendar, of_calendar).when(clock, of_clock)).cast("bigint")


def month_key(ts: Column) -> Column:
    """``yyyyMM`` partition key of a timestamp or date."""
    return F.date_format(ts, "yyyyMM")
