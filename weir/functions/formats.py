"""Numbers as the screens show them: shares, sizes, times left and past, severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB")


def percent(part: Column, whole: Column) -> Column:
    """A share with one decimal, halves away from zero; ``0%`` of nothing."""
    return F.when(whole <= 0, "0%").otherwise(F.format_string("%.1f%%", F.round(part * F.lit(100.0) / whole, 1)))


def tenths(x: Column) -> Column:
    """A number with one decimal at most."""
    near = F.round(x, 1)
    return F.when(near == F.floor(near), F.floor(near).cast("string")).otherwise(F.format_string("%.1f", near))


def byte_size(n: Column) -> Column:
    """Bytes in the largest unit, up to GB, of which there is at least one."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate(UNITS[1:], 1):
        shown = F.concat(tenths(n / F.lit(float(1024**k))), F.lit(f" {unit}"))
        out = out.otherwise(shown) if k == len(UNITS) - 1 else out.when(n < 1024 ** (k + 1), shown)
    return F.when(n.isNotNull(), out)


def _seconds(ms: Column) -> Column:
    """Seconds begun, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(ms / 1000)).cast("string")


def remaining(ms: Column) -> Column:
    """Time left: minutes and seconds from a minute on, else seconds begun; ``0s`` if it is over."""
    minutes, seconds = F.floor(ms / 60000), F.floor(ms / 1000) % 60
    return F.when(ms <= 0, "0s").when(ms >= 60000, F.concat(minutes.cast("string"), F.lit("m "), seconds.cast("string"), F.lit("s"))).otherwise(F.concat(_seconds(ms), F.lit("s")))


def lock_age(ms: Column) -> Column:
    """How long ago a lock was taken."""
    return F.when(ms.isNull(), "lock time n/a").when(ms >= 60000, F.concat(F.lit("locked "), F.floor(ms / 60000).cast("string"), F.lit("m ago"))).otherwise(F.concat(F.lit("locked "), _seconds(ms), F.lit("s ago")))


def short_severity(level: Column) -> Column:
    """Three letters of a level: its first ones, but for those that are shortened otherwise."""
    up = F.upper(level)
    return F.when(up == "WARNING", "WRN").when(up == "INFORMATION", "INF").when(up == "DEBUG", "DBG").otherwise(F.left(up, F.lit(3)))
