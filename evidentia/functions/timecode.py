"""Subtitle times and media offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIME = r"(\d{2}):(\d{2}):(\d{2})[,.](\d{3})"


def to_ms(time: Column) -> Column:
    """HH:MM:SS,mmm to milliseconds; null if it does not parse (two hour digits exactly)."""
    part = lambda i: F.regexp_extract(time, f"^{TIME}$", i).cast("long")
    return F.when(time.rlike(f"^{TIME}$"), ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4))


def from_ms(ms: Column) -> Column:
    whole = lambda n: F.floor(ms / n).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", whole(3_600_000), whole(60_000) % 60, whole(1000) % 60, ms.cast("long") % 1000)


def seconds_to_ms(seconds: Column) -> Column:
    """Rounded half to even."""
    return F.rint(seconds * 1000).cast("long")


def stamp_ms(ts: Column) -> Column:
    """Milliseconds of a timestamp with or without zone (in the session's zone, UTC)."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1000).cast("long")
