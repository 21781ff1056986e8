"""Instants, service days and times of day as column expressions (the session's zone is UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from headway.constants import LONDON

OFFSET = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"


def instant(text: Column) -> Column:
    """ISO text with a mandatory offset; null where it has none or cannot be read."""
    return F.when(text.rlike(OFFSET), F.try_to_timestamp(text))


def has_offset(text: Column) -> Column:
    return F.coalesce(text.rlike(OFFSET), F.lit(False))


def service_day(ts: Column) -> Column:
    """The London date of an instant."""
    return F.to_date(F.from_utc_timestamp(ts, LONDON))


def clock_seconds(text: Column) -> Column:
    """``HH:MM`` or ``HH:MM:SS`` to seconds; hours may pass 24."""
    part = lambda k: F.coalesce(F.regexp_extract(text, r"^(\d{1,2}):(\d{2})(?::(\d{2}))?$", k).try_cast("int"), F.lit(0))
    return F.when(text.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$"), part(1) * 3600 + part(2) * 60 + part(3))


def duration_seconds(text: Column) -> Column:
    """ISO 8601 ``PnDTnHnMnS`` to seconds, rounded half to even; ``PT`` alone is null."""
    form = r"^P(?=.*\d)(?:\d+D)?(?:T(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?)?$"
    after = lambda c, mark: F.substring_index(c, mark, -1)

    def number(mark: str, *before: str) -> Column:
        """The number that stands before ``mark``, after all marks that may come earlier; 0 where it is not said."""
        c = F.substring_index(text, mark, 1)
        for m in before:
            c = after(c, m)
        return F.when(text.contains(mark), F.coalesce(c.try_cast("double"), F.lit(0.0))).otherwise(0.0)

    # the form is matched once; a text of that form has each mark once at most, and in this order
    total = number("D", "P") * 86400 + number("H", "T") * 3600 + number("M", "T", "H") * 60 + number("S", "T", "H", "M")
    return F.when(text.rlike(form), F.bround(total).cast("int"))


def wall_clock(day: Column, seconds: Column, zone: str = LONDON) -> Column:
    """The instant at which a clock on that service day shows so many seconds after midnight.

    Seconds are added to the wall clock, not to midnight's instant. In the repeated autumn hour the later instant is meant.
    """
    wall = F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + seconds.cast("long"))
    early = F.to_utc_timestamp(wall, zone)
    later = F.timestamp_seconds(F.unix_seconds(early) + 3600)
    return F.when(F.from_utc_timestamp(later, zone) == wall, later).otherwise(early)


def days_met(now: Column) -> Column:
    """Service days that a search at ``now`` meets: yesterday before 04:00, tomorrow from 21:00."""
    local = F.from_utc_timestamp(now, LONDON)
    day, hour = F.to_date(local), F.hour(local)
    return F.array_compact(F.array(F.when(hour < 4, F.date_sub(day, 1)), day, F.when(hour >= 21, F.date_add(day, 1))))
