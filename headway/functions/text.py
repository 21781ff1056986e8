"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from headway.constants import COMPASS, GENERIC_PLACE_WORDS


def place_words(name: Column) -> Column:
    """Lower-case words of a place name without the generic ones, joined by single spaces."""
    words = F.split(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), " +")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*GENERIC_PLACE_WORDS)), " ")


def same_place(a: Column, b: Column) -> Column:
    """Equal, or one within the other, after normalising; never where either is empty."""
    x, y = place_words(a), place_words(b)
    return F.coalesce((x != "") & (y != "") & (x.contains(y) | y.contains(x)), F.lit(False))


def natural_key(line: Column) -> Column:
    """Sorts lines by their number, then by what follows; lines without one come last."""
    digits = F.regexp_extract(line, r"^([0-9]+)", 1)
    return F.struct((digits == "").alias("late"), F.expr("0").cast("bigint") + F.coalesce(F.nullif(digits, F.lit("")).cast("bigint"), F.lit(0)), F.upper(line))


def redacted(url: Column) -> Column:
    """A URL whose key-like query values are hidden."""
    return F.regexp_replace(url, r"(?i)([?&](?:api_?key|key|token|secret|password)=)[^&#]*", "$1REDACTED")


def duration_words(seconds: Column) -> Column:
    """``45 s``, ``12 min``, ``1 h 05 min``."""
    minutes = F.floor(seconds / 60)
    return (
        F.when(seconds < 60, F.concat(seconds.cast("int").cast("string"), F.lit(" s")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min")))
        .otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h "), F.lpad((minutes % 60).cast("string"), 2, "0"), F.lit(" min")))
    )


def compass(degrees: Column) -> Column:
    at = (F.floor((F.pmod(degrees, F.lit(360.0)) + 22.5) / 45) % 8).cast("int")
    return F.when(degrees.isNotNull(), F.element_at(F.array(*[F.lit(c) for c in COMPASS]), at + 1))


def day_runs(days: Column) -> Column:
    """Weekdays 0-6 as words, runs of three or more joined: ``Mon–Fri, Sun``."""
    names = F.array(*[F.lit(d) for d in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")])
    has = lambda d: F.array_contains(days, d)
    starts = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda d: has(d) & ~F.coalesce(has(d - 1), F.lit(False)))

    def run(s):
        end = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(6)), lambda e: (e >= s) & F.forall(F.sequence(s, F.greatest(s, e)), lambda k: has(k))))
        first, last = F.get(names, s), F.get(names, end)
        return F.when(end == s, first).when(end == s + 1, F.concat(first, F.lit(", "), last)).otherwise(F.concat(first, F.lit("–"), last))

    return F.array_join(F.transform(starts, run), ", ")
