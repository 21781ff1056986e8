"""Departure boards: run encoding, expansion on a day, next departures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.constants import BOARD_GRACE_S, BOARD_LIMIT, BOARD_WINDOW_S
from headway.functions.rules import runs_on
from headway.functions.time import wall_clock


def encode_runs(departures: DataFrame, keys: list[str], second: str) -> DataFrame:
    """``first`` and ``gaps``: the times of a key in order, each as the step from the one before. A board's key is one service at one stop."""
    times = departures.groupBy(*keys).agg(F.array_sort(F.collect_list(second)).alias("t"))
    gaps = F.zip_with(F.slice("t", F.lit(2), F.size("t")), F.slice("t", F.lit(1), F.size("t") - 1), lambda b, a: b - a)
    return times.select(*keys, F.get("t", F.lit(0)).alias("first"), gaps.alias("gaps"))


def decode_runs(runs: DataFrame, keys: list[str], second: str) -> DataFrame:
    """One row per departure. The steps are added up inside the run's own row."""
    start = F.struct(F.col("first").cast("long").alias("at"), F.array(F.col("first").cast("long")).alias("all"))
    added = F.aggregate("gaps", start, lambda s, gap: F.struct((s["at"] + gap).alias("at"), F.concat(s["all"], F.array(s["at"] + gap)).alias("all")))
    return runs.select(*keys, F.explode(added["all"]).alias(second))


def islands_of_rules(departures: DataFrame, keys: list[str], second: str, same: list[str]) -> DataFrame:
    """Runs of consecutive departures with the same rule and timing, as the published board keeps them."""
    w = W.partitionBy(*keys).orderBy(second, *same)
    changed = F.row_number().over(w) == 1
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    marked = departures.withColumn("run", F.sum(F.when(changed, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return encode_runs(marked, [*keys, "run", *same], second)


def board(patterns: DataFrame, stops: DataFrame, departures: DataFrame) -> DataFrame:
    """Scheduled seconds of every departure at every stop but a pattern's last.

    patterns: pattern_id; stops: pattern_id, position, stop, seconds (the pattern's own, may be null); departures: pattern_id,
    origin_second, rule, timing (array of seconds by position, may be null). A stop without either time is left out.
    """
    last = W.partitionBy("pattern_id")
    calls = stops.withColumn("last", F.max("position").over(last)).filter("position < last").drop("last")
    rows = patterns.select("pattern_id").join(calls, "pattern_id").join(departures, "pattern_id")
    offset = F.coalesce(F.get("timing", F.col("position")), F.col("seconds"))
    return rows.withColumn("second", F.col("origin_second") + offset).filter("second IS NOT NULL").select("stop", "pattern_id", "position", "rule", "second")


def next_departures(board: DataFrame, keys: list[str], second: str, tie: list[str], now_second: int, limit: int = BOARD_LIMIT) -> DataFrame:
    """The next departures of each key around a second of the day; both ends of the window belong."""
    near = board.filter(F.col(second).between(now_second - BOARD_GRACE_S, now_second + BOARD_WINDOW_S))
    order = W.partitionBy(*keys).orderBy(second, *tie)
    return near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def departures_at(board: DataFrame, rules: Column, now: Column, limit: int = BOARD_LIMIT) -> DataFrame:
    """Departures around an instant over yesterday's (from 24:00 on), today's and tomorrow's service days, by instant.

    A row whose rules are unknown stays, with ``day_known`` false.
    """
    day = F.to_date(F.from_utc_timestamp(now, "Europe/London"))
    days = F.array(F.date_sub(day, 1), day, F.date_add(day, 1))
    rows = board.withColumn("service_day", F.explode(days)).filter((F.col("service_day") >= day) | (F.col("second") >= 86400))
    runs = runs_on(rules, F.col("service_day"))
    rows = rows.withColumns({"day_known": runs.isNotNull(), "departs": wall_clock(F.col("service_day"), F.col("second"))}).filter(F.coalesce(runs, F.lit(True)))
    ahead = F.unix_seconds("departs") - F.unix_seconds(now)
    order = W.partitionBy("stop").orderBy("departs", "pattern_id")
    return rows.filter(ahead.between(-BOARD_GRACE_S, BOARD_WINDOW_S)).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
