"""When vehicles pass the stops of their pattern, read from reports along its road.

A journey's reports are one row (an array in time order, a few hundred at most) and meet their track, the road of the
pattern, in one join. Chaining one projection to the next is sequential, so it runs in numpy on Arrow batches of journeys;
everything after it is windows and array expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.constants import BACKWARDS_M, MIN_REPORTS, OFF_ROAD_M, PASSAGE_GAP_S, SPEED_WINDOW_S
from headway.functions.geo import Track

JUMP_BACK_M, JUMP_M_S, MAX_M_S, LEAST_SPAN_S, LEAST_M_S = 25, 30.0, 20.0, 20, 0.5


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for k, (reports, lats, lons) in enumerate(zip(batch.column("reports").to_pylist(), batch.column("lats").to_pylist(), batch.column("lons").to_pylist(), strict=True)):
            track, near = Track(lats, lons), None
            for r in reports:
                s, off = track.project_near(r["lat"], r["lon"], near)
                on = off <= OFF_ROAD_M
                near = s if on else near
                for column, value in zip(out, (k, r["t"], s, off, on), strict=True):
                    column.append(value)
        at = pa.array(out[0], pa.int64())
        columns = [batch.column("journey_id").take(at), batch.column("pattern_id").take(at), *(pa.array(c, kind) for c, kind in zip(out[1:], (pa.int64(), pa.float64(), pa.float64(), pa.bool_()), strict=True))]
        yield pa.RecordBatch.from_arrays(columns, names=["journey_id", "pattern_id", "t", "s", "off_m", "on_road"])


def placed(reports: DataFrame, tracks: DataFrame) -> DataFrame:
    """journey_id, pattern_id, t (ms), s (metres along the road), off_m, on_road of every report of a journey with enough of them.

    reports: journey_id, pattern_id, t, lat, lon. tracks: pattern_id, lats, lons. Each search starts where the last report on the
    road was found. Journeys with fewer than ``MIN_REPORTS`` reports, in all or on the road, are left out.
    """
    rows = reports.groupBy("journey_id", "pattern_id").agg(F.array_sort(F.collect_list(F.struct("t", "lat", "lon"))).alias("reports"))
    rows = rows.filter(F.size("reports") >= MIN_REPORTS).join(tracks.select("pattern_id", "lats", "lons"), "pattern_id")
    kinds = f"journey_id {dict(reports.dtypes)['journey_id']}, pattern_id {dict(reports.dtypes)['pattern_id']}, t long, s double, off_m double, on_road boolean"
    found = rows.select("journey_id", "pattern_id", "reports", "lats", "lons").mapInArrow(_placed, kinds)
    per = W.partitionBy("journey_id", "pattern_id")
    return found.withColumn("n", F.sum(F.col("on_road").cast("int")).over(per)).filter(F.col("n") >= MIN_REPORTS).drop("n")


def passages(along: DataFrame, stops: DataFrame) -> DataFrame:
    """Passages of stops between two consecutive reports on the road, at the linearly interpolated time.

    along: journey_id, pattern_id, t, s. stops: pattern_id, stop_index, stop, offset_m (null: not on the road). A step back by more
    than ``BACKWARDS_M`` is a jump and passes nothing. Only first visits within a gap of ``PASSAGE_GAP_S`` are scoreable.
    """
    order = W.partitionBy("journey_id", "pattern_id").orderBy("t", "s")
    steps = along.select("journey_id", "pattern_id", F.lag("t").over(order).alias("t0"), F.lag("s").over(order).alias("s0"), F.col("t").alias("t1"), F.col("s").alias("s1"))
    steps = steps.filter((F.col("s1") >= F.col("s0") - BACKWARDS_M) & (F.col("s0") < F.col("s1")))
    held = stops.filter("offset_m IS NOT NULL").groupBy("pattern_id").agg(F.array_sort(F.collect_list(F.struct("offset_m", "stop_index", "stop"))).alias("held"))
    met = steps.join(held, "pattern_id")
    met = met.select("*", F.explode(F.filter("held", lambda x: (x["offset_m"] > F.col("s0")) & (x["offset_m"] <= F.col("s1")))).alias("x"))
    at = F.col("t0") + (F.col("x.offset_m") - F.col("s0")) / (F.col("s1") - F.col("s0")) * (F.col("t1") - F.col("t0"))
    gap = (F.col("t1") - F.col("t0")) / 1000
    visits = W.partitionBy("journey_id", "pattern_id", "stop_index").orderBy("t0", "t1")
    out = met.select("journey_id", "pattern_id", F.col("x.stop_index").alias("stop_index"), F.col("x.stop").alias("stop"), F.col("x.offset_m").alias("offset_m"), "t0", "t1", "s0", "s1", F.floor(at).alias("passed_ms"), gap.alias("gap_s"))
    out = out.withColumns({"uncertainty_s": F.col("gap_s") / 2, "visit": F.row_number().over(visits)})
    return out.withColumn("scoreable", (F.col("gap_s") <= PASSAGE_GAP_S) & (F.col("visit") == 1))


def passage_counts(found: DataFrame, keys: list[str]) -> DataFrame:
    """How many passages there are, how many are scoreable, repeat visits, or bounded by too long a gap."""
    count = lambda c: F.count(F.when(c, 1))
    return found.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("passages"), count(F.col("scoreable")).alias("scoreable"), count(F.col("visit") > 1).alias("repeat_visits"), count(F.col("gap_s") > PASSAGE_GAP_S).alias("unbounded")
    )


def with_speed(along: DataFrame, keys: list[str], window_s: int = SPEED_WINDOW_S) -> DataFrame:
    """``along`` (t in ms, s in metres) with ``speed``, metres a second since the earliest report of the last ``window_s`` after the latest jump.

    A jump is a step that takes no time, goes back by more than 25 m or is faster than 30 m/s. Null where that is less than 20 s.
    """
    order = W.partitionBy(*keys).orderBy("t", "s")
    dt, ds = (F.col("t") - F.lag("t").over(order)) / 1000, F.col("s") - F.lag("s").over(order)
    jump = F.coalesce((dt <= 0) | (ds < -JUMP_BACK_M) | (ds / dt > JUMP_M_S), F.lit(True))
    rows = along.withColumn("__run", jump.cast("int"))
    rows = rows.withColumn("__run", F.sum("__run").over(order.rowsBetween(W.unboundedPreceding, 0)))
    back = W.partitionBy(*keys, "__run").orderBy("t").rangeBetween(-window_s * 1000, 0)
    span = (F.col("t") - F.first("t").over(back)) / 1000
    speed = (F.col("s") - F.first("s").over(back)) / span
    limited = F.greatest(F.lit(0.0), F.least(F.lit(MAX_M_S), speed))
    return rows.withColumn("speed", F.when(span >= LEAST_SPAN_S, limited)).drop("__run")


def scheduled_seconds_at(timing: Column, s: Column) -> Column:
    """The timetable's seconds at ``s`` metres: linear between the stops about it. timing: array of (offset_m, seconds) along the road."""
    held = F.filter(timing, lambda x: x["offset_m"].isNotNull() & x["seconds"].isNotNull())
    pairs = F.zip_with(F.slice(held, F.lit(1), F.size(held) - 1), F.slice(held, F.lit(2), F.size(held) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    x = F.get(F.filter(pairs, lambda p: s.between(p["a"]["offset_m"], p["b"]["offset_m"])), F.lit(0))
    (o0, t0), (o1, t1) = ((x[k]["offset_m"], x[k]["seconds"]) for k in ("a", "b"))
    between = F.when(o0 == o1, t0.cast("double")).otherwise(t0 + (t1 - t0) * (s - o0) / (o1 - o0))
    first, last = F.get(held, F.lit(0)), F.get(held, F.size(held) - 1)
    return F.when(F.size(held) >= 2, F.when(s <= first["offset_m"], first["seconds"].cast("double")).when(x.isNotNull(), between).otherwise(last["seconds"].cast("double")))


def remaining_eta(t: Column, s: Column, stop_m: Column, stop_s: Column, here_s: Column) -> Column:
    """Scheduled running time from here to the stop, added to now (ms); null at or past the stop, or without a time."""
    return F.when(s < stop_m, (t + F.greatest(F.lit(0.0), stop_s - here_s) * 1000).cast("long"))


def progress_eta(t: Column, s: Column, stop_m: Column, between: Column, speed: Column, cruise: Column, dwell_s: float, standing_m_s: float) -> Column:
    """The observed pace, or the usual one of a standing vehicle, to the stop, and a dwell at each stop between."""
    pace = F.when(speed < standing_m_s, cruise).otherwise(speed)
    seconds = (stop_m - s) / F.greatest(pace, F.lit(LEAST_M_S)) + between * dwell_s
    return F.when((s < stop_m) & speed.isNotNull(), (t + seconds * 1000).cast("long"))


def blended_eta(scheduled: Column, progress: Column, remaining_m: Column, near_m: float) -> Column:
    """The timetable far from the stop, the observed pace more and more within ``near_m`` of it; either alone where the other is missing."""
    w = remaining_m / near_m
    mixed = (w * scheduled + (1 - w) * progress).cast("long")
    return F.when(scheduled.isNull(), progress).when(progress.isNull() | (remaining_m > near_m), scheduled).otherwise(mixed)


def bootstrap(histograms: DataFrame, resamples: int, seed: int, fractions: tuple[float, ...] = (0.5, 0.8)) -> DataFrame:
    """Quantiles of absolute error in resamples of whole journeys with replacement: one row per resample.

    histograms: journey (0, 1, 2 ... without gaps), bin, n. Draw k of resample r is journey floor(x mod J) of a fixed
    congruential sequence, so a rerun draws the same. Draws are counted per journey before they meet its bins, and quantiles
    come from cumulative counts per bin, so nothing grows with the number of errors.
    """
    journeys = histograms.agg((F.max("journey") + 1).alias("j"))
    spark = histograms.sparkSession
    draws = spark.range(resamples).withColumnRenamed("id", "resample").join(F.broadcast(journeys))  # one row
    draws = draws.select("resample", "j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("j") - 1)).alias("k"))
    x = ((F.col("resample") * F.col("j") + F.col("k") + seed) * 48271) % 2147483647
    x = (x * 48271) % 2147483647
    drawn = draws.select("resample", (x % F.col("j")).alias("journey")).groupBy("resample", "journey").agg(F.count(F.lit(1)).alias("weight"))
    bins = drawn.join(histograms, "journey").groupBy("resample", "bin").agg(F.sum(F.col("weight") * F.col("n")).alias("n"))
    upto = W.partitionBy("resample").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    bins = bins.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(W.partitionBy("resample"))})
    return bins.groupBy("resample").agg(*[F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))).alias(f"q{round(q * 100)}") for q in fractions])


def interval(samples: DataFrame, column: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """The values at ranks floor(low * n) and floor(high * n) - 1 of a column; one row per resample, so few enough for one array."""
    x = samples.agg(F.sort_array(F.collect_list(column)).alias("x"))
    n = F.size("x")
    return x.select(F.lit(column).alias("measure"), F.get("x", F.floor(n * low).cast("int")).alias("low"), F.get("x", (F.floor(n * high) - 1).cast("int")).alias("high"))
