"""Passages and arrival estimates over the events table: users stand for journeys, ``value`` for metres along the road."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.constants import BOOTSTRAP_SEED, DWELL_S, NEAR_M, STANDING_M_S
from headway.operators import passages as ops
from headway.plans.base import events, registering

QUERIES, ORACLES, query = registering()

_STOPS = (40.0, 90.0, 150.0, 260.0)
_ALONG = "a AS (SELECT user_id AS journey_id, event_type AS pattern_id, epoch_us(ts) // 1000 AS t, value AS s FROM events)"
_STEPS = """st AS (SELECT journey_id, pattern_id, lag(t) OVER w AS t0, lag(s) OVER w AS s0, t AS t1, s AS s1 FROM a WINDOW w AS (PARTITION BY journey_id, pattern_id ORDER BY t, s)),
o AS (SELECT * FROM (VALUES (0, 40.0::DOUBLE), (1, 90.0), (2, 150.0), (3, 260.0)) x(stop_index, offset_m)),
pa AS (SELECT journey_id, pattern_id, stop_index, t0, t1, CAST(floor(t0 + (offset_m - s0) / (s1 - s0) * (t1 - t0)) AS BIGINT) AS passed_ms, (t1 - t0) / 1000 AS gap_s, row_number() OVER (PARTITION BY journey_id, pattern_id, stop_index ORDER BY t0, t1) AS visit
  FROM st, o WHERE s0 < offset_m AND offset_m <= s1)"""


def _along(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("user_id").alias("journey_id"), F.col("event_type").alias("pattern_id"), F.unix_millis("ts").alias("t"), F.col("value").alias("s"))


def _stops(along):
    held = F.array(*[F.struct(F.lit(k).alias("stop_index"), F.lit(f"stop {k}").alias("stop"), F.lit(m).alias("offset_m")) for k, m in enumerate(_STOPS)])
    return along.select("pattern_id").distinct().select("pattern_id", F.explode(held).alias("x")).select("pattern_id", "x.*")


def _passages(spark, sf_dir):
    along = _along(spark, sf_dir)
    return ops.passages(along, _stops(along))


@query(f"WITH {_ALONG}, {_STEPS} SELECT journey_id, pattern_id, CAST(stop_index AS INTEGER) AS stop_index, passed_ms, gap_s, CAST(visit AS INTEGER) AS visit, gap_s <= 60 AND visit = 1 AS scoreable FROM pa")
def stop_passages(spark, sf_dir):
    """Every passage of a stop between two consecutive reports, interpolated."""
    return _passages(spark, sf_dir).select("journey_id", "pattern_id", "stop_index", "passed_ms", "gap_s", "visit", "scoreable")


@query(
    f"""WITH {_ALONG}, {_STEPS} SELECT pattern_id, count(*) AS passages, count(*) FILTER (WHERE gap_s <= 60 AND visit = 1) AS scoreable, count(*) FILTER (WHERE visit > 1) AS repeat_visits, count(*) FILTER (WHERE gap_s > 60) AS unbounded
FROM pa GROUP BY 1"""
)
def passage_summary(spark, sf_dir):
    """How many passages of each pattern can be used."""
    return ops.passage_counts(_passages(spark, sf_dir), ["pattern_id"])


_SPEED = """r AS (SELECT *, coalesce((t - lag(t) OVER w) / 1000 <= 0 OR s - lag(s) OVER w < -25 OR (s - lag(s) OVER w) / ((t - lag(t) OVER w) / 1000) > 30, true) AS jump FROM a WINDOW w AS (PARTITION BY journey_id ORDER BY t, s)),
i AS (SELECT *, sum(CAST(jump AS INTEGER)) OVER (PARTITION BY journey_id ORDER BY t, s ROWS UNBOUNDED PRECEDING) AS run FROM r),
f AS (SELECT *, (t - first_value(t) OVER w) / 1000 AS span, s - first_value(s) OVER w AS ds FROM i WINDOW w AS (PARTITION BY journey_id, run ORDER BY t RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW)),
sp AS (SELECT journey_id, pattern_id, t, s, CASE WHEN span >= 20 THEN greatest(0.0, least(20.0, ds / span)) END AS speed FROM f)"""
_WINDOW_S = 86400


@query(f"WITH {_ALONG}, {_SPEED} SELECT journey_id, t, s, round(speed, 9) AS speed FROM sp")
def observed_speeds(spark, sf_dir):
    """The speed of the last day's reports after the latest jump (reports here are hours apart, so the window is long)."""
    return ops.with_speed(_along(spark, sf_dir), ["journey_id"], _WINDOW_S).select("journey_id", "t", "s", F.round("speed", 9).alias("speed"))


_TIMING = ((0.0, 0), (40.0, 90), (90.0, 150), (150.0, 400), (260.0, 700))


@query(
    f"""WITH {_ALONG}, {_SPEED}, g AS (SELECT * FROM (VALUES (0.0::DOUBLE, 0, 40.0::DOUBLE, 90), (40.0, 90, 90.0, 150), (90.0, 150, 150.0, 400), (150.0, 400, 260.0, 700)) x(o0, t0, o1, t1)),
h AS (SELECT sp.*, coalesce(t0 + (t1 - t0) * (s - o0) / (o1 - o0), CASE WHEN s <= 0 THEN 0.0 ELSE 700.0 END) AS here, (CASE WHEN s < 40 THEN 1 ELSE 0 END) + (CASE WHEN s < 90 THEN 1 ELSE 0 END) + (CASE WHEN s < 150 THEN 1 ELSE 0 END) AS between_
  FROM sp LEFT JOIN g ON s > o0 AND s <= o1),
e AS (SELECT *, CASE WHEN s < 260 THEN CAST(trunc(t + greatest(0.0, 700 - here) * 1000) AS BIGINT) END AS scheduled,
  CASE WHEN s < 260 AND speed IS NOT NULL THEN CAST(trunc(t + ((260 - s) / greatest(CASE WHEN speed < 1.0 THEN 6.0 ELSE speed END, 0.5) + between_ * 20) * 1000) AS BIGINT) END AS progress FROM h)
SELECT journey_id, t, s, scheduled, progress, CASE WHEN scheduled IS NULL THEN progress WHEN progress IS NULL OR 260 - s > 1000 THEN scheduled ELSE CAST(trunc((260 - s) / 1000 * scheduled + (1 - (260 - s) / 1000) * progress) AS BIGINT) END AS blended FROM e"""
)
def arrival_estimates(spark, sf_dir):
    """When the last stop is reached, by the timetable's running time, by observed pace, and blended near the stop."""
    rows = ops.with_speed(_along(spark, sf_dir), ["journey_id"], _WINDOW_S)
    timing = F.array(*[F.struct(F.lit(m).alias("offset_m"), F.lit(sec).alias("seconds")) for m, sec in _TIMING])
    t, s, stop_m, stop_s = F.col("t"), F.col("s"), F.lit(_TIMING[-1][0]), F.lit(_TIMING[-1][1])
    between = sum((F.when(s < m, 1).otherwise(0) for m in _STOPS[:-1]), F.lit(0))
    scheduled = ops.remaining_eta(t, s, stop_m, stop_s, ops.scheduled_seconds_at(timing, s))
    progress = ops.progress_eta(t, s, stop_m, between, F.col("speed"), F.lit(6.0), DWELL_S, STANDING_M_S)
    rows = rows.withColumns({"scheduled": scheduled, "progress": progress})
    return rows.select("journey_id", "t", "s", "scheduled", "progress", ops.blended_eta(F.col("scheduled"), F.col("progress"), stop_m - s, NEAR_M).alias("blended"))


_HISTOGRAM = "h AS (SELECT CAST(n_nationkey AS BIGINT) AS journey, CAST(floor(abs(c_acctbal) / 200) AS BIGINT) AS bin, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"


def _histograms(spark, sf_dir):
    from headway.session import table

    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("journey"), F.floor(F.abs("c_acctbal") / 200).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


_DRAWS = f"""j AS (SELECT max(journey) + 1 AS j FROM h), d AS (SELECT r AS resample, (((r * j + k + {BOOTSTRAP_SEED}) * 48271) % 2147483647 * 48271) % 2147483647 % j AS journey FROM j, range(1000) a(r), range(25) b(k) WHERE k < j),
w AS (SELECT resample, bin, sum(n) AS n FROM d JOIN h USING (journey) GROUP BY 1, 2), u AS (SELECT resample, bin, sum(n) OVER (PARTITION BY resample ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY resample) AS total FROM w),
q AS (SELECT resample, min(bin) FILTER (WHERE upto >= 0.5 * total) AS q50, min(bin) FILTER (WHERE upto >= 0.8 * total) AS q80 FROM u GROUP BY 1)"""


@query(f"WITH {_HISTOGRAM}, {_DRAWS} SELECT resample, q50, q80 FROM q")
def cluster_bootstrap(spark, sf_dir):
    """The median and 80th percentile of 1000 resamples of whole journeys."""
    return ops.bootstrap(_histograms(spark, sf_dir), 1000, BOOTSTRAP_SEED)


@query(
    f"""WITH {_HISTOGRAM}, {_DRAWS}, o AS (SELECT 'q50' AS measure, list_sort(list(q50)) AS x FROM q UNION ALL SELECT 'q80', list_sort(list(q80)) FROM q)
SELECT measure, x[26] AS low, x[975] AS high FROM o"""
)
def bootstrap_intervals(spark, sf_dir):
    """The 95 % intervals of those resamples."""
    from functools import reduce

    samples = ops.bootstrap(_histograms(spark, sf_dir), 1000, BOOTSTRAP_SEED)
    return reduce(lambda a, b: a.unionByName(b), [ops.interval(samples, name) for name in ("q50", "q80")])
