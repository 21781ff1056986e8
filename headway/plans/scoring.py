"""Scoring estimates over events: a user's events are a journey's reports, time runs 1,500 times as fast, ``value`` are metres ridden since the last report."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.operators import passages, scoring
from headway.plans.base import events, registering

QUERIES, ORACLES, query = registering()

_STOP_M, _LAST = 400, 20
_BASE = f"""e AS (SELECT user_id AS journey, event_id, epoch_us(ts) // 1500000 AS at_ms, sum(CAST(floor(value * 4) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1500000, event_id) AS along FROM events),
r AS (SELECT journey, at_ms, max(along) AS along, min(at_ms + event_id % 3 * 4000) AS retrieved FROM e GROUP BY 1, 2),
st AS (SELECT journey, lag(at_ms) OVER w AS t0, lag(along) OVER w AS s0, at_ms AS t1, along AS s1 FROM r WINDOW w AS (PARTITION BY journey ORDER BY at_ms)),
pa AS (SELECT journey, k AS stop_index, CAST(k * {_STOP_M} AS DOUBLE) AS offset_m, CAST(floor(t0 + (k * {_STOP_M} - s0) / (s1 - s0)::DOUBLE * (t1 - t0)) AS BIGINT) AS passed_ms, t1 AS known_ms FROM st, (SELECT unnest(range(1, {_LAST + 1})) AS k) WHERE s0 < k * {_STOP_M} AND k * {_STOP_M} <= s1),
j AS (SELECT journey, min(at_ms) AS begun FROM r GROUP BY 1),
p AS (SELECT pa.*, CASE WHEN pa.journey % 4 > 0 THEN begun + stop_index * 50000 END AS timetable_ms FROM pa JOIN j USING (journey)),
s AS (SELECT r.journey, r.at_ms, p.stop_index, CASE WHEN p.stop_index % 7 > 0 THEN r.at_ms + CAST(floor((offset_m - r.along) / 8 * 1000) AS BIGINT) END AS eta_ms FROM r JOIN p ON r.journey = p.journey WHERE r.along < offset_m)"""


def _reports(spark, sf_dir):
    at = F.floor(F.unix_micros("ts") / 1_500_000).cast("long")
    e = events(spark, sf_dir).select(F.col("user_id").alias("journey"), "event_id", at.alias("at"), F.floor(F.col("value") * 4).cast("long").alias("ridden"))
    e = e.withColumn("along", F.sum("ridden").over(W.partitionBy("journey").orderBy("at", "event_id").rowsBetween(W.unboundedPreceding, 0)))
    return e.groupBy("journey", "at").agg(F.max("along").alias("along"), F.min(F.col("at") + F.col("event_id") % 3 * 4000).alias("retrieved"))


def _passages(reports):
    held = F.array(*[F.struct(F.lit(k).alias("stop_index"), F.lit(str(k)).alias("stop"), F.lit(float(k * _STOP_M)).alias("offset_m")) for k in range(1, _LAST + 1)])
    along = reports.select(F.col("journey").alias("journey_id"), F.lit(0).alias("pattern_id"), F.col("at").alias("t"), F.col("along").alias("s"))
    stops = along.select("pattern_id").distinct().select("pattern_id", F.explode(held).alias("x")).select("pattern_id", "x.*")
    found = passages.passages(along, stops)
    begun = reports.groupBy("journey").agg(F.min("at").alias("begun"))
    rows = found.select(F.col("journey_id").alias("journey"), "stop_index", "offset_m", F.col("passed_ms").cast("long").alias("passed_ms"), F.col("t1").alias("known_ms"), "uncertainty_s").join(begun, "journey")
    return rows.withColumn("timetable_ms", F.when(F.col("journey") % 4 > 0, F.col("begun") + F.col("stop_index") * 50_000)).drop("begun")


def _estimates(reports, found):
    """A steady 8 m/s to the stop; no estimate for every seventh stop."""
    met = reports.join(found.select("journey", "stop_index", "offset_m"), "journey").filter(F.col("along") < F.col("offset_m"))
    eta = F.when(F.col("stop_index") % 7 > 0, F.col("at") + F.floor((F.col("offset_m") - F.col("along")) / 8 * 1000))
    return met.select("journey", "at", "stop_index", eta.cast("long").alias("eta_ms"))


def _spells(spark, sf_dir):
    r = _reports(spark, sf_dir).withColumn("feed", F.col("journey") % 50)
    found = _passages(r)
    pub = r.select("feed", (F.floor(F.col("at") / 20_000) * 20_000).cast("long").alias("published"))
    return scoring.display_spells(scoring.with_holds(r, pub, ["feed"]), found, _estimates(r, found).filter("eta_ms IS NOT NULL"))


_DISPLAY = f"""{_BASE}, pb AS (SELECT DISTINCT journey % 50 AS feed, at_ms // 20000 * 20000 AS published FROM r),
h AS (SELECT r.*, (SELECT min(published) FROM pb WHERE feed = r.journey % 50 AND published >= retrieved) + 10000 AS held_from, count(*) OVER (PARTITION BY journey) AS n FROM r),
q AS (SELECT *, least(coalesce(first_value(held_from IGNORE NULLS) OVER (PARTITION BY journey ORDER BY at_ms, retrieved ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), at_ms + 150000), at_ms + 150000) AS held_to FROM h),
m AS (SELECT q.journey, q.at_ms, p.stop_index, passed_ms, timetable_ms, eta_ms, unnest(range(held_from, held_to, 5000)) AS t FROM q JOIN p ON q.journey = p.journey AND q.at_ms < passed_ms AND passed_ms - q.at_ms <= 1200000 AND q.along < offset_m LEFT JOIN s ON s.journey = q.journey AND s.at_ms = q.at_ms AND s.stop_index = p.stop_index WHERE n >= 6 AND held_to > held_from),
d AS (SELECT *, passed_ms - t BETWEEN 120000 AND 600000 AS eligible, coalesce(eta_ms - t BETWEEN 120000 AND 600000, false) AS shown, CAST(round_even((passed_ms - eta_ms) / 60000.0::DOUBLE / 0.05::DOUBLE, 0) AS INTEGER) AS bin, CAST(round_even((passed_ms - timetable_ms) / 60000.0::DOUBLE / 0.05::DOUBLE, 0) AS INTEGER) AS tbin FROM m)"""


@query(
    f"""WITH {_DISPLAY} SELECT journey, 'signed' AS kind, bin, count(*) AS n FROM d WHERE shown GROUP BY 1, 2, 3 UNION ALL SELECT journey, 'candidate', abs(bin) AS b, count(*) FROM d WHERE shown AND tbin IS NOT NULL GROUP BY 1, 2, 3
UNION ALL SELECT journey, 'timetable', abs(tbin) AS b, count(*) FROM d WHERE shown AND tbin IS NOT NULL GROUP BY 1, 2, 3"""
)
def display_histograms(spark, sf_dir):
    """E5: errors of all moments at which a page shows minutes, by journey and bin."""
    return scoring.journey_histograms(_spells(spark, sf_dir), ["journey"])


@query(f"WITH {_DISPLAY} SELECT journey, CAST(count(*) FILTER (WHERE eligible) AS BIGINT) AS eligible, CAST(count(*) FILTER (WHERE eligible AND shown) AS BIGINT) AS eligible_shown, count(DISTINCT CASE WHEN shown THEN stop_index END) AS passages FROM d GROUP BY 1")
def display_coverage(spark, sf_dir):
    """At how many moments a vehicle was two to ten minutes away, and at how many of them a page says so."""
    return scoring.journey_coverage(_spells(spark, sf_dir), ["journey"])


_Q = "min(CASE WHEN upto >= {q} * whole THEN bin END) * 0.05"
_HIST = "SELECT {k}, bin, sum(n) OVER (PARTITION BY {k} ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {k}) AS whole FROM (SELECT {k}, {b} AS bin, sum(n) AS n FROM {f} GROUP BY {k}, {b})"


@query(
    f"""WITH {_DISPLAY}, hs AS (SELECT journey, journey % 3 AS grp, bin, count(*) AS n FROM d WHERE shown GROUP BY 1, 2, 3), hc AS (SELECT journey % 3 AS grp, abs(bin) AS b, count(*) AS n FROM d WHERE shown AND tbin IS NOT NULL GROUP BY 1, 2), ht AS (SELECT journey % 3 AS grp, abs(tbin) AS b, count(*) AS n FROM d WHERE shown AND tbin IS NOT NULL GROUP BY 1, 2),
a AS ({_HIST.format(k='grp', b='abs(bin)', f='hs')}), g AS ({_HIST.format(k='grp', b='bin', f='hs')}), c AS ({_HIST.format(k='grp', b='b', f='hc')}), t AS ({_HIST.format(k='grp', b='b', f='ht')}), o AS ({_HIST.format(k='grp, journey', b='abs(bin)', f='hs')}),
own AS (SELECT grp, journey, {_Q.format(q=0.5)} AS own FROM o GROUP BY 1, 2), ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY own) - 1 AS k, count(*) OVER (PARTITION BY grp) AS n FROM own),
x AS (SELECT grp, sum(n) AS moments, count(DISTINCT journey) AS journeys, sum(CASE WHEN bin > 0 THEN n ELSE 0 END) / sum(n) AS share_later, sum(CASE WHEN bin * 0.05 BETWEEN -1.15 - 1e-9 AND 5.75 + 1e-9 THEN n ELSE 0 END) / sum(n) AS interval_coverage FROM hs GROUP BY 1)
SELECT x.grp, CAST(moments AS BIGINT) AS moments, journeys, round(share_later, 9) AS share_later, round(interval_coverage, 9) AS interval_coverage, round(median_abs, 6) AS median_abs, round(p80_abs, 6) AS p80_abs, round(p10, 6) AS signed_p10, round(p90, 6) AS signed_p90, round(cand, 6) AS median_abs_where_paired, round(tt, 6) AS timetable_median_abs, eligible, round(coverage, 9) AS coverage, round(mm, 6) AS median_of_medians
FROM x JOIN (SELECT grp, {_Q.format(q=0.5)} AS median_abs, {_Q.format(q=0.8)} AS p80_abs FROM a GROUP BY 1) USING (grp) JOIN (SELECT grp, {_Q.format(q=0.1)} AS p10, {_Q.format(q=0.9)} AS p90 FROM g GROUP BY 1) USING (grp) JOIN (SELECT grp, {_Q.format(q=0.5)} AS cand FROM c GROUP BY 1) USING (grp) JOIN (SELECT grp, {_Q.format(q=0.5)} AS tt FROM t GROUP BY 1) USING (grp)
JOIN (SELECT journey % 3 AS grp, count(*) FILTER (WHERE eligible) AS eligible, count(*) FILTER (WHERE eligible AND shown) / count(*) FILTER (WHERE eligible) AS coverage FROM d GROUP BY 1) USING (grp) JOIN (SELECT grp, max(CASE WHEN k = n // 2 THEN own END) AS mm FROM ranked GROUP BY 1) USING (grp)"""
)
def display_evaluation(spark, sf_dir):
    """Pooled errors, interval coverage, share later, coverage and medians of medians, by group of journeys."""
    s = _spells(spark, sf_dir).withColumn("grp", F.col("journey") % 3)
    found = scoring.evaluated(s, ["grp"], (-1.15, 5.75))
    six = lambda *names: [F.round(n, 6).alias(n) for n in names]
    return found.select("grp", "moments", "journeys", F.round("share_later", 9).alias("share_later"), F.round("interval_coverage", 9).alias("interval_coverage"), *six("median_abs", "p80_abs", "signed_p10", "signed_p90", "median_abs_where_paired", "timetable_median_abs"), "eligible", F.round("coverage", 9).alias("coverage"), *six("median_of_medians"))


_SCORE = f"""{_BASE}, n AS (SELECT *, count(*) OVER (PARTITION BY journey) AS n FROM r),
z AS (SELECT n.journey, n.at_ms, p.*  EXCLUDE (journey), (passed_ms - n.at_ms) / 60000.0 AS horizon_min FROM n JOIN p ON n.journey = p.journey WHERE n >= 6 AND passed_ms - n.at_ms BETWEEN 60000 AND 1200000 AND along < offset_m),
b AS (SELECT z.journey, z.at_ms, z.stop_index, max_by(q.passed_ms - q.timetable_ms, (q.stop_index, q.passed_ms - q.timetable_ms)) AS delay FROM z JOIN p q ON q.journey = z.journey AND q.stop_index < z.stop_index AND q.known_ms <= z.at_ms GROUP BY 1, 2, 3),
y AS (SELECT z.journey, z.at_ms, z.stop_index, horizon_min, (passed_ms - eta_ms) / 60000.0 AS progress, (passed_ms - timetable_ms) / 60000.0 AS scheduled, (passed_ms - timetable_ms - delay) / 60000.0 AS adjusted, (passed_ms - CASE WHEN z.stop_index % 5 > 0 THEN eta_ms + 30000 END) / 60000.0 AS remaining, (passed_ms - eta_ms - 15000) / 60000.0 AS blended
  FROM z LEFT JOIN s ON s.journey = z.journey AND s.at_ms = z.at_ms AND s.stop_index = z.stop_index LEFT JOIN b ON b.journey = z.journey AND b.at_ms = z.at_ms AND b.stop_index = z.stop_index)"""


def _scored(spark, sf_dir):
    r = _reports(spark, sf_dir)
    found = _passages(r)
    e = _estimates(r, found).select("journey", "at", "stop_index", F.col("eta_ms").alias("progress_ms"), F.when(F.col("stop_index") % 5 > 0, F.col("eta_ms") + 30_000).alias("remaining_ms"), (F.col("eta_ms") + 15_000).alias("blended_ms"))
    return scoring.scored(r.select("journey", "at", "along"), found, e)


@query(f"WITH {_SCORE} SELECT journey, at_ms AS at, stop_index, round(horizon_min, 6) AS horizon_min, round(progress, 6) AS progress, round(scheduled, 6) AS scheduled, round(adjusted, 6) AS adjusted, round(remaining, 6) AS remaining, round(blended, 6) AS blended FROM y")
def arrival_scores(spark, sf_dir):
    """The error of five methods at every report before a passage; one corrects the timetable by what was known of the journey's delay by then."""
    return _scored(spark, sf_dir).select("journey", "at", "stop_index", *[F.round(c, 6).alias(c) for c in ("horizon_min", *scoring.METHODS)])


@query(
    f"""WITH {_SCORE}, i AS (SELECT *, unnest(CASE WHEN progress IS NOT NULL AND remaining IS NOT NULL AND blended IS NOT NULL THEN ['all', 'identical'] ELSE ['all'] END) AS subset FROM y WHERE horizon_min >= 2 AND horizon_min < 10), t AS (SELECT subset, count(*) AS moments FROM i GROUP BY 1),
u AS (UNPIVOT (SELECT subset, journey, progress, scheduled, adjusted, remaining, blended FROM i) ON progress, scheduled, adjusted, remaining, blended INTO NAME method VALUE e),
o AS (SELECT subset, method, journey, quantile_cont(abs(e), 0.5) AS own FROM u GROUP BY 1, 2, 3), w AS (SELECT *, row_number() OVER (PARTITION BY subset, method ORDER BY abs(e)) - 1 AS k, count(*) OVER (PARTITION BY subset, method) AS n FROM u)
SELECT a.subset, a.method, moments, available, round(available / moments, 9) AS coverage, round(median_abs, 6) AS median_abs, round(p80_abs, 6) AS p80_abs, journeys, round(mm, 6) AS median_of_medians FROM (SELECT subset, method, count(*) AS available, quantile_cont(abs(e), 0.5) AS median_abs, max(CASE WHEN k = least(n - 1, CAST(floor(0.8 * n) AS BIGINT)) THEN abs(e) END) AS p80_abs FROM w GROUP BY 1, 2) a
JOIN t USING (subset) JOIN (SELECT subset, method, count(*) AS journeys, quantile_cont(own, 0.5) AS mm FROM o GROUP BY 1, 2) USING (subset, method)"""
)
def methods_compared(spark, sf_dir):
    """The methods where each gives a time, and on identical moments."""
    found = scoring.methods_compared(_scored(spark, sf_dir).withColumn("one", F.lit(1)), ["one"])
    return found.select("subset", "method", "moments", "available", F.round("coverage", 9).alias("coverage"), F.round("median_abs", 6).alias("median_abs"), F.round("p80_abs", 6).alias("p80_abs"), "journeys", F.round("median_of_medians", 6).alias("median_of_medians"))
