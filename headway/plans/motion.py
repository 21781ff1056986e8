"""The motion estimate over events: a user's events are reports on a road that bends at every kilometre, time runs 1,500 times as fast."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.operators import motion
from headway.plans.base import registering
from headway.plans.scoring import _reports

QUERIES, ORACLES, query = registering()

_BENDS = 40


def world(spark, sf_dir):
    """Reports (journey, pattern_id, at, available, lat, lon) and roads; one pattern has no road."""
    x = F.col("along") * 1.0
    lat = 53.4 + F.floor(x / 1000) % 2 * (x % 1000) / 111_320.0 * 0.5 + (1 - F.floor(x / 1000) % 2) * (1000 - x % 1000) / 111_320.0 * 0.5
    r = _reports(spark, sf_dir)
    reports = r.select("journey", (F.col("journey") % 5).alias("pattern_id"), "at", F.col("retrieved").alias("available"), lat.alias("lat"), (F.lit(-2.3) + x / 66_374.0).alias("lon"))
    k = F.sequence(F.lit(0), F.lit(_BENDS))
    lats, lons = F.transform(k, lambda i: 53.4 + (1 - i % 2) * 500 / 111_320.0), F.transform(k, lambda i: -2.3 + i * 1000 / 66_374.0)
    stops = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: i * 450.0)
    roads = reports.filter("pattern_id < 4").select("pattern_id").distinct().select("pattern_id", lats.alias("lats"), lons.alias("lons"), stops.alias("stops"))
    return reports, roads


@query()
def motion_scores(spark, sf_dir):
    """Every later report as foretold from what was known, or why it was not; checked by brute force in the tests."""
    return motion.scores(*world(spark, sf_dir), motion.Settings(horizon=120.0, dwell=10.0, hold=15.0))


@query()
def motion_profile(spark, sf_dir):
    """Errors by the report's age, and how often the estimate beats the last report."""
    return motion.profile(motion.scores(*world(spark, sf_dir), motion.Settings(horizon=120.0, decay=45.0)))


@query()
def motion_settings(spark, sf_dir):
    """The mean error and the visible moves of every setting of the family."""
    return motion.compared(*world(spark, sf_dir), motion.grid(motion.Settings(horizon=120.0)))
