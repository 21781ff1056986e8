"""Validation ladders, freshness labels and named checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.constants import AGEING_S, EXPIRY_S, FRESH_S, FUTURE_TOLERANCE_S, REPLAY_LAG_MS, REPLAY_LEAD_MS, SERVICE_BOX, TRAIL_POINTS, TRAIL_S
from headway.functions.geo import in_box
from headway.functions.time import has_offset, instant
from headway.operators.spatial import meets


def freshness(age_s: Column) -> Column:
    return (
        F.when(age_s.isNull(), "unknown")
        .when(age_s < 0, "ahead_of_clock")
        .when(age_s <= FRESH_S, "fresh")
        .when(age_s <= AGEING_S, "ageing")
        .when(age_s <= EXPIRY_S, "stale")
        .otherwise("expired")
    )


def bearing(raw: Column) -> Column:
    """status and degrees: 0 is a bearing, nothing at all is absent, what is no number of 0 to 360 is invalid."""
    value = raw.try_cast("double")
    good = value.isNotNull() & ~F.isnan(value) & value.between(0.0, 360.0)
    status = F.when(raw.isNull() | (F.trim(raw) == ""), "absent").when(good, "reported").otherwise("invalid")
    return F.struct(status.alias("status"), F.when(good, value).alias("degrees"))


def validated(raw: DataFrame, box=SERVICE_BOX) -> DataFrame:
    """Parsed activities with typed columns and ``reason``: the first rule they fail, ``outside_area`` (no rejection), or null.

    Expects strings latitude, longitude, recorded_at, vehicle and the timestamp retrieved_at.
    """
    lat, lon = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    finite = lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))
    observed = instant(F.col("recorded_at"))
    reason = (
        F.when(lat.isNull() | lon.isNull(), "unreadable_coordinate")
        .when(~(finite(lat) & finite(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)), "coordinate_out_of_range")
        .when(~in_box(lat, lon, box), "outside_area")
        .when(observed.isNull() & F.try_to_timestamp("recorded_at").isNotNull() & ~has_offset(F.col("recorded_at")), "timestamp_without_offset")
        .when(observed.isNull(), "unreadable_timestamp")
        .when(F.unix_millis(observed) > F.unix_millis("retrieved_at") + FUTURE_TOLERANCE_S * 1000, "future_timestamp")
        .when(F.coalesce(F.trim("vehicle"), F.lit("")) == "", "missing_vehicle_identity")
    )
    return raw.withColumns({"lat": lat, "lon": lon, "observed_at": observed, "reason": reason})


def quarantine_id(*fields: Column) -> Column:
    """First 32 hex digits of the digest of the fields joined by ``|``; null counts as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(f, F.lit("")) for f in fields]), 256), 1, 32)


def checks(facts: DataFrame, named: dict[str, Column]) -> DataFrame:
    """One row per named check over a one-row frame of facts."""
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in named.items()])
    return facts.select(F.explode(rows).alias("x")).select("x.check_name", "x.passed")


#: What a published bearing may be said to be. Fixed values.
BEARING_STATUSES = ("reported", "absent", "invalid", "not_captured")


def live_checks(vehicles: DataFrame, trail: DataFrame, publications: DataFrame, box: tuple[float, float, float, float] = SERVICE_BOX) -> DataFrame:
    """(publication, check_name, passed): the ten named checks of every live publication.

    vehicles: publication, vehicle, observed (ms), lat, lon, age_s, kind, bearing, bearing_status; trail: publication, vehicle, before_ms (how much earlier than the
    position), source_known; publications: publication, state, published (ms), previous (ms of the one before, or null).
    """
    c, every = F.col, lambda cond: F.coalesce(F.bool_and(F.coalesce(cond, F.lit(False))), F.lit(True))
    reported = c("bearing_status") == "reported"
    bearing = c("bearing_status").isin(*BEARING_STATUSES) & (c("bearing").isNotNull() == reported) & F.coalesce(c("bearing").between(0, 360), F.lit(True))
    v = vehicles.join(publications.select("publication", "published"), "publication").groupBy("publication").agg(
        F.count(F.lit(1)).alias("vehicles"), every(c("observed").isNotNull()).alias("timed"), every(in_box(c("lat"), c("lon"), box)).alias("inside"), every(F.coalesce("age_s", F.lit(0)) <= EXPIRY_S).alias("young"),
        every(c("kind") == "observed").alias("observed_only"), every(bearing).alias("bearings"), every(c("observed") <= c("published")).alias("not_future"),
    )
    points = trail.groupBy("publication", "vehicle").agg(F.count(F.lit(1)).alias("n"), every((c("before_ms") > 0) & (c("before_ms") <= TRAIL_S * 1000) & c("source_known")).alias("ok"))
    t = points.groupBy("publication").agg(every(c("ok") & (c("n") <= TRAIL_POINTS)).alias("trails"))
    facts = publications.join(v, "publication", "left").join(t, "publication", "left")
    held = lambda name: F.coalesce(name, F.lit(True))
    named = {
        "state_is_known": c("state").isin("live", "stale", "unavailable"), "positions_have_observation_times": held("timed"), "positions_inside_declared_area": held("inside"), "no_expired_position_published": held("young"),
        "every_position_is_an_observed_fix": held("observed_only"), "trail_is_earlier_observed_history": held("trails"), "bearings_reported_or_explicitly_absent": held("bearings"),
        "live_state_requires_positions": ~c("state").eqNullSafe(F.lit("live")) | (F.coalesce("vehicles", F.lit(0)) > 0), "publication_time_not_before_newest_observation": held("not_future"),
        "publication_time_not_going_backwards": c("previous").isNull() | (c("published") >= c("previous")),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), F.coalesce(x, F.lit(False)).alias("passed")) for n, x in named.items()])
    return facts.select("publication", F.explode(rows).alias("x")).select("publication", "x.check_name", "x.passed")


def snapshot_checks(points: DataFrame, sources: DataFrame, snapshots: DataFrame, warehouse: DataFrame, lead_ms: int = REPLAY_LEAD_MS, lag_ms: int = REPLAY_LAG_MS) -> DataFrame:
    """(snapshot, check_name, passed): the ten named checks of every archive snapshot before it replaces the served one.

    points: snapshot, journey, lat, lon, source; sources: snapshot, source; snapshots: snapshot, version, mode, start, end (ms), west, south, east, north, journeys, unique_observations,
    timetable_matched, scheduled_coverage, served_end, served_count (null: nothing is served), newly_suppressed; warehouse: observed (ms) of every publishable observation.
    """
    c = F.col
    known = sources.select("snapshot", "source").distinct().withColumn("known", F.lit(True))
    p = points.join(known, ["snapshot", "source"], "left").join(snapshots.select("snapshot", "west", "south", "east", "north"), "snapshot")
    outside = ~(c("lon").between(c("west"), c("east")) & c("lat").between(c("south"), c("north")))
    p = p.groupBy("snapshot").agg(F.count(F.lit(1)).alias("points"), F.countDistinct("journey").alias("with_points"), F.count(F.when(c("known").isNull(), 1)).alias("unresolved"), F.count(F.when(F.coalesce(outside, F.lit(True)), 1)).alias("outside"))
    run = warehouse.groupBy("observed").agg(F.count(F.lit(1)).alias("n"))
    spans = snapshots.select("snapshot", (c("start") - lead_ms).alias("a"), (c("end") + lag_ms + 1).alias("z"))
    held = meets(spans, run, "a", "z", "observed", 86_400_000).groupBy("snapshot").agg(F.sum("n").alias("in_window"))
    facts = snapshots.join(p, "snapshot", "left").join(held, "snapshot", "left").na.fill(0, ["points", "with_points", "unresolved", "outside", "in_window"])
    nothing = c("served_end").isNull() & c("served_count").isNull()
    named = {
        "schema_shape": (c("version") == 1) & (c("mode") == "archive") & c("snapshot").isNotNull(), "window_ordered": F.coalesce("end", F.lit(0)) > F.coalesce("start", F.lit(0)),
        "journeys_non_empty": (c("journeys") > 0) & (c("with_points") == c("journeys")), "points_reconcile_with_quality": c("points") == c("unique_observations"), "every_point_resolves_to_a_source": c("unresolved") == 0,
        "coordinates_inside_declared_bounds": c("outside") == 0, "no_unvalidated_timetable_claim": c("timetable_matched").eqNullSafe(F.lit(False)) & c("scheduled_coverage").isNull(), "built_from_full_warehouse": c("points") == c("in_window"),
        "window_end_not_earlier_than_served": nothing | (F.coalesce("end", F.lit(0)) >= F.coalesce("served_end", F.lit(0))),
        "observations_not_lost_without_suppression": nothing | (c("points") + F.coalesce("newly_suppressed", F.lit(0)) >= F.coalesce("served_count", F.lit(0))),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), F.coalesce(x, F.lit(False)).alias("passed")) for n, x in named.items()])
    return facts.select("snapshot", F.explode(rows).alias("x")).select("snapshot", "x.check_name", "x.passed")
