"""Roads of patterns: which stop each routed place is, where stops lie along the road, how near reports come to it, and the windows that a router is asked for.

A road is its vertices (pattern_id, vertex, lat, lon). What compares a point with a road meets its segments through a grid of cells, so a report meets the few
about it; one that is further off than a cell reaches meets all segments of its own pattern. Places along a road are found by one sort of vertices and
offsets together. Only the ordered alignment of two short arrays (a pattern's stops and its routed places) runs inside a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.constants import COORD_TOLERANCE_DEG, GEOMETRY_TOLERANCE_M, MAPPING_VERSION, MEAN_RADIUS_M, PLAIN_DEGREE_M, SHAPE_MIN_REPORTS, SHAPE_P95_M, SHAPE_WINDOW, SHARED_M, WITHIN_M
from headway.functions import stats
from headway.functions.geo import metres, polyline_points
from headway.operators.matching import match
from headway.operators.sequences import asof
from headway.session import settled

OCCURRENCES = "array<struct<index:int,stop:string,offset:double>>"
#: Metres that a cell of the segment index reaches, and its size in degrees of latitude; both are only about how many segments a report meets.
REACH_M, CELL_M = 40.0, 240.0


def windows(stops: Column, size: int = SHAPE_WINDOW) -> Column:
    """An array of stops as windows of at most ``size``, each starting where the last ended; fewer than two stops give none."""
    last = F.size(stops) - 1
    starts = F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0)), F.lit(size - 1))
    return F.when(last < 1, F.array().cast("array<array<string>>")).otherwise(F.transform(starts, lambda a: F.slice(stops, a + 1, F.lit(size))))


def vertices_of(roads: DataFrame, column: str = "polyline6") -> DataFrame:
    """Vertices of roads that are kept as encoded polylines (pattern_id, ``column``)."""
    return roads.select("pattern_id", F.posexplode(polyline_points(F.col(column))).alias("vertex", "p")).select("pattern_id", "vertex", "p.lat", "p.lon")


def with_lengths(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Vertices with ``along``, metres along the road up to each."""
    order = W.partitionBy(*keys).orderBy("vertex")
    step = metres(F.lag("lat").over(order), F.lag("lon").over(order), F.col("lat"), F.col("lon"), MEAN_RADIUS_M)
    return vertices.withColumn("__step", F.coalesce(step, F.lit(0.0))).withColumn("along", F.sum("__step").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("__step")


def assembled(legs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vertices of joined legs (with ``along``), and the offset of each stop: (pattern_id, stop_at, offset).

    legs: pattern_id, leg (0, 1, ... over all windows), points (array of lat, lon). A leg that begins where the last ended gives its first point once.
    """
    order = W.partitionBy("pattern_id").orderBy("leg", "at")
    p = legs.select("pattern_id", "leg", F.posexplode("points").alias("at", "p")).select("pattern_id", "leg", "at", "p.lat", "p.lon")
    repeats = (F.col("at") == 0) & F.col("lat").eqNullSafe(F.lag("lat").over(order)) & F.col("lon").eqNullSafe(F.lag("lon").over(order))
    kept = p.withColumn("__repeats", repeats).filter(~F.col("__repeats")).withColumn("vertex", F.row_number().over(order) - 1)
    road = with_lengths(kept.select("pattern_id", "leg", "vertex", "lat", "lon"), ["pattern_id"])
    ends = road.groupBy("pattern_id", "leg").agg(F.max("along").alias("along"))
    ends = legs.select("pattern_id", "leg").join(ends, ["pattern_id", "leg"], "left")  # a leg without points ends where the one before did
    upto = W.partitionBy("pattern_id").orderBy("leg").rowsBetween(W.unboundedPreceding, 0)
    ends = ends.select("pattern_id", (F.col("leg") + 1).alias("stop_at"), F.round(F.coalesce(F.max("along").over(upto), F.lit(0.0)), 1).alias("offset"))
    starts = legs.select("pattern_id", F.lit(0).alias("stop_at"), F.lit(0.0).alias("offset")).distinct()
    return road.drop("leg"), starts.unionByName(ends)


def mapped(patterns: DataFrame) -> DataFrame:
    """``patterns`` with ``occurrences`` (index, stop, offset) of its routed places, in order, or the ``refused`` reason.

    patterns: pattern_id, stops (array of stop, lat, lon; places may be null), routed (array of lat, lon), offsets (array). Each routed place is the next stop at
    its coordinates; stops that were not routed are passed over, and one that is no stop after the last refuses the whole mapping.
    """
    same = lambda s, r: (F.abs(s["lat"] - r["lat"]) <= COORD_TOLERANCE_DEG) & (F.abs(s["lon"] - r["lon"]) <= COORD_TOLERANCE_DEG)
    begin = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("held"))

    def step(state: Column, r: Column) -> Column:
        after = F.filter(F.sequence(F.lit(0), F.size("stops") - 1), lambda k: (k >= state["next"]) & F.coalesce(same(F.get("stops", k), r), F.lit(False)))
        k = F.get(after, F.lit(0))  # null once a place is no stop: everything after it is null as well
        return F.struct((k + 1).alias("next"), F.concat(state["held"], F.array(k)).alias("held"))

    held = F.when(F.size("stops") > 0, F.aggregate("routed", begin, step)["held"]).otherwise(F.transform("routed", lambda r: F.lit(None).cast("int")))
    rows = patterns.withColumn("__held", held)
    lost = F.exists("__held", lambda k: k.isNull())
    refused = F.when(F.size("routed") != F.size("offsets"), "counts_differ").when(lost, "no_stop_of_the_pattern")
    found = F.transform(F.arrays_zip("__held", "offsets"), lambda z: F.struct(z["__held"].alias("index"), F.get("stops", z["__held"])["stop"].cast("string").alias("stop"), z["offsets"].cast("double").alias("offset")))
    return rows.withColumns({"refused": refused, "occurrences": F.when(refused.isNull(), found.cast(OCCURRENCES))}).drop("__held")


def aligned(mappings: DataFrame) -> DataFrame:
    """``mappings`` with ``offsets``, an offset (or null) for each stop of the pattern, or the ``refused`` reason: the first rule that is broken.

    mappings: pattern_id, stops (array of codes), length (or null), and of the mapping: version, mapped_id, mapped_count, occurrences (all null: there is none).
    """
    occ, n = F.coalesce("occurrences", F.array().cast(OCCURRENCES)), F.size("stops")
    before = lambda k, name: F.get(occ, k - 1)[name]

    def broken(o: Column, k: Column) -> Column:
        index, offset = o["index"], o["offset"]
        out = index.isNull() | (index < 0) | (index >= n) | F.coalesce(index <= before(k, "index"), F.lit(False))
        unordered = offset.isNull() | F.isnan(offset) | (F.abs(offset) == float("inf")) | F.coalesce(offset < before(k, "offset"), F.lit(False))
        return (
            F.when(out, "index_out_of_order").when(~F.get("stops", index).eqNullSafe(o["stop"]), "names_another_stop").when(unordered, "offset_out_of_order").when(F.coalesce(offset > F.col("length") + 1.0, F.lit(False)), "beyond_the_road")
        )

    first = F.get(F.filter(F.transform(occ, broken), lambda r: r.isNotNull()), F.lit(0))
    refused = (
        F.when(F.col("version").isNull() & F.col("mapped_id").isNull() & F.col("occurrences").isNull(), "no_mapping").when(~F.col("version").eqNullSafe(F.lit(MAPPING_VERSION)), "another_version")
        .when(~F.col("mapped_id").eqNullSafe(F.col("pattern_id")), "another_pattern").when(~F.col("mapped_count").eqNullSafe(n), "another_stop_count").when(first.isNotNull(), first).when(F.size(occ) == 0, "places_no_stop")
    )
    offsets = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.filter(occ, lambda o: o["index"] == i), F.lit(0))["offset"]))
    return mappings.withColumn("refused", refused).withColumn("offsets", F.when(F.col("refused").isNull(), offsets))


def points_along(vertices: DataFrame, offsets: DataFrame) -> DataFrame:
    """``offsets`` (pattern_id, offset and what else) with the place at_lat, at_lon of the road there; its ends beyond them. vertices: as ``with_lengths`` gives them."""
    order = W.partitionBy("pattern_id").orderBy("vertex")
    steps = vertices.select("pattern_id", F.col("along").alias("offset"), "vertex", "lat", "lon", F.lag("along").over(order).alias("a"), F.lag("lat").over(order).alias("a_lat"), F.lag("lon").over(order).alias("a_lon"))
    # of vertices at one place the first, as a walk along the road meets it
    first = steps.groupBy("pattern_id", "offset").agg(F.min(F.struct("vertex", "lat", "lon", "a", "a_lat", "a_lon")).alias("s"))
    ends = vertices.groupBy("pattern_id").agg(F.max(F.struct("vertex", "lat", "lon")).alias("end"))
    rows = offsets.withColumn("__asked", F.col("offset")).withColumn("offset", F.greatest(F.col("offset").cast("double"), F.lit(0.0)))
    met = asof(rows, first, ["pattern_id"], "offset", ["s"], forward=True).join(ends, "pattern_id")
    s = F.col("hit_s")
    part = F.when(F.col("hit_offset") == s["a"], 0.0).otherwise((F.col("offset") - s["a"]) / (F.col("hit_offset") - s["a"]))
    at = lambda c: F.when(s.isNull(), F.col("end")[c]).when(s["a"].isNull(), s[c]).otherwise(s[f"a_{c}"] + part * (s[c] - s[f"a_{c}"]))
    return met.select(*[F.col("__asked").alias("offset") if c == "offset" else F.col(c) for c in offsets.columns], at("lat").alias("at_lat"), at("lon").alias("at_lon"))


def geometry_check(mappings: DataFrame, vertices: DataFrame, stops: DataFrame) -> DataFrame:
    """(pattern_id, checked, worst_m, passed): how far mapped stops with a published place lie from the road at their own offsets. mappings: pattern_id, occurrences; stops: stop, lat, lon."""
    occ = mappings.select("pattern_id", F.explode("occurrences").alias("o")).select("pattern_id", F.col("o.index").alias("index"), F.col("o.stop").alias("stop"), F.col("o.offset").alias("offset"))
    placed = occ.join(stops.select(F.col("stop").cast("string").alias("stop"), F.col("lat").alias("stop_lat"), F.col("lon").alias("stop_lon")).filter("stop_lat IS NOT NULL AND stop_lon IS NOT NULL"), "stop")
    far = metres(F.col("at_lat"), F.col("at_lon"), F.col("stop_lat"), F.col("stop_lon"), MEAN_RADIUS_M)
    per = points_along(with_lengths(vertices, ["pattern_id"]), placed).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("checked"), F.max(far).alias("worst_m"))
    rows = mappings.filter("occurrences IS NOT NULL").select("pattern_id").join(per, "pattern_id", "left")
    worst = F.coalesce("worst_m", F.lit(0.0))
    return rows.select("pattern_id", F.coalesce("checked", F.lit(0)).alias("checked"), worst.alias("worst_m"), (worst <= GEOMETRY_TOLERANCE_M).alias("passed"))


def offsets_from(reports: DataFrame, vertices: DataFrame) -> DataFrame:
    """``reports`` (pattern_id, lat, lon and what else) with ``off_m``, metres to the nearest point of their pattern's road; null where it has no segment.

    Places that repeat are measured once and joined back.
    """
    once = reports.select("pattern_id", "lat", "lon").filter("lat IS NOT NULL AND lon IS NOT NULL").distinct()
    return reports.join(_measured(once, vertices), ["pattern_id", "lat", "lon"], "left")


def _measured(places: DataFrame, vertices: DataFrame) -> DataFrame:
    """Distinct ``places`` (pattern_id, lat, lon and what else) with ``off_m``; those whose pattern has no segment are left out."""
    ends = _segments(vertices)
    near = places.select("*", *_cell_of("lat", "lon")).join(_in_cells(ends, REACH_M, 85.0), ["pattern_id", "__y", "__x"])
    found = near.groupBy(*places.columns).agg(F.min(_off()).alias("off_m")).filter(F.col("off_m") <= REACH_M)
    rest = places.join(found, ["pattern_id", "lat", "lon"], "left_anti").join(ends, "pattern_id").groupBy(*places.columns).agg(F.min(_off()).alias("off_m"))
    return found.unionByName(rest)


def _segments(vertices: DataFrame) -> DataFrame:
    """The segments of roads: pattern_id, a_lat, a_lon, b_lat, b_lon."""
    order = W.partitionBy("pattern_id").orderBy("vertex")
    ends = vertices.select("pattern_id", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.lead("lat").over(order).alias("b_lat"), F.lead("lon").over(order).alias("b_lon"))
    return ends.filter("b_lat IS NOT NULL")


def _cell_of(lat: str, lon: str) -> list[Column]:
    """The cell of a place: __y, __x. Cells are as high as CELL_M, and as wide in degrees of longitude."""
    return [F.floor(F.col(c) / (CELL_M / PLAIN_DEGREE_M)).alias(name) for c, name in ((lat, "__y"), (lon, "__x"))]


def _in_cells(ends: DataFrame, reach_m: float, most_lat: float) -> DataFrame:
    """Segments with each cell (__y, __x) that holds places within ``reach_m`` of them, up to ``most_lat`` north or south."""
    dy, reach = CELL_M / PLAIN_DEGREE_M, reach_m / PLAIN_DEGREE_M
    # a degree of longitude is as long as at the latitude nearest a pole, or longer
    shrink = F.cos(F.radians(F.least(F.lit(most_lat), F.greatest(F.abs("a_lat"), F.abs("b_lat")) + reach)))
    cell = lambda x: F.floor(x / dy)
    ys = F.sequence(cell(F.least("a_lat", "b_lat") - reach), cell(F.greatest("a_lat", "b_lat") + reach))
    xs = F.sequence(cell(F.least("a_lon", "b_lon") - reach / shrink), cell(F.greatest("a_lon", "b_lon") + reach / shrink))
    return ends.withColumn("__y", F.explode(ys)).withColumn("__x", F.explode(xs))


def _off(lat: Column | None = None, lon: Column | None = None) -> Column:
    """Metres from (lat, lon), columns of these names if not given, to the segment a, b on a plane with the scale at the point."""
    lat, lon = (F.col(name) if c is None else c for c, name in ((lat, "lat"), (lon, "lon")))
    kx, ky = F.cos(F.radians(lat)) * PLAIN_DEGREE_M, F.lit(PLAIN_DEGREE_M)
    dx, dy, px, py = (F.col("b_lon") - F.col("a_lon")) * kx, (F.col("b_lat") - F.col("a_lat")) * ky, (lon - F.col("a_lon")) * kx, (lat - F.col("a_lat")) * ky
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / F.when(square == 0, 1.0).otherwise(square))))
    return F.hypot(px - t * dx, py - t * dy)


def validated(reports: DataFrame, vertices: DataFrame) -> DataFrame:
    """(pattern_id, reports, p50, p95, within30, status, reason) of every road: whether its own reports vouch for it."""
    places = reports.filter("lat IS NOT NULL AND lon IS NOT NULL").groupBy("pattern_id", "lat", "lon").agg(F.count(F.lit(1)).alias("n"))
    # counted by distance once, for all that is asked of it
    off = settled(_measured(places, vertices).filter("off_m IS NOT NULL").groupBy("pattern_id", "off_m").agg(F.sum("n").alias("n")))
    at = stats.quantiles(off, ["pattern_id"], "off_m", {"p50": ("linear", 0.5), "p95": ("linear", 0.95)}, "n").drop("n")
    per = off.groupBy("pattern_id").agg(F.sum("n").alias("reports"), (F.sum(F.when(F.col("off_m") <= WITHIN_M, F.col("n")).otherwise(0)) / F.sum("n")).alias("within30"))
    roads = vertices.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("points"))
    rows = roads.join(per, "pattern_id", "left").join(at, "pattern_id", "left").withColumn("reports", F.coalesce("reports", F.lit(0)))
    reason = F.when(F.col("points") < 2, "no_path").when(F.col("reports") < SHAPE_MIN_REPORTS, "too_few_reports").when(F.col("p95") > SHAPE_P95_M, "too_far")
    return rows.select("pattern_id", "reports", "p50", "p95", "within30", F.when(reason.isNull(), "accepted").otherwise("rejected").alias("status"), reason.alias("reason"))


def reports_by_pattern(reports: DataFrame, lines: DataFrame) -> DataFrame:
    """``reports`` that the matcher places on a pattern, with its ``pattern_id``; equal reports of a day are matched once and joined back.

    reports: route, operator, direction, destination, lat, lon, day; lines: as ``matching.by_line`` gives them.
    """
    same = ["route", "operator", "direction", "destination", "lat", "lon", "day"]
    once = match(reports.select(*same).distinct(), lines).filter("matched").select(*[F.col(c).alias(f"__{c}") for c in same], "pattern_id")
    on = F.lit(True)
    for c in same:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return reports.join(once, on).drop(*[f"__{c}" for c in same])


def shared_roads(sets: DataFrame, vertices: DataFrame, tolerance_m: float = SHARED_M) -> DataFrame:
    """(set_id, piece, from_m, to_m): the stretches of a set's checked road that all its other roads come within ``tolerance_m`` of, in metres along it; the whole road where there is no other.

    sets: set_id, pattern_id, checked (one true in each set); vertices: pattern_id, vertex, lat, lon. Each vertex of the checked road asks every other whether one of its
    segments is near enough, and takes the first that is; no distance is ranked. Stretches are runs of shared vertices.
    """
    others = sets.filter(~F.col("checked")).select("set_id", F.col("pattern_id").alias("other"))
    asks = sets.filter("checked").select("set_id", "pattern_id").join(others, "set_id", "left").withColumn("others", F.count("other").over(W.partitionBy("set_id")))
    vertices = vertices.filter("pattern_id IS NOT NULL")  # said once, so that both uses of the roads read one shuffle
    place = F.row_number().over(W.partitionBy("pattern_id").orderBy("vertex"))
    road = with_lengths(vertices, ["pattern_id"]).withColumn("place", place)
    cell = dict(zip(("at_y", "at_x"), _cell_of("lat", "lon"), strict=True))
    asked = road.join(asks, "pattern_id").select("set_id", "place", "along", "others", "other", F.col("lat").alias("at_lat"), F.col("lon").alias("at_lon"), *[c.alias(name) for name, c in cell.items()])
    of = {name: F.col(name).outer() for name in ("other", "at_y", "at_x", "at_lat", "at_lon")}  # no names that a segment has
    near = _in_cells(_segments(vertices), tolerance_m * 1.001, 89.999).filter((F.col("pattern_id") == of["other"]) & (F.col("__y") == of["at_y"]) & (F.col("__x") == of["at_x"]) & (_off(of["at_lat"], of["at_lon"]) <= tolerance_m))
    # dealt by set once, which is how everything after it is grouped and ordered
    met = asked.filter(F.col("other").isNull() | near.exists()).select("set_id", "place", "along", "others", "other").repartition("set_id")
    shared = met.groupBy("set_id", "place").agg(F.count("other").alias("met"), F.max("others").alias("others"), F.max("along").alias("along")).filter("met = others")
    runs = shared.withColumn("run", F.col("place") - F.row_number().over(W.partitionBy("set_id").orderBy("place")))
    runs = runs.groupBy("set_id", "run").agg(F.min("along").alias("from_m"), F.max("along").alias("to_m")).filter("to_m > from_m")
    return runs.select("set_id", F.row_number().over(W.partitionBy("set_id").orderBy("from_m")).alias("piece"), "from_m", "to_m")
