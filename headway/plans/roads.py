"""Roads of patterns: a supplier's line items are the vertices of its road, orders the reports on it; an order's line items are a pattern's stops."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.operators import shapes
from headway.plans.base import lineitem, orders, registering
from headway.plans.matching import _MADE, _lines, _vehicles
from headway.session import table

QUERIES, ORACLES, query = registering()

_SORTED = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax"
_ROAD = f"""v AS (SELECT l_suppkey AS pattern_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_SORTED}) - 1 AS vertex, 53.4 + (l_partkey % 50) / 111195.0 AS lat,
  -2.3 + (row_number() OVER (PARTITION BY l_suppkey ORDER BY {_SORTED}) - 1) * 30 / 66000.0 AS lon FROM lineitem)"""
_STEP = "sqrt(power(radians({a}.lon - {b}.lon) * cos(radians(({a}.lat + {b}.lat) / 2)), 2) + power(radians({a}.lat - {b}.lat), 2)) * 6371008.8"


def _vertices(spark, sf_dir):
    at = F.row_number().over(W.partitionBy("l_suppkey").orderBy(*_SORTED.split(", "))) - 1
    x = lineitem(spark, sf_dir).withColumn("vertex", at)
    return x.select(F.col("l_suppkey").alias("pattern_id"), "vertex", (F.lit(53.4) + F.col("l_partkey") % 50 / 111195.0).alias("lat"), (F.lit(-2.3) + F.col("vertex") * 30 / 66000.0).alias("lon"))


def _reports(spark, sf_dir):
    n = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey").alias("n"))  # one row
    k = F.col("o_orderkey")
    o = orders(spark, sf_dir).crossJoin(F.broadcast(n))
    lat = F.lit(53.4) + (k % 61 - 5 + F.when(k % 50 == 0, 4000).otherwise(0)) / 111195.0
    return o.select((F.col("o_custkey") % F.col("n") + 1).alias("pattern_id"), k.alias("report"), lat.alias("lat"), (F.lit(-2.3) + k * 7 % 20000 / 66000.0).alias("lon"))


_OFF = f"""WITH {_ROAD}, s AS (SELECT pattern_id, lat AS ay, lon AS ax, lead(lat) OVER w AS by_, lead(lon) OVER w AS bx FROM v WINDOW w AS (PARTITION BY pattern_id ORDER BY vertex)),
r AS (SELECT o_custkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS pattern_id, o_orderkey AS report, 53.4 + (o_orderkey % 61 - 5 + CASE WHEN o_orderkey % 50 = 0 THEN 4000 ELSE 0 END) / 111195.0 AS lat, -2.3 + (o_orderkey * 7 % 20000) / 66000.0 AS lon FROM orders),
m AS (SELECT r.pattern_id, report, (bx - ax) * cos(radians(lat)) * 111195.0 AS dx, (by_ - ay) * 111195.0 AS dy, (lon - ax) * cos(radians(lat)) * 111195.0 AS px, (lat - ay) * 111195.0 AS py FROM r JOIN s ON r.pattern_id = s.pattern_id WHERE bx IS NOT NULL),
t AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0, least(1, (px * dx + py * dy) / (dx * dx + dy * dy))) END AS t FROM m),
d AS (SELECT pattern_id, report, min(sqrt(power(px - t * dx, 2) + power(py - t * dy, 2))) AS off_m FROM t GROUP BY 1, 2)"""


@query(f"{_OFF} SELECT pattern_id, report, round(off_m, 4) AS off_m FROM d")
def report_offsets(spark, sf_dir):
    """Metres from each report to the nearest point of its pattern's road."""
    return shapes.offsets_from(_reports(spark, sf_dir), _vertices(spark, sf_dir)).filter("off_m IS NOT NULL").select("pattern_id", "report", F.round("off_m", 4).alias("off_m"))


@query(
    f"""{_OFF}, g AS (SELECT pattern_id, count(*) AS n, quantile_cont(off_m, 0.5) AS p50, quantile_cont(off_m, 0.95) AS p95, avg(CASE WHEN off_m <= 30 THEN 1.0 ELSE 0.0 END) AS w FROM d GROUP BY 1), p AS (SELECT pattern_id, count(*) AS points FROM v GROUP BY 1),
h AS (SELECT p.pattern_id, coalesce(n, 0) AS reports, p50, p95, w, CASE WHEN points < 2 THEN 'no_path' WHEN coalesce(n, 0) < 30 THEN 'too_few_reports' WHEN p95 > 35 THEN 'too_far' END AS reason FROM p LEFT JOIN g USING (pattern_id))
SELECT pattern_id, reports, round(p50, 4) AS p50, round(p95, 4) AS p95, round(w, 6) AS within30, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason FROM h"""
)
def shape_validation(spark, sf_dir):
    """Whether the reports on each pattern vouch for its road."""
    found = shapes.validated(_reports(spark, sf_dir), _vertices(spark, sf_dir))
    return found.select("pattern_id", "reports", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), F.round("within30", 6).alias("within30"), "status", "reason")


@query(f"WITH {_MADE} SELECT chosen AS pattern_id, CAST(count(*) * 3 AS BIGINT) AS reports FROM m WHERE reason IS NULL GROUP BY 1")
def reports_by_pattern(spark, sf_dir):
    """Reports by the pattern they are matched to; every vehicle reports three times from one place and is matched once."""
    v = _vehicles(spark, sf_dir).withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return shapes.reports_by_pattern(v, _lines(spark, sf_dir)).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("reports"))


_STOPS = f"""c AS (SELECT l_orderkey AS pattern_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_discount, l_tax) - 1 AS index, count(*) OVER (PARTITION BY l_orderkey) AS n, l_suppkey AS stop FROM lineitem)"""


def _stops(spark, sf_dir):
    """pattern_id and stops: an array of stop, lat, lon; suppliers of one nation have no place."""
    s = F.col("s_suppkey")
    placed = F.col("s_nationkey") != 3
    at = table(spark, sf_dir, "supplier").select(s.alias("l_suppkey"), F.when(placed, 53.0 + F.floor(s / 100) * 0.001).alias("lat"), F.when(placed, -2.0 + s % 100 * 0.001).alias("lon"))
    order = ("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_discount", "l_tax")
    x = lineitem(spark, sf_dir).join(at, "l_suppkey").groupBy(F.col("l_orderkey").alias("pattern_id"))
    x = x.agg(F.array_sort(F.collect_list(F.struct(*order, F.col("l_suppkey").alias("stop"), "lat", "lon"))).alias("x"))
    return x.select("pattern_id", F.transform("x", lambda c: F.struct(c["stop"].alias("stop"), c["lat"].alias("lat"), c["lon"].alias("lon"))).alias("stops"))


@query(
    f"""WITH {_STOPS}, w AS (SELECT DISTINCT pattern_id, n, unnest(range(0, greatest(n - 1, 0), 3)) AS a FROM c)
SELECT w.pattern_id, CAST(a // 3 AS INTEGER) AS place, string_agg(CAST(stop AS VARCHAR), ',' ORDER BY index) AS stops FROM w JOIN c ON w.pattern_id = c.pattern_id AND index BETWEEN a AND a + 3 GROUP BY 1, 2"""
)
def router_windows(spark, sf_dir):
    """Stops in windows of at most four, each starting where the last ended."""
    stops = F.transform("stops", lambda c: c["stop"].cast("string"))
    w = _stops(spark, sf_dir).select("pattern_id", F.posexplode(shapes.windows(stops, 4)).alias("place", "w"))
    return w.select("pattern_id", "place", F.array_join("w", ",").alias("stops"))


@query(
    f"""WITH {_STOPS}, p AS (SELECT c.*, s_nationkey <> 3 AS placed, row_number() OVER (PARTITION BY pattern_id, s_nationkey <> 3 ORDER BY index) - 1 AS k FROM c JOIN supplier ON stop = s_suppkey),
q AS (SELECT pattern_id, string_agg(CASE WHEN placed THEN index || ':' || stop || ':' || k * 100 END, ',' ORDER BY index) AS held, count(*) FILTER (WHERE placed) AS n FROM p GROUP BY 1)
SELECT pattern_id, CASE WHEN o_orderstatus = 'P' THEN 'no_stop_of_the_pattern' WHEN o_orderpriority = '1-URGENT' THEN 'counts_differ' END AS refused, CASE WHEN o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT' THEN coalesce(held, '') END AS occurrences
FROM q JOIN orders ON o_orderkey = pattern_id"""
)
def stop_mappings(spark, sf_dir):
    """Routed places, a metre off their stops, back to the pattern's stops; a place elsewhere, or one offset too few, refuses the mapping."""
    elsewhere = F.array(F.struct(F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon")))
    routed = F.transform(F.filter("stops", lambda s: s["lat"].isNotNull()), lambda s: F.struct((s["lat"] + 1e-6).alias("lat"), (s["lon"] - 1e-6).alias("lon")))
    x = _stops(spark, sf_dir).join(orders(spark, sf_dir).select(F.col("o_orderkey").alias("pattern_id"), "o_orderstatus", "o_orderpriority"), "pattern_id")
    x = x.withColumn("routed", F.when(F.col("o_orderstatus") == "P", F.concat(routed, elsewhere)).otherwise(routed))
    few = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") != "P")
    x = x.withColumn("offsets", F.transform(F.when(few, F.concat("routed", elsewhere)).otherwise(F.col("routed")), lambda r, k: k * 100.0))
    words = F.array_join(F.transform("occurrences", lambda o: F.concat_ws(":", o["index"], o["stop"], o["offset"].cast("int"))), ",")
    return shapes.mapped(x).select("pattern_id", "refused", words.alias("occurrences"))


@query(
    f"""WITH {_STOPS}, p AS (SELECT pattern_id, any_value(n) AS n, list(stop ORDER BY index) AS stops FROM c GROUP BY 1)
SELECT pattern_id, CASE pattern_id % 11 WHEN 0 THEN 'no_mapping' WHEN 1 THEN 'another_version' WHEN 2 THEN 'another_pattern' WHEN 3 THEN 'another_stop_count' WHEN 4 THEN 'index_out_of_order'
  WHEN 5 THEN 'names_another_stop' WHEN 6 THEN CASE WHEN n > 1 THEN 'offset_out_of_order' END WHEN 7 THEN CASE WHEN n > 3 THEN 'beyond_the_road' END WHEN 8 THEN 'places_no_stop' END AS refused,
  CASE WHEN pattern_id % 11 > 8 OR (pattern_id % 11 = 6 AND n = 1) OR (pattern_id % 11 = 7 AND n <= 3) THEN array_to_string(list_transform(range(n), lambda k: CASE WHEN pattern_id % 11 = 9 AND k % 2 = 1 THEN '-' ELSE CAST(k * 100 AS VARCHAR) END), ',') END AS offsets FROM p"""
)
def aligned_offsets(spark, sf_dir):
    """A published mapping on the pattern's own stops, or the first of nine rules that it breaks."""
    k, kind = F.col("pattern_id"), F.col("pattern_id") % 11
    x = _stops(spark, sf_dir).withColumn("stops", F.transform("stops", lambda s: s["stop"].cast("string")))
    every = F.transform("stops", lambda s, i: F.struct(F.when(kind == 4, i - 1).otherwise(i).cast("int").alias("index"), F.when(kind == 5, "x").otherwise(s).alias("stop"), F.when(kind == 6, -i * 100.0).otherwise(i * 100.0).alias("offset")))
    some = F.when(kind == 9, F.filter(every, lambda o: o["index"] % 2 == 0)).when(kind == 8, F.filter(every, lambda o: F.lit(False))).otherwise(every)
    held = kind > 0
    x = x.withColumns({
        "version": F.when(held, F.when(kind == 1, 1).otherwise(2)), "mapped_id": F.when(held, F.when(kind == 2, k + 1).otherwise(k)), "mapped_count": F.when(held, F.size("stops") + F.when(kind == 3, 1).otherwise(0)),
        "occurrences": F.when(held, some.cast(shapes.OCCURRENCES)), "length": F.when(kind == 7, 200.0),
    })
    words = F.array_join(F.transform("offsets", lambda o: F.coalesce(o.cast("int").cast("string"), F.lit("-"))), ",")
    return shapes.aligned(x).select("pattern_id", "refused", words.alias("offsets"))


@query(
    f"""WITH {_ROAD}, s AS (SELECT a.*, coalesce({_STEP.format(a='a', b='b')}, 0) AS step, b.lat AS p_lat, b.lon AS p_lon FROM v a LEFT JOIN v b ON a.pattern_id = b.pattern_id AND a.vertex = b.vertex + 1),
l AS (SELECT *, sum(step) OVER (PARTITION BY pattern_id ORDER BY vertex) AS along FROM s), e AS (SELECT pattern_id, max_by(lat, vertex) AS e_lat, max_by(lon, vertex) AS e_lon FROM v GROUP BY 1),
o AS (SELECT o_custkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS pattern_id, o_orderkey AS id, CAST(o_orderkey * 13 % 30000 - 50 AS DOUBLE) AS off, 53.4 + (o_orderkey % 40) / 111195.0 AS s_lat, -2.3 + (o_orderkey * 13 % 30000 - 50) / 66000.0 AS s_lon FROM orders),
f AS (SELECT id, o.pattern_id, off, s_lat, s_lon, vertex, lat, lon, along, step, p_lat, p_lon, row_number() OVER (PARTITION BY id ORDER BY vertex) AS k FROM o LEFT JOIN l ON o.pattern_id = l.pattern_id AND along >= greatest(off, 0)),
g AS (SELECT f.pattern_id, s_lat, s_lon, CASE WHEN vertex IS NULL THEN e_lat WHEN p_lat IS NULL THEN lat ELSE p_lat + CASE WHEN step = 0 THEN 0 ELSE (greatest(off, 0) - (along - step)) / step END * (lat - p_lat) END AS lat,
  CASE WHEN vertex IS NULL THEN e_lon WHEN p_lon IS NULL THEN lon ELSE p_lon + CASE WHEN step = 0 THEN 0 ELSE (greatest(off, 0) - (along - step)) / step END * (lon - p_lon) END AS lon FROM f JOIN e ON f.pattern_id = e.pattern_id WHERE k = 1),
h AS (SELECT pattern_id, sqrt(power(radians(s_lon - lon) * cos(radians((s_lat + lat) / 2)), 2) + power(radians(s_lat - lat), 2)) * 6371008.8 AS m FROM g)
SELECT pattern_id, count(*) AS checked, round(max(m), 3) AS worst_m, max(m) <= 30 AS passed FROM h GROUP BY 1"""
)
def geometry_checks(spark, sf_dir):
    """How far mapped stops lie from the road at their own offsets; each order is a stop of one road."""
    n = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey").alias("n"))  # one row
    k = F.col("o_orderkey")
    o = orders(spark, sf_dir).crossJoin(F.broadcast(n)).withColumns({"pattern_id": F.col("o_custkey") % F.col("n") + 1, "off": (k * 13 % 30000 - 50).cast("double")})
    road = _vertices(spark, sf_dir)
    o = o.join(road.select("pattern_id").distinct(), "pattern_id", "left_semi")
    mappings = o.groupBy("pattern_id").agg(F.collect_list(F.struct(F.lit(0).alias("index"), k.cast("string").alias("stop"), F.col("off").alias("offset"))).cast(shapes.OCCURRENCES).alias("occurrences"))
    stops = o.select(k.alias("stop"), (F.lit(53.4) + k % 40 / 111195.0).alias("lat"), (F.lit(-2.3) + F.col("off") / 66000.0).alias("lon"))
    return shapes.geometry_check(mappings, road, stops).select("pattern_id", "checked", F.round("worst_m", 3).alias("worst_m"), "passed")
