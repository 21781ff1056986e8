"""Boards and journeys as a passenger meets them: orders stand for patterns, line items for their calls, suppliers for stops."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.functions import geo, text, time
from headway.functions.rules import RULE, valid_on
from headway.operators import boards, planner
from headway.plans.base import events, lineitem, orders, registering
from headway.session import table

QUERIES, ORACLES, query = registering()

_CALLS = "c AS (SELECT l_orderkey AS pattern_id, l_suppkey AS stop, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_quantity DESC) - 1 AS position, CASE WHEN l_quantity > 5 THEN CAST(l_quantity AS INTEGER) * 20 END AS seconds FROM lineitem)"
_BOARD = f"""{_CALLS}, n AS (SELECT *, max(position) OVER (PARTITION BY pattern_id) AS last FROM c),
b AS (SELECT stop, pattern_id, position, o_orderstatus AS rule, o_orderkey % 90000 + CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN position < 3 THEN position * 90 + 5 ELSE seconds END ELSE seconds END AS second FROM n JOIN orders ON pattern_id = o_orderkey WHERE position < last)"""


def _calls(spark, sf_dir):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", F.desc("l_quantity"))
    seconds = F.when(F.col("l_quantity") > 5, F.col("l_quantity").cast("int") * 20)
    return lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("pattern_id"), F.col("l_suppkey").alias("stop"), (F.row_number().over(w) - 1).alias("position"), seconds.alias("seconds"))


def _board(spark, sf_dir):
    key = F.col("o_orderkey")
    timing = F.when(key % 2 == 0, F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: k * 90 + 5))
    o = orders(spark, sf_dir).select(key.alias("pattern_id"), (key % 90000).alias("origin_second"), F.col("o_orderstatus").alias("rule"), timing.alias("timing"))
    return boards.board(o.select("pattern_id"), _calls(spark, sf_dir), o)


@query(f"WITH {_BOARD} SELECT stop, pattern_id, CAST(position AS INTEGER) AS position, rule, second FROM b WHERE second IS NOT NULL")
def stop_departures(spark, sf_dir):
    """Every departure at every stop but its pattern's last, by the journey's own timing or else the pattern's."""
    return _board(spark, sf_dir)


@query(
    f"""WITH {_BOARD}, d AS (SELECT DISTINCT stop, rule, second FROM b WHERE second IS NOT NULL), f AS (SELECT *, CASE WHEN rule IS DISTINCT FROM lag(rule) OVER (PARTITION BY stop ORDER BY second, rule) THEN 1 ELSE 0 END AS changed,
  second - lag(second) OVER (PARTITION BY stop ORDER BY second, rule) AS gap FROM d),
g AS (SELECT *, sum(changed) OVER (PARTITION BY stop ORDER BY second, rule ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT stop, CAST(run AS BIGINT) AS run, min(rule) AS rule, min(second) AS first, coalesce(string_agg(CASE WHEN changed = 0 THEN CAST(gap AS VARCHAR) END, ',' ORDER BY second), '') AS gaps FROM g GROUP BY 1, 2"""
)
def board_islands(spark, sf_dir):
    """Runs of consecutive departures with one rule, as first time and gaps."""
    d = _board(spark, sf_dir).select("stop", "rule", "second").distinct()
    runs = boards.islands_of_rules(d, ["stop"], "second", ["rule"])
    return runs.select("stop", F.col("run").cast("long").alias("run"), "rule", "first", F.array_join(F.transform("gaps", lambda g: g.cast("string")), ",").alias("gaps"))


@query(
    f"""WITH {_BOARD}, r AS (SELECT *, unnest([DATE '1997-03-04', DATE '1997-03-05', DATE '1997-03-06']) AS day FROM b WHERE second IS NOT NULL),
k AS (SELECT *, pattern_id % 4 > 0 AS known, (isodow(day) - 1 - pattern_id % 7 + 7) % 7 < 4 AS runs, epoch(day) + second - epoch(TIMESTAMP '1997-03-05 23:30:00') AS ahead FROM r WHERE day >= DATE '1997-03-05' OR second >= 86400),
p AS (SELECT *, row_number() OVER (PARTITION BY stop ORDER BY ahead, pattern_id, position, second) AS place FROM k WHERE (runs OR NOT known) AND ahead BETWEEN -60 AND 10800)
SELECT stop, pattern_id, day AS service_day, known AS day_known, second FROM p WHERE place <= 8"""
)
def departures_tonight(spark, sf_dir):
    """The next eight departures over three service days; unreadable rules stay, marked."""
    key, empty = F.col("pattern_id"), F.lit(None).cast(RULE)
    days = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: ((key + k) % 7).cast("int"))
    rules = F.array(F.struct(days.alias("days"), *[empty[n].alias(n) for n in ("holidaysOnly", "alsoOn", "notOn", "serviced", "bankHolidays")]))
    now = F.lit("1997-03-05 23:30:00").cast("timestamp")
    return boards.departures_at(_board(spark, sf_dir), F.when(key % 4 > 0, rules), now).select("stop", "pattern_id", "service_day", "day_known", "second")


_NEAR = "f AS (SELECT s_suppkey AS stop, s_acctbal / 20 AS walk FROM supplier WHERE s_nationkey < 6), t AS (SELECT s_suppkey AS stop, s_acctbal / 15 AS walk FROM supplier WHERE s_nationkey > 15)"


@query(
    f"""WITH {_CALLS}, {_NEAR}, x AS (SELECT a.pattern_id, a.stop AS board, b.stop AS alight, a.position AS board_at, b.position AS alight_at, f.walk + t.walk AS walk FROM c a JOIN f USING (stop) JOIN c b ON a.pattern_id = b.pattern_id AND a.position < b.position JOIN t ON b.stop = t.stop),
p AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY walk, board_at, alight_at) AS k FROM x WHERE walk < 700),
q AS (SELECT *, row_number() OVER (PARTITION BY board, alight ORDER BY walk, pattern_id) AS j, count(*) OVER (PARTITION BY board, alight) AS family FROM p WHERE k = 1)
SELECT pattern_id, board, alight, round(walk, 6) AS walk, family FROM q WHERE j = 1 ORDER BY q.walk, pattern_id LIMIT 24"""
)
def direct_choices(spark, sf_dir):
    """The best pair of stops of each pattern, one pattern per pair with how many share it, better than walking."""
    s = table(spark, sf_dir, "supplier")
    near = lambda rows, part: rows.select(F.col("s_suppkey").alias("stop"), (F.col("s_acctbal") / part).alias("walk_m"))
    out = planner.direct_options(_calls(spark, sf_dir), near(s.filter("s_nationkey < 6"), 20), near(s.filter("s_nationkey > 15"), 15), 700.0)
    return out.select("pattern_id", "board", "alight", F.round("walk", 6).alias("walk"), "family")


_TIMED = """o AS (SELECT s_suppkey AS option, abs(s_acctbal) / 10 AS walk FROM supplier), r AS (SELECT *, CASE WHEN floor(walk * 1.3 / 80.0 * 60 + 0.5) < 60 THEN 30000 - 60 ELSE 30000 + floor(walk * 1.3 / 80.0 * 60 + 0.5) END AS ready FROM o),
d AS (SELECT DISTINCT l_suppkey AS option, CAST(l_orderkey * 37 % 200000 AS BIGINT) AS depart_s, CAST(l_orderkey * 37 % 200000 + l_quantity * 60 AS BIGINT) AS arrive_s FROM lineitem WHERE l_suppkey % 5 > 0 OR l_orderkey * 37 % 200000 > 60000),
m AS (SELECT *, min(depart_s) OVER (PARTITION BY option) > ready + 10800 AS later FROM r JOIN d USING (option) WHERE depart_s BETWEEN ready AND ready + 93600),
w AS (SELECT * FROM m WHERE later OR depart_s <= ready + 10800),
u AS (SELECT *, min(arrive_s) OVER (PARTITION BY option ORDER BY depart_s, arrive_s DESC ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS least FROM w),
p AS (SELECT *, row_number() OVER (PARTITION BY option ORDER BY depart_s) AS place FROM u WHERE least IS NULL OR arrive_s < least),
j AS (SELECT option, depart_s, arrive_s, later, place FROM p WHERE place <= CASE WHEN later THEN 1 ELSE 6 END)"""


def _timed(spark, sf_dir):
    o = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("option"), (F.abs("s_acctbal") / 10).alias("walk_m"))
    depart = F.col("l_orderkey") * 37 % 200000
    d = lineitem(spark, sf_dir).filter((F.col("l_suppkey") % 5 > 0) | (depart > 60000))
    d = d.select(F.col("l_suppkey").alias("option"), depart.alias("depart_s"), (depart + F.col("l_quantity") * 60).cast("long").alias("arrive_s")).distinct()
    return planner.time_direct(o, d, F.lit(30000)).select("option", "depart_s", "arrive_s", "later", "place")


@query(f"WITH {_TIMED} SELECT option, depart_s, arrive_s, later, CAST(place AS INTEGER) AS place FROM j")
def timed_choices(spark, sf_dir):
    """Departures of each direct option that can be caught and that no later one beats, or the first later on."""
    return _timed(spark, sf_dir)


@query(
    f"""WITH {_TIMED}, a AS (SELECT option, option % 7 AS request, option % 3 AS bus, CASE WHEN option % 4 > 0 THEN arrive_s END AS arrive_s, CASE WHEN option % 4 > 0 THEN depart_s END AS leave_s, option AS place FROM j WHERE place = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY request, bus, arrive_s IS NOT NULL ORDER BY arrive_s NULLS LAST, leave_s DESC NULLS LAST, place) AS k FROM a)
SELECT request, option, CAST(row_number() OVER (PARTITION BY request ORDER BY arrive_s NULLS LAST, leave_s DESC NULLS LAST, place) AS INTEGER) AS rank FROM k WHERE k = 1 OR arrive_s IS NULL"""
)
def ranked_choices(spark, sf_dir):
    """Choices of each request by arrival, the same vehicle once, untimed ones last."""
    t = _timed(spark, sf_dir).filter("place = 1")
    timed = F.col("option") % 4 > 0
    a = t.select("option", (F.col("option") % 7).alias("request"), (F.col("option") % 3).alias("bus"), F.when(timed, F.col("arrive_s")).alias("arrive_s"), F.when(timed, F.col("depart_s")).alias("leave_s"), F.col("option").alias("place"))
    return planner.ranked(a, ["request"], ["bus"]).select("request", "option", "rank")


@query(
    """WITH o AS (SELECT s_suppkey AS option, abs(s_acctbal) / 10 AS walk, s_suppkey % 350 AS transfer FROM supplier), r AS (SELECT *, CASE WHEN floor(walk * 1.3 / 80.0 * 60 + 0.5) < 60 THEN 30000 - 60 ELSE 30000 + floor(walk * 1.3 / 80.0 * 60 + 0.5) END AS ready FROM o),
f AS (SELECT l_suppkey AS option, CAST(l_orderkey * 37 % 150000 AS BIGINT) AS leave_s, CASE WHEN l_quantity < 45 THEN CAST(l_orderkey * 37 % 150000 + l_quantity * 60 AS BIGINT) END AS arrive_s FROM lineitem WHERE l_returnflag = 'A'),
s AS (SELECT l_suppkey AS option, CAST(l_orderkey * 41 % 170000 AS BIGINT) AS depart_s, min(CASE WHEN l_quantity < 48 THEN CAST(l_orderkey * 41 % 170000 + l_quantity * 50 AS BIGINT) END) AS reach_s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
w AS (SELECT *, min(leave_s) OVER (PARTITION BY option) > 30000 + 10800 AS later FROM r JOIN f USING (option) WHERE leave_s BETWEEN ready AND 30000 + 93600),
p AS (SELECT *, row_number() OVER (PARTITION BY option ORDER BY leave_s, arrive_s NULLS LAST) AS place FROM w WHERE later OR leave_s <= 30000 + 10800),
q AS (SELECT *, arrive_s + CAST(floor(transfer * 1.3 / 80.0 * 60 + 120 + 0.5) AS BIGINT) AS ready2 FROM p WHERE place <= 12),
m AS (SELECT q.*, x.depart_s, x.reach_s FROM q LEFT JOIN LATERAL (SELECT depart_s, reach_s FROM s WHERE s.option = q.option AND s.depart_s BETWEEN q.ready2 AND q.ready2 + 5400 ORDER BY depart_s LIMIT 1) x ON true),
e AS (SELECT *, coalesce(reach_s, depart_s) AS fin, min(coalesce(reach_s, depart_s)) OVER (PARTITION BY option ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS least FROM m),
g AS (SELECT *, least IS NOT NULL AND (fin IS NULL OR least <= fin) AS folded FROM e),
h AS (SELECT *, min(CASE WHEN NOT folded THEN place END) OVER (PARTITION BY option ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS into_place FROM g),
k AS (SELECT *, count(*) FILTER (WHERE folded AND depart_s IS NOT NULL) OVER (PARTITION BY option, into_place) AS earlier, min(leave_s) FILTER (WHERE folded AND depart_s IS NOT NULL) OVER (PARTITION BY option, into_place) AS earlier_s FROM h)
SELECT option, leave_s, arrive_s, later, depart_s, reach_s, earlier, earlier_s, depart_s - ready2 AS spare_s FROM k WHERE NOT folded"""
)
def timed_changes(spark, sf_dir):
    """P10: the second bus that leaves first after each of the next twelve first buses; first buses that gain nothing are folded into a later one."""
    x = lineitem(spark, sf_dir)
    a, b, q = F.col("l_orderkey") * 37 % 150000, F.col("l_orderkey") * 41 % 170000, F.col("l_quantity")
    options = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("option"), (F.abs("s_acctbal") / 10).alias("walk_m"), (F.col("s_suppkey") % 350).alias("transfer_m"))
    first = x.filter("l_returnflag = 'A'").select(F.col("l_suppkey").alias("option"), a.alias("leave_s"), F.when(q < 45, (a + q * 60).cast("long")).alias("arrive_s"))
    second = x.filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("option"), b.alias("depart_s"), F.when(q < 48, (b + q * 50).cast("long")).alias("reach_s"))
    return planner.timed_connections(options, first, second, F.lit(30000)).select("option", "leave_s", "arrive_s", "later", "depart_s", "reach_s", "earlier", "earlier_s", "spare_s")


_OPEN = """p AS (SELECT o_orderkey AS pattern_id, o_orderpriority AS operator, 'L' || (o_custkey % 30) AS line, CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN false END AS public_use, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 300 AS z, o_orderkey % 7 AS first_day FROM orders)"""


@query(f"WITH {_OPEN}, d AS (SELECT * FROM p, (VALUES (DATE '1997-03-05'), (DATE '1997-03-06')) v(day)) SELECT DISTINCT pattern_id FROM d WHERE coalesce(public_use, true) AND a <= day AND day <= z AND (isodow(day) - 1 - first_day + 7) % 7 < 2")
def usable_patterns(spark, sf_dir):
    """P5: patterns open to the public that run on one of two days."""
    key, empty = F.col("o_orderkey"), F.lit(None).cast(RULE)
    days = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda k: ((key + k) % 7).cast("int"))
    rules = F.array(F.struct(days.alias("days"), *[empty[n].alias(n) for n in ("holidaysOnly", "alsoOn", "notOn", "serviced", "bankHolidays")]))
    o = orders(spark, sf_dir).select(
        key.alias("pattern_id"), F.col("o_orderpriority").alias("operator"), F.concat(F.lit("L"), F.col("o_custkey") % 30).alias("line"), F.when(key % 6 == 0, True).when(key % 6 == 1, False).alias("public_use"),
        F.col("o_orderdate").alias("valid_from"), F.date_add("o_orderdate", 300).alias("valid_to"), rules.alias("rules"),
    )
    searched = F.array(*[F.lit(d).cast("date") for d in ("1997-03-05", "1997-03-06")])
    return planner.usable_patterns(o, searched, ["1-URGENT|L1"]).select("pattern_id")


_ANCHORS = "a AS (SELECT s_suppkey AS pattern_id, s_nationkey % 2 = 0 AS verified, s_acctbal / 100 AS offset_min FROM supplier WHERE s_nationkey % 3 > 0)"


@query(f"WITH {_ANCHORS}, q AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN verified THEN 'verified' WHEN verified IS NULL THEN 'unverified' ELSE 'unreliable' END AS quality FROM lineitem LEFT JOIN a ON l_suppkey = pattern_id), o AS (SELECT l_orderkey, min(l_linenumber) AS own FROM lineitem GROUP BY 1), g AS (SELECT l_orderkey AS leg, max(quality) FILTER (WHERE l_linenumber = own) AS own_quality, bool_and(quality = 'verified') AS every FROM q JOIN o USING (l_orderkey) GROUP BY 1) SELECT leg, CASE WHEN own_quality = 'verified' AND NOT every THEN 'unverified' ELSE own_quality END AS quality FROM g")
def leg_quality(spark, sf_dir):
    """Whether a leg's timetables were checked against their own vehicles."""
    s = table(spark, sf_dir, "supplier").filter("s_nationkey % 3 > 0")
    anchors = s.select(F.col("s_suppkey").alias("pattern_id"), (F.col("s_nationkey") % 2 == 0).alias("verified"), (F.col("s_acctbal") / 100).alias("offset_min"))
    legs = lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("leg"), F.col("l_suppkey").alias("pattern_id"), (F.col("l_linenumber") == F.min("l_linenumber").over(W.partitionBy("l_orderkey"))).alias("is_own"))
    return planner.family_quality(planner.with_quality(legs, anchors), ["leg"])


@query(
    """WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey % 3 END AS journeys, o_orderkey % 2 = 0 AS timed, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 > 1 END AS verified, o_orderkey % 4 AS v, o_custkey % 6 AS s, o_custkey % 8 > 0 AS has FROM orders)
SELECT id, CASE WHEN journeys IS NULL THEN 'no_journey_named' WHEN journeys <> 1 AND NOT timed THEN 'several_journeys' WHEN verified IS NULL THEN 'clock_not_checked' WHEN NOT verified THEN 'clock_does_not_match' WHEN v >= s THEN 'at_or_past_stop'
  WHEN NOT timed AND NOT has THEN 'no_running_times' WHEN CASE WHEN timed THEN s > 3 ELSE s > 4 END THEN 'no_time_to_stop' END AS refused,
  CASE WHEN journeys = 1 OR (journeys IS NOT NULL AND timed) THEN CASE WHEN verified AND v < s THEN CASE WHEN timed THEN CASE WHEN s <= 3 THEN 100 * s END WHEN has AND s <= 4 THEN 90 * s END END END AS seconds_to_stop FROM x"""
)
def scheduled_times_at_stop(spark, sf_dir):
    """The scheduled time at a stop, or the first reason why it is withheld."""
    k = F.col("o_orderkey")
    times = lambda n, step: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda x: x * step)
    x = orders(spark, sf_dir).select(
        k.alias("id"), F.when(k % 9 > 0, k % 3).alias("journeys"), F.when(k % 2 == 0, times(3, 100)).alias("timed"), F.when(k % 5 > 0, k % 5 > 1).alias("verified"), (k % 4).cast("int").alias("vehicle_at"),
        (F.col("o_custkey") % 6).cast("int").alias("stop_at"), F.when(F.col("o_custkey") % 8 > 0, times(4, 90)).alias("seconds"),
    )
    return planner.scheduled_at_stop(x).select("id", "refused", "seconds_to_stop")


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey % 27) * 3600 + (o_orderkey % 60) * 60 + CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 59 ELSE 0 END END AS clock_s,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 3) * 3600 + (o_orderkey % 50) * 60 + CAST(round_even((o_orderkey % 7) + 0.5, 0) AS BIGINT) END AS duration_s,
  ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][CAST(floor(((o_orderkey % 360) + 22.5) / 45) AS BIGINT) % 8 + 1] AS towards, least((o_orderkey * 7 % 360 - o_orderkey * 3 % 360 + 360) % 360, 360 - (o_orderkey * 7 % 360 - o_orderkey * 3 % 360 + 360) % 360) AS turned,
  DATE '1996-01-01' + CAST(o_orderkey % 40 AS INTEGER) >= DATE '1996-01-15' AND (o_orderkey % 3 = 0 OR DATE '1996-01-01' + CAST(o_orderkey % 40 AS INTEGER) <= DATE '1996-02-01') AS valid FROM orders"""
)
def times_and_headings(spark, sf_dir):
    """Clock times, durations, compass points, turns and validity as column functions."""
    k = F.col("o_orderkey")
    clock = F.when(k % 4 == 0, F.lit("7h")).when(k % 2 == 0, F.format_string("%02d:%02d:%02d", k % 27, k % 60, k % 59)).otherwise(F.format_string("%02d:%02d", k % 27, k % 60))
    duration = F.when(k % 5 == 0, "PT").otherwise(F.format_string("PT%dH%dM%d.5S", k % 3, k % 50, k % 7))
    day = F.date_add(F.lit("1996-01-01").cast("date"), (k % 40).cast("int"))
    end = F.when(k % 3 != 0, F.lit("1996-02-01").cast("date"))
    return orders(spark, sf_dir).select(
        k.alias("id"), time.clock_seconds(clock).cast("long").alias("clock_s"), time.duration_seconds(duration).cast("long").alias("duration_s"), text.compass((k % 360).cast("double")).alias("towards"),
        geo.turn((k * 7 % 360).cast("double"), (k * 3 % 360).cast("double")).cast("long").alias("turned"), valid_on(F.lit("1996-01-15").cast("date"), end, day).alias("valid"),
    )


@query(
    """WITH x AS (SELECT p_partkey AS id, p_name || ' Bus_Station, The ' || p_type AS name, p_partkey % 7 AS d FROM part)
SELECT id, trim(regexp_replace(lower(replace(replace(replace(name, ' Bus_Station, The ', ' '), ',', ' '), '_', ' ')), '[^a-z0-9]+', ' ', 'g')) AS place,
  'https://x.org/feed?a=' || id || '&api_key=REDACTED&b=2' AS shown, CASE d WHEN 0 THEN 'Mon–Fri' WHEN 1 THEN 'Tue, Thu, Sat' WHEN 2 THEN 'Sat, Sun' WHEN 3 THEN 'Mon–Wed, Fri' WHEN 4 THEN 'Sun' WHEN 5 THEN 'Mon–Sun' ELSE '' END AS days FROM x"""
)
def names_and_words(spark, sf_dir):
    """Place names without generic words, addresses without keys, running days as words."""
    k = F.col("p_partkey")
    name = F.concat("p_name", F.lit(" Bus_Station, The "), "p_type")
    sets = ((0, 1, 2, 3, 4), (1, 3, 5), (5, 6), (0, 1, 2, 4), (6,), (0, 1, 2, 3, 4, 5, 6), ())
    days = F.element_at(F.array(*[F.array(*[F.lit(d) for d in s]).cast("array<int>") for s in sets]), (k % 7 + 1).cast("int"))
    url = F.concat(F.lit("https://x.org/feed?a="), k, F.lit("&api_key=s3cret"), k, F.lit("&b=2"))
    return table(spark, sf_dir, "part").select(k.alias("id"), text.place_words(name).alias("place"), text.redacted(url).alias("shown"), text.day_runs(days).alias("days"))


@query(
    """WITH x AS (SELECT event_id, ts + INTERVAL 1 HOUR * (event_id % 24) AS at_ts FROM events), d AS (SELECT event_id, CAST(at_ts AS DATE) AS day, hour(at_ts) AS h FROM x)
SELECT event_id, CASE WHEN h < 4 THEN CAST(day - 1 AS VARCHAR) || ',' ELSE '' END || CAST(CAST(day AS DATE) AS VARCHAR) || CASE WHEN h >= 21 THEN ',' || CAST(day + 1 AS VARCHAR) ELSE '' END AS days FROM d"""
)
def service_days_met(spark, sf_dir):
    """The service days that a search at an instant meets (the events are of January, when local time is UTC)."""
    now = F.col("ts") + F.make_dt_interval(F.lit(0), (F.col("event_id") % 24).cast("int"))
    days = F.transform(time.days_met(now), lambda d: d.cast("string"))
    return events(spark, sf_dir).select("event_id", F.array_join(days, ",").alias("days"))
