"""Timetable files made from the order tables: a customer is a file, an order a section and a pattern (its own section and the customer's next), a line item a call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.functions.rules import runs_on
from headway.plans.base import lineitem, orders, registering
from headway.session import table
from headway.sources import timetables

QUERIES, ORACLES, query = registering()

_ORDER = ("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_discount", "l_tax")  # line numbers repeat

_PROFILES = {
    "1-URGENT": "<RegularDayType><DaysOfWeek><MondayToFriday/></DaysOfWeek></RegularDayType><BankHolidayOperation><DaysOfNonOperation><AllBankHolidays/></DaysOfNonOperation></BankHolidayOperation>",
    "2-HIGH": "<RegularDayType><DaysOfWeek><Saturday/><Sunday/></DaysOfWeek></RegularDayType>",
    "4-NOT SPECIFIED": "<RegularDayType><HolidaysOnly/></RegularDayType><SpecialDaysOperation><DaysOfOperation><DateRange><StartDate>1996-05-04</StartDate></DateRange></DaysOfOperation></SpecialDaysOperation>",
    "5-LOW": "<RegularDayType><DaysOfWeek><NotMonday/></DaysOfWeek></RegularDayType><ServicedOrganisationDayType><DaysOfOperation><WorkingDays><ServicedOrganisationRef>SCH</ServicedOrganisationRef></WorkingDays></DaysOfOperation></ServicedOrganisationDayType>",
}
_DEFAULT = "<RegularDayType><DaysOfWeek><MondayToSunday/></DaysOfWeek></RegularDayType><SpecialDaysOperation><DaysOfNonOperation><DateRange><StartDate>1996-12-24</StartDate><EndDate>1997-01-02</EndDate></DateRange></DaysOfNonOperation></SpecialDaysOperation>"
_TERM = "<ServicedOrganisations><ServicedOrganisation><OrganisationCode>SCH</OrganisationCode><WorkingDays><DateRange><StartDate>1996-01-08</StartDate><EndDate>1996-07-19</EndDate></DateRange></WorkingDays></ServicedOrganisation></ServicedOrganisations>"


def _documents(spark, sf_dir, stops: str) -> DataFrame:
    """dataset, file, body: a document for each customer with orders; ``stops`` is an expression of a call's stop number."""
    x = lineitem(spark, sf_dir).withColumn("stop", F.concat(F.lit("A"), F.expr(stops)))
    before = F.lag("stop").over(W.partitionBy("l_orderkey").orderBy(*_ORDER))
    part = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    run = F.when(F.col("l_discount") != 0.1, part("RunTime", F.format_string("PT%dM30S", F.col("l_quantity").cast("int"))))
    far = F.when(F.col("l_tax") != 0.08, part("Distance", (F.col("l_partkey") % 1000).cast("string")))
    link = part("JourneyPatternTimingLink", F.concat(part("From", part("StopPointRef", before)), part("To", F.concat(F.lit("<StopPointRef><![CDATA["), F.col("stop"), F.lit("]]></StopPointRef>"))), F.coalesce(run, F.lit("")), F.coalesce(far, F.lit(""))))
    sections = x.withColumn("link", link).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*_ORDER, F.coalesce("link", F.lit("")).alias("link")))), lambda r: r["link"]), "").alias("links"))
    per = W.partitionBy("o_custkey").orderBy("o_orderkey")
    o = orders(spark, sf_dir).join(sections, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("next", F.lead("o_orderkey").over(per))
    key = F.col("o_orderkey").cast("string")
    refs = F.concat(part("JourneyPatternSectionRefs", F.concat(F.lit("S"), key)), F.coalesce(part("JourneyPatternSectionRefs", F.concat(F.lit("S"), F.col("next").cast("string"))), F.lit("")))
    way = F.when(F.col("o_orderstatus") == "O", "<Direction>Outbound</Direction>").when(F.col("o_orderstatus") == "F", "<Direction> inbound </Direction>").otherwise("")
    profile = F.lit("")
    for name, text in _PROFILES.items():
        profile = F.when(F.col("o_orderpriority") == name, f"<OperatingProfile>{text}</OperatingProfile>").otherwise(profile)
    leaves = F.format_string("%02d:%02d:00", F.col("o_orderkey") % 26, F.col("o_orderkey") % 60)
    texts = F.struct(
        "o_orderkey", F.concat(F.lit('<JourneyPatternSection id="S'), key, F.lit('">'), "links", F.lit("</JourneyPatternSection>")).alias("section"),
        F.concat(F.lit('<JourneyPattern id="P'), key, F.lit('">'), way, part("DestinationDisplay", F.lit("To &#65;&amp;B")), refs, F.lit("</JourneyPattern>")).alias("pattern"),
        F.concat(
            part("VehicleJourney", F.concat(profile, part("VehicleJourneyCode", F.concat(F.lit("J"), key)), part("JourneyPatternRef", F.concat(F.lit("P"), key)), part("DepartureTime", leaves))),
            part("VehicleJourney", F.concat(part("VehicleJourneyCode", F.concat(F.lit("K"), key)), part("VehicleJourneyRef", F.concat(F.lit("J"), key)))),
        ).alias("journeys"),
    )
    c = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(texts)).alias("t"), F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
    all_of = lambda name: F.array_join(F.transform("t", lambda r: r[name]), "")
    op, line = F.concat(F.lit("OP"), F.col("o_custkey") % 2), F.concat(F.lit("L"), F.col("o_custkey") % 3)
    use = F.when(F.col("o_custkey") % 5 == 0, "<PublicUse>false</PublicUse>").when(F.col("o_custkey") % 5 == 1, "<PublicUse>true</PublicUse>").otherwise("")
    body = F.concat(
        F.lit('<?xml version="1.0"?><TransXChange xmlns="http://www.transxchange.org.uk/" ModificationDateTime="1996-01-01T00:00:00" RevisionNumber="2"><JourneyPatternSections>'), all_of("section"),
        F.lit("</JourneyPatternSections><Operators><Operator>"), part("NationalOperatorCode", op), F.lit("</Operator></Operators><Services><Service>"), part("ServiceCode", F.concat(F.lit("SV"), F.col("o_custkey"))), use,
        part("OperatingPeriod", part("StartDate", F.col("a").cast("string"))), F.lit(f"<OperatingProfile>{_DEFAULT}</OperatingProfile>"), part("Lines", part("Line", part("LineName", line))), part("StandardService", all_of("pattern")),
        F.lit("</Service></Services>"), part("VehicleJourneys", all_of("journeys")), F.lit(_TERM + "</TransXChange>"),
    )
    ymd = lambda d: F.date_format(d, "yyyyMMdd")
    file = F.concat(op, F.lit("_"), line, F.lit("_"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("_"), ymd("a"), F.lit("_"), ymd("z"), F.lit("_1.xml"))
    return c.select(op.alias("dataset"), file.alias("file"), body.alias("body"), F.col("o_custkey").alias("customer"))


def _customer():
    return F.regexp_extract("file", r"_(\d{9})_", 1).cast("long")


def _patterns(spark, sf_dir, stops: str) -> DataFrame:
    return timetables.patterns(timetables.read(timetables.named(_documents(spark, sf_dir, stops).drop("customer")).drop("operator", "line")))


#: What the documents hold, read from the tables themselves: p has a pattern's calls with metres and seconds.
_CALLS = """x AS (SELECT l_orderkey, (l_linenumber, l_suppkey, l_partkey, l_quantity, l_discount, l_tax) AS place, 'A' || {stops} AS stop, CASE WHEN l_tax <> 0.08 THEN l_partkey % 1000 END AS m, CASE WHEN l_discount <> 0.1 THEN CAST(l_quantity AS BIGINT) * 60 + 30 END AS s FROM lineitem),
n AS (SELECT *, row_number() OVER w - 1 AS call_at, count(*) OVER (PARTITION BY l_orderkey) AS lines FROM x WINDOW w AS (PARTITION BY l_orderkey ORDER BY place)),
sec AS (SELECT l_orderkey, call_at, stop, CASE WHEN count(*) FILTER (WHERE call_at > 0 AND m IS NULL) OVER w = 0 THEN sum(CASE WHEN call_at > 0 THEN m ELSE 0 END) OVER w END AS m,
  CASE WHEN count(*) FILTER (WHERE call_at > 0 AND s IS NULL) OVER w = 0 THEN sum(CASE WHEN call_at > 0 THEN s ELSE 0 END) OVER w END AS s FROM n WHERE lines > 1 WINDOW w AS (PARTITION BY l_orderkey ORDER BY call_at)),
o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, row_number() OVER w - 1 AS pattern_at, lead(o_orderkey) OVER w AS next FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
r AS (SELECT o_orderkey, 0 AS section_at, o_orderkey AS ref FROM o UNION ALL SELECT o_orderkey, 1, next FROM o WHERE next IS NOT NULL),
bad AS (SELECT DISTINCT o_orderkey FROM r WHERE ref NOT IN (SELECT l_orderkey FROM sec)),
j AS (SELECT r.o_orderkey, section_at, call_at, stop, m, s, stop IS DISTINCT FROM lag(stop) OVER (PARTITION BY r.o_orderkey ORDER BY section_at, call_at) AS called FROM r JOIN sec ON ref = l_orderkey WHERE r.o_orderkey NOT IN (SELECT o_orderkey FROM bad)),
e AS (SELECT o_orderkey, any_value(hit) AS hit, max_by(m0, call_at) AS m0, max_by(s0, call_at) AS s0, max_by(um, call_at) AS um, max_by(us, call_at) AS us FROM (SELECT *, 1 AS hit, coalesce(m, 0) AS m0, coalesce(s, 0) AS s0, m IS NULL AS um, s IS NULL AS us FROM j WHERE called AND section_at = 0) GROUP BY 1),
k AS (SELECT j.o_orderkey, section_at, call_at, stop, CASE WHEN section_at = 0 THEN m WHEN NOT um THEN m + m0 END AS metres, CASE WHEN section_at = 0 THEN s WHEN NOT us THEN s + s0 END AS seconds FROM j JOIN e USING (o_orderkey) WHERE called),
p AS (SELECT o_custkey, pattern_at, o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER w - 1 AS position, count(*) OVER (PARTITION BY o_orderkey) AS stop_count, stop, metres, seconds FROM k JOIN o USING (o_orderkey) WINDOW w AS (PARTITION BY o_orderkey ORDER BY section_at, call_at) QUALIFY stop_count >= 5)"""
_STOP = ("l_suppkey", "(l_suppkey % 3)")


@query(f"WITH {_CALLS.format(stops=_STOP[0])} SELECT o_custkey AS customer, CAST(pattern_at AS INTEGER) AS pattern_at, CAST(position AS INTEGER) AS position, stop, CAST(metres AS INTEGER) AS metres, CAST(seconds AS INTEGER) AS seconds FROM p")
def timetable_calls(spark, sf_dir):
    """Sections joined to patterns, with metres and seconds from the first stop, unknown after anything undeclared."""
    found = _patterns(spark, sf_dir, _STOP[0]).select("file", "pattern_at", F.explode("calls").alias("c"))
    return found.select(_customer().alias("customer"), "pattern_at", "c.*")


_MERGED = f"""{_CALLS.format(stops=_STOP[1])},
f AS (SELECT o_orderkey, any_value(o_custkey) AS c, any_value(pattern_at) AS pat, any_value(o_orderpriority) AS priority, CASE any_value(o_orderstatus) WHEN 'O' THEN 'outbound' WHEN 'F' THEN 'inbound' ELSE '' END AS direction, list(stop ORDER BY position) AS stops,
  list(coalesce(CAST(seconds AS VARCHAR), '-') ORDER BY position) AS timing, count(metres) AS known, max_by(metres, position) AS last_m FROM p GROUP BY 1),
g AS (SELECT *, 'OP' || c % 2 AS operator, 'L' || c % 3 AS line FROM f),
h AS (SELECT *, '["' || operator || '", "' || line || '", "' || direction || '", ["' || array_to_string(stops, '", "') || '"]]' AS said FROM g),
i AS (SELECT *, operator || ':' || line || ':' || CASE direction WHEN '' THEN '-' ELSE direction END || ':' || substr(sha256(said), 1, 10) AS pattern_id FROM h)"""


@query(
    f"""WITH {_MERGED}, b AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY known DESC, c, pat) AS best FROM i)
SELECT pattern_id, operator, line, direction, CAST(count(*) * 2 AS BIGINT) AS journeys, len(any_value(stops)) AS stop_count, len(list_distinct(any_value(stops))) < len(any_value(stops)) AS has_repeated_stop,
  max(CASE WHEN best = 1 AND known = len(stops) THEN 1 ELSE 0 END) = 1 AS distances_known, CAST(max(CASE WHEN best = 1 AND known = len(stops) THEN last_m END) AS INTEGER) AS total_m, count(DISTINCT timing) AS timings, count(*) AS departures,
  CAST(count(DISTINCT CASE WHEN priority <> '3-MEDIUM' THEN priority END) + 1 AS INTEGER) AS rules,
  CASE WHEN bool_or(c % 5 = 1) THEN true WHEN bool_and(c % 5 = 0) THEN false END AS public_use FROM b GROUP BY 1, 2, 3, 4"""
)
def timetable_patterns(spark, sf_dir):
    """Patterns over the same stops as one, with a key that rebuilding keeps."""
    m = timetables.merged(_patterns(spark, sf_dir, _STOP[1]))
    n = lambda c: F.size(c).cast("long").alias(c)
    return m.select("pattern_id", "operator", "line", "direction", "journeys", F.col("stop_count").cast("long").alias("stop_count"), "has_repeated_stop", "distances_known", "total_m", n("timings"), n("departures"), F.size("rules").alias("rules"), "public_use")


@query(
    f"""WITH {_MERGED}, t AS (SELECT pattern_id, timing, row_number() OVER (PARTITION BY pattern_id ORDER BY min((c, pat))) - 1 AS k FROM i GROUP BY 1, 2),
u AS (SELECT pattern_id, c, pat, 0 AS q, CASE WHEN priority = '3-MEDIUM' THEN 'service' ELSE priority END AS rule FROM i UNION ALL SELECT pattern_id, c, pat, 1, 'service' FROM i),
v AS (SELECT pattern_id, rule, row_number() OVER (PARTITION BY pattern_id ORDER BY min((c, pat, q))) - 1 AS k FROM u GROUP BY 1, 2)
SELECT i.pattern_id, printf('%02d:%02d:00', o_orderkey % 26, o_orderkey % 60) AS time, CAST(t.k AS INTEGER) AS timing, CAST(v.k AS INTEGER) AS rule FROM i JOIN t ON i.pattern_id = t.pattern_id AND i.timing = t.timing
JOIN v ON i.pattern_id = v.pattern_id AND CASE WHEN priority = '3-MEDIUM' THEN 'service' ELSE priority END = v.rule"""
)
def timetable_departures(spark, sf_dir):
    """Every scheduled departure with its own running times and operating rule."""
    return timetables.departures(timetables.merged(_patterns(spark, sf_dir, _STOP[1])))


@query(
    f"""WITH {_CALLS.format(stops=_STOP[0])}, q AS (SELECT DISTINCT o_custkey, pattern_at, o_orderkey, o_orderpriority AS pr FROM p), d AS (SELECT q.*, CAST(o_orderdate AS DATE) AS day FROM q JOIN orders USING (o_orderkey))
SELECT o_custkey AS customer, CAST(pattern_at AS INTEGER) AS pattern_at, CASE pr WHEN '1-URGENT' THEN '0,1,2,3,4' WHEN '2-HIGH' THEN '5,6' WHEN '4-NOT SPECIFIED' THEN '' WHEN '5-LOW' THEN '1,2,3,4,5,6' ELSE '0,1,2,3,4,5,6' END AS days,
  pr = '4-NOT SPECIFIED' AS holidays_only, CASE pr WHEN '5-LOW' THEN 'only WorkingDays SCH 1' END AS serviced, CASE WHEN pr = '1-URGENT' THEN 'declared_not_evaluated' END AS bank_holidays,
  CASE pr WHEN '1-URGENT' THEN isodow(day) <= 5 WHEN '2-HIGH' THEN isodow(day) > 5 WHEN '4-NOT SPECIFIED' THEN day = DATE '1996-05-04' WHEN '5-LOW' THEN isodow(day) > 1 AND day BETWEEN DATE '1996-01-08' AND DATE '1996-07-19'
    ELSE NOT day BETWEEN DATE '1996-12-24' AND DATE '1997-01-02' END AS runs FROM d"""
)
def timetable_rules(spark, sf_dir):
    """Rule parsing: each pattern's first journey's rule, and whether it runs on its order's day."""
    found = _patterns(spark, sf_dir, _STOP[0]).select(_customer().alias("customer"), "pattern_at", F.get("journeys", F.lit(0))["rule"].alias("r"))
    o = orders(spark, sf_dir).join(lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi")
    o = o.select(F.col("o_custkey").alias("customer"), (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("pattern_at"), F.col("o_orderdate").alias("day"))
    words = F.array_join(F.transform("r.serviced", lambda s: F.concat_ws(" ", s["mode"], s["kind"], F.array_join(s["organisations"], "+"), F.size(s["ranges"]).cast("string"))), ";")
    return found.join(o, ["customer", "pattern_at"]).select(
        "customer", "pattern_at", F.array_join(F.transform("r.days", lambda d: d.cast("string")), ",").alias("days"), F.col("r.holidaysOnly").alias("holidays_only"),
        words.alias("serviced"), F.col("r.bankHolidays").alias("bank_holidays"), runs_on(F.array("r"), F.col("day")).alias("runs"),
    )


@query(
    """WITH m AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS a FROM orders WHERE o_orderkey % 7 > 0)
SELECT id, CASE WHEN id % 7 < 3 THEN 'unrecognised' WHEN a + 60 < DATE '1996-03-01' THEN 'expired' WHEN a > DATE '1996-03-15' THEN 'beyond' ELSE 'taken' END AS state,
  CASE WHEN id % 7 > 2 AND a + 60 >= DATE '1996-03-01' AND a <= DATE '1996-03-15' THEN a <= DATE '1996-03-01' END AS in_force FROM m"""
)
def timetable_survey(spark, sf_dir):
    """Which files of a dataset are read on a day, by their names alone."""
    k, ymd = F.col("o_orderkey"), lambda d: F.date_format(d, "yyyyMMdd")
    name = F.concat(F.lit("x/OP"), F.col("o_custkey") % 9, F.lit("_"), k % 50, F.lit("_a_b_"), ymd("o_orderdate"), F.lit("_"), ymd(F.date_add("o_orderdate", 60)), F.lit("_u-"), k, F.when(k % 7 == 2, ".XML").otherwise(".xml"))
    file = F.when(k % 7 == 0, "notes.txt").when(k % 7 == 1, "x/op_lower_y_19960101_19970101_1.xml").otherwise(name)
    return timetables.survey(orders(spark, sf_dir).select(k.alias("id"), file.alias("file")), F.lit("1996-03-01").cast("date")).select("id", "state", "in_force")


@query(
    """WITH s AS (SELECT s_suppkey AS snapshot, s_nationkey AS modified, s_suppkey % 11 > 0 AS readable FROM supplier), m AS (SELECT l_suppkey AS snapshot, CASE WHEN l_partkey % 3 = 0 THEN 'OP' || l_suppkey % 13 ELSE 'OP' || l_partkey % 4 + 20 END AS op FROM lineitem WHERE l_linenumber > 1 OR l_suppkey % 2 = 0),
c AS (SELECT snapshot, op, count(*) AS n FROM m GROUP BY 1, 2), d AS (SELECT snapshot, CAST(sum(n) AS BIGINT) AS files, arg_min(op, (-n, op)) AS dataset FROM c GROUP BY 1),
h AS (SELECT s.*, dataset, files, row_number() OVER w AS k, lead(files) OVER w AS before FROM s JOIN d USING (snapshot) WHERE readable WINDOW w AS (PARTITION BY dataset ORDER BY modified DESC, snapshot DESC)),
r AS (SELECT *, k = 1 AND coalesce(files < before * 0.5, false) AS shrunk FROM h), t AS (SELECT *, bool_or(shrunk) OVER (PARTITION BY dataset) AS refused FROM r)
SELECT snapshot, dataset, files, CASE WHEN shrunk THEN 'shrunk' WHEN k = 1 OR (refused AND k = 2) THEN 'taken' ELSE 'superseded' END AS state FROM t
UNION ALL SELECT snapshot, NULL, 0, CASE WHEN readable THEN 'without_timetables' ELSE 'unreadable' END FROM s LEFT JOIN d USING (snapshot) WHERE NOT readable OR dataset IS NULL"""
)
def newest_snapshots(spark, sf_dir):
    """The newest snapshot of each dataset, unless it has lost more than half of its files."""
    k, p = F.col("l_suppkey"), F.col("l_partkey")
    op = F.when(p % 3 == 0, F.concat(F.lit("OP"), k % 13)).otherwise(F.concat(F.lit("OP"), p % 4 + 20))
    file = F.concat(F.when((F.col("l_linenumber") > 1) | (k % 2 == 0), op).otherwise("readme"), F.lit("_5_x_19960101_19961231_1.xml"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("snapshot"), F.col("s_nationkey").alias("modified"), (F.col("s_suppkey") % 11 > 0).alias("readable"))
    return timetables.newest_snapshots(s, lineitem(spark, sf_dir).select(k.alias("snapshot"), file.alias("file"))).select("snapshot", "dataset", "files", "state")


@query(
    """WITH o AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS a FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1)
SELECT 'OP' || o_custkey % 2 AS dataset, CAST(min(a) AS VARCHAR) AS effective_from, '1997-01-02' AS effective_to, '1996-01-01T00:00:00' AS modified, count(*) AS files FROM o GROUP BY 1"""
)
def declared_dates(spark, sf_dir):
    """The widest window that the documents of a dataset declare between them."""
    return timetables.declared_dates(_documents(spark, sf_dir, _STOP[0])).select("dataset", "effective_from", "effective_to", "modified", "files")
