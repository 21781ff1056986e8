"""Timetable files (TransXChange): what a name declares, which snapshot of a dataset counts, and the patterns in the documents.

A document is one row and is read once, by Spark's XML reader (names without namespaces, character data and references as they mean).
Its ids are resolved inside the row: a pattern's section references, a journey's pattern (its own, or that of the journey it refers to),
serviced organisations' calendars. What is left is a row for each call of a pattern, and one shuffle by pattern: metres and
seconds are added up by windows over a section's calls, then over the sections, and a stop that repeats the one before it (as
sections do where they meet) is called at once.

An undeclared distance or running time leaves everything after it unknown, never zero. Patterns that no journey runs, that
refer to a section without readable links, or that have fewer than ``PATTERN_MIN_STOPS`` calls are left out; a document that cannot be
read is a row of ``unreadable``. All calls and journeys of a pattern are one row, as many as one document or, after merging,
the documents of one path hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.constants import HORIZON_DAYS, PATTERN_MIN_STOPS, SHRINK_FLOOR
from headway.functions.rules import RULE
from headway.functions.time import duration_seconds
from headway.operators.sequences import poisoned_sum

# How members of a dataset are named (operator, line, declared validity), and the days that a name of days stands for.
FILE_NAME = r"^([A-Z0-9]+)_([^_]+)_.*_(\d{8})_(\d{8})_[^_]+\.xml$"
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
DAY_GROUPS = {"MondayToFriday": (0, 1, 2, 3, 4), "MondayToSaturday": (0, 1, 2, 3, 4, 5), "MondayToSunday": (0, 1, 2, 3, 4, 5, 6), "Weekend": (5, 6)}

_NAMED = {d: (k,) for k, d in enumerate(DAYS)} | DAY_GROUPS | {f"Not{d}": tuple(x for x in range(7) if x != k) for k, d in enumerate(DAYS)}
_RANGES = "struct<DateRange:array<struct<StartDate:string,EndDate:string>>>"
_ORGANISATIONS = "struct<WorkingDays:struct<ServicedOrganisationRef:array<string>>,Holidays:struct<ServicedOrganisationRef:array<string>>>"
_PROFILE = (
    f"struct<RegularDayType:struct<DaysOfWeek:struct<{','.join(f'{d}:string' for d in _NAMED)}>,HolidaysOnly:string>,"
    f"SpecialDaysOperation:struct<DaysOfOperation:{_RANGES},DaysOfNonOperation:{_RANGES}>,"
    f"ServicedOrganisationDayType:struct<DaysOfOperation:{_ORGANISATIONS},DaysOfNonOperation:{_ORGANISATIONS}>,BankHolidayOperation:string>"
)
_OPERATOR = "array<struct<NationalOperatorCode:string,OperatorCode:string>>"
#: The parts of a document that are read. What could not be read must come last: the reader fills the other fields by their places.
DOCUMENT = (
    "_ModificationDateTime string, _RevisionNumber string,"
    f"ServicedOrganisations struct<ServicedOrganisation:array<struct<OrganisationCode:string,WorkingDays:{_RANGES},Holidays:{_RANGES}>>>,"
    f"Operators struct<Operator:{_OPERATOR},LicensedOperator:{_OPERATOR}>,"
    f"Services struct<Service:array<struct<ServiceCode:string,PublicUse:string,OperatingPeriod:struct<StartDate:string,EndDate:string>,OperatingProfile:{_PROFILE},"
    "Lines:struct<Line:array<struct<LineName:string>>>,"
    "StandardService:struct<JourneyPattern:array<struct<_id:string,Direction:string,DestinationDisplay:string,JourneyPatternSectionRefs:array<string>>>>>>>,"
    "JourneyPatternSections struct<JourneyPatternSection:array<struct<_id:string,JourneyPatternTimingLink:array<struct<"
    "From:struct<StopPointRef:string>,To:struct<StopPointRef:string>,Distance:string,RunTime:string>>>>>,"
    f"VehicleJourneys struct<VehicleJourney:array<struct<VehicleJourneyCode:string,VehicleJourneyRef:string,JourneyPatternRef:string,DepartureTime:string,OperatingProfile:{_PROFILE}>>>, _corrupt_record string"
)
FILE = ["dataset", "file"]


def _said(c: Column) -> Column:
    """Trimmed text, null where it is empty."""
    return F.nullif(F.trim(c), F.lit(""))


def _array(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def _once(c: Column) -> Column:
    """``c`` under a condition on the row's number, which always holds: filters are not moved below what is not deterministic, where each of them would work it out again."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def _last(c: Column) -> Column:
    return F.get(c, F.size(c) - 1)


def named(members: DataFrame, file: str = "file") -> DataFrame:
    """``members`` with operator, line, valid_from and valid_to as the file's name declares them; nulls where it declares nothing."""
    base = F.regexp_extract(F.col(file), r"([^/]*)$", 1)
    part = lambda k: F.regexp_extract(base, FILE_NAME, k)
    day = lambda k: F.try_to_timestamp(part(k), F.lit("yyyyMMdd")).cast("date")
    known = base.rlike(FILE_NAME) & day(3).isNotNull() & day(4).isNotNull()
    return members.withColumns({"operator": F.when(known, part(1)), "line": F.when(known, part(2)), "valid_from": F.when(known, day(3)), "valid_to": F.when(known, day(4))})


def survey(members: DataFrame, today: Column, horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """XML members with ``state``: taken where their validity touches the days from today to the horizon, else unrecognised, expired or beyond; and in_force today."""
    rows = named(members.filter(F.lower("file").endswith(".xml")))
    state = (
        F.when(F.col("operator").isNull(), "unrecognised").when(F.col("valid_to") < today, "expired")
        .when(F.col("valid_from") > F.date_add(today, max(0, horizon_days)), "beyond").otherwise("taken")
    )
    return rows.withColumns({"state": state, "in_force": F.when(state == "taken", F.col("valid_from") <= today)})


def newest_snapshots(snapshots: DataFrame, members: DataFrame, allow_shrink: bool = False, floor: float = SHRINK_FLOOR) -> DataFrame:
    """Every snapshot with its dataset, its files and ``state``: taken, superseded, shrunk, without_timetables or unreadable.

    snapshots: snapshot, modified, readable; members: snapshot, file. A dataset is the operator that most files of a snapshot name (of
    equals the first by name), and its newest snapshot is taken, unless it holds fewer than ``floor`` of the files of the one before, which then stays.
    """
    counts = named(members).filter("operator IS NOT NULL").groupBy("snapshot", "operator").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("snapshot").agg(F.sum("n").alias("files"), F.max("n").alias("most"))
    first = counts.join(per, "snapshot").filter("n = most").groupBy("snapshot").agg(F.min("operator").alias("dataset"), F.first("files").alias("files"))
    rows = snapshots.join(first, "snapshot", "left")
    dataset = F.when(F.col("readable"), F.col("dataset"))
    newest = W.partitionBy("dataset").orderBy(F.desc("modified"), F.desc("snapshot"))
    held = rows.filter(dataset.isNotNull()).withColumns({"k": F.row_number().over(newest), "before": F.lead("files").over(newest)})
    shrunk = F.lit(False) if allow_shrink else F.coalesce((F.col("k") == 1) & (F.col("files") < F.col("before") * floor), F.lit(False))
    refused = F.coalesce(F.max(shrunk).over(W.partitionBy("dataset")), F.lit(False))
    state = F.when(shrunk, "shrunk").when((F.col("k") == 1) | (refused & (F.col("k") == 2)), "taken").otherwise("superseded")
    left = rows.filter(dataset.isNull()).withColumns({"dataset": F.lit(None).cast("string"), "files": F.lit(0).cast("long")})
    left = left.withColumn("state", F.when(F.col("readable"), "without_timetables").otherwise("unreadable"))
    return held.withColumn("state", state).drop("k", "before").unionByName(left)


def declared_dates(files: DataFrame) -> DataFrame:
    """The widest window that a dataset's files declare between them, from the first dates in each; what none declares stays unknown. files: dataset, file, body."""
    found = lambda pattern: F.nullif(F.regexp_extract("body", pattern, 1), F.lit(""))
    day = r"\s*([0-9]{4}-[0-9]{2}-[0-9]{2})"
    rows = files.select("dataset", "file", found(f"<(?:OperatingPeriod>\\s*<)?StartDate>{day}").alias("a"), found(f"<EndDate>{day}").alias("z"), found('ModificationDateTime="([^"]{1,40})"').alias("m"))
    first = F.min(F.when(F.col("m").isNotNull(), F.struct("file", "m")))
    return rows.groupBy("dataset").agg(F.min("a").alias("effective_from"), F.max("z").alias("effective_to"), first["m"].alias("modified"), F.count(F.lit(1)).alias("files"))


def date_ranges(node: Column) -> Column:
    """Ranges of days; one without an end is its one day, one without a start is none."""
    kept = F.filter(_array(node["DateRange"], "array<struct<StartDate:string,EndDate:string>>"), lambda r: _said(r["StartDate"]).isNotNull())
    day = lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date")
    return F.transform(kept, lambda r: F.struct(day(_said(r["StartDate"])).alias("start"), day(F.coalesce(_said(r["EndDate"]), _said(r["StartDate"]))).alias("end")))


def _calendar(organisations: Column, kind: str):
    """The days that an organisation's code stands for, of the kind asked for."""
    return lambda code: date_ranges(_last(F.filter(organisations, lambda o: F.trim(o["OrganisationCode"]) == code))[kind])


def operating_rule(profile: Column, organisations: Column) -> Column:
    """An operating profile as a rule (``RULE``); null where there is none."""
    week = profile["RegularDayType"]["DaysOfWeek"]
    none = F.array().cast("array<int>")
    days = F.sort_array(F.array_distinct(F.flatten(F.array(*[F.when(week[d].isNotNull(), F.array(*map(F.lit, numbers))).otherwise(none) for d, numbers in _NAMED.items()]))))
    filled = lambda ranges: F.when(F.size(ranges) > 0, ranges)
    special, serviced = profile["SpecialDaysOperation"], profile["ServicedOrganisationDayType"]
    entry = "array<struct<mode:string,kind:string,organisations:array<string>,ranges:array<struct<start:date,end:date>>>>"
    parts = []
    for mode, tag in (("only", "DaysOfOperation"), ("except", "DaysOfNonOperation")):
        for kind in ("WorkingDays", "Holidays"):
            part = serviced[tag][kind]
            codes = F.filter(F.transform(_array(part["ServicedOrganisationRef"], "array<string>"), lambda c: F.trim(c)), lambda c: c != "")
            ranges = F.flatten(F.transform(codes, _calendar(organisations, kind)))
            parts.append(F.when(part.isNotNull(), F.array(F.struct(F.lit(mode).alias("mode"), F.lit(kind).alias("kind"), codes.alias("organisations"), ranges.alias("ranges"))).cast(entry)).otherwise(F.array().cast(entry)))
    rule = F.struct(
        days.alias("days"), profile["RegularDayType"]["HolidaysOnly"].isNotNull().alias("holidaysOnly"), filled(date_ranges(special["DaysOfOperation"])).alias("alsoOn"),
        filled(date_ranges(special["DaysOfNonOperation"])).alias("notOn"), filled(F.flatten(F.array(*parts))).alias("serviced"), F.when(profile["BankHolidayOperation"].isNotNull(), "declared_not_evaluated").alias("bankHolidays"),
    )
    return F.when(profile.isNotNull(), rule.cast(RULE))


def read(files: DataFrame) -> DataFrame:
    """``files`` (dataset, file, body, ...) with the document in ``doc``."""
    return files.withColumn("doc", F.from_xml(_once(F.col("body")), DOCUMENT, {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})).drop("body")


def unreadable(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("doc").isNull() | F.col("doc._corrupt_record").isNotNull()).select(*FILE)


def _sections(doc: Column) -> Column:
    """(id, calls: stop, step_m, step_s) of every section with a readable link; the first call starts at 0."""
    readable = lambda x: _said(x["From"]["StopPointRef"]).isNotNull() & _said(x["To"]["StopPointRef"]).isNotNull()
    whole = lambda c: F.when(F.trim(c).rlike(r"^[+]?\d+$"), F.trim(c).try_cast("int"))
    call = lambda stop, m, s: F.struct(stop.alias("stop"), m.cast("int").alias("step_m"), s.cast("int").alias("step_s"))
    steps = lambda links: F.transform(links, lambda x: call(F.trim(x["To"]["StopPointRef"]), whole(x["Distance"]), F.when(F.trim(x["RunTime"]).startswith("PT"), duration_seconds(F.trim(x["RunTime"])))))
    kept = F.transform(doc["JourneyPatternSections"]["JourneyPatternSection"], lambda s: F.struct(s["_id"].alias("id"), F.filter(s["JourneyPatternTimingLink"], readable).alias("links")))
    kept = F.filter(kept, lambda s: F.size(s["links"]) > 0)
    return F.transform(kept, lambda s: F.struct(s["id"].alias("id"), F.concat(F.array(call(F.trim(F.get(s["links"], F.lit(0))["From"]["StopPointRef"]), F.lit(0), F.lit(0))), steps(s["links"])).alias("calls")))


def _journeys(doc: Column, service_rule: Column, organisations: Column) -> Column:
    """(pattern, time, rule) of every vehicle journey that has a pattern, its own or that of the journey it refers to."""
    every = _array(doc["VehicleJourneys"]["VehicleJourney"], f"array<struct<VehicleJourneyCode:string,VehicleJourneyRef:string,JourneyPatternRef:string,DepartureTime:string,OperatingProfile:{_PROFILE}>>")
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    owning = F.filter(every, lambda j: _said(j["JourneyPatternRef"]).isNotNull())
    of = lambda j: F.coalesce(_said(j["JourneyPatternRef"]), F.trim(_last(F.filter(owning, lambda o: text(o["VehicleJourneyCode"]) == text(j["VehicleJourneyRef"])))["JourneyPatternRef"]))
    rows = F.transform(every, lambda j: F.struct(of(j).alias("pattern"), _said(j["DepartureTime"]).alias("time"), F.coalesce(operating_rule(j["OperatingProfile"], organisations), service_rule).alias("rule")))
    return F.filter(rows, lambda j: j["pattern"].isNotNull())


def patterns(documents: DataFrame) -> DataFrame:
    """One row per pattern that journeys run: dataset, file, pattern_at and what the document says of it, ``calls`` (position, stop, metres, seconds) and ``journeys`` (time, rule).

    documents: dataset, file, doc, and valid_from and valid_to of the file's name, which hold where the service declares none.
    """
    doc = F.col("doc")
    rows = documents.withColumn("organisations", _array(doc["ServicedOrganisations"]["ServicedOrganisation"], f"array<struct<OrganisationCode:string,WorkingDays:{_RANGES},Holidays:{_RANGES}>>"))
    services = doc["Services"]["Service"]
    service = F.get(services, F.lit(0))
    first = lambda c: F.get(F.filter(c, lambda x: x.isNotNull()), F.lit(0))
    lines = F.flatten(F.transform(services, lambda s: F.transform(_array(s["Lines"]["Line"], "array<struct<LineName:string>>"), lambda x: _said(x["LineName"]))))
    operators = F.concat(_array(doc["Operators"]["Operator"], _OPERATOR), _array(doc["Operators"]["LicensedOperator"], _OPERATOR))
    open_to_all = F.lower(F.trim(service["PublicUse"]))
    pattern = "array<struct<_id:string,Direction:string,DestinationDisplay:string,JourneyPatternSectionRefs:array<string>>>"
    day = lambda c: F.try_to_timestamp(_said(c), F.lit("yyyy-MM-dd")).cast("date")
    rows = rows.select(
        *FILE, first(lines).alias("line"), _said(service["ServiceCode"]).alias("service_code"),
        F.coalesce(first(F.transform(operators, lambda o: _said(o["NationalOperatorCode"]))), first(F.transform(operators, lambda o: _said(o["OperatorCode"])))).alias("operator"),
        F.when(open_to_all == "true", True).when(open_to_all == "false", False).alias("public_use"),
        F.coalesce(day(service["OperatingPeriod"]["StartDate"]), F.col("valid_from")).alias("valid_from"), F.coalesce(day(service["OperatingPeriod"]["EndDate"]), F.col("valid_to")).alias("valid_to"),
        doc["_ModificationDateTime"].alias("modified"), doc["_RevisionNumber"].alias("revision"), _sections(doc).alias("sections"),
        "organisations", doc.alias("doc"), _once(operating_rule(service["OperatingProfile"], F.col("organisations"))).alias("service_rule"),
        F.flatten(F.transform(services, lambda s: _array(s["StandardService"]["JourneyPattern"], pattern))).alias("patterns"),
    ).filter("line IS NOT NULL")
    rows = rows.withColumn("journeys", _journeys(F.col("doc"), F.col("service_rule"), F.col("organisations"))).drop("doc", "organisations", "service_rule")
    rows = rows.select("*", F.posexplode("patterns").alias("pattern_at", "p")).drop("patterns")
    refs = F.filter(F.transform(F.col("p.JourneyPatternSectionRefs"), lambda r: _said(r)), lambda r: r.isNotNull())
    held = F.transform(refs, lambda r: _last(F.filter(F.col("sections"), lambda s: s["id"] == r))["calls"])
    head = F.struct(
        "line", "service_code", "operator", "public_use", "valid_from", "valid_to", "modified", "revision", F.lower(F.coalesce(F.trim("p.Direction"), F.lit(""))).alias("direction"),
        F.coalesce(F.trim("p.DestinationDisplay"), F.lit("")).alias("destination"), F.transform(F.filter("journeys", lambda j: j["pattern"] == F.col("p._id")), lambda j: F.struct(j["time"].alias("time"), j["rule"].alias("rule"))).alias("journeys"),
    )
    rows = rows.select(*FILE, "pattern_at", _once(head).alias("head"), _once(held).alias("held"))
    rows = rows.filter((F.size("head.journeys") > 0) & (F.size("held") > 0) & F.forall("held", lambda x: x.isNotNull()))
    rows = rows.select(*FILE, "pattern_at", "head", F.posexplode("held").alias("section_at", "section"))
    rows = rows.select(*FILE, "pattern_at", "section_at", F.when(F.col("section_at") == 0, F.col("head")).alias("head"), F.posexplode("section").alias("call_at", "call"))
    rows = rows.select(*FILE, "pattern_at", "section_at", "call_at", F.when(F.col("call_at") == 0, F.col("head")).alias("head"), "call.*")
    return _joined(rows).filter(F.size("calls") >= PATTERN_MIN_STOPS)


def _joined(rows: DataFrame) -> DataFrame:
    """Calls of sections to calls of patterns."""
    one = [*FILE, "pattern_at"]
    section = W.partitionBy(*one, "section_at")
    upto = section.orderBy("call_at")
    whole = W.partitionBy(*one).orderBy("section_at", "call_at")
    rows = rows.withColumns({"m": poisoned_sum(F.col("step_m"), upto), "s": poisoned_sum(F.col("step_s"), upto), "called": ~F.col("stop").eqNullSafe(F.lag("stop").over(whole))})
    # where a section ends: at its last call that counts; one whose calls all repeat the stop before adds nothing
    rows = rows.withColumns({"end": F.max(F.when(F.col("called"), F.struct("call_at", "m", "s"))).over(section), "is_first": F.col("call_at") == 0})
    before = W.partitionBy(*one).orderBy("section_at").rangeBetween(W.unboundedPreceding, -1)

    def start(c: str) -> Column:
        length = F.when(F.col("is_first"), F.when(F.col("end").isNull(), F.lit(0)).otherwise(F.col("end")[c]))
        unknown = F.max(F.when(F.col("is_first") & length.isNull(), 1).otherwise(0)).over(before)
        return F.when(F.coalesce(unknown, F.lit(0)) == 0, F.coalesce(F.sum(length).over(before), F.lit(0)))

    rows = rows.withColumns({"metres": (F.col("m") + start("m")).cast("int"), "seconds": (F.col("s") + start("s")).cast("int")})
    rows = rows.withColumn("position", F.count(F.when(F.col("called"), 1)).over(whole.rowsBetween(W.unboundedPreceding, 0)).cast("int") - 1)
    calls = F.collect_list(F.when(F.col("called"), F.struct("position", "stop", "metres", "seconds")))
    return rows.groupBy(*one).agg(F.array_sort(calls).alias("calls"), F.any_value("head", True).alias("head")).select(*one, "head.*", "calls")


def merged(found: DataFrame) -> DataFrame:
    """Patterns with one operator, line, direction and sequence of stops as one, first come first: rules united, journeys added, distinct running times listed, the best measured calls kept.

    ``timings`` are distinct arrays of seconds by call; ``departures`` (time, timing, rule) point into them and into ``rules`` (-1: no rule). Open to the
    public if any is, closed if all say so. ``pattern_id`` is made from the key alone, so rebuilding keeps it (stops and names in ASCII, as the registers have them).
    """
    rest = [c for c in found.columns if c not in ("operator", "line", "direction", *FILE, "pattern_at")]
    key, place = ["operator", "line", "direction", "stops"], [*FILE, "pattern_at"]
    rows = found.withColumns({"stops": F.transform("calls", lambda c: c["stop"]), "timing": F.transform("calls", lambda c: c["seconds"])})
    numbered = lambda first, own: F.dense_rank().over(W.partitionBy(*key).orderBy(F.asc_nulls_last(first), own)) - 1
    rows = rows.withColumn("timing_first", F.min(F.struct(*place)).over(W.partitionBy(*key, "timing"))).withColumn("timing_at", numbered("timing_first", "timing"))
    rows = rows.select(*key, *place, "timing", "timing_at", (F.col("timing_first") == F.struct(*place)).alias("timing_new"), F.struct(*place, *rest).alias("p"), F.posexplode_outer("journeys").alias("journey_at", "j"))
    # a pattern stands in the row of its first journey
    rows = rows.withColumn("p", F.when(F.coalesce("journey_at", F.lit(0)) == 0, F.col("p"))).withColumn("rule", F.col("j.rule"))
    said = F.col("rule").isNotNull()
    rows = rows.withColumn("rule_first", F.min(F.when(said, F.struct(*place, "journey_at"))).over(W.partitionBy(*key, "rule"))).withColumn("rule_at", F.when(said, numbered("rule_first", "rule")).otherwise(-1))
    is_new, declared = F.col("rule_first") == F.struct(*place, "journey_at"), F.size(F.filter("p.calls", lambda c: c["metres"].isNotNull()))
    listed_by = lambda new, at, what: F.transform(F.array_sort(F.collect_set(F.when(new, F.struct(F.col(at).alias("at"), F.col(what).alias("x"))))), lambda v: v["x"])
    rows = rows.groupBy(*key).agg(
        F.min("p").alias("first"), F.min(F.when(F.col("p").isNotNull(), F.struct((-declared).alias("n"), "p"))).alias("best"),
        F.bool_or(F.coalesce("p.public_use", F.lit(False))).alias("some"), F.bool_and(F.when(F.col("p").isNotNull(), F.coalesce(~F.col("p.public_use"), F.lit(False)))).alias("none"),
        F.count("journey_at").alias("total"), listed_by(F.col("p").isNotNull() & F.col("timing_new"), "timing_at", "timing").alias("timings"), listed_by(is_new, "rule_at", "rule").alias("rules"),
        F.array_sort(F.collect_list(F.when(F.col("j.time").isNotNull(), F.struct(F.col("j.time").alias("time"), F.col("timing_at").cast("int").alias("timing"), F.col("rule_at").cast("int").alias("rule"))))).alias("departures"),
    )
    first, some, none, total, calls = F.col("first"), F.col("some"), F.col("none"), F.col("total"), F.col("best.p.calls")
    text = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1))
    listed = F.concat(F.lit("["), F.array_join(F.transform("stops", lambda s: F.regexp_extract(F.to_json(F.array(s)), r"^\[(.*)\]$", 1)), ", "), F.lit("]"))
    digest = F.substring(F.sha2(F.concat(F.lit("["), text("operator"), F.lit(", "), text("line"), F.lit(", "), text("direction"), F.lit(", "), listed, F.lit("]")), 256), 1, 10)
    name = F.concat_ws(":", F.coalesce("operator", F.lit("NOC")), "line", F.when(F.col("direction") == "", "-").otherwise(F.col("direction")), digest)
    return rows.select(
        name.alias("pattern_id"), "operator", "line", "direction", *[first[c].alias(c) for c in (*FILE, "service_code", "destination", "valid_from", "valid_to", "modified", "revision")], F.when(some, True).when(none, False).alias("public_use"),
        total.alias("journeys"), F.size("stops").alias("stop_count"), (F.size(F.array_distinct("stops")) < F.size("stops")).alias("has_repeated_stop"), F.forall(calls, lambda c: c["metres"].isNotNull()).alias("distances_known"),
        F.when(F.forall(calls, lambda c: c["metres"].isNotNull()), _last(calls)["metres"]).alias("total_m"), F.when(F.size("rules") > 0, F.col("rules")).alias("rules"), "timings", "departures", calls.alias("calls"),
    )


def calls(catalogue: DataFrame) -> DataFrame:
    return catalogue.select("pattern_id", F.explode("calls").alias("c")).select("pattern_id", "c.*")


def departures(catalogue: DataFrame) -> DataFrame:
    return catalogue.select("pattern_id", F.explode("departures").alias("d")).select("pattern_id", "d.*")


def stops_in_area(catalogue: DataFrame, stops: DataFrame) -> DataFrame:
    """pattern_id and how many of its calls are at one of ``stops`` (stop)."""
    held = stops.select("stop").distinct().withColumn("inside", F.lit(1))
    return calls(catalogue).join(held, "stop", "left").groupBy("pattern_id").agg(F.count("inside").alias("stops_in_area"))
