"""Stateful operators against a loop over the rows in order, as a table and as a stream that stops and goes on."""

import pytest
from pyspark.sql import functions as F

from headway.constants import KEPT_FIXES
from headway.plans import cycles
from headway.streaming import cycle

SF = "/root/testdata/sf0.001"


def loop_fixes(rows):
    """(operator, vehicle, seq, at, service) to (operator, vehicle, seq, at, service, event, is_new, held, newest)."""
    out, held, service, newest = [], {}, {}, {}
    for op, v, seq, at, own in sorted(rows, key=lambda r: (r[2], r[3], r[4])):
        k = (op, v)
        new = k not in newest or at > newest[k]
        newest[k] = max(at, newest.get(k, at))
        have = held.get(k, [])
        if not have:
            event, held[k], service[k] = "first", [at], own
        elif service[k] != own:
            event = "ignored"
            if at > have[-1]:
                event, held[k], service[k] = "service_change", [at], own
        elif at in have:
            event = "duplicate"
        else:
            event, held[k] = ("added" if at > have[-1] else "out_of_order"), sorted(have + [at])[-12:]
        out.append((op, v, seq, at, own, event, new, len(held[k]), held[k][-1]))
    return sorted(out)


def loop_held(rows):
    out, state = [], {}
    for v, seq, journey, latest, trail in sorted(rows, key=lambda r: (r[0], r[1])):
        start = min(trail) if len(trail) >= 6 else latest - 240_000
        own = {*trail, latest}
        if v not in state or state[v][0] != journey:
            state[v] = (journey, own, start, latest)
        else:
            _, had, begun, last = state[v]
            if latest >= last:
                state[v] = (journey, had | own, min(begun, start) if start <= last else start, latest)
        j, had, begun, last = state[v]
        had = {t for t in had if t >= max(had) - 420_000}
        state[v] = (j, had, begun, last)
        out.append((v, seq, j, len(had), begun, last, begun <= last - 180_000))
    return sorted(out)


def fixes_of(df):
    return sorted(tuple(r) for r in df.select(*[c.split()[0] for c in cycle.FIX.split(", ")]).collect())


def test_reports_of_the_smallest_tables(spark):
    rows = [tuple(r) for r in cycles._reports(spark, SF).select("operator", "vehicle", "seq", "at", "service").collect()]
    got = fixes_of(cycles.QUERIES["journey_reports"](spark, SF))
    assert got == loop_fixes(rows)
    assert {r[5] for r in got} == {"first", "added", "duplicate", "out_of_order", "service_change", "ignored"}


def test_newest_twelve_are_kept(spark):
    rows = [("o", "v", k, k * 10, "s") for k in range(40)] + [("o", "v", 50, 395, "s"), ("o", "v", 51, 5, "s"), ("o", "v", 52, 280, "s"), ("o", "v", 53, 390, "s")]
    got = fixes_of(cycle.journey_fixes(spark.createDataFrame(rows, "operator string, vehicle string, seq long, at long, service string")))
    assert got == loop_fixes(rows) and max(r[7] for r in got) == KEPT_FIXES
    # filed and cut again at once, so the same late time is no duplicate when it comes back
    assert [r[5] for r in got[-4:]] == ["added", "out_of_order", "out_of_order", "duplicate"]


def test_publications_of_the_smallest_tables(spark):
    rows = [(r["vehicle"], r["seq"], r["journey"], r["latest"], list(r["trail"])) for r in cycles.publications(spark, SF).collect()]
    got = sorted(tuple(r) for r in cycles.QUERIES["reports_held_back_to"](spark, SF).collect())
    assert got == loop_held(rows)


def test_publications_that_overlap_or_leave_a_gap(spark):
    s = 1000
    full = [t * s for t in (700, 720, 740, 760, 780, 790)]
    rows = [("v", 1, "j", 500 * s, []), ("v", 2, "j", 600 * s, [550 * s]), ("v", 3, "j", 800 * s, full), ("v", 4, "j", 650 * s, []), ("v", 5, "j", 850 * s, [810 * s]), ("v", 6, "k", 100 * s, []), ("v", 7, "k", 400 * s, [350 * s])]
    got = sorted(tuple(r) for r in cycle.held_back_to(spark.createDataFrame(rows, "vehicle string, seq long, journey string, latest long, trail array<long>")).collect())
    assert got == loop_held(rows)
    assert [r[4] // s for r in got] == [260, 260, 700, 700, 610, -140, 160] and [r[6] for r in got] == [True, True, False, False, True, True, True]


@pytest.mark.parametrize("again", [False, True])
def test_stream_goes_on_after_a_restart(spark, tmp_path, again):
    cycle.with_store(spark)
    rows = [tuple(r) for r in cycles._reports(spark, SF).select("operator", "vehicle", "seq", "at", "service").collect()]
    rows.sort(key=lambda r: r[2])
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    kinds = "operator string, vehicle string, seq long, at long, service string"
    step = len(rows) // 4 + 1

    def run():
        stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(folder)
        cycle.start(cycle.journey_fixes(stream), out, check).awaitTermination()

    for k in range(0, len(rows), step):
        spark.createDataFrame(rows[k : k + step], kinds).coalesce(1).write.mode("append").parquet(folder)
        run()
        if again:
            run()  # nothing new: nothing comes twice
    assert fixes_of(spark.read.parquet(out)) == loop_fixes(rows)


def test_ages_and_outcomes(spark):
    assert [r[0] for r in spark.createDataFrame([(0.4,), (900.0,), (900.5,)], "x double").select(cycle.age_bucket(F.col("x"))).collect()] == ["0", "900", ">900"]
    rows = [("f", 1, "a", False), ("f", 2, "a", True), ("f", 3, "b", True), ("f", 4, "a", False), ("f", 5, "b", False), ("g", 1, "b", False)]
    got = cycle.classified_payloads(spark.createDataFrame(rows, "feed string, seq long, digest string, refused boolean")).collect()
    assert {(r["feed"], r["seq"]): r["outcome"] for r in got} == {("f", 1): "succeeded", ("f", 2): "repeat_payload", ("f", 3): "malformed", ("f", 4): "repeat_payload", ("f", 5): "succeeded", ("g", 1): "succeeded"}
