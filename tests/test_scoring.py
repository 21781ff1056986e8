"""What was known of a journey's delay, by brute force, and medians of small groups."""

import random

from headway.functions import stats
from headway.operators import scoring


def test_delay_known_at_each_report(spark):
    rng = random.Random(14)
    passages = [(j, k, 1000 * k + rng.randrange(500), 1000 * k + rng.randrange(4000), 900 * k if rng.random() < 0.7 else None) for j in range(5) for k in range(1, 9)]
    reports = [(j, 700 * n) for j in range(5) for n in range(20)]
    want = set()
    for j, at in reports:
        for target in range(1, 9):
            known = [(p[1], p[2] - p[4] if p[4] is not None else None) for p in passages if p[0] == j and p[1] < target and p[3] <= at]
            if known and max(known)[1] is not None:
                want.add((j, at, target, max(known)[1]))
    got = scoring.known_delay(spark.createDataFrame(reports, "journey long, at long"), spark.createDataFrame(passages, "journey long, stop_index int, passed_ms long, known_ms long, timetable_ms long"))
    assert {(r["journey"], r["at"], r["stop_index"], r["delay_ms"]) for r in got.collect()} == want and want
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_small_quantiles_are_the_exact_ones(spark):
    rng = random.Random(15)
    x = spark.createDataFrame([(k, rng.randrange(50) / 7 if rng.random() < 0.9 else None) for k in range(20) for _ in range(k)], "k long, x double")
    want = stats.quantiles(x, ["k"], "x", {"own": ("linear", 0.5)}).drop("n")
    assert sorted(stats.small_quantile(x, ["k"], "x", 0.5, "own").collect()) == sorted(want.collect())


def test_evaluation_makes_its_spells_once(spark):
    rng = random.Random(20)
    rows = [(j % 3, j, rng.randrange(20), n if j % 3 else 0, rng.randrange(n + 1) if j % 3 else 0, rng.randrange(30), rng.uniform(-5, 9), rng.uniform(-9, 9) if rng.random() < 0.6 else None) for j in range(40) for n in range(15)]
    rows += [(5, 99, 1, 4, 0, 0, None, 2.0), (1, 98, 1, 4, 0, 0, None, None)]  # never shown
    s = spark.createDataFrame(rows, "grp int, journey long, stop_index int, eligible long, eligible_shown long, shown long, error_min double, timetable_min double")
    by = ["grp", "journey"]
    want = scoring.pooled(scoring.journey_histograms(s, by), scoring.journey_coverage(s, by), ["grp"], (-1.15, 5.75))
    got = scoring.evaluated(s, ["grp"], (-1.15, 5.75))
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.filter("grp = 0").first()["eligible"] == 0
    assert "error_min" not in got._jdf.queryExecution().optimizedPlan().toString()
