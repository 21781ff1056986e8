"""Versions of day records, digests of what they say, and windows that only read their own days."""

from pyspark.sql import functions as F

from headway.operators import release, sequences


def test_digests_do_not_depend_on_order(spark):
    rows = [(1, "a", 2), (1, "b", 3), (2, "a", 2), (2, "a", 2), (3, "a", 2)]
    kinds = "day int, x string, n int"
    digest = lambda r: {d["day"]: d["digest"] for d in release.content_digest(spark.createDataFrame(r, kinds), ["day"], ["x", "n"]).collect()}
    one = digest(rows)
    assert one == digest(rows[::-1]) and one[2] != one[3] and len(set(one.values())) == 3
    assert digest([*rows[:4], (3, "a", 3)])[3] != one[3]


def test_reruns_add_nothing_and_changes_add_a_version(spark):
    kinds = "day string, protocol string, model string, mapping int, digest string, scored_at int"
    make = lambda *r: spark.createDataFrame(list(r), kinds)
    stored = make(("d1", "p", "m", 2, "x", 1), ("d2", "p", "m", 2, "y", 1))
    assert release.new_versions(stored, stored).count() == 0
    fresh = make(("d1", "p", "m", 2, "x", 5), ("d1", "p", "m", 2, "z", 5), ("d1", "p", "m", 2, "z", 6), ("d3", "q", "m", 2, "x", 5))
    added = release.new_versions(stored, fresh)
    assert sorted((r["day"], r["digest"]) for r in added.collect()) == [("d1", "z"), ("d3", "x")]
    records = stored.unionByName(added)
    got = {r["day"]: (r["digest"], r["versions"]) for r in release.current_versions(records, "p", "m", 2).collect()}
    assert got == {"d1": ("z", 2), "d2": ("y", 1)}
    window = spark.createDataFrame([("d2",), ("d3",)], "day string")
    assert [r["day"] for r in release.touched_days(records, window, "p", "m", 2).collect()] == ["d3"]


def test_windows_read_their_own_days_only(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = spark.range(0, 40).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 10_000).alias("at"), "id").withColumn("day", F.to_date("at"))
    rows.write.partitionBy("day").parquet(path)
    start, end = F.timestamp_seconds(F.lit(1_700_100_000)), F.timestamp_seconds(F.lit(1_700_150_000))
    got = sequences.in_window(spark.read.parquet(path), "at", start, end, "day")
    assert sorted(r["id"] for r in got.collect()) == [10, 11, 12, 13, 14, 15]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_gaps_over_days_without_rows(spark):
    times = [0, 10, 86_399, 86_400, 5 * 86_400 + 7]
    df = spark.createDataFrame([(t,) for t in times], "t long").withColumn("at", F.timestamp_seconds("t"))
    got = [r["gap_s"] for r in sequences.global_gaps(df, "at").orderBy("at").collect()]
    assert got == [None, 10.0, 86_389.0, 1.0, 4 * 86_400 + 7.0]
