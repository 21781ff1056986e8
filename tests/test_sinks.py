"""Published tables that fail half-way, go backwards, lose keys or are taken back."""

import os

import pytest
from pyspark.sql import functions as F

from headway.sources.sinks import Published, Refused


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "stop string, departs long")


def held(sink):
    return sorted((r["stop"], r["departs"]) for r in sink.read().collect())


def test_versions_and_keys(spark, tmp_path):
    sink = Published(spark, str(tmp_path / "boards"), ["stop"])
    with pytest.raises(FileNotFoundError):
        sink.read()
    assert sink.publish(rows(spark, ("a", 1), ("b", 2)), 10)["rows"] == 2
    sink.publish(rows(spark, ("b", 3), ("c", 4)), 20)
    assert held(sink) == [("b", 3), ("c", 4)]  # a has lost its last service and keeps no board
    version = sink.current()["version"]
    assert sorted(n for n in os.listdir(tmp_path / "boards" / version) if "=" in n) == ["stop=b", "stop=c"]
    assert sink.read().filter("stop = 'b'").count() == 1
    sink.publish(rows(spark, ("d", 5)), 20)  # the same time may be published again
    assert len([n for n in os.listdir(tmp_path / "boards") if n.startswith("version-")]) == 2


def test_a_failure_before_the_swap_leaves_what_is_served(spark, tmp_path, monkeypatch):
    sink = Published(spark, str(tmp_path / "t"))
    sink.publish(rows(spark, ("a", 1)), 10)
    monkeypatch.setattr(sink, "_swap", lambda pointer: (_ for _ in ()).throw(OSError("the machine stops here")))
    with pytest.raises(OSError):
        sink.publish(rows(spark, ("b", 2)), 20)
    again = Published(spark, str(tmp_path / "t"))
    assert held(again) == [("a", 1)]
    broken = rows(spark, ("x", 1)).withColumn("departs", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        again.publish(broken, 30)
    assert held(again) == [("a", 1)]
    again.publish(rows(spark, ("b", 2)), 30)
    assert held(again) == [("b", 2)]


def test_checks_and_order_of_time(spark, tmp_path):
    sink = Published(spark, str(tmp_path / "t"))
    good = {"has_rows": F.count(F.lit(1)) > 0, "all_positive": F.bool_and(F.col("departs") > 0)}
    sink.publish(rows(spark, ("a", 1)), 10, good)
    for bad, names in ((rows(spark, ("a", -1)), ["all_positive"]), (rows(spark), ["has_rows", "all_positive"])):
        with pytest.raises(Refused) as error:
            sink.publish(bad, 20, good)
        assert error.value.reasons == names
    with pytest.raises(Refused, match="not_going_backwards"):
        sink.publish(rows(spark, ("z", 9)), 9)
    assert held(sink) == [("a", 1)] and len([n for n in os.listdir(tmp_path / "t") if n.startswith("version-")]) == 1


def test_rollback(spark, tmp_path):
    sink = Published(spark, str(tmp_path / "t"))
    sink.publish(rows(spark, ("a", 1)), 10)
    with pytest.raises(Refused):
        sink.rollback()
    sink.publish(rows(spark, ("b", 2)), 20)
    assert sink.rollback()["stamp"] == 10 and held(sink) == [("a", 1)]
    sink.publish(rows(spark, ("c", 3)), 15)
    assert held(sink) == [("c", 3)]
