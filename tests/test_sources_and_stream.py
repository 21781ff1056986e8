"""Payloads to activities, captures, the stop register, and the stream into the history."""

import hashlib
import io
import os
import time
import zipfile

from pyspark.sql import functions as F

from headway.sources import activities as A
from headway.sources import stops
from headway.streaming.ingest import History, ingest, payload_stream

NOW = time.strftime("%Y-%m-%dT%H:%M:%S+00:00", time.gmtime(time.time() - 3600))


def activity(vehicle="V1", at=NOW, lat="53.470", lon="-2.240", line="<LineRef>142</LineRef>", bearing="", prefix=""):
    xml = (
        f"<VehicleActivity><RecordedAtTime>{at}</RecordedAtTime><MonitoredVehicleJourney>{line}<DirectionRef>inbound</DirectionRef><OperatorRef>T&amp;T</OperatorRef>"
        f"<FramedVehicleJourneyRef><DatedVehicleJourneyRef>J1</DatedVehicleJourneyRef></FramedVehicleJourneyRef><VehicleJourneyRef>J0</VehicleJourneyRef>"
        f"<VehicleLocation><Longitude>{lon}</Longitude><Latitude>{lat}</Latitude></VehicleLocation>{bearing}<VehicleRef>{vehicle}</VehicleRef></MonitoredVehicleJourney></VehicleActivity>"
    )
    return xml.replace("</", f"</{prefix}").replace("<", f"<{prefix}").replace(f"<{prefix}/{prefix}", f"</{prefix}") if prefix else xml


def payload(*each, head=f"<ResponseTimestamp>{NOW}</ResponseTimestamp>"):
    return f'<?xml version="1.0"?><Siri xmlns="http://www.siri.org.uk/siri">{head}{"".join(each)}</Siri>'.encode()


def test_activities(spark):
    good = payload(activity(bearing="<Bearing>0</Bearing>"), activity("V2", line="", bearing="<Bearing>nan</Bearing>"))
    rows = [("a", bytearray(good)), ("b", bytearray(b"<!DOCTYPE x>" + good)), ("c", bytearray(b"nothing")), ("d", bytearray(payload(activity("V3", prefix="s:"))))]
    df = spark.createDataFrame(rows, "path string, content binary").withColumn("retrieved_at", F.current_timestamp())
    got = {r["vehicle"]: r for r in A.activities(df).collect()}
    assert set(got) == {"V1", "V2", "V3"}
    assert (got["V1"]["operator"], got["V1"]["journey_ref"], got["V1"]["line"], got["V1"]["bearing"], got["V1"]["bearing_status"]) == ("T&T", "J1", "142", 0.0, "reported")
    assert (got["V2"]["line"], got["V2"]["bearing_status"], got["V2"]["bearing"]) == ("Unspecified", "invalid", None)
    odd = payload(activity("<![CDATA[V & 4]]>", line="<LineRef>&#49;5&amp;A</LineRef>"))
    more = A.activities(spark.createDataFrame([("e", bytearray(odd))], "path string, content binary").withColumn("retrieved_at", F.current_timestamp())).first()
    assert (more["vehicle"], more["line"]) == ("V & 4", "15&A")
    assert got["V3"]["bearing_status"] == "absent" and got["V1"]["source_hash"] == hashlib.sha256(good).hexdigest()


def test_captures(spark):
    good, undated = payload(activity()), payload(activity(), head="")
    name = lambda b: f"/x/{hashlib.sha256(b).hexdigest()}.xml"
    rows = [(name(good), bytearray(good)), (name(good).replace("/x", "/y"), bytearray(undated)), (name(undated), bytearray(undated)), (name(b"zz"), bytearray(b"zz"))]
    got = {r["path"]: r["state"] for r in A.captures(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert [got[r[0]] for r in rows] == ["ready", "corrupt", "undated", "malformed"]


def test_stop_register(spark, tmp_path):
    base = dict.fromkeys(stops.COLUMNS, "x") | {"Latitude": "53.47", "Longitude": "-2.24", "StopType": "BCT", "Status": "active"}
    odd = [{}, {"StopType": "RLY", "Status": "inactive"}, {"Status": "inactive"}, {"Latitude": "y"}, {"Latitude": "50"}, {"CommonName": ""}]
    lines = [",".join(stops.COLUMNS)] + [",".join((base | o | {"ATCOCode": str(k)})[c] for c in stops.COLUMNS) for k, o in enumerate(odd)]
    (tmp_path / "stops.csv").write_text("\n".join(lines))
    judged = stops.judged(stops.read(spark, str(tmp_path / "stops.csv")))
    got = {int(r["ATCOCode"]): r["reason"] for r in judged.collect()}
    assert got == {0: None, 1: "not_a_bus_stop", 2: "not_active", 3: "unreadable_coordinate", 4: "outside_collected_area", 5: "missing_name"}
    assert stops.refusals(judged).count() == 5


def test_stream_into_history(spark, tmp_path):
    folder, history = tmp_path / "in", History(spark, str(tmp_path / "history"))
    os.makedirs(folder)

    def run(name, *each):
        (folder / name).write_bytes(payload(*each))
        ingest(payload_stream(spark, str(folder)), history, str(tmp_path / "checkpoint")).awaitTermination()
        return history.rows("observations").count(), history.rows("conflicts").count(), history.published().count(), history.rows("quarantine").count()

    assert run("1.xml", activity("V1"), activity("V2")) == (2, 0, 2, 0)
    assert run("2.xml", activity("V1"), activity("V2", lat="53.471"), activity("V3"), activity("V3", lat="53.480")) == (2, 2, 1, 0)
    assert run("3.xml", activity("V4"), activity("V5", at="2026-01-01T10:00:00"), activity("V6", lat="10"), activity("", lat="53.45")) == (3, 2, 2, 2)
    assert run("4.xml", activity("V4"), activity("V5", at="2026-01-01T10:00:00")) == (3, 2, 2, 3)
    late = "2026-01-02T10:00:00Z"
    assert run("5.xml", activity("V4", at=late)) == (4, 2, 3, 3)
    again = spark.createDataFrame([("z", bytearray(payload(activity("V4", at=late))))], "path string, content binary").withColumn("retrieved_at", F.current_timestamp())
    assert history.add(A.activities(again)) == {"repeat": 1}


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name.replace("_", "."), body)
    return out.getvalue()


def test_stream_keeps_refused_payloads_and_unpacks_archives(spark, tmp_path):
    folder, history = tmp_path / "in", History(spark, str(tmp_path / "history"))
    os.makedirs(folder)
    good = payload(activity("V1"))
    refused = {b"<!DOCTYPE x>" + good: "declares_entities", payload(activity("V2"))[:-7]: "malformed", b"nothing": "malformed", b"PK broken": "malformed"}
    refused |= {zipped(a_txt=b"no XML"): "malformed", zipped(a_xml=payload(activity("V3")), b_xml=b"<Siri>"): "malformed"}
    for k, body in enumerate([*refused, good, zipped(a_xml=payload(activity("V4")), b_XML=payload(activity("V5")), c_txt=b"x")]):
        (folder / f"{k}").write_bytes(body)
    for checkpoint in ("c1", "c2"):  # the second load finds its rows there
        ingest(payload_stream(spark, str(folder)), history, str(tmp_path / checkpoint)).awaitTermination()
        assert sorted(r["vehicle"] for r in history.rows("observations").collect()) == ["V1", "V4", "V5"]
        got = {r["source_hash"]: r["reason"] for r in history.rows("quarantine").collect()}
        assert got == {hashlib.sha256(body).hexdigest(): reason for body, reason in refused.items()}
        assert history.rows("quarantine").count() == len(refused)
