"""What each cycle brings, with state that is kept from one micro-batch to the next and survives a restart.

Three operators by ``transformWithState``, each with its state in the stream's checkpoint; the same operators run over a table (all rows as one batch):

* ``classified_payloads``: payloads of a feed that repeat the one before them bring nothing new;
* ``journey_fixes``: the newest reports of each vehicle's journey, and which of six kinds every report is;
* ``held_back_to``: from when on every report of a journey is held, as overlapping publications extend it.

Rows of a key are handled in the order in which they arrived, which the rows state themselves, so a batch may hold them in any order and a batch that runs again
gives the same rows. What a key keeps is bounded: a digest, ``KEPT`` reports, or the reports of ``TRAIL_S + SPEED_WINDOW_S`` seconds.
A batch's rows of one key are handled by one task, in memory: a vehicle's reports of a batch, a feed's payloads without their contents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from headway.constants import AGE_CAP_S, KEPT_FIXES, SPEED_WINDOW_S, TRAIL_POINTS, TRAIL_S

#: The store that operators with several states need; set before the stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

PAYLOAD = "feed string, seq long, digest string, outcome string"
FIX = "operator string, vehicle string, seq long, at long, service string, event string, is_new boolean, held int, newest long"
HELD = "vehicle string, seq long, journey string, reports int, complete_from long, latest long, complete boolean"


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable", na_position="first", ignore_index=True)


class Payloads(StatefulProcessor):
    """A feed's payload against the last one that was read: ``repeat_payload`` or ``succeeded``; a refused one is ``malformed`` and changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.previous = handle.getValueState("previous", "digest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = _ordered(rows, ["seq", "digest"])
        last = self.previous.get()[0] if self.previous.exists() else None
        outcomes = []
        for digest, refused in zip(table["digest"], table["refused"], strict=True):
            if digest == last:
                outcomes.append("repeat_payload")
            elif refused:
                outcomes.append("malformed")
            else:
                outcomes.append("succeeded")
                last = digest
        if last is not None:
            self.previous.update((last,))
        yield pd.DataFrame({"feed": key[0], "seq": table["seq"], "digest": table["digest"], "outcome": outcomes})

    def close(self) -> None:
        pass


class Fixes(StatefulProcessor):
    """A vehicle's newest ``KEPT_FIXES`` reports of its present journey, in order of their own time, and the latest time it ever had.

    A report is ``first``, ``added``, a ``duplicate`` of a time that is held, ``out_of_order`` (filed, but never the newest), a ``service_change`` (a newer report of another
    journey, which starts the list anew) or ``ignored`` (an older one of another journey). It is new where it is later than all before it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fixes = handle.getListState("fixes", "at long")
        self.known = handle.getValueState("known", "service string, newest long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = _ordered(rows, ["seq", "at", "service"])
        held = [r[0] for r in self.fixes.get()] if self.fixes.exists() else []
        service, newest = self.known.get() if self.known.exists() else (None, None)
        out = []
        for at, own in zip(table["at"].tolist(), table["service"].tolist(), strict=True):
            is_new = newest is None or at > newest
            newest = at if is_new else newest
            if not held:
                event, held, service = "first", [at], own
            elif own != service:
                event = "service_change" if at > held[-1] else "ignored"
                if event == "service_change":
                    held, service = [at], own
            elif at in held:
                event = "duplicate"
            else:
                event = "out_of_order" if at < held[-1] else "added"
                held = sorted([*held, at])[-KEPT_FIXES:]
            out.append((event, is_new, len(held), held[-1]))
        self.fixes.put([(at,) for at in held])
        self.known.update((service, newest))
        done = pd.DataFrame(out, columns=["event", "is_new", "held", "newest"])
        yield pd.DataFrame({"operator": key[0], "vehicle": key[1], "seq": table["seq"], "at": table["at"], "service": table["service"]}).join(done)

    def close(self) -> None:
        pass


class HeldBack(StatefulProcessor):
    """A vehicle's journey as its publications give it: a full trail is complete back to its oldest report, a shorter one for ``TRAIL_S``.

    A publication that reaches back to what is held extends it, a gap starts anew, an older one or another journey's earlier one changes nothing of what is held.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("held", "journey string, reports array<long>, complete_from long, latest long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = _ordered(rows, ["seq", "journey", "latest"])
        journey, reports, start, latest = self.state.get() if self.state.exists() else (None, [], None, None)
        reports = list(reports or [])
        out = []
        for own, now, trail in zip(table["journey"].tolist(), table["latest"].tolist(), table["trail"].tolist(), strict=True):
            trail = [] if trail is None else [int(t) for t in trail]
            back = min(trail) if len(trail) >= TRAIL_POINTS else now - TRAIL_S * 1000
            fresh = {t for t in trail if t < now} | {now}
            if own != journey:
                journey, reports, start, latest = own, sorted(fresh), back, now
            elif now >= latest:
                start = min(start, back) if back <= latest else back
                reports, latest = sorted(fresh | set(reports)), now
            reports = [t for t in reports if t >= reports[-1] - (TRAIL_S + SPEED_WINDOW_S) * 1000]
            out.append((journey, len(reports), start, latest, start <= latest - SPEED_WINDOW_S * 1000))
        self.state.update((journey, reports, start, latest))
        done = pd.DataFrame(out, columns=["journey", "reports", "complete_from", "latest", "complete"])
        yield pd.DataFrame({"vehicle": key[0], "seq": table["seq"]}).join(done)

    def close(self) -> None:
        pass


def with_store(spark: SparkSession) -> SparkSession:
    """``spark`` with the store that several states of one key need; asking for its streams starts what coordinates stores, for tables too."""
    spark.conf.set(*STORE)
    assert spark.streams is not None
    return spark


def _with_state(rows: DataFrame, keys: list[str], processor: StatefulProcessor, kinds: str) -> DataFrame:
    with_store(rows.sparkSession)
    return rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=kinds, outputMode="Append", timeMode="None")


def classified_payloads(payloads: DataFrame) -> DataFrame:
    """payloads: feed, seq (the order of arrival), digest, refused."""
    return _with_state(payloads.select("feed", "seq", "digest", "refused"), ["feed"], Payloads(), PAYLOAD)


def journey_fixes(reports: DataFrame) -> DataFrame:
    """reports: operator, vehicle, seq (the payload's order of arrival), at (ms), service."""
    return _with_state(reports.select("operator", "vehicle", "seq", "at", "service"), ["operator", "vehicle"], Fixes(), FIX)


def held_back_to(publications: DataFrame) -> DataFrame:
    """publications: vehicle, seq (the order of publication), journey, latest (ms), trail (array of earlier ms)."""
    return _with_state(publications.select("vehicle", "seq", "journey", "latest", "trail"), ["vehicle"], HeldBack(), HELD)


def age_bucket(age_s: Column) -> Column:
    """Whole seconds as text; all above the cap together."""
    return F.when(age_s > AGE_CAP_S, f">{AGE_CAP_S}").otherwise(F.floor(age_s).cast("string"))


def arrival_ages(fixes: DataFrame, payloads: DataFrame) -> DataFrame:
    """How old the reports were that each payload brought for the first time: seq, bucket, reports. A run's first payload has nothing to compare with and counts nothing.

    fixes: as ``journey_fixes`` gives them; payloads: run, seq, received (ms).
    """
    first = payloads.groupBy("run").agg(F.min("seq").alias("first_seq"))
    counted = payloads.join(first, "run").filter("seq > first_seq").select("run", "seq", "received")
    new = fixes.filter("is_new").select("seq", "at")
    met = new.join(counted, "seq").withColumn("bucket", age_bucket((F.col("received") - F.col("at")) / 1000))
    return met.groupBy("run", "seq", "bucket").agg(F.count(F.lit(1)).alias("reports"))


def start(rows: DataFrame, path: str, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Append the rows of an operator to ``path``; with ``seconds`` continuously, else what is there now. A restart goes on from the checkpoint's state."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
