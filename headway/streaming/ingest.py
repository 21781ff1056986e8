"""Continuous ingestion: a stream of payload files into an observation history that may be loaded again and again.

Late reports are accepted for ever, so there is no watermark: an observation's identity includes its time, and a batch adds what
the history lacks. A batch that is run again after a failure finds its rows there and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from headway.operators import identity, quality
from headway.sources.activities import parsed, refusals, unpacked

KEYS = ["day", "operator", "vehicle", "line", "direction", "journey_ref", "observed_at"]
VALUES = ["lat", "lon"]
_READINGS = "day date, operator string, vehicle string, line string, direction string, journey_ref string, observed_at timestamp, lat double, lon double"
_FILE = "path string, modificationTime timestamp, length long, content binary"
_REFUSED = "quarantine_id string, reason string, source_hash string, recorded_at string, vehicle string, latitude string, longitude string"


class History:
    """Observations, conflicts and quarantined rows as Parquet folders; observations by day, so a batch meets its own days only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for name in ("observations", "conflicts", "quarantine"):
            if not self._there(name):
                self._append(spark.createDataFrame([], _REFUSED if name == "quarantine" else _READINGS), name)

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _append(self, rows: DataFrame, name: str) -> None:
        writer = rows.write.mode("append")
        (writer if name == "quarantine" else writer.partitionBy("day")).parquet(f"{self.path}/{name}")

    def rows(self, name: str) -> DataFrame:
        return self.spark.read.schema(_REFUSED if name == "quarantine" else _READINGS).parquet(f"{self.path}/{name}")

    def published(self) -> DataFrame:
        """Observations that no conflict names."""
        return identity.publishable(self.rows("observations"), self.rows("conflicts"), KEYS)

    def add(self, activities: DataFrame, payloads: DataFrame | None = None) -> dict[str, int]:
        """Load parsed activities, and payloads refused whole (source_hash, reason); how many identities had which outcome."""
        judged = quality.validated(activities).persist()
        text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)  # noqa: E731  identities have no nulls
        good = judged.filter("reason IS NULL").select(F.to_date("observed_at").alias("day"), *[text(c) for c in KEYS[1:-1]], "observed_at", *VALUES)
        found = identity.classify(good, self.rows("observations"), KEYS, VALUES).persist()
        outcomes = {r["outcome"]: r["n"] for r in found.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
        refused = judged.filter("reason IS NOT NULL AND reason <> 'outside_area'")
        if payloads is not None:
            refused = refused.unionByName(payloads, allowMissingColumns=True)
        fields = [F.col(c) for c in ("source_hash", "reason", "recorded_at", "vehicle", "latitude", "longitude")]
        refused = refused.select(quality.quarantine_id(*fields).alias("quarantine_id"), "reason", "source_hash", "recorded_at", "vehicle", "latitude", "longitude")
        refused = identity.insert_absent(self.rows("quarantine"), refused.dropDuplicates(["quarantine_id"]), ["quarantine_id"])
        conflicts = found.filter("outcome IN ('conflict_in_batch', 'conflict_with_stored')").select(*KEYS, *VALUES)
        self._append(identity.insert_absent(self.rows("conflicts"), conflicts, KEYS), "conflicts")
        self._append(refused, "quarantine")
        self._append(found.filter("outcome = 'new'").select(*KEYS, *VALUES), "observations")
        found.unpersist()
        judged.unpersist()
        return outcomes


def payload_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Payload files as they arrive; a file counts as retrieved when it was written."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select("path", "content", F.col("modificationTime").alias("retrieved_at"))


def ingest(stream: DataFrame, history: History, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Start loading; with ``seconds`` continuously, else what is there now and then stop."""

    def load(batch: DataFrame, _: int) -> None:
        once = batch.withColumn("digest", F.sha2("content", 256)).dropDuplicates(["digest"]).drop("digest")
        read = unpacked(once).persist()
        history.add(parsed(read), refusals(read))
        read.unpersist()

    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
