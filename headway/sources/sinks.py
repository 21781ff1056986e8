"""Published tables: each version a folder of its own, and a pointer that names the one that is served.

A version is written whole and checked, and only then the pointer is swapped, by a rename of a file written beside it. Whatever fails before that leaves the served version as it
was; a folder that no pointer names is never read. A version stamped earlier than the served one is refused, so what is served never goes back by itself; ``rollback`` does it on purpose.
Tables that have one folder for each key (``by``) need no deletions: a key that has lost its last row is not in the new version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Refused(RuntimeError):
    """A version that was not published, with the names of the checks it failed."""

    def __init__(self, reasons: list[str]):
        super().__init__(", ".join(reasons))
        self.reasons = reasons


class Published:
    """A published table in ``path``; ``by`` names the columns that its folders are made by."""

    def __init__(self, spark: SparkSession, path: str, by: list[str] | None = None):
        self.spark, self.path, self.by = spark, path.rstrip("/"), by or []
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _text(self, name: str) -> str | None:
        file = self._jpath(f"{self.path}/{name}")
        if not self._fs.exists(file):
            return None
        stream = self._fs.open(file)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _swap(self, pointer: dict) -> None:
        """Replace the pointer: written aside under a name of its own, then renamed over the old one."""
        aside, file = self._jpath(f"{self.path}/.pointer-{uuid.uuid4().hex}"), self._jpath(f"{self.path}/CURRENT")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps(pointer).encode()))
        stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = overwrite
        context.rename(aside, file, options)

    def current(self) -> dict | None:
        """The served version: version, stamp, rows and the versions before it, newest first."""
        held = self._text("CURRENT")
        return json.loads(held) if held else None

    def read(self) -> DataFrame:
        held = self.current()
        if held is None:
            raise FileNotFoundError(f"nothing is published in {self.path}")
        return self.spark.read.parquet(f"{self.path}/{held['version']}")

    def publish(self, rows: DataFrame, stamp: int, checks: dict[str, Column] | None = None, keep: int = 2) -> dict:
        """Write ``rows`` as the version of ``stamp``, check what was written, and serve it. ``checks``: aggregates over the version that must be true.

        Raises ``Refused`` with the failed checks; then, as after any failure, what was served still is. Versions beyond the last ``keep`` are deleted.
        """
        before = self.current()
        if before and stamp < before["stamp"]:
            raise Refused(["publication_time_not_going_backwards"])
        version = f"version-{stamp}-{uuid.uuid4().hex[:12]}"
        writer = rows.write.partitionBy(*self.by) if self.by else rows.write
        writer.parquet(f"{self.path}/{version}")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{version}")
        named = checks or {}
        found = written.agg(F.count(F.lit(1)).alias("__rows"), *[F.coalesce(c, F.lit(False)).alias(n) for n, c in named.items()]).first()
        failed = [n for n in named if not found[n]]
        if failed:
            self._delete(version)
            raise Refused(failed)
        earlier = [before["version"], *before["earlier"]] if before else []
        pointer = {"version": version, "stamp": stamp, "rows": found["__rows"], "earlier": earlier[: keep - 1]}
        self._swap(pointer)
        for old in earlier[keep - 1 :]:
            self._delete(old)
        return pointer

    def rollback(self) -> dict:
        """Serve the version before the served one."""
        held = self.current()
        if held is None or not held["earlier"]:
            raise Refused(["no_version_to_go_back_to"])
        version, *earlier = held["earlier"]
        rows = self.spark.read.parquet(f"{self.path}/{version}").count()
        pointer = {"version": version, "stamp": int(version.split("-")[1]), "rows": rows, "earlier": earlier}
        self._swap(pointer)
        return pointer

    def _delete(self, version: str) -> None:
        self._fs.delete(self._jpath(f"{self.path}/{version}"), True)
