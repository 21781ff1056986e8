"""Exact deduplication against a persistent digest index.

The index is a table of (text_sha256, keep_id, batch), bucketed and sorted by digest, in a folder of its own. A batch of new
documents is reduced to one row per digest, anti-joined with the index by sort-merge, and what is new is appended.
Both sides of that join hold a digest once, so a text that fills a third of the batch costs one row. Documents then meet
their group in a join of (doc_id, digest) rows, whose hot keys adaptive execution splits.

Every ingest has a batch id, kept with the rows it appends. Rows of the same batch id count as new, not as known: a caller
that stopped between the append and the writing of its documents runs the same batch again, under the same id, and gets
the same documents; nothing is appended twice. Without an id each ingest is a batch of its own.

Defined results: a null text counts as empty, and all empty texts are one group; within a batch the largest doc_id of a
group stays, or the id that the index already holds; a null doc_id is smaller than any other and stays only where no row
of its group has an id; rows that repeat a doc_id are each reported, and ``kept_documents`` returns one of them; an empty
table gives an empty result; columns besides doc_id and text are not read by ``decisions`` and pass through
``kept_documents`` whatever their names are.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.common import ascii_lower, first_rows, fresh, removed, scratch_path, written

DIGEST = "text_sha256"


def with_digest(docs: DataFrame, name: str = DIGEST) -> DataFrame:
    return docs.withColumn(name, F.sha2(ascii_lower(F.col("text")), 256))


class DigestIndex:
    """A digest index in ``path``. ``buckets`` is fixed when the index is made, by default as the session's shuffle partitions, and kept
    in the file ``_buckets`` beside its files; reopening takes that count and refuses another. For files without it ``buckets`` must be given.
    The table's name in the catalogue comes from the whole path; ``forget`` takes it out again and leaves the files.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = self._kept(buckets)
        self.name = "digest_index_" + hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:32]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({DIGEST} STRING, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY ({DIGEST}) SORTED BY ({DIGEST}) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def _kept(self, asked: int | None) -> int:
        Path = self.spark._jvm.org.apache.hadoop.fs.Path
        folder, note = Path(self.path), Path(f"{self.path}/_buckets")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(note):
            stream = fs.open(note)
            kept = int(stream.readLine())
            stream.close()
            if asked and asked != kept:
                raise ValueError(f"the index in {self.path} has {kept} buckets, not {asked}")
            return kept
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        held = [int(m[1]) for m in (re.search(r"^part-.*_([0-9]{5})\.", n) for n in names) if m]
        if held and (not asked or max(held) >= asked):
            raise ValueError(f"the index in {self.path} has files of bucket {max(held)} but no bucket count: give the one it was made with")
        count = asked or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        stream = fs.create(note, False)
        stream.writeBytes(f"{count}\n")
        stream.close()
        return count

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def forget(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def compacted(self, path: str) -> DigestIndex:
        """A new index in ``path`` with the same rows, one sorted file per bucket where each append had left one of its own."""
        new = DigestIndex(self.spark, path, self.buckets)
        new._append(self.spark.read.schema(self.rows().schema).parquet(self.path))  # as plain files, so that the rows are dealt anew
        return new

    def _append(self, rows: DataFrame) -> None:
        dealt = rows.select(DIGEST, "keep_id", "batch").repartition(self.buckets, DIGEST)
        writer = dealt.write.bucketBy(self.buckets, DIGEST).sortBy(DIGEST).format("parquet").option("path", self.path)
        writer.mode("append").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def ingest(self, digests: DataFrame, batch: str | None = None) -> DataFrame:
        """Add a batch of (doc_id, text_sha256) rows. Returns one row per digest of the batch: keep_id, group_size, is_new."""
        batch = batch or uuid.uuid4().hex
        groups = written(digests.groupBy(DIGEST).agg(F.max("doc_id").alias("newest_id"), F.count(F.lit(1)).alias("group_size")), "batch")
        dealt = groups.repartition(self.buckets, DIGEST)
        held = self.rows().withColumnRenamed("keep_id", "held_id").hint("merge")
        fresh = dealt.join(held, DIGEST, "left_anti").select(DIGEST, F.col("newest_id").alias("keep_id"), "group_size", F.lit(True).alias("is_new"), F.lit(False).alias("is_held"))
        own = F.coalesce(F.col("batch") == batch, F.lit(False))
        known = dealt.join(held, DIGEST).select(DIGEST, F.col("held_id").alias("keep_id"), "group_size", own.alias("is_new"), F.lit(True).alias("is_held"))
        met = written(fresh.unionByName(known), "groups")
        removed(groups)
        self._append(met.filter("NOT is_held").withColumn("batch", F.lit(batch)))
        return met.drop("is_held")


def decisions(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = written(with_digest(docs.select("doc_id", "text")).select("doc_id", DIGEST), "digests")
    groups = index.ingest(digests, batch)
    kept = F.col("is_new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return digests.join(groups, DIGEST).select("doc_id", "keep_id", "group_size", kept.alias("kept"), DIGEST)


def kept_documents(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, one of each new group, with all their columns."""
    mark, key = fresh(docs, "__digest"), fresh(docs, "__keep_id")
    digests = with_digest(docs.select("doc_id", "text")).select("doc_id", DIGEST)
    groups = index.ingest(digests, batch).filter("is_new").select(F.col(DIGEST).alias(mark), F.col("keep_id").alias(key))
    rows = with_digest(docs, mark)
    stay = (rows[mark] == groups[mark]) & rows["doc_id"].eqNullSafe(groups[key])
    return first_rows(rows.join(groups, stay, "left_semi"), [mark, "doc_id"]).select(*docs.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decisions(docs, DigestIndex(spark, scratch_path(spark, "index")))


OP7_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
