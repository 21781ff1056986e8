"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; ``conf`` keys are given with ``_`` for ``.``."""
    builder = SparkSession.builder.appName("headway")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def settled(df):
    """``df`` computed once for what reads it several times: a checkpoint in the shared folder where the session has one, else kept by the executors."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One input table, read by Spark's own reader (any file system that it knows)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
