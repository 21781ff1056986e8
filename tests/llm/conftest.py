"""Inputs of the corpus tests: the smallest tables as they are (HEADWAY_SF names others), and documents with odd rows."""

import os
import random

import pytest
from pyspark.sql import types as T

SF = os.environ.get("HEADWAY_SF", "/root/testdata/sf0.001")

#: The documents' columns, and others whose names the operators use themselves.
WIDE = T.StructType(
    [T.StructField(n, t()) for n, t in (("doc_id", T.LongType), ("text", T.StringType), ("lang", T.StringType), ("source", T.StringType), ("n_chars", T.LongType))]
    + [T.StructField(n, T.LongType()) for n in ("id", "size", "copies", "score", "low", "length", "rank", "target", "text_sha256", "n_words", "row", "label", "toxic", "a")]
)


def wide(spark, rows):
    """(doc_id, text, source) to documents with extra columns."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *[7] * (len(WIDE) - 5)) for i, t, s in rows], WIDE)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, copies, repeated rows and shared passages."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(70))
    long = " ".join(rng.choice(words) for _ in range(60_000))
    near = [rng.choice(words) for _ in range(300)]
    rows = [(1, None, "s"), (2, "", None), (3, "   \t\n", "s"), (4, "one", "s"), (5, "ONE", "t"), (6, "one two three four", "t"), (7, long, "s"), (8, long, "u")]
    rows += [(9, "ÀÉ Same text İ", "u"), (10, "ÀÉ same text İ", "u"), (11, "àé same text İ", "v")]
    rows += [(20 + k, f"intro {k} " + passage + f" outro {k}", "v") for k in range(8)]
    rows += [(40 + k, " ".join([*near[: 10 * k], f"x{k}", *near[10 * k + 1 :]]), "s") for k in range(6)]
    rows += [(60, "twice the same row", "t")] * 2 + [(None, "no id here at all", "t"), (None, "no id here at all", "t"), (None, "one", None)]
    rows += [(70 + k, "hot text that is copied many times over", "hot") for k in range(60)]
    return rows
