"""What several of the corpus operators share: shared scratch tables, word rules and word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word, by the contracts: a run of anything but ASCII white space (``bytes.split()`` gives the same words).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_unset: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local folder of our own only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or _unset.get(sc.applicationId)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _unset[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="headway-")
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/headway/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage ends here and lost executors cost no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete a table that ``written`` made and that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def first_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key, always the same: that whose text is first, by code point, then that whose columns hash lowest."""
    hashed = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    order = [F.col("text").asc_nulls_first(), F.xxhash64(*hashed)]
    place = fresh(df, "__place")
    return df.withColumn(place, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(place) == 1).drop(place)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the fast built-in, which does the same for them."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def portions(texts: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes, one text at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
    start = 0
    while start < len(sizes):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield start, end
        start = end


def coded_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of the texts, each word's place among them in order, and where each text's words begin (and end)."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = parts.offsets.to_numpy()
    coded = parts.flatten().dictionary_encode()
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    full = np.array([bool(w) for w in words], bool)[at] if words else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(full)])
    return words, at[full], before[offsets - offsets[0]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def platt(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None, counts: tuple[int, int] | None = None) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * logit + b) is calibrated: Newton steps on smoothed targets; few rows leave the logit as it is. counts: rows labelled 0 and 1, where one stands for several."""
    weights = np.ones(len(labels)) if weights is None else weights
    n0, n1 = counts or (int((1 - labels).sum()), int(labels.sum()))
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([logits.astype(np.float64), np.ones(len(logits))], axis=1)
    ab, toward, pull = np.array([1.0, 0.0]), np.array([1.0, 0.0]), np.diag([1.0, 0.05])
    for _ in range(50):
        p = sigmoid(x @ ab)
        h = (x * (weights * p * (1 - p))[:, None]).T @ x + pull
        ab = ab - np.clip(np.linalg.solve(h, x.T @ (weights * (p - goal)) + pull @ (ab - toward)), -0.5, 0.5)
    return max(float(ab[0]), 0.1), float(ab[1])


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound and then begun anew."""

    BOUND = 100_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return h

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words of the texts, and where each text's words begin (and end)."""
        words, at, starts = coded_words(texts)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))[at], starts


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of all windows of ``n`` consecutive word hashes, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])

    def prefix(self, h: np.ndarray) -> np.ndarray:
        self.powers(len(h) + 1)
        out = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.up[: len(h)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of words[start:end]; equal for equal word sequences wherever they stand (mixed with the length by the caller's choice)."""
        return mix64((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64))
