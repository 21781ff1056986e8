"""Substring deduplication by seed and extend over winnowed anchors.

A window is ``WINDOW`` consecutive words. Its anchor is the 20-gram of words with the smallest hash in it, so equal windows
have equal anchors at equal places, and runs of windows share one anchor: a document of n words has about n / 16 anchors.

1. Seed: anchors that occur in two documents or more are found by one aggregation; documents join on them.
2. Extend: an anchor's run of windows covers a span of up to 80 words, the longest that its windows extend it both ways. Words
   are not compared one by one: a span is extended and compared by a 128-bit hash of all its words. Equal spans are settled at once: all but those of the smallest doc_id are repeats. Of each distinct span only that first
   document goes on, and only if its anchor has several spans: there every window is compared, by a 128-bit hash.
3. A document's windows that start in a smaller doc_id unite to maximal repeats, whose words are removed.

No step pairs the occurrences of an anchor with each other: each is aggregated to its smallest doc_id and joined with that.

Defined results: a null text has no words; a document shorter than a window keeps all its words; rows that repeat a doc_id
are one document and never repeat each other; a row without doc_id is neither compared nor changed; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.common import Rolling, WordHashes, first_rows, mix64, portions, removed, written

WINDOW, GRAM = 50, 20
CHOICE = WINDOW - GRAM + 1

_words, _one, _two = WordHashes(), Rolling(0x9E3779B97F4A7C15), Rolling(0xC2B2AE3D27D4EB4F)


class Anchored:
    """The anchors of some texts: of each run of windows its text, first and last window, anchor and hashes."""

    def __init__(self, texts: pa.Array):
        self.words, self.starts = _words.of(texts)
        n = len(self.words)
        self.first, self.second = _one.prefix(self.words), _two.prefix(mix64(self.words ^ np.uint64(0xD6E8FEB86659FD93)))
        text = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        left = self.starts[1:][text] - np.arange(n)  # words from here to the text's end
        gram = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
        at = np.flatnonzero(left >= GRAM)
        gram[at] = _one.between(self.first, at, at + GRAM)
        window = np.flatnonzero(left >= WINDOW)
        if len(window):
            least = np.lib.stride_tricks.sliding_window_view(gram, CHOICE)[window].argmin(1) + window
            new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (text[window[1:]] != text[window[:-1]])]))
            last = np.concatenate([new[1:] - 1, [len(window) - 1]])
            self.begin, self.end, self.anchor = window[new], window[last], least[new]
        else:
            self.begin = self.end = self.anchor = np.zeros(0, np.int64)
        self.text = text[self.begin]
        self.gram = gram[self.anchor]

    def spans(self) -> np.ndarray:
        return _two.between(self.second, self.begin, self.end + WINDOW)

    def packed(self) -> np.ndarray:
        """First window within the text, windows after it, and the anchor's distance from it."""
        own = self.begin - self.starts[self.text]
        return own << 12 | (self.end - self.begin) << 6 | (self.anchor - self.begin)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in portions(batch.column(1)):
            texts = batch.column(1).slice(a, b - a)
            found = Anchored(texts)
            cuts = np.searchsorted(found.text, np.arange(b - a + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int64))) for x in (found.gram.view(np.int64), found.spans().view(np.int64), found.packed())]
            whole = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in texts.to_pylist()]
            columns = [batch.column(0).slice(a, b - a), pa.array(np.diff(found.starts), pa.int64()), pa.array(whole), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "whole_sha256", "anchor", "span", "place"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, places to open) to one row per window to compare."""
    for batch in batches:
        for a, b in portions(batch.column("text")):
            part = batch.slice(a, b - a)
            found = Anchored(part.column("text"))
            places = found.packed()
            cuts = np.searchsorted(found.text, np.arange(b - a + 1))
            opened = np.zeros(len(places), bool)
            for k, ask in enumerate(part.column("ask").to_pylist()):
                opened[cuts[k] : cuts[k + 1]] = np.isin(places[cuts[k] : cuts[k + 1]], ask)
            runs = np.flatnonzero(opened)
            size = found.end[runs] - found.begin[runs] + 1
            at = np.repeat(found.begin[runs] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            text = np.searchsorted(found.starts, at, side="right") - 1
            docs = part.column("doc_id").to_numpy()[text]
            one, two = (r.between(p, at, at + WINDOW).view(np.int64) for r, p in ((_one, found.first), (_two, found.second)))
            columns = [pa.array(docs), pa.array((at - found.starts[text]).astype(np.int32)), pa.array(one), pa.array(two)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "at", "one", "two"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, ranges of windows) to what is left without the words that the windows cover."""
    for batch in batches:
        out: list[list] = [[], []]
        for text, first, last in zip(batch.column("text").to_pylist(), batch.column("first").to_pylist(), batch.column("last").to_pylist(), strict=True):
            words = (text or "").encode().split()
            cover = np.zeros(len(words) + WINDOW + 1, np.int64)
            np.add.at(cover, np.minimum(first, len(words)), 1)
            np.add.at(cover, np.minimum(np.array(last, np.int64) + WINDOW, len(words)), -1)
            gone = np.cumsum(cover)[: len(words)] > 0
            out[0].append(int(gone.sum()))
            out[1].append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(~gone)])).hexdigest())
        columns = [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "n_removed", "left_sha256"])


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of every document its size and digest; the texts that share an anchor; their repeated windows (doc_id, first, last)."""
    found = written(docs.select("doc_id", "text").mapInArrow(_anchors, "doc_id long, n_words long, whole_sha256 string, anchor array<long>, span array<long>, place array<long>"), "anchors")
    seeds = found.filter("doc_id IS NOT NULL").select("doc_id", F.explode(F.arrays_zip("anchor", "span", "place")).alias("x"))
    seeds = seeds.select("doc_id", "x.anchor", "x.span", "x.place")
    ends = seeds.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("span").alias("a"), F.max("span").alias("b"))
    ends = written(ends.filter("lo < hi").select("anchor", (F.col("a") < F.col("b")).alias("several")), "shared")
    shared = written(seeds.join(ends, "anchor"), "seeds")
    whole = written(found.select("doc_id", "n_words", "whole_sha256"), "sizes")
    removed(found)
    removed(ends)
    firsts = written(shared.groupBy("anchor", "span").agg(F.min("doc_id").alias("first_id")), "firsts")
    spans = written(shared.join(firsts, ["anchor", "span"]).select("doc_id", "place", "several", "first_id"), "spans")
    removed(shared)
    removed(firsts)
    at = F.shiftright("place", 12)
    settled = spans.filter("doc_id > first_id").select("doc_id", at.alias("first"), (at + F.shiftright("place", 6).bitwiseAND(F.lit(63))).alias("last"))
    per = spans.groupBy("doc_id").agg(F.collect_list(F.when(F.col("several") & (F.col("doc_id") == F.col("first_id")), F.col("place"))).alias("ask"))
    per = written(per, "places")
    ids = per.select("doc_id")
    texts = written(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), "texts")
    opened = texts.join(per.filter(F.size("ask") > 0), "doc_id").select("doc_id", "text", "ask")
    windows = written(opened.mapInArrow(_windows, "doc_id long, at int, one long, two long"), "windows")
    least = windows.groupBy("one", "two").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    least = written(least.select("one", "two", "lo"), "least")
    hits = windows.join(least, ["one", "two"]).filter("doc_id > lo").select("doc_id", F.col("at").cast("long").alias("first"), F.col("at").cast("long").alias("last"))
    return whole, texts, written(settled.unionByName(hits), "repeats")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256."""
    whole, texts, found = repeats(docs)
    ranges = written(found.groupBy("doc_id").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last")), "ranges")
    cut = texts.join(ranges, "doc_id").transform(first_rows, ["doc_id"]).select("doc_id", "text", "first", "last").mapInArrow(_kept, "id long, n_removed long, left_sha256 string")
    cut = written(cut, "cut")
    rows = whole.join(cut, whole["doc_id"] == cut["id"], "left")
    return rows.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("left_sha256", "whole_sha256").alias("kept_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
