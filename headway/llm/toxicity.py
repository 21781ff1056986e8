"""Toxicity by a convolutional text classifier trained in numpy, on every labelled row.

Words (lower case, without punctuation at their ends) get hashed embeddings from four tables side by side: two by different
hashes of the whole word, so two words share both only if both hashes meet, and two by its first letters, for words that
were never seen but begin like known ones. The first component starts as the word's shrunken log-odds. Filters of several widths slide over the word vectors, the largest activation of each
filter over the whole text is kept, and a logistic layer scores it.

Training is iterative parameter mixing: the labelled rows are dealt by id into shards of about ``ROWS``, a task for each.
The log-odds are counted over all of them. In an epoch each task goes once through its shard, from the model that all share, and
what it changed is averaged by parameter over the shards that changed it, in fixed point, so the order of the tasks does not matter. A quarter of
the rows, by a hash of the id, is set aside to calibrate the score (Platt scaling) and a threshold for each language, from counts of
their logits to 1/``BIN``. The driver holds tables of a fixed size only. The score itself sees the text only.

Defined results: a null or empty text is scored as no words at all; a document without doc_id is scored and counts as not
held out; labels that are null, or of no document, are not used; with one class or none the score is the labelled share of
toxic rows; of labelled rows that repeat a doc_id the one whose text is first is learnt from; an empty table gives an empty
result; rows that repeat are scored alike; other columns pass through
``accepted_documents`` and are not read by ``score_documents`` (which takes ``lang`` for the thresholds alone).
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.common import WordHashes, first_rows, platt, portions, sigmoid

#: Labelled rows of a shard, on average; a part of a logit that calibration tells apart; steps of the fixed point.
ROWS, BIN, UNIT = 4000, 256, 1 << 32
WIDTHS, FILTERS, DEPTH, BUCKETS = (1, 2, 3), 8, 4, 1 << 16
#: First letters that the third and fourth table go by.
PREFIXES = (6, 8)
TABLES = 2 + len(PREFIXES)
EPOCHS, BATCH, RATE, SEED = 5, 32, 0.02, 20260929
#: Words that are scored at a time; longer texts are pooled over several stretches.
STRETCH = 1 << 15
#: The contract's cut; the fallback of languages with too few labelled rows.
CUT, LEAST = 0.3, 15
EDGES = ".,;:!?\"'()[]{}|*#<>-_=+/\\~`"


class Words(WordHashes):
    """The four rows of a word, 16 bits each in one number; 0 for a word of punctuation alone."""

    def __missing__(self, word: str) -> int:
        bare = word.lower().strip(EDGES)
        if len(self) >= self.BOUND:
            self.clear()
        packed = xxhash.xxh3_64_intdigest(bare.encode()) & 0xFFFFFFFF if bare else 0
        for k, n in enumerate(PREFIXES if bare else ()):
            packed |= (xxhash.xxh32_intdigest(bare[:n].encode(), n) & 0xFFFF) << (32 + 16 * k)
        self[word] = packed
        return packed


_words = Words()


def rows_of(words: np.ndarray) -> list[np.ndarray]:
    return [((words >> np.uint64(16 * t)) & np.uint64(BUCKETS - 1)).astype(np.int64) for t in range(TABLES)]


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts, each text led by as many zeros as a window may reach over its end; where each begins, and the end."""
    words, starts = _words.of(texts)
    lead = max(WIDTHS) - 1
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    out = np.zeros(len(words) + lead * (len(starts) - 1), np.uint64)
    out[np.arange(len(words)) + lead * (text + 1)] = words
    return out, starts + lead * np.arange(len(starts))


class Model:
    """Embedding tables, filters of each width and a logistic layer; ``a`` and ``b`` calibrate the logit."""

    def __init__(self, rng: np.random.Generator):
        self.tables = [np.zeros((BUCKETS, DEPTH), np.float32) for _ in range(TABLES)]
        # blocks[j, f, step]: what filter f of width WIDTHS[j] takes from the word at ``step`` of its window
        self.blocks = [rng.normal(0, 0.2, (w, FILTERS, TABLES * DEPTH)).astype(np.float32) for w in WIDTHS]
        for w, block in zip(WIDTHS, self.blocks, strict=True):
            block[:, :, ::DEPTH] = np.abs(block[:, :, ::DEPTH]) + 0.3 / w  # the priors count for, never against
        self.floors = np.full(len(WIDTHS) * FILTERS, -0.2, np.float32)
        self.out = (0.2 + rng.normal(0, 0.05, len(WIDTHS) * FILTERS)).astype(np.float32)
        self.bias, self.a, self.b = np.float32(-2.0), 1.0, 0.0
        self.thresholds: dict[str, float] = {}
        # Adagrad's sums of squares
        self.grown = [np.full_like(v, 1e-4) for v in (*self.blocks, self.floors, self.out)]
        self.table_grown = [np.full(BUCKETS, 1e-2, np.float32) for _ in range(TABLES)]
        self.bias_grown = 1e-4

    def state(self) -> np.ndarray:
        """All that is learnt: a row for each row of the tables (its vector and sum of squares), then for each other parameter (it in the first column)."""
        tables = np.concatenate([np.column_stack([t, g]) for t, g in zip(self.tables, self.table_grown, strict=True)]).astype(np.float64)
        value, grown = ([*map(np.ravel, (*v, last))] for v, last in (((*self.blocks, self.floors, self.out), self.bias), (self.grown, self.bias_grown)))
        rest = np.zeros((sum(map(len, value)), DEPTH + 1))
        rest[:, 0], rest[:, -1] = np.concatenate(value), np.concatenate(grown)
        return np.concatenate([tables, rest])

    def take(self, state: np.ndarray) -> None:
        for t in range(TABLES):
            own = state[t * BUCKETS : (t + 1) * BUCKETS]
            self.tables[t][:], self.table_grown[t][:] = own[:, :DEPTH], own[:, DEPTH]
        at = TABLES * BUCKETS
        for value, grown in zip((*self.blocks, self.floors, self.out), self.grown, strict=True):
            own = state[at : at + value.size]
            value[:], grown[:] = own[:, 0].reshape(value.shape), own[:, -1].reshape(value.shape)
            at += value.size
        self.bias, self.bias_grown = np.float32(state[at, 0]), float(state[at, -1])

    def vectors(self, words: np.ndarray) -> np.ndarray:
        return np.concatenate([t[rows] for t, rows in zip(self.tables, rows_of(words), strict=True)], axis=1)

    def activations(self, x: np.ndarray) -> np.ndarray:
        """One row per filter, one column per word."""
        flat = np.concatenate([b.reshape(-1, x.shape[1]) for b in self.blocks]) @ x.T
        z = np.repeat(self.floors[:, None], len(x), axis=1)
        row = 0
        for j, w in enumerate(WIDTHS):
            own = z[j * FILTERS : (j + 1) * FILTERS]
            for step in range(w):
                own[:, : len(x) - step] += flat[row : row + FILTERS, step:]
                row += FILTERS
        return z

    def logits(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        top = np.full((len(self.floors), len(starts) - 1), -np.inf, np.float32)
        for a in range(0, len(words), STRETCH):
            b = min(a + STRETCH, len(words))
            z = self.activations(self.vectors(words[a : b + max(WIDTHS) - 1]))[:, : b - a]
            here = slice(np.searchsorted(starts, a, side="right") - 1, np.searchsorted(starts, b - 1, side="right"))
            top[:, here] = np.maximum(top[:, here], np.maximum.reduceat(z, np.maximum(starts[:-1][here] - a, 0), axis=1))
        return np.maximum(top, 0).T @ self.out + self.bias

    def score(self, logits: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * logits.astype(np.float64) + self.b)


def holding(parts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """By label and table row: how many texts hold a word of it."""
    held = np.zeros((2, TABLES * BUCKETS), np.int64)
    for words, label in zip(parts, labels, strict=True):
        for t, index in enumerate(rows_of(words)):
            held[label, t * BUCKETS + np.unique(index)] += 1
    return held


def prior(model: Model, every: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> None:
    """The first component of a bucket's vector: the log-odds of toxic documents that hold a word of it, shrunk by its count. every: as of ``holding``; n: texts by label."""
    for t, table in enumerate(model.tables):
        held = every[:, t * BUCKETS : (t + 1) * BUCKETS].astype(np.float64)
        odds = np.log((held[1] + 0.5) / (n[1] + 1)) - np.log((held[0] + 0.5) / (n[0] + 1))
        count = held.sum(0)
        table[:, 0] = odds * count / (count + 5)
        known = count >= 5
        table[known, 1:] = rng.normal(0, 0.1, (int(known.sum()), DEPTH - 1))
        table[(count == 0) | (np.arange(BUCKETS) == 0)] = 0


def learn(model: Model, parts: list[np.ndarray], labels: np.ndarray, epoch: int, rng: np.random.Generator) -> None:
    """One epoch of Adagrad on the logistic loss; gradients reach a word only where it won the pooling."""
    trained = [*model.blocks, model.floors, model.out]
    rate = np.float32(RATE / (1 + epoch))
    turn = rng.permutation(len(parts))
    for k in range(0, len(turn), BATCH):
        rows = turn[k : k + BATCH]
        here = np.concatenate([parts[i] for i in rows])
        begin = np.cumsum([0, *(len(parts[i]) for i in rows)])
        x = model.vectors(here)
        z = model.activations(x)
        at = np.stack([z[:, a:b].argmax(1) + a for a, b in zip(begin[:-1], begin[1:], strict=True)], axis=1)
        top = np.take_along_axis(z, at, 1)
        pooled = np.maximum(top, 0)
        p = 1 / (1 + np.exp(-np.clip(model.out @ pooled + model.bias, -30, 30)))
        g = ((p - labels[rows]) / len(rows)).astype(np.float32)
        back = np.outer(model.out, g) * (top > 0)
        padded = np.concatenate([x, np.zeros((max(WIDTHS), x.shape[1]), np.float32)])
        dx = np.zeros_like(padded)
        grads = []
        for j, (w, block) in enumerate(zip(WIDTHS, model.blocks, strict=True)):
            grad = np.zeros_like(block)
            for f in range(FILTERS):
                b, pos = back[j * FILTERS + f], at[j * FILTERS + f]
                for step in range(w):
                    grad[step, f] = b @ padded[pos + step]
                    np.add.at(dx, pos + step, np.outer(b, block[step, f]))
            grads.append(grad)
        grads += [back.sum(1), pooled @ g]
        for value, sums, grad in zip(trained, model.grown, grads, strict=True):
            sums += grad**2
            value -= rate * grad / np.sqrt(sums)
        model.bias_grown += float(g.sum()) ** 2
        model.bias -= np.float32(rate * g.sum() / np.sqrt(model.bias_grown))
        moved = np.flatnonzero(np.abs(dx[: len(x)]).sum(1) * (here != 0))
        for t, index in enumerate(rows_of(here[moved])):
            part = dx[moved][:, t * DEPTH : (t + 1) * DEPTH]
            np.add.at(model.table_grown[t], index, (part**2).sum(1))
            np.add.at(model.tables[t], index, -(rate * part / np.sqrt(model.table_grown[t][index])[:, None]))


def calibrate(model: Model, logits: np.ndarray, labels: np.ndarray, langs: list[str | None], copies: np.ndarray | None = None) -> None:
    """Platt scaling by Newton steps with smoothed targets, then the threshold of each language with the best F1. copies: for how many rows each one stands."""
    copies = np.ones(len(labels), np.int64) if copies is None else copies
    pairs, place = np.unique(np.stack([logits, labels], axis=1), axis=0, return_inverse=True)  # the same whatever the languages
    n = np.bincount(place.ravel(), copies)
    model.a, model.b = platt(pairs[:, 0], pairs[:, 1], n, (int(n @ (1 - pairs[:, 1])), int(n @ pairs[:, 1])))
    scores = model.score(logits)
    for lang in {x for x in langs if x is not None}:
        own = np.array([x == lang for x in langs])
        n, toxic, score = copies[own], labels[own] == 1, scores[own]
        if min(n[toxic].sum(), n[~toxic].sum()) < LEAST:
            continue
        cuts = np.round(np.arange(0.1, 0.91, 0.05), 2)
        f1 = [2 * (hit := n[(score >= c) & toxic].sum()) / max(1, hit + n[score >= c].sum() + n[toxic].sum() - hit) for c in cuts]
        best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-12)
        model.thresholds[lang] = float(cuts[best[np.argmin(np.abs(cuts[best] - CUT))]])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, lang, toxic) of every labelled row that is not held out, dealt by id: a partition is a shard."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    shards = max(1, -(-known.count() // ROWS))
    rows = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang").repartition(shards, "doc_id")
    # the join may take more partitions than it is given, which are put together again where they are
    return first_rows(rows.join(known.repartition(shards, "doc_id"), "doc_id"), ["doc_id"]).select("doc_id", "text", "lang", "toxic").coalesce(shards)


ENCODED = "doc_id long, words binary, lang string, toxic int"


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for start, end in portions(texts):
            words, starts = hashed(texts.slice(start, end - start))
            own = batch.slice(start, end - start)
            parts = pa.array([words[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), parts, own.column("lang"), own.column("toxic")], names=["doc_id", "words", "lang", "toxic"])


def _shard(batches: Iterator[pa.RecordBatch]) -> tuple[list[np.ndarray], np.ndarray]:
    """Words and labels of a shard, by doc_id."""
    held = [b for b in batches if len(b)]
    if not held:
        return [], np.zeros(0, np.int64)
    table = pa.Table.from_batches(held).sort_by("doc_id")
    return [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()], table.column("toxic").to_numpy().astype(np.int64)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = holding(*_shard(batches))
    slot = np.flatnonzero(held.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(held[0, slot]), pa.array(held[1, slot])], names=["slot", "n0", "n1"])


def _learnt(shared, epoch: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, labels = _shard(batches)
        if parts:
            model = copy.deepcopy(shared.value)  # workers keep the value for other shards
            before = model.state()
            learn(model, parts, labels, epoch, np.random.default_rng([SEED, epoch, TaskContext.get().partitionId()]))
            change = np.rint((model.state() - before) * UNIT).astype(np.int64)
            slot = np.flatnonzero(change.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), *(pa.array(change[slot, k]) for k in range(DEPTH + 1))], names=["slot", *_CHANGES])

    return of


_CHANGES = [f"d{k}" for k in range(DEPTH + 1)]


def _logits(shared):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            parts = [np.frombuffer(x, np.uint64) for x in batch.column("words").to_pylist()]
            logits = [model.logits(x, np.array([0, len(x)]))[0] for x in parts]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("toxic"), pa.array(np.rint(np.array(logits, np.float64) * BIN).astype(np.int64))], names=["lang", "toxic", "bin"])

    return of


def train(rows: DataFrame) -> Model:
    """The model of ``rows`` (``ENCODED``), whose partitions are the shards."""
    sc, rng = rows.sparkSession.sparkContext, np.random.default_rng(SEED)
    model = Model(rng)
    aside = F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(4)) == 0
    n = np.zeros((2, 2), np.int64)
    for r in rows.groupBy(aside.alias("aside"), "toxic").count().collect():
        n[int(r["aside"]), r["toxic"]] = r["count"]
    total = n.sum(0)
    if not total.all():
        model.out[:], model.bias = 0, np.float32(0)
        model.b = float(np.log((total[1] + 0.5) / (total[0] + 0.5))) if total.any() else 0.0
        return model
    own, n = (rows.filter(~aside), n[0]) if n[0].all() else (rows, total)
    counts = own.mapInArrow(_held, "slot int, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    every = np.zeros((2, TABLES * BUCKETS), np.int64)
    for label in (0, 1):
        every[label, counts.column("slot").to_numpy()] = counts.column(f"n{label}").to_numpy()
    prior(model, every, n, rng)
    for epoch in range(EPOCHS):
        shared = sc.broadcast(model)
        moved = own.mapInArrow(_learnt(shared, epoch), f"slot int, {', '.join(f'{c} long' for c in _CHANGES)}")
        moved = moved.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in _CHANGES)).toArrow()
        state = model.state()
        state[moved.column("slot").to_numpy()] += np.column_stack([moved.column(c).to_numpy() for c in _CHANGES]) / (moved.column("n").to_numpy()[:, None] * float(UNIT))
        model.take(state)
        shared.destroy()
    shared = sc.broadcast(model)
    logits = rows.filter(aside).mapInArrow(_logits(shared), "lang string, toxic int, bin long").groupBy("lang", "toxic", "bin").agg(F.count(F.lit(1)).alias("n")).persist()
    enough = logits.groupBy("lang").agg(*(F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1))).filter(F.least("n0", "n1") >= LEAST)
    # languages with too few rows count as none, so that what comes here is bounded
    kept = logits.join(enough.select("lang", F.col("lang").alias("own")), "lang", "left").groupBy("own", "toxic", "bin").agg(F.sum("n").alias("n")).toArrow()
    if len(kept):
        calibrate(model, kept.column("bin").to_numpy() / BIN, kept.column("toxic").to_numpy().astype(np.int64), kept.column("own").to_pylist(), kept.column("n").to_numpy())
    logits.unpersist()
    shared.destroy()
    return model


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of all labelled rows; their words are kept by the executors while it is trained."""
    rows = labelled(docs, labels).mapInArrow(_encoded, ENCODED).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return train(rows)
    finally:
        rows.unpersist()


def _scores(shared):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            logits = np.zeros(len(texts), np.float64)
            for start, end in portions(texts):
                logits[start:end] = model.logits(*hashed(texts.slice(start, end - start)))
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(np.round(model.score(logits), 9))], names=[*rest, "score"])

    return of


def _verdicts(scored: DataFrame, model: Model, lang: str) -> DataFrame:
    cut = F.lit(CUT)
    for code, at in sorted(model.thresholds.items()):
        cut = F.when(F.col(lang) == code, F.lit(at)).otherwise(cut)
    return scored.withColumn("threshold", cut).withColumn("rejected", F.col("score") >= F.col("threshold"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (by the fixed cut), threshold and rejected (by the language's) of every row."""
    model = fitted(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of a fixed size
    scored = docs.select("doc_id", "text", "lang").mapInArrow(_scores(shared), "doc_id long, lang string, score double")
    scored = _verdicts(scored, model, "lang").withColumn("predicted", (F.col("score") >= CUT).cast("int"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "threshold", "rejected")


def accepted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns; nothing is shuffled."""
    model = fitted(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    nested = docs.select("text", F.struct(*docs.columns).alias("row"), F.col("lang").alias("language"))
    kinds = f"row {nested.schema['row'].dataType.simpleString()}, language string, score double"
    scored = _verdicts(nested.mapInArrow(_scores(shared), kinds), model, "language")
    return scored.filter(~F.col("rejected")).select("row.*")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
