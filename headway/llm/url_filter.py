"""URL filtering: rules first, then a logistic regression on hashed character n-grams of host and path.

The regression is trained in numpy on a small labelled URL table: of each verdict at most ``SAMPLE`` / 2 different urls, those
whose hash is below a threshold that follows from the count. Here these are the urls that a rule fits, labelled with its
verdict. Both verdicts weigh the same in training. A quarter of the table is set aside: on it the score is calibrated (Platt
scaling) and the error of the verdicts measured. The regression judges the urls that no rule fits; it can only carry over
what the rules say of similar urls. The longest rule wins: by its host, then by its path.

Defined results: a url that is null or without ``://`` has an empty host and path and is judged by the regression like any
other; with labels of one verdict or none the regression gives that verdict, or allow; rows that repeat, and rows without
page_id, are judged alike; urls of any length are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.common import LOWER, UPPER, mix64, platt, removed, sigmoid, written

#: (verdict, host, path) of the contract.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
SAMPLE, LONGEST, BUCKETS, GRAMS = 20_000, 2048, 1 << 16, (2, 3, 4)
EPOCHS, BATCH, RATE, RIDGE, SEED = 6, 256, 0.3, 1e-6, 7
#: Characters of a portion of urls.
PORTION = 500_000


def host_of(url: Column) -> Column:
    after = F.substring_index(F.regexp_replace(url, r"(?s)^.*?://", ""), "/", 1)
    host = F.substring_index(F.substring_index(after, "?", 1), "#", 1)
    return F.when(F.coalesce(url.contains("://"), F.lit(False)), F.translate(host, UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(url.contains("://"), F.lit(False)), after).otherwise("")


def judged_by_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and the rule's verdict (null where none fits)."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1]), len(r[2]))):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return rows.withColumns({"rule": name, "rule_verdict": verdict})


def grams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The different buckets of each url's character n-grams, host and path told apart and with marks at their ends; where each url's begin (and end)."""
    parts = [f"^{part}$" for url in zip(hosts, paths, strict=True) for part in url]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    letters = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    part = np.repeat(np.arange(len(parts)), sizes)
    found = []
    for n in GRAMS:
        at = np.flatnonzero(part[: len(part) - n + 1] == part[n - 1 :]) if len(part) >= n else np.zeros(0, np.int64)
        h = (part[at] % 2 + 2 * n).astype(np.uint64)
        for k in range(n):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + letters[at + k] + np.uint64(1))
        found.append(part[at] // 2 * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64))
    flat = np.unique(np.concatenate(found))
    return flat % BUCKETS, np.searchsorted(flat // BUCKETS, np.arange(len(hosts) + 1))


class Regression:
    """Weights by bucket; each url's n-grams count once and are scaled to length one. ``error`` is the share of wrong verdicts among the urls set aside, by verdict."""

    def __init__(self):
        self.weights, self.bias, self.a, self.b = np.zeros(BUCKETS), 0.0, 1.0, 0.0
        self.error: dict[str, float] = {}

    def logits(self, buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[buckets])])
        return (sums[starts[1:]] - sums[starts[:-1]]) / np.sqrt(np.maximum(np.diff(starts), 1)) + self.bias

    def scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        return sigmoid(self.a * self.logits(*grams(hosts, paths)) + self.b)

    def train(self, rows: list[tuple[str, str]], blocked: np.ndarray) -> Regression:
        rng = np.random.default_rng(SEED)
        if len(set(blocked)) < 2:
            self.bias = 1.0 if len(blocked) and blocked[0] else -1.0
            return self
        buckets, starts = grams(*map(list, zip(*rows, strict=True)))
        order = rng.permutation(len(rows))
        aside, learn = order[: len(order) // 4], order[len(order) // 4 :]
        if len(set(blocked[learn])) < 2:
            aside, learn = order[:0], order
        weigh = np.where(blocked == 1, 0.5 / blocked[learn].mean(), 0.5 / (1 - blocked[learn].mean()))
        pick = lambda ids: (np.concatenate([buckets[starts[i] : starts[i + 1]] for i in ids]), np.cumsum([0, *(starts[i + 1] - starts[i] for i in ids)]))
        grown, bias_grown = np.full(BUCKETS, 1e-6), 1e-6
        for epoch in range(EPOCHS):
            turn = rng.permutation(learn)
            for k in range(0, len(turn), BATCH):
                part = turn[k : k + BATCH]
                here, begin = pick(part)
                slack = (sigmoid(self.logits(here, begin)) - blocked[part]) * weigh[part]
                size = np.diff(begin)
                g = np.bincount(here, np.repeat(slack / np.sqrt(size), size), BUCKETS) / len(part) + RIDGE * self.weights
                grown += g**2
                self.weights -= RATE / (1 + epoch) * g / np.sqrt(grown)
                b = float(slack.mean())
                bias_grown += b * b
                self.bias -= RATE / (1 + epoch) * b / np.sqrt(bias_grown)
        if len(set(blocked[aside])) == 2:
            logits = self.logits(*pick(aside))
            self.a, self.b = platt(logits, blocked[aside], weigh[aside])
            wrong = (sigmoid(self.a * logits + self.b) >= 0.5) != (blocked[aside] == 1)
            self.error = {"allow": float(wrong[blocked[aside] == 0].mean()), "block": float(wrong[blocked[aside] == 1].mean())}
        return self


def _judge(shared):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Regression = shared.value
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            turn = np.cumsum([len(h) + len(p) for h, p in zip(hosts, paths, strict=True)]) // PORTION
            cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1), len(hosts)]
            score = np.concatenate([np.zeros(0), *(model.scores(hosts[a:b], paths[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b)])
            verdict = [v or ("block" if s >= 0.5 else "allow") for v, s in zip(batch.column("rule_verdict").to_pylist(), score, strict=True)]
            columns = [batch.column(c) for c in ("page_id", "host", "path", "rule")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(verdict, pa.string()), pa.array(score)], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return of


def fitted(labelled: DataFrame) -> Regression:
    """The regression of a table of host, path, verdict. Urls that repeat count once; every task sends its part of a sample of at most ``SAMPLE`` urls of at most ``LONGEST`` characters."""
    known = labelled.filter("verdict IN ('allow', 'block')").select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    known = written(known.filter(F.length("host") + F.length("path") <= LONGEST).distinct(), "labelled")
    counts = {r["verdict"]: r["count"] for r in known.groupBy("verdict").count().collect()}  # two rows
    chosen = F.lit(False)
    for verdict, count in sorted(counts.items()):
        share = min(1.0, 0.45 * SAMPLE / count) if count > SAMPLE // 2 else 1.0  # the hash scatters about it, far less than up to a half
        chosen |= (F.col("verdict") == verdict) & (F.pmod(F.xxhash64("host", "path"), F.lit(1 << 40)) < int(share * (1 << 40)))
    rows = sorted(tuple(r) for r in known.filter(chosen).collect())
    removed(known)
    return Regression().train([r[:2] for r in rows], np.array([r[2] == "block" for r in rows], float))


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """``labelled``: host, path, verdict. Every page's host, path, rule, verdict, and the regression's score for block."""
    shared = pages.sparkSession.sparkContext.broadcast(fitted(labelled))  # of a fixed size
    kinds = "page_id long, host string, path string, rule string, verdict string, score double"
    return judged_by_rules(pages, rules).mapInArrow(_judge(shared), kinds)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, judged_by_rules(pages).withColumn("verdict", F.col("rule_verdict")))
