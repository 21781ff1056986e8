"""The corpus pipeline, each stage against a plain version of its rule on its own input."""

import importlib.util
import os
from collections import Counter

import corpus_pipeline
from headway.llm import packing, toxicity
from headway.llm.common import scratch_path

_spec = importlib.util.spec_from_file_location("brute", os.path.join(os.path.dirname(__file__), "brute.py"))
brute = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(brute)


def test_stages_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.select("doc_id", "text", "source").collect()
        path = scratch_path(spark, f"test-{k}")
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        after = docs.collect()
        ids = Counter(r["doc_id"] for r in after)
        if name == "toxicity":
            judged = toxicity.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
            assert ids == Counter(r["doc_id"] for r in judged.filter("NOT rejected").collect())
        elif name == "exact dedup":
            assert ids == Counter(i for i, _, _, kept, _ in brute.exact([(r["doc_id"], r["text"]) for r in before]) if kept)
        elif name == "MinHash near-dedup":
            want = brute.near([(r["doc_id"], r["text"]) for r in before])
            assert ids == Counter(i for i, (_, c) in want.items() if c == i)
        elif name == "mixing sources to target weights":
            sizes, least = Counter(), {}
            for r in before:
                n = len(brute.SPACE.findall(r["text"] or ""))
                sizes[r["source"]] += n
                least[r["source"]] = min(n, least.get(r["source"], n))
            taken = Counter()
            for r in after:
                taken[r["source"]] += len(brute.SPACE.findall(r["text"] or ""))
            for s, goal in brute.targets(sizes).items():
                assert abs(taken[s] - goal) <= max(2, 0.02 * goal, least[s] / 2)  # here a source has about ten documents
            assert max(ids.values()) <= 3
        else:
            from tokenizers import Tokenizer

            got = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in after)
            assert got == brute.pieces([(r["doc_id"], r["text"]) for r in before], Tokenizer.from_file(packing.tokenizer_path()), packing.LENGTH)


def test_run_is_the_stages_in_order(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 0
