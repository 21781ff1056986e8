"""Each corpus operator against brute force, over a whole small table and over odd rows."""

import hashlib
import importlib.util
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from headway.llm import exact_dedup, media, mixing, near_dedup, packing, pii, preference, substring_dedup, toxicity, url_filter
from headway.llm.common import scratch_path

_spec = importlib.util.spec_from_file_location("brute", os.path.join(os.path.dirname(__file__), "brute.py"))
brute = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(brute)
_spec = importlib.util.spec_from_file_location("llm_inputs", os.path.join(os.path.dirname(__file__), "conftest.py"))
inputs = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(inputs)
wide = inputs.wide


def rows(df, *names):
    return sorted((tuple(r) for r in (df.select(*names) if names else df).collect()), key=repr)


# personal data


@pytest.fixture(scope="module")
def pii_odd():
    return [
        (1, "Mail a.b+c@x-y.example.org, or a@b. No: @x.y, a@b", "s"), (2, "ip 10.0.0.255 and 10.0.0.256 and 1.2.3.4.5", "s"),
        (3, "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111", "s"), (4, "call +44 (20) 7946-0958 or +1 23, ÄÖ+44 20 7946 0958", "s"), (5, None, "s"), (6, "", "s"), (7, "1 " * 3000, "s"),
    ]


def test_pii_base_spans(spark, documents, pii_odd):
    for data in (documents, pii_odd):
        found = {r["doc_id"]: r for r in pii.find(wide(spark, data)).collect()}
        for i, text, _ in data:
            want = brute.base_spans(text)
            row = found[i]
            assert row["base_sha256"] == brute.sha(",".join(f"{k}:{s}:{e}" for k, s, e in want))
            assert tuple(row[f"n_{k}"] for k in pii.KINDS) == tuple(sum(w[0] == k for w in want) for k in pii.KINDS)
            spans = set(row["spans"].split(",")) - {""}
            assert {f"{k}:{s}:{e}" for k, s, e in want} <= spans


def test_pii_field_labels_alike_tokens_alike(spark):
    texts = [f"Reach me at +4420794{60000 + k} any time, not at {k} pm. Again: +4420794{60000 + k}" for k in range(200)] + [f"Mail user{k}@mail.example.com about item {k}." for k in range(200)]
    model = pii.train(texts)
    text = "Reach me at +442079460958 any time. Later I said: reach me at 442079460958 again."
    base = [pii.base_spans(text)]
    assert base[0] == [(3, 12, 25)]
    start = text.index("442079460958 again")
    assert pii.added_spans([text], base, model) == [[(3, start, start + 12)]]
    field = pii.Field([text])
    assert len(field.skip) == 1
    alone = pii.Field([text[: 12] + "x" * 13 + text[25:]])
    second = lambda f: f.spans.index((start, start + 12))
    assert model.marginals(field, field.labels(base))[second(field), 4] > model.marginals(alone)[second(alone), 4]


def test_pii_neighbours_of_base_spans_are_added():
    texts = [f"Reach me at +4420794{60000 + k} any time, not at {k} pm. Again: +4420794{60000 + k}" for k in range(200)] + [f"Mail user{k}@mail.example.com about item {k}." for k in range(200)]
    model = pii.train(texts)
    text = "Reach me at:\n442079460958\n+442079460958\n442079460958\nany time."
    first, last = text.index("442079460958"), text.rindex("442079460958")
    assert pii.added_spans([text], [pii.base_spans(text)], model) == [[(3, first, first + 12), (3, last, last + 12)]]


def test_pii_field_reaches_the_last_of_fifty_repeats():
    field = pii.Field(["1 2 3 4", " or ".join(["2079460958"] * 50), "a 5 b"])
    assert len(field.skip) == 49
    model = pii.Model()
    model.pair["skip"] = np.full((pii.LABELS, pii.LABELS), -4.0) + 8 * np.eye(pii.LABELS)
    known = np.zeros(len(field.spans), np.int64)
    repeats = np.flatnonzero((np.array(field.text) == 1) & field.candidate)
    known[repeats[0]] = 4
    got = model.marginals(field, known)[repeats, 4]
    step = (np.exp(4) - np.exp(-4)) / (np.exp(4) + 4 * np.exp(-4))  # of a chain, what is left of a label's excess after one edge
    start = 1 / (1 + 4 * np.exp(-4 * pii.REACH)) - 0.2
    assert np.allclose(got, 0.2 + start * step ** np.arange(50), atol=0.01) and got[-1] > 0.9


def test_pii_marginals_against_enumeration():
    """Message passing on small graphs against the sum over all labellings: exact without loops, near with one."""
    import itertools

    rng = np.random.default_rng(9)
    for text, loops in (("call 5551234567 now or 9 later", False), ("at 5551234567 or 5551234567 at 5551234567", True), ("x 12-3456-789 12-9999-111", True)):
        field, model = pii.Field([text]), pii.Model()
        for name in pii.EDGES_OF:
            pair = rng.normal(0, 0.5, (pii.LABELS, pii.LABELS))
            model.pair[name] = pair if name == "chain" else (pair + pair.T) / 2
        n, unary = len(field.spans), rng.normal(0, 1, (len(field.spans), pii.LABELS))
        total, nodes, edges = 0.0, np.zeros((n, pii.LABELS)), {k: np.zeros((len(e), pii.LABELS, pii.LABELS)) for k, e in field.edges.items()}
        for labels in itertools.product(range(pii.LABELS), repeat=n):
            w = np.exp(unary[np.arange(n), labels].sum() + sum(model.pair[k][labels[a], labels[b]] for k, e in field.edges.items() for a, b in e))
            total += w
            nodes[np.arange(n), labels] += w
            for k, e in field.edges.items():
                for i, (a, b) in enumerate(e):
                    edges[k][i, labels[a], labels[b]] += w
        got, joint = model.inferred(field, unary)
        assert np.abs(got - nodes / total).max() < (0.08 if loops else 2e-3)
        assert all(np.abs(joint[k] - edges[k] / total).max(initial=0) < (0.08 if loops else 2e-3) for k in edges)
        assert sum(map(len, field.edges.values())) >= n - 1


def test_pii_adds_numbers_that_stand_side_by_side(documents):
    """Two card numbers in a row are one run of digits to the patterns, which drop it; words of plain text stay clean."""
    texts = [f"pay with {4_000_000_000_000_000 + k * 10 + c} at once, order {k}" for k in range(150) for c in range(10) if pii.luhn(str(4_000_000_000_000_000 + k * 10 + c))]
    model = pii.train(texts)
    text = "pay with 4465758382889437 4465758382889437 at once, order 12"
    assert pii.base_spans(text) == []
    assert pii.added_spans([text], [[]], model) == [[(2, 9, 25), (2, 26, 42)]]
    clean = ["The meeting of 12 people on 2026-09-28 cost 300 and 45.5, see page 7.", "version 2.0 of the licence, chapters 3 and 4"]
    assert pii.added_spans(clean, [[], []], model) == [[], []]


def test_pii_withheld_spans_come_back(documents):
    texts = [f"Reach me at +4420794{60000 + k} any time. Again: +4420794{60000 + k}" for k in range(200)] + [f"Mail user{k}@mail.example.com about item {k}." for k in range(200)]
    model = pii.train(texts)
    fresh = [f"Reach me at +4420795{60000 + k} any time. Again: +4420795{60000 + k}" for k in range(50)] + [f"Mail person{k}@mail.example.com about item {k}." for k in range(50)]
    withheld, back, other = pii.recovered(fresh, model)
    assert withheld > 50 and back >= 0.9 * withheld and other == 0


def test_pii_odd_rows(spark):
    rows_ = [(1, "mail a@b.example.org", "s"), (1, "no data", "s"), (1, "mail a@b.example.org", "s"), (None, "ip 10.0.0.1", "s"), (2, "9" * 200_000, "s"), (3, "@ + " * 20_000, "s")]
    out = [(r["doc_id"], r["n_email"], r["n_ip"]) for r in pii.find(wide(spark, rows_)).collect()]
    assert sorted(out, key=repr) == sorted([(1, 1, 0), (1, 0, 0), (1, 1, 0), (None, 0, 1), (2, 0, 0), (3, 0, 0)], key=repr)


def test_pii_empty(spark):
    assert pii.find(wide(spark, [])).count() == 0


# mixing


def check_mix(data, out):
    sizes = {}
    for i, t, s in data:
        sizes.setdefault(s, []).append((i, len(brute.SPACE.findall(t or ""))))
    total = {s: sum(n for _, n in v) for s, v in sizes.items()}
    goals = brute.targets(total)
    source = {i: s for i, _, s in data}
    taken = Counter()
    for r in out:
        s = source[r["doc_id"]]
        assert r["source_size"] == total[s] and abs(r["target"] - goals[s]) <= 1e-6 * max(1, goals[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert sorted((r["doc_id"], r["size"]) for r in out) == sorted(x for v in sizes.values() for x in v)
    for s, goal in goals.items():
        if max(n for _, n in sizes[s]) <= goal / 4:  # coarser sources come only as near as their documents allow
            assert abs(taken[s] - goal) <= max(2, 0.02 * goal)
    return dict(taken)


def test_mixing(spark, documents, odd_rows):
    known = [r for r in odd_rows if r[0] is not None]
    unique = list({r[0]: r for r in known}.values())
    for data in (documents, unique):
        first = mixing.mix(wide(spark, data)).collect()
        check_mix(data, first)
        again = mixing.mix(wide(spark, data[::-1]).repartition(7)).collect()
        assert sorted(first) == sorted(again)


def test_mixed_documents_repeat_rows(spark, documents):
    df = wide(spark, documents)
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(df).collect() if r["copies"]}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    assert Counter(r[0] for r in out.select("doc_id").collect()) == Counter(want)


def test_mixing_without_words(spark):
    assert mixing.mix(wide(spark, [])).count() == 0
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix(wide(spark, [(1, None, None), (2, "", "a")])).collect()] == [(0, 0.0, 0)] * 2


# substring deduplication


def test_substring_dedup(spark, documents, odd_rows):
    unique = list({r[0]: r for r in odd_rows if r[0] is not None}.values())
    for data in (documents, unique):
        want = brute.substring_dedup([(i, t) for i, t, _ in data])
        got = rows(substring_dedup.deduplicated(wide(spark, data)), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert got == sorted(((i, *w) for i, w in want.items()), key=repr)


def test_substring_dedup_of_periodic_and_hot_texts(spark):
    cycle = " ".join(["a", "b", "c"] * 60)
    data = [(1, cycle, "s"), (2, cycle + " d", "s"), (3, "a " * 300, "s"), (4, "a " * 120 + "z", "s"), (5, "q " + cycle, "s")]
    data += [(10 + k, f"u{k} v{k} " + " ".join(f"x{j}" for j in range(49 + k % 3)) + f" y{k}", "s") for k in range(30)]
    want = brute.substring_dedup([(i, t) for i, t, _ in data])
    got = rows(substring_dedup.deduplicated(wide(spark, data)))
    assert got == sorted(((i, *w) for i, w in want.items()), key=repr)


def test_substring_dedup_odd_ids(spark, odd_rows):
    twice = [(60, "w " * 60, "t")] * 2 + [(None, "w " * 60, "t"), (61, "w " * 60, "t")]
    got = rows(substring_dedup.deduplicated(wide(spark, twice)), "doc_id", "n_removed")
    assert got == [(60, 0), (60, 0), (61, 60), (None, 0)]
    assert substring_dedup.deduplicated(wide(spark, [])).count() == 0
    assert substring_dedup.deduplicated(wide(spark, odd_rows)).count() == len(odd_rows)


# urls


def test_url_rules(spark):
    urls = [
        ("http://Example.COM/en/x?y#z", "example.com", "/en/x", "example.com/en/", "block"), ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://a.www.example.com/en/q", "a.www.example.com", "/en/q", "www.example.com/en/", "allow"), ("https://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
        ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), ("https://sub.example.com/fr", "sub.example.com", "/fr", "com/", "allow"),
        ("x://h.com", "h.com", "", None, None), ("x://h.com?a/b", "h.com", "", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None),
        ("http://h.com\n/p\nq?r", "h.com\n", "/p\nq", None, None),
    ]
    df = spark.createDataFrame([(k, u[0]) for k, u in enumerate(urls)], "page_id long, url string")
    labelled = url_filter.judged_by_rules(df).withColumn("verdict", F.col("rule_verdict"))
    for r in url_filter.judge(df, labelled).collect():
        _, host, path, rule, verdict = urls[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert url_filter.judge(df.limit(0), labelled.limit(0)).count() == 0


def test_url_regression_learns(spark):
    good = [(k, "news.org", f"/world/story-{k}", "allow") for k in range(60)]
    bad = [(100 + k, "cheap-pills.biz", f"/buy-now/{k}", "block") for k in range(60)]
    labelled = spark.createDataFrame(good + bad, "page_id long, host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://more.news.org/world/story-999"), (2, "http://cheap-pills.biz/buy-now/77")], "page_id long, url string")
    assert rows(url_filter.judge(pages, labelled), "page_id", "verdict") == [(1, "allow"), (2, "block")]


def test_url_features_by_brute_force():
    hosts, paths = ["a.org", "", "x" * 3000, "\u00e9.net"], ["/en/1", "", "/" + "yz" * 900, "/\U0001f600"]
    buckets, starts = url_filter.grams(hosts, paths)
    for k, (host, path) in enumerate(zip(hosts, paths, strict=True)):
        alone, _ = url_filter.grams([host], [path])
        assert (alone == buckets[starts[k] : starts[k + 1]]).all()
        different = {(part, text[i : i + n]) for part, text in enumerate((f"^{host}$", f"^{path}$")) for n in url_filter.GRAMS for i in range(len(text) - n + 1)}
        assert 0.9 * len(different) <= len(alone) <= len(different)
    model = url_filter.Regression()
    model.weights[:] = np.random.default_rng(1).normal(size=url_filter.BUCKETS)
    want = [model.weights[buckets[a:b]].sum() / np.sqrt(b - a) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert np.allclose(model.logits(buckets, starts), want)


def test_url_sample_is_bounded_and_balanced(spark, monkeypatch):
    """A url that fills most rows counts once; of many urls a share by hash is taken; the verdicts' weights are even."""
    monkeypatch.setattr(url_filter, "SAMPLE", 400)
    taken = []
    monkeypatch.setattr(url_filter.Regression, "train", lambda self, rows, blocked: taken.append((rows, blocked)) or self)
    rows_ = [("hot.com", "/", "allow")] * 3000 + [(f"h{k}.com", f"/{k}", "allow") for k in range(3000)] + [(f"b{k}.net", None, "block") for k in range(150)] + [("n.org", "/", None)]
    url_filter.fitted(spark.createDataFrame(rows_, "host string, path string, verdict string"))
    (found, blocked), = taken
    assert blocked.sum() == 150 and 50 < (blocked == 0).sum() <= 200 and len(set(found)) == len(found)


def test_url_error_is_measured_on_urls_set_aside():
    rows_ = [(f"shop{k}.biz", f"/buy/{k}") for k in range(300)] + [(f"news{k}.org", f"/story/{k}") for k in range(100)]
    model = url_filter.Regression().train(rows_, np.array([1.0] * 300 + [0.0] * 100))
    assert max(model.error.values()) < 0.1
    noise = url_filter.Regression().train(rows_, np.random.default_rng(0).integers(0, 2, 400).astype(float))
    assert max(noise.error.values()) > 0.3


def test_url_odd_rows(spark):
    data = [(None, "http://a.com/en/"), (1, "http://b.org/" + "x" * 100_000), (1, "http://b.org/" + "x" * 100_000), (2, None)]
    df = spark.createDataFrame([(*r, 3, "h") for r in data], "page_id long, url string, score int, host string")
    out = url_filter.judge(df, url_filter.judged_by_rules(df).withColumn("verdict", F.col("rule_verdict"))).collect()
    assert len(out) == 4 and {len(r["path"]) for r in out if r["page_id"] == 1} == {100_001}
    assert [r["verdict"] for r in out if r["page_id"] is None] == ["allow"]


# media


def test_media_round_trip(spark, documents, odd_rows):
    import io
    import zlib

    data = documents + list({i: (i + 1_000_000, t, s) for i, t, s in odd_rows if i is not None}.values())
    by_text = {}
    for r, text in ((r, r["text"]) for r in wide(spark, data).join(media.document_media(wide(spark, data)).dropDuplicates(["doc_id"]).withColumnsRenamed({"doc_id": "d"}), F.col("doc_id") == F.col("d")).collect()):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-32:])
        size, stored = media.store(text)
        assert (size, len(stored), hashlib.sha256(stored).hexdigest()) == (len(raw), r["media_bytes"], r["media_sha256"])
        assert media.decode(stored).tobytes() == payload
        assert by_text.setdefault(text or "", r["feature"]) == r["feature"]
    tile = np.load(io.BytesIO(media.npy(media.resize(media.decode(media.store("some text")[1]), 32, 32))))
    assert tile.shape == (32, 32) and tile.dtype == np.uint8


def test_media_formats():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (7, 10), dtype=np.uint8)
    assert (media.decode(media.encode_bmp(image)) == image).all()
    assert (media.decode(media.encode_pgm(image)) == image).all()
    plain = b"P2\n# note\n10 7\n255\n" + b" ".join(str(v).encode() for v in image.ravel())
    assert (media.decode(plain) == image).all()
    colour = rng.integers(0, 256, (3, 4, 3), dtype=np.uint8)
    assert (media.decode(b"P6 4 3 255\n" + colour.tobytes()) == colour).all()
    bits = media.decode(b"P4\n10 1\n" + bytes([0b10110000, 0b01000000]))
    assert bits.tolist() == [[0, 255, 0, 0, 255, 255, 255, 255, 255, 0]]
    assert (media.decode(b"P1\n2 2\n1 0\n0 1\n") == np.array([[0, 255], [255, 0]])).all()


def test_media_area_means():
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (12, 18), dtype=np.uint8)
    fine = np.kron(image, np.ones((5, 7)))  # 60 x 126 holds whole pixels for a 5 x 7 tile
    want = np.floor(fine.reshape(5, 12, 7, 18).mean((1, 3)) + 0.5)
    assert np.abs(media.resize(image, 5, 7).astype(int) - want).max() <= 1  # floating sums may round a half either way
    assert (media.resize(image, 12, 18) == image).all()


def test_media_unreadable(spark):
    df = spark.createDataFrame([(1, bytearray(b"P5\n3 3\n255\nab")), (2, None), (3, bytearray(b"BM")), (4, bytearray(media.encode_pgm(np.full((2, 2), 9, np.uint8))))], "k long, c binary")
    got = {r["k"]: r for r in media.describe(df, "k", "c").collect()}
    assert [got[k]["error"] is None for k in (1, 2, 3, 4)] == [False, False, False, True]
    assert got[4]["height"] == 2 and got[1]["tile"] is None
    bad = [b"P2 2 1 255\n300 1\n", b"P2 2 1 10\n11 1\n", b"P5 99999999999 99999999999 255\n", b"P5 0 0 255\n", b"P4 0 3\n", b"P5 60000 60000 255\n", b"P3 2 2 255\n1 2 3", b"P5 3"]
    bad += [b"P2 1 1 255\n99999999999999999999", b"P2 1 1 255\n-3", b"P9 1 1", b"", media.encode_bmp(np.zeros((3, 3), np.uint8))[:60]]
    df = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(bad)], "k long, c binary")
    assert all(r["error"] and r["tile"] is None and r["feature"] is None for r in media.describe(df, "k", "c").collect())


def test_media_tiles_are_written_and_read_back(spark):
    rng = np.random.default_rng(6)
    images = [rng.integers(0, 256, (int(h), int(w)), dtype=np.uint8) for h, w in rng.integers(1, 90, (12, 2))]
    df = spark.createDataFrame([(k, bytearray(media.encode_pgm(i))) for k, i in enumerate(images)], "k long, c binary")
    out = media.tiles_written(df, "k", "c", 16)
    assert out.inputFiles()
    for r in out.collect():
        tile = media.tile_array(bytes(r["tile"]))
        assert tile.shape == (16, 16) and (tile == media.resize(images[r["k"]], 16, 16)).all()


def test_difference_hash_by_brute_force():
    rng = np.random.default_rng(7)
    for height, width in ((8, 9), (16, 27), (40, 90)):
        image = rng.integers(0, 256, (height, width), dtype=np.uint8)
        small = np.array([[np.floor(image[y * height // 8 : (y + 1) * height // 8, x * width // 9 : (x + 1) * width // 9].mean() + 0.5) for x in range(9)] for y in range(8)])
        bits = "".join("1" if small[y, x + 1] > small[y, x] else "0" for y in range(8) for x in range(8))
        assert media.difference_hash(image) == f"{int(bits, 2):016x}"


# preference pairs


def test_preference_pairs(spark):
    turns = [
        (1, True, 10, 0, "user", "hi"), (1, True, 10, 1, "assistant", "hello"), (1, False, 11, 0, "user", "hi"), (1, False, 11, 1, "assistant", "go away"),
        (2, True, 12, 0, "user", "same"), (2, False, 13, 0, "user", "same"), (3, True, 14, 0, None, None), (None, True, 15, 0, "user", "lost"),
    ]
    df = spark.createDataFrame(turns, "pair_id long, chosen boolean, conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: r for r in preference.pairs(df).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["prompt"] == "<|user|>\nhi\n" and got[1]["n_common"] == 1
    assert [(s["text"], s["train"]) for s in got[1]["rejected"]] == [("<|assistant|>\n", False), ("go away\n", True)]
    assert got[2]["chosen"] == [] and got[2]["rejected"] == []
    assert got[3]["rejected_id"] is None and got[3]["n_common"] == 0 and [s["text"] for s in got[3]["chosen"]] == ["<||>\n", "\n"]
    assert preference.pairs(df.limit(0)).count() == 0


# exact deduplication


def test_exact_dedup(spark, documents, odd_rows):
    for data in (documents, odd_rows):
        index = exact_dedup.DigestIndex(spark, scratch_path(spark, "index"))
        got = rows(exact_dedup.decisions(wide(spark, data), index), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
        assert got == brute.exact([(i, t) for i, t, _ in data])


def test_exact_dedup_index_lasts(spark):
    path = scratch_path(spark, "index")
    first = exact_dedup.kept_documents(wide(spark, [(1, "a", "s"), (2, "A", "s"), (3, "b", "s")]), exact_dedup.DigestIndex(spark, path))
    assert rows(first, "doc_id", "text") == [(2, "A"), (3, "b")] and first.columns == inputs.WIDE.names
    index = exact_dedup.DigestIndex(spark, path)
    again = exact_dedup.kept_documents(wide(spark, [(4, "a", "s"), (5, "c", "s"), (5, "c", "s")]), index)
    assert rows(again, "doc_id") == [(5,)]
    assert index.rows().count() == 3
    assert exact_dedup.kept_documents(wide(spark, []), index).count() == 0


def test_exact_dedup_rerun_of_a_batch_loses_nothing(spark):
    """A driver that stops after the append and before its documents are written runs the batch again."""
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "index"))
    exact_dedup.kept_documents(wide(spark, [(1, "old", "s")]), index, "monday").collect()
    data = wide(spark, [(2, "OLD", "s"), (3, "a", "s"), (4, "A", "s"), (5, "b", "s")])
    exact_dedup.kept_documents(data, index, "tuesday")  # its rows are never written
    again = exact_dedup.kept_documents(data, index, "tuesday")
    assert rows(again, "doc_id", "text") == [(4, "A"), (5, "b")]
    assert rows(exact_dedup.decisions(data, index, "tuesday"), "doc_id", "keep_id", "kept") == [(2, 1, False), (3, 4, False), (4, 4, True), (5, 5, True)]
    assert rows(exact_dedup.kept_documents(data, index, "wednesday"), "doc_id") == [] and index.rows().count() == 3


def test_exact_dedup_indexes_of_one_folder_name_and_compaction(spark):
    one, two = (exact_dedup.DigestIndex(spark, f"{scratch_path(spark, 'parent')}/index") for _ in range(2))
    for k in range(4):
        exact_dedup.kept_documents(wide(spark, [(k, f"text {k}", "s"), (9, "shared", "s")]), one)
    assert rows(exact_dedup.kept_documents(wide(spark, [(7, "text 0", "s")]), two), "doc_id") == [(7,)]
    small = one.compacted(scratch_path(spark, "compacted"))
    assert rows(small.rows(), "text_sha256", "keep_id", "batch") == rows(one.rows(), "text_sha256", "keep_id", "batch")
    assert len(small.rows().inputFiles()) <= small.buckets < len(one.rows().inputFiles()) + small.buckets
    assert exact_dedup.kept_documents(wide(spark, [(50, "TEXT 3", "s")]), small).count() == 0
    small.forget()
    assert not spark.catalog.tableExists(small.name)


def test_exact_dedup_index_keeps_its_bucket_count(spark):
    path, set_to = scratch_path(spark, "index"), spark.conf.get("spark.sql.shuffle.partitions")
    data = [(k, f"text {k}", "s") for k in range(60)]
    index = exact_dedup.DigestIndex(spark, path, 7)
    assert exact_dedup.kept_documents(wide(spark, data), index).count() == 60
    try:
        for partitions in ("3", "11"):
            spark.sql(f"DROP TABLE {index.name}")  # as in a session whose catalog does not hold it
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            index = exact_dedup.DigestIndex(spark, path)
            assert index.buckets == 7
            assert exact_dedup.kept_documents(wide(spark, data), index).count() == 0 and index.rows().count() == 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", set_to)
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path, 11)


# packing


def test_pieces_and_places(spark, documents, odd_rows):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    unique = [r for r in odd_rows if r[0] is not None]
    marks = [(900, "Don't stop!! ΣΑΣ e\u0301clair ﬁne... 3.5% x<|endoftext|>y İstanbul naïve,", "s"), (901, "a" * 5000, "s"), (902, "日本語 テスト", "s"), (903, "\u00a0x\u2003y\u200bz", "s")]
    for data in (documents, unique + marks):
        out = packing.pack(wide(spark, data), path).collect()
        got = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out)
        assert got == brute.pieces([(i, t) for i, t, _ in data], tokenizer, packing.LENGTH)
        check_places(out)


def check_places(out, length=packing.LENGTH):
    held = defaultdict(list)
    for r in out:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    total = sum(r["length"] for r in out)
    if total > 50 * length:
        assert len(held) <= brute.best_fit_decreasing([r["length"] for r in out], length)
    return len(held)


def test_packing_small_cases(spark):
    assert packing.pack(wide(spark, []), packing.tokenizer_path()).count() == 0
    out = packing.pack(wide(spark, [(1, None, "s"), (2, "", "s")]), packing.tokenizer_path()).collect()
    assert check_places(out) == 1 and {r["length"] for r in out} == {1}


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(2048, rng.lognormal(4 + seed, 1.2, 4000).astype(int) + 1)
    histogram = dict(Counter(lengths.tolist()))
    used = Counter()
    for count, items in packing.plan(histogram):
        assert count > 0 and sum(n * m for n, m in items) <= packing.LENGTH
        for n, m in items:
            used[n] += count * m
    assert used == Counter(histogram)
    sequences = sum(c for c, _ in packing.plan(histogram))
    assert sequences <= brute.best_fit_decreasing(lengths.tolist(), packing.LENGTH)


# toxicity


def test_toxicity_on_held_out(spark, documents, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.score_documents(docs, labels)
    got = {r["doc_id"]: r for r in out.collect()}
    import zlib

    assert len(got) == len(documents)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    known = [(got[r["doc_id"]]["score"], r["toxic"]) for r in labels.collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"] and r["toxic"] is not None]
    toxic, clean = [s for s, y in known if y], [s for s, y in known if not y]
    if toxic and clean and len(known) > 100:
        auc = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
        assert auc > 0.8, auc


def test_toxicity_pooling_by_a_plain_loop(monkeypatch):
    """Every window of every width scored on its own, the largest kept; the same however the words are cut into stretches."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    model = toxicity.Model(rng)
    for table in model.tables:
        table[:] = rng.normal(size=table.shape)
    texts = ["one", "", " ".join(f"w{k}" for k in range(300)), "two words, three!", "..."]
    words, starts = toxicity.hashed(pa.array(texts))
    want = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        x = np.concatenate([model.vectors(words[a:]), np.zeros((3, toxicity.TABLES * toxicity.DEPTH), np.float32)])
        pooled = []
        for w, block, floors in zip(toxicity.WIDTHS, model.blocks, model.floors.reshape(len(toxicity.WIDTHS), -1), strict=True):
            for f in range(toxicity.FILTERS):
                pooled.append(max(0, max(sum(float(block[step, f] @ x[k + step]) for step in range(w)) + floors[f] for k in range(b - a))))
        want.append(np.array(pooled) @ model.out + model.bias)
    for stretch in (7, 64, 1 << 15):
        monkeypatch.setattr(toxicity, "STRETCH", stretch)
        assert np.allclose(model.logits(words, starts), want, atol=1e-4)


def test_toxicity_thresholds_by_language(spark):
    model = toxicity.Model(np.random.default_rng(0))
    logits = np.concatenate([np.linspace(-3, 1, 40), np.linspace(-1, 3, 40), [-2.0, 2.0]])
    labels = np.array([0] * 40 + [1] * 40 + [0, 1])
    toxicity.calibrate(model, logits, labels, ["en"] * 80 + ["de"] * 2)
    assert set(model.thresholds) == {"en"}  # two rows are too few for a threshold of their own
    scores = model.score(logits)[:80]
    f1 = lambda cut: 2 * (hit := ((scores >= cut) & (labels[:80] == 1)).sum()) / max(1, (scores >= cut).sum() + 40)
    assert f1(model.thresholds["en"]) >= max(f1(c) for c in np.arange(0.1, 0.91, 0.05)) - 1e-9
    model.thresholds = {"en": 0.8}
    scored = spark.createDataFrame([("en", 0.5), ("en", 0.8), ("de", 0.5), (None, 0.2)], "lang string, score double")
    got = rows(toxicity._verdicts(scored, model, "lang"), "lang", "score", "rejected")
    assert got == sorted([("en", 0.5, False), ("en", 0.8, True), ("de", 0.5, True), (None, 0.2, False)], key=repr)


def test_toxicity_scores_see_text_only(spark, documents, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    other = docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x")})
    a, b = (dict(rows(toxicity.score_documents(d, labels), "doc_id", "score")) for d in (docs, other))
    assert a == b


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """What only the last of many labelled rows hold is learnt too, in several shards, and learning again gives the same model."""
    ids = spark.range(9000).select(F.col("id").alias("doc_id")).withColumn("toxic", (F.col("doc_id") % 3 == 0).cast("int"))
    late = {r["doc_id"] for r in ids.filter((F.col("toxic") == 1) & ~toxicity.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).collect()[-300:]}
    text = F.when(F.col("doc_id").isin(*late), "zork words here").when(F.col("toxic") == 1, "awful words here").otherwise("fine words here")
    docs = ids.withColumns({"text": text, "lang": F.lit("en")})
    new = spark.createDataFrame([(-1, "zork", "en"), (-2, "plain", "en")], "doc_id long, text string, lang string")
    monkeypatch.setattr(toxicity, "ROWS", 1000)
    learnt = toxicity.labelled(docs, ids)
    assert learnt.count() == ids.filter(~toxicity.held_out(F.col("doc_id"))).count() and learnt.rdd.getNumPartitions() == 7
    got = [dict(rows(toxicity.score_documents(docs.drop("toxic").unionByName(new), ids).filter("doc_id < 0"), "doc_id", "score")) for _ in range(2)]
    assert got[0] == got[1] and got[0][-1] > got[0][-2] + 0.2


def test_toxicity_odd_inputs(spark, odd_rows):
    labels = spark.createDataFrame([(4, 1, 1), (6, 1, 0), (None, 1, 1), (7, 0, None), (99_999, 1, 1)], "doc_id long, quality int, toxic int")
    df = wide(spark, odd_rows)
    for known in (labels, labels.limit(0), labels.filter("toxic = 1")):
        out = toxicity.score_documents(df, known).collect()
        assert len(out) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in out)
        kept = toxicity.accepted_documents(df, known)
        assert kept.columns == df.columns
    assert toxicity.score_documents(df.limit(0), labels).count() == 0


# near duplicates


def test_near_dedup(spark, documents, odd_rows):
    unique = list({r[0]: r for r in odd_rows if r[0] is not None}.values())
    for data in (documents, unique):
        want = brute.near([(i, t) for i, t, _ in data])
        got = rows(near_dedup.decisions(wide(spark, data)), "doc_id", "n_shingles", "component_id", "kept")
        assert got == sorted(((i, n, c, c == i) for i, (n, c) in want.items()), key=repr)


def test_near_dedup_chains(spark):
    """Links that only lead from one neighbour to the next, in scrambled order of ids."""
    words = [f"w{k}" for k in range(400)]
    order = [7, 3, 11, 0, 9, 5, 1, 10, 2, 8, 4, 6]
    data = [(100 + i, " ".join(words[6 * k : 6 * k + 100]), "s") for k, i in enumerate(order)]
    got = rows(near_dedup.decisions(wide(spark, data)), "doc_id", "component_id")
    assert got == [(100 + i, 100) for i in range(12)]


def family(rng, n, changed):
    """Texts that each differ from one original in some words, so their similarities lie on both sides of the limit."""
    first = [f"w{rng.integers(5000)}" for _ in range(120)]
    out = []
    for _ in range(n):
        words = list(first)
        for k in rng.integers(0, len(words), int(rng.integers(1, changed))):
            words[k] = f"x{rng.integers(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("tile, shingles", [(512, 1 << 19), (16, 1 << 19), (512, 1000)])
def test_near_dedup_of_families_in_small_tiles(spark, monkeypatch, tile, shingles):
    """Many texts of similarity 0.5 to 1 in the same buckets, whole families in one tile and spread over many."""
    monkeypatch.setattr(near_dedup, "TILE", tile)
    monkeypatch.setattr(near_dedup, "TILE_SHINGLES", shingles)
    rng = np.random.default_rng(8)
    data = [(1000 - k, t, "s") for k, t in enumerate(family(rng, 130, 9) + family(rng, 60, 5) + family(rng, 30, 14))]
    want = brute.near([(i, t) for i, t, _ in data])
    got = rows(near_dedup.decisions(wide(spark, data)), "doc_id", "n_shingles", "component_id")
    assert got == sorted(((i, n, c) for i, (n, c) in want.items()), key=repr)
    assert 10 < len({c for _, _, c in got}) < 200


def test_tiles_put_out_fewer_links_than_members():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = pa.array(family(rng, 80, 9))
    signed = next(near_dedup._signatures(iter([pa.record_batch([pa.array(range(80)), texts], names=["doc_id", "text"])])))
    sets = next(near_dedup._sets(iter([pa.record_batch([pa.array(range(80)), texts], names=["id", "text"])])))
    both = [pa.array([k] * 80, pa.int32()) for k in (near_dedup.OTHER, near_dedup.QUERY)]
    shared = {"id": pa.array(range(80)), "component": pa.array(range(80)), "n_shingles": signed["n_shingles"], "signature": signed["signature"], "shingles": sets["shingles"]}
    tile = pa.concat_tables([pa.table({"kind": kind} | shared) for kind in both]).combine_chunks()
    (links,) = near_dedup._united(tile)
    links = list(zip(links["a"].to_pylist(), links["b"].to_pylist(), strict=True))
    component = {i: c for i, (_, c) in brute.near(list(enumerate(texts.to_pylist()))).items()}
    assert len(links) == 80 - len(set(component.values())) and all(component[a] == component[b] for a, b in links)
    assert len({x for pair in links for x in pair}) > 20


def test_near_dedup_odd_ids(spark, odd_rows):
    df = wide(spark, odd_rows)
    out = rows(near_dedup.decisions(df), "doc_id", "component_id", "kept")
    assert len(out) == len(odd_rows) and all(r[1:] == (None, True) for r in out if r[0] is None)
    kept = near_dedup.kept_documents(df)
    assert kept.columns == df.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert ids.count(60) == 1 and ids.count(None) == 3
    assert near_dedup.decisions(df.limit(0)).count() == 0


def test_components_against_brute_force(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2)) if a != b] + [(k, k + 1) for k in range(1000, 1200)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = dict(rows(near_dedup.components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {i: find(i) for i in parent}
