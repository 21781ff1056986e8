"""Capture index, whitening and prefix trie against plain versions of their rules."""

import gzip
import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from headway.llm import prefix_trie, warc, whitening
from headway.llm.common import scratch_path

# ---- capture index


def brute_captures(rows):
    first = {}
    key = lambda i: (i is None, i or 0)
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100:
            first[data] = min(first.get(data, page), page, key=key)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        own = len(data) < 100 or first[data] == page
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "response" if own else "revisit", None if own else first[data]))
    return sorted(out, key=repr)


def odd_pages():
    same, other = "<p>" + "same text again " * 20, "y" * 100
    rows = [(5, "http://A.example.com/x y\r\nz", same), (3, "http://b.example.com/", same), (9, None, same), (4, "", same), (None, "http://É.com/É?a#b", same)]
    rows += [(1, "no scheme/at all", None), (2, "http://b.example.com/", ""), (6, "http://u@b.example.com:8080", "short"), (7, "https://b.example.com:443/p", "short")]
    rows += [(8, "http://b.example.com/", other), (8, "http://b.example.com/", other), (8, "http://c.example.com/", other), (8, "http://b.example.com/", same), (10, "http://b.example.com/q", other)]
    rows += [(None, None, "z" * 200), (None, None, "z" * 200), (11, "http://l.com/", "long \n\r\n\r\n " * 200_000)]
    return rows + [(100 + k, f"http://hot.example.com/{k % 7}", same if k % 2 else f"page {k} " * 30) for k in range(300)]


PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())] + [T.StructField(n, T.LongType()) for n in ("key", "digest", "file", "offset", "n")])


def replay(spark, pages, **kw):
    archives = scratch_path(spark, "archives")
    manifest = warc.write_archives(pages, archives, kw.get("archive", warc.ARCHIVE))
    index = warc.CaptureIndex(manifest, scratch_path(spark, "index"), kw.get("lines", warc.LINES), kw.get("segments"))
    return warc.replayed(pages, index, archives), manifest, index, archives


@pytest.mark.parametrize("kw", [{}, {"lines": 3, "segments": 5, "archive": 2000}])
def test_replayed_captures_by_brute_force(spark, kw):
    pages = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in odd_pages()], PAGE).repartition(3)
    got, manifest, index, archives = replay(spark, pages, **kw)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_captures(odd_pages())
    if kw:
        assert index.segments.count() > 3 and manifest.select("file").distinct().count() > 10


def test_archives_are_gzip_members_of_warc_records(spark):
    pages = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in odd_pages()[:14]], PAGE).coalesce(1)
    _, manifest, _, archives = replay(spark, pages)
    fs, root = warc.opened(archives)
    (name,) = {r["file"] for r in manifest.collect()}
    with fs.open_input_file(f"{root}/{name}") as f:
        data = f.read()
    assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type: ") == 14
    for r in manifest.collect():
        headers, payload = warc.parsed_record(data[r["offset"] : r["offset"] + r["length"]])
        assert headers["warc-record-id"] == warc.record_id(r["page_id"])
        with pytest.raises((ValueError, zlib.error)):
            warc.parsed_record(data[r["offset"] : r["offset"] + r["length"] - 9])


def test_lookup_finds_only_what_is_there(spark):
    pages = spark.createDataFrame([(k, f"http://x.com/{k // 40}", "t") for k in range(400)], "page_id long, url string, html string")
    _, manifest, index, _ = replay(spark, pages, lines=7, segments=4)
    wanted = spark.createDataFrame([(warc.capture_key("http://x.com/3"), 130), (warc.capture_key("http://x.com/9"), 399)], "key string, page_id long")
    assert sorted(r["page_id"] for r in index.locate(wanted).collect()) == [130, 399]
    with pytest.raises(Exception, match="no capture of"):
        index.locate(spark.createDataFrame([("com,x)/3", 5)], "key string, page_id long")).collect()


def test_capture_keys():
    assert warc.capture_key("HTTP://www.Example.com:80/A?b#c") == "com,example,www)/A?b"
    assert warc.capture_key("http://example.com") == "com,example)/"
    for url in ("http://É.com/É x%20", "a\tb://c"):
        assert warc.capture_key(warc.quoted(url)) == warc.capture_key(url)


def test_no_pages(spark):
    got, _, index, _ = replay(spark, spark.createDataFrame([], PAGE))
    assert got.count() == 0 and index.segments.count() == 0


def test_op11_on_the_smallest_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, warc.op11_warc_index(spark, sf).collect()), key=repr) == brute_captures(rows)


# ---- whitening


def brute_whitened(rows, components=4):
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = [list(x) for x in sorted({tuple(x) for _, x in good})]
    n, s = len(fit), [sum(col) for col in zip(*fit, strict=True)]
    x = np.array(fit, float) - np.array(s) / n
    values, vectors = np.linalg.eigh(x.T @ x / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, row in good:
        dev = sum((n * c - t) ** 2 for c, t in zip(row, s, strict=True))
        y = (np.array(row) - np.array(s) / n) @ vectors / np.sqrt(values)
        for k in range(len(values)):
            out.setdefault((i, k + 1), []).append((n, dev, abs(y[k]), values[k] / (x * x).sum() * n))
    return out


def same_whitening(got, want):
    seen = defaultdict(list)
    for r in got:
        seen[r["vec_id"], r["component"]].append((r["n"], int(r["deviation"]), abs(r["whitened"]), r["explained"]))
        assert r["identity_error"] < 1e-9
    assert seen.keys() == want.keys()
    for k, rows in want.items():
        assert len(rows) == len(seen[k])
        for a, b in zip(sorted(seen[k]), sorted(rows), strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-7) and a[3] == pytest.approx(b[3], rel=1e-9)


VECTOR = "vec_id long, embedding array<float>, x long, component long, whitened double"


def test_whitening_by_eigenvectors_with_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(v) for v in rng.normal(size=7) * [9, 5, 3, 2, 1, 1, 0] + 3]) for k in range(200)]
    rows += [(300 + k, rows[0][1]) for k in range(150)] + [(500, None), (501, []), (502, [1.0] * 6 + [None]), (503, [math.nan] * 7), (504, [math.inf] * 7), (None, rows[1][1])]
    df = spark.createDataFrame([(i, v, 1, 2, 0.5) for i, v in rows], VECTOR)
    other = spark.createDataFrame([(505, [1.0, 2.0], 1, 2, 0.5)], VECTOR)
    same_whitening(whitening.whitened(df.unionByName(other)).collect(), brute_whitened(rows))


def test_whitened_signs_agree_between_rows(spark, sf):
    rows = [(r["vec_id"], list(r["embedding"]) if r["embedding"] is not None else None) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = whitening.op12_whitening(spark, sf).collect()
    same_whitening(got, brute_whitened(rows))
    y = defaultdict(dict)
    for r in got:
        y[r["component"]][r["vec_id"]] = r["whitened"]
    assert abs(sum(y[1][i] * y[2][i] for i in y[1])) < 1e-6 * len(y[1])


def test_few_directions_and_few_rows(spark):
    make = lambda vs: spark.createDataFrame([(k, v) for k, v in enumerate(vs)], "vec_id long, embedding array<float>")
    line = whitening.whitened(make([[float(k), 2.0 * k, 1.0, 0.0, 5.0] for k in range(50)])).collect()
    assert {r["component"] for r in line} == {1} and len(line) == 50 and line[0]["explained"] == pytest.approx(1)
    for vs in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None]):
        assert whitening.whitened(make(vs) if vs and vs != [None] else spark.createDataFrame([(1, None)] if vs else [], "vec_id long, embedding array<float>")).count() == 0
    equal = whitening.whitened(make([[float(a), float(b), float(c)] for a in (0, 1) for b in (0, 1) for c in (0, 1)])).collect()  # equal variances
    assert {r["component"] for r in equal} == {1, 2, 3} and equal[0]["identity_error"] < 1e-9


def test_many_steps_and_large_deviations(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(np.float32(v)) for v in rng.normal(size=40) * 1e9]) for k in range(60)]  # values that lie close together
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    same_whitening(whitening.whitened(df).collect(), brute_whitened(rows))
    with pytest.raises(Exception, match="too large"):
        whitening.whitened(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<float>")).collect()


# ---- prefix trie


def brute_trie(rows, every=5, most=8):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[c].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in turns.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        path = tuple(own.get(c - c % every, [])[:h] + t[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = []
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) if children[p] else 1
        saved[p] = sum(saved[q] for q in children[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], digest))
    return sorted(out, key=repr)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(df):
    return sorted((tuple(r[c] for c in NODE) for r in df.collect()), key=repr)


def odd_turns():
    rng = random.Random(9)
    rows = [(c, t, "user" if t % 2 == 0 else "bot", rng.choice("abc")) for c in range(120) for t in range(rng.randrange(1, 7))]
    rows += [(c, t, "user", f"hot {t}") for c in range(200, 320) for t in range(3)]  # copies
    rows += [(c, t, "user", "same start" if t < 12 else f"{c} {t}") for c in range(400, 430) for t in range(15)]
    rows += [(c, t, "user", f"grows {t}") for c in range(500, 540) for t in range(c - 500 + 1)]  # one inside the other
    rows += [(600, t, "user", f"long {t}") for t in range(2000)]
    rows += [(700, None, None, None), (700, 1, None, "x"), (700, 1, None, "x"), (701, None, "user", ""), (None, 1, "user", "nobody"), (999, 0, "ü", "é" * 5), (3, 2, "user", "a third turn 2")]
    return rows


@pytest.mark.parametrize("light, heavy", [(prefix_trie.LIGHT, prefix_trie.HEAVY), (50, 10_000), (20, 3)])
def test_trie_by_brute_force(spark, light, heavy):
    rows = odd_turns()
    kind = "conv_id long, turn int, role string, text string, depth long, k1 string, path long, digest long"
    df = spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows if heavy > 3 or r[0] is None or not 500 <= r[0] < 600], kind).repartition(3)
    want = brute_trie([r for r in rows if heavy > 3 or r[0] is None or not 500 <= r[0] < 600])
    assert nodes(prefix_trie.rebuilt_trie(df, light=light, heavy=heavy)) == want


def test_ids_of_a_hot_node_come_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(c, 0, "user", "same") for c in range(1000)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5)
    assert nodes(prefix_trie.rebuilt_trie(df)) == brute_trie(rows)


def test_no_conversations(spark):
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0
    assert nodes(prefix_trie.rebuilt_trie(spark.createDataFrame([(1, 0, "a", "b")], "conv_id long, turn int, role string, text string"))) == brute_trie([(1, 0, "a", "b")])


def test_op13_on_the_smallest_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(prefix_trie.op13_prefix_trie(spark, sf)) == brute_trie(rows)


# ---- earlier operators on rows that repeat ids, and columns that clash


def test_near_copies_of_rows_that_repeat_an_id(spark):
    from headway.llm import near_dedup

    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(3, b), (5, a), (5, b), (9, a), (11, "alone here"), (5, None), (20, "x"), (21, "x"), (21, "")]
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in near_dedup.decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 36): (3, True), (5, 36): (3, False), (9, 36): (3, False), (11, 1): (11, True), (5, 0): (3, False), (20, 1): (20, True), (21, 1): (20, False), (21, 0): (20, False)}


def test_kept_documents_with_columns_of_the_same_names(spark):
    from headway.llm import exact_dedup, near_dedup

    rows = [(1, "same text of some words", 7, 8, 9, 10), (2, "same text of some words", 7, 8, 9, 10), (3, "other", 7, 8, 9, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __place long, __digest long, __keep_id long, __kept_id long")
    for kept in (near_dedup.kept_documents(docs), exact_dedup.kept_documents(docs, exact_dedup.DigestIndex(spark, scratch_path(spark, "index")))):
        assert kept.columns == docs.columns
        assert {tuple(r)[2:] for r in kept.collect()} == {(7, 8, 9, 10)} and kept.count() == 2


def test_labels_of_words_by_all_pairs():
    from headway.llm import pii

    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a@b.co", "+44 20 7946 0958", "10.0.0.1", "4111 1111 1111 1111", "word", "12345", "3.3.3.3.3"]) for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    field, base = pii.Field(texts), [pii.base_spans(t) for t in texts]
    want = []
    for t, (start, end) in zip(field.text, field.spans, strict=True):
        want.append(next((1 + kind for kind, s, e in sorted(base[t]) if s < end and start < e), 0))
    assert field.labels(base).tolist() == want and len(set(want)) > 3
    for spans in base:
        taken = pii.Taken(spans)
        for _ in range(50):
            a = rng.randrange(0, 400)
            b = a + rng.randrange(1, 40)
            assert taken.overlaps(a, b) == any(s < b and a < e for _, s, e in spans)


def test_long_texts_take_time_in_proportion():
    import time

    from headway.llm import pii

    model = pii.Model()
    took = []
    for n in (20_000, 80_000):
        text = " ".join(f"10.0.{k % 250}.{k % 99}" for k in range(n))
        began = time.process_time()
        base = [pii.base_spans(text)]
        pii.Field([text]).labels(base)
        pii.added_spans([text], base, model)
        took.append(time.process_time() - began)
    assert took[1] < 4 * took[0] * 1.8


def test_urls_that_repeat_count_once(spark):
    from headway.llm import url_filter

    rows = [(f"h{k % 20}.net", "/es/x", "block") for k in range(60_000)] + [(f"g{k}.com", "/en/", "allow") for k in range(300)]
    df = spark.createDataFrame(rows, "host string, path string, verdict string")
    model = url_filter.fitted(df)
    assert min(model.scores(["h1.net", "h19.net"], ["/es/x", "/es/x"])) > 0.5 and model.scores(["g7.com"], ["/en/"])[0] < 0.5
