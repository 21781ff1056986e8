"""Near-duplicate documents by MinHash, banding, verification and connected components.

1. Every text becomes its set of 5-word shingles (64-bit hashes): its size, a 128-bit fingerprint and ``HASHES`` minima under
   universal hash functions. Documents with equal sets are one class, named by its smallest doc_id; only classes go on.
2. Minima are banded, ``ROWS`` to a band. At a similarity of 0.75 two classes share none of the bands with a probability of
   (1 - 0.75**4)**40 < 3e-7.
3. A bucket's leader is the class that has the most companions over all its buckets, so the text from which many copies
   were made leads them. Each class is paired with up to three leaders of its buckets; pairs whose signatures agree
   enough are confirmed on the full sets of both texts, and confirmed links are joined to components.
4. Every bucket that still holds several components is compared in tiles. Its members are dealt by size class first (linked sets
   differ in size by a third at most, so they are in the same or in neighbouring classes); then each member outside the
   bucket's largest component meets all members of other components, a tile of about ``TILE`` x ``TILE`` of them at a time,
   smaller where the sets are large. A first pass over the tiles keeps the members that agree enough with one of another
   component, by signatures. Only for these are the full sets brought into the tile, where links are confirmed and components
   united; a tile puts out the links that unite components, fewer than it has members.
   So no pair that shares a bucket and could join two components goes unseen, while what is written and sent grows with
   members, not with pairs.
5. Components come from alternating large-star and small-star steps until nothing changes.

The signature test keeps pairs that agree in at least ``AGREE`` of the minima; a pair of similarity 0.75 fails it with a
probability below 1e-6.

Defined results: texts that are null or without words have no shingles, link with nothing and stay; fewer than 5 words are
one shingle; rows that repeat a doc_id are one document that holds all their sets; a row without doc_id is compared with
nothing, has no component and stays; an empty table gives an empty result; other columns pass through ``kept_documents`` and
are not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.common import Rolling, WordHashes, first_rows, fresh, mix64, portions, removed, written

SHINGLE, HASHES, ROWS = 5, 160, 4
BANDS = HASHES // ROWS
AGREE = 0.57 * HASHES
#: Members of a tile's side, and the shingles they may have together; the step of size classes, a little over 4 / 3.
TILE, TILE_SHINGLES, SIZE_STEP = 512, 1 << 19, 1.34
TILED = ("band", "key", "slot", "piece", "part")
#: What a row of a tile is: a member of the bucket's largest component, another member, or a query.
MAIN, OTHER, QUERY = 0, 1, 2

_rng = np.random.default_rng(0x5EED)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_words, _rolling = WordHashes(), Rolling(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts in order, repeats included, and where each text's begin (and end)."""
    words, starts = _words.of(pc.ascii_lower(pc.fill_null(texts, "")))
    prefix = _rolling.prefix(words)
    size = np.diff(starts)
    count = np.where(size > 0, np.maximum(size - SHINGLE + 1, 1), 0)
    ends = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(size)), count)
    first = starts[:-1][text] + np.arange(ends[-1]) - ends[:-1][text]
    return _rolling.between(prefix, first, np.minimum(first + SHINGLE, starts[1:][text])), ends


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in portions(batch.column(1)):
            h, ends = shingles(batch.column(1).slice(a, b - a))
            n, low, high = [], [], []
            for s, e in zip(ends[:-1], ends[1:], strict=True):
                own = np.unique(h[s:e])
                n.append(len(own))
                low.append(mix64(own).sum(dtype=np.uint64).astype(np.int64))
                high.append(mix64(own ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64).astype(np.int64))
            full = np.flatnonzero(np.diff(ends))
            minima = np.zeros((b - a, HASHES), np.uint16)
            bands = np.zeros((b - a, BANDS), np.uint64)
            if len(full):
                for k in range(HASHES):
                    least = np.minimum.reduceat((h * _A[k] + _B[k]) >> np.uint64(32), ends[full])
                    minima[full, k] = mix64(least).astype(np.uint16)
                    bands[full, k // ROWS] = mix64(bands[full, k // ROWS] ^ (least + np.uint64(k + 1)))
            kinds = [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())]
            kinds += [pa.array([m.tobytes() for m in minima], pa.binary()), pa.array(list(bands.view(np.int64)), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(kinds, names=["doc_id", "n_shingles", "low", "high", "signature", "bands"])


def signatures(docs: DataFrame) -> DataFrame:
    kinds = "doc_id long, n_shingles long, low long, high long, signature binary, bands array<long>"
    return docs.select("doc_id", "text").mapInArrow(_signatures, kinds)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) to the pairs that are similar enough on their full sets."""
    for batch in batches:
        keep = []
        for k in range(0, len(batch), 256):
            part = batch.slice(k, 256)
            left, right = (shingles(part.column(c)) for c in ("text_a", "text_b"))
            for i in range(len(part)):
                x, y = (np.unique(h[e[i] : e[i + 1]]) for h, e in (left, right))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= 75 * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of class ids that are linked."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return written(both.mapInArrow(_confirmed, "a long, b long"), "links")


def _agreements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
        yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= AGREE, pa.bool_()))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id of the edges (a, b); component is the smallest id reachable."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    before = None
    while True:
        # large star: the larger neighbours of a node move to its smallest neighbour or itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least")), "least")
        moved = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct(), "large")
        removed(least)
        # small star: the smaller neighbours of a node, and the node itself, move to its smallest neighbour
        least = written(moved.groupBy("u").agg(F.min("v").alias("least")), "least")
        near = moved.join(least, "u").filter("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        fresh = written(near.unionByName(least.select("u", F.col("least").alias("v"))).distinct(), "edges")
        removed(least)
        removed(moved)
        removed(edges)
        edges = fresh
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    pairs = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return pairs.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _by_tile(compare):
    """Rows sorted by tile, whole tiles at a time, through ``compare``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            if not len(rows):
                continue
            keys = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in TILED])
            begin = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
            for start, end in zip(begin[:-1], begin[1:], strict=True):
                yield from compare(rows.slice(start, end - start).combine_chunks())
            rest = rows.slice(begin[-1])
        if rest is not None:
            yield from compare(rest.combine_chunks())

    return of


def _likely(tile: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of queries and of members of other components that agree enough and are near in size, and in how many minima."""
    signs = np.frombuffer(b"".join(tile.column("signature").to_pylist()), np.uint16).reshape(-1, HASHES)
    kind, ids, comps, size = (tile.column(c).to_numpy() for c in ("kind", "id", "component", "n_shingles"))
    asked, member = np.flatnonzero(kind == QUERY), np.flatnonzero(kind != QUERY)
    step = max(1, 8_000_000 // (max(1, len(member)) * HASHES))
    for part in (asked[k : k + step] for k in range(0, len(asked) if len(member) else 0, step)):
        agree = np.add.reduce((signs[part][:, None] == signs[member][None]).view(np.uint8), axis=2, dtype=np.uint8)
        fits = (agree >= AGREE) & (comps[part][:, None] != comps[member][None])
        fits &= 100 * np.minimum(size[part][:, None], size[member][None]) >= 75 * np.maximum(size[part][:, None], size[member][None])
        fits &= (kind[member] == MAIN)[None] | (ids[part][:, None] > ids[member][None])  # two queries meet once
        x, y = np.nonzero(fits)
        yield part[x], member[y], agree[x, y]


def _involved(tile: pa.Table) -> Iterator[pa.RecordBatch]:
    """The tile's rows that may be linked with another of its rows."""
    found = np.zeros(len(tile), bool)
    for x, y, _ in _likely(tile):
        found[x] = found[y] = True
    yield from tile.filter(pa.array(found)).to_batches()


def _united(tile: pa.Table) -> Iterator[pa.RecordBatch]:
    """Confirmed links (a, b) that unite the components of a tile: no more than it has components, less one."""
    sets = [np.frombuffer(b, np.uint64) for b in tile.column("shingles").to_pylist()]
    ids, comps = (tile.column(c).to_numpy() for c in ("id", "component"))
    above: dict[int, int] = {}

    def root(c: int) -> int:
        while c in above:
            if above[c] in above:
                above[c] = above[above[c]]
            c = above[c]
        return c

    out: tuple[list[int], list[int]] = ([], [])
    for x, y, agree in _likely(tile):
        order = np.lexsort((-agree.astype(np.int64), x))
        x, y = x[order], y[order]
        for one, start, end in _runs(x):
            others = y[start:end]
            while len(others):
                own = root(int(comps[one]))
                others = others[[root(int(c)) != own for c in comps[others]]]
                now, others = others[:16], others[16:]
                if not len(now):
                    break
                many = [sets[k] for k in now]
                flat, size = np.concatenate(many), np.array([len(m) for m in many])
                at = np.minimum(np.searchsorted(sets[one], flat), len(sets[one]) - 1)
                both = np.add.reduceat((sets[one][at] == flat).astype(np.int64), np.cumsum(size) - size)
                for other in now[100 * both >= 75 * (len(sets[one]) + size - both)]:
                    p, q = root(int(comps[one])), root(int(comps[other]))
                    if p != q:
                        above[max(p, q)] = min(p, q)
                        out[0].append(int(max(ids[one], ids[other])))
                        out[1].append(int(min(ids[one], ids[other])))
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])


def _runs(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of every run of equal values."""
    begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    for start, end in zip(begin, np.append(begin[1:], len(x)), strict=True):
        yield int(x[start]), int(start), int(end)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in portions(batch.column(1)):
            h, ends = shingles(batch.column(1).slice(a, b - a))
            own = pa.array([np.unique(h[s:e]).tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), own], names=["id", "shingles"])


def across(buckets: DataFrame, classes: DataFrame, comps: DataFrame, texts: DataFrame) -> DataFrame:
    """Confirmed links (a, b) that unite all components of which two members share a bucket and are similar enough."""
    sized = classes.select("id", "n_shingles")
    rows = buckets.select("band", "key", "id").join(sized, "id").join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    size_class = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(SIZE_STEP))).cast("int")
    rows = written(rows.select("band", "key", "id", "component", "n_shingles"), "members")
    several = rows.groupBy("band", "key").agg((F.min("component") < F.max("component")).alias("mixed")).filter("mixed").select("band", "key")
    rows = rows.join(several, ["band", "key"], "left_semi").withColumn("slot", F.explode(F.array(size_class, size_class + 1)))
    dealt = written(rows, "slots")
    per = dealt.groupBy("band", "key", "slot", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("long"))
    mixed = per.groupBy("band", "key", "slot").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("n").alias("members"), F.sum("long").alias("shingles"), F.max(F.struct("n", "component", "long")).alias("most")
    )
    sides = lambda n, long: F.greatest(F.ceil(n / TILE), F.ceil(long / TILE_SHINGLES)).cast("int")
    pieces, parts = sides(F.col("members"), F.col("shingles")), sides(F.col("members") - F.col("most.n"), F.col("shingles") - F.col("most.long"))
    mixed = mixed.filter("parts > 1").select("band", "key", "slot", F.col("most.component").alias("main"), pieces.alias("pieces"), parts.alias("parts"))
    rows = written(dealt.join(mixed, ["band", "key", "slot"]), "mixed")
    piece = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int")
    outside = F.col("component") != F.col("main")
    members = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = members.withColumns({"piece": piece, "kind": F.when(outside, F.lit(OTHER)).otherwise(F.lit(MAIN))})
    queries = rows.filter(outside).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    queries = queries.withColumns({"part": part, "kind": F.lit(QUERY)})
    names = (*TILED, "kind", "id", "component", "n_shingles")
    both = written(members.select(*names).unionByName(queries.select(*names)), "tiles")
    signed = both.join(classes.select("id", "signature"), "id").select(*names, "signature")
    kinds = "band int, key long, slot int, piece int, part int, kind int, id long, component long, n_shingles long, signature binary"
    involved = signed.repartition(*TILED).sortWithinPartitions(*TILED).mapInArrow(_by_tile(_involved), kinds)
    involved = written(involved, "involved")
    for done in (dealt, rows, both):
        removed(done)
    sets = written(texts.join(involved.select("id").distinct(), "id", "left_semi").select("id", "text").mapInArrow(_sets, "id long, shingles binary"), "sets")
    full = involved.join(sets, "id").select(*names, "signature", "shingles")
    found = full.repartition(*TILED).sortWithinPartitions(*TILED).mapInArrow(_by_tile(_united), "a long, b long")
    return written(found.distinct(), "across")


def classes_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, id, component) of every row, id being its class; and the rows' sets behind them."""
    signed = written(signatures(docs), "signatures")
    full = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    named = written(full.groupBy("low", "high").agg(F.min("doc_id").alias("id")), "classes")
    rows = signed.select("doc_id", "n_shingles", "low", "high")
    rows = rows.join(named, ["low", "high"], "left").withColumn("id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("id")).otherwise(F.col("doc_id")))
    rows = written(rows.select("doc_id", "n_shingles", "id"), "rows")
    # one row per class: that of the smallest doc_id (rows that repeat it carry the same set)
    first = full.join(named, (full["doc_id"] == named["id"]) & (full["low"] == named["low"]) & (full["high"] == named["high"]), "left_semi")
    classes = written(first.select(F.col("doc_id").alias("id"), "n_shingles", "signature", "bands"), "reps")
    band = classes.select("id", F.posexplode("bands").alias("band", "key"))
    held = band.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(band.join(held, ["band", "key"]), "shared")
    mates = written(shared.groupBy("id").agg(F.sum("n").alias("mates")), "mates")
    leaders = shared.join(mates, "id").groupBy("band", "key").agg(F.max(F.struct("mates", (-F.col("id")).alias("least"))).alias("x"))
    leaders = written(leaders.select("band", "key", (-F.col("x.least")).alias("leader"), "x.mates"), "leaders")
    buckets = written(shared.join(leaders, ["band", "key"]).select("band", "key", "id", "leader", "mates"), "buckets")
    removed(leaders)
    removed(shared)
    met = buckets.filter("id != leader").groupBy("id", "leader").agg(F.count(F.lit(1)).alias("times"), F.max("mates").alias("mates"))
    best = met.groupBy("id").agg(F.max(F.struct("times", "leader")).alias("m0"), F.max(F.struct("mates", "leader")).alias("m1"), F.min("leader").alias("m2"))
    pairs = best.select(F.col("id").alias("a"), F.explode(F.array_distinct(F.array("m0.leader", "m1.leader", "m2"))).alias("b"))
    pairs = written(pairs, "pairs")
    sign = classes.select("id", "signature")
    signs = pairs.join(sign.select(F.col("id").alias("a"), F.col("signature").alias("sig_a")), "a")
    signs = signs.join(sign.select(F.col("id").alias("b"), F.col("signature").alias("sig_b")), "b")
    likely = written(signs.select("a", "b", "sig_a", "sig_b").mapInArrow(_agreements, "a long, b long"), "likely")
    shared = buckets.select("id").distinct()
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(shared, "id", "left_semi")
    texts = written(texts, "texts")
    links = confirm(likely, texts).unionByName(_own_links(rows))
    comps = written(components(links), "components")
    more = across(buckets, classes, comps, texts)
    if not more.isEmpty():
        comps = written(components(links.unionByName(more)), "components")
    return rows.join(comps, "id", "left").withColumn("component_id", F.coalesce("component", "id")), classes


def _own_links(rows: DataFrame) -> DataFrame:
    """(a, b) between the classes of rows that repeat a doc_id with different sets, or with none."""
    per = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("most")).filter("b < most").select("doc_id", "b")
    return rows.join(per, "doc_id").filter("id > b").select(F.col("id").alias("a"), "b").distinct()


def decisions(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    rows, _ = classes_of(docs)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one per component and all without doc_id, with all their columns."""
    kept = fresh(docs, "__kept_id")
    stay = written(decisions(docs).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(kept)).distinct(), "kept")
    rows = docs.join(stay, docs["doc_id"] == stay[kept], "left_semi")
    return first_rows(rows, ["doc_id"]).unionByName(docs.filter("doc_id IS NULL"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark.read.parquet(f"{sf_dir}/documents.parquet"))
