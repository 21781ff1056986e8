"""Prefix trie of conversations by truncation peeling.

Every conversation is a path of turns. A node (a distinct sequence of first turns) has two 64-bit keys, each the exclusive or of one
hash per turn (of its place, role and text), so a window over a conversation gives the keys of all its prefixes without its texts.
Conversations that are equal throughout are one path with a count.

Peeling starts at the deepest turn: paths that end at a depth are merged with the nodes that survive from below, a node is written with
what it has gathered (members, children, leaves, saved bytes), then its last turn is stripped and what is left is regrouped with others.
So nodes are found and summed on the way, each once. Where a subtree is small this runs inside a task: a path goes with its first node
under which at most ``LIGHT`` turns of paths stand (or a single path). The few nodes above are peeled in one task while there are at most ``HEAVY`` of them, and
before that one depth at a time by Spark, deepest first. How many turns stand under a prefix is counted first, by a partial
aggregation; it decides only where a subtree is peeled.

``ends_sha256`` needs the ids of a node's ended members in order: they are sorted over ranges of (node, id) and joined to chunks of ``CHUNK`` ids,
and a node's chunks then run through one hash in order, so that a task holds one chunk of a hot node at a time.

Defined results: rows without conv_id belong to no conversation; turns are ordered by turn (null first), those of one number by the digest
of role and text, and rows that repeat each count as a turn; null role and text are empty; the remainder of a negative conv_id is negative (as in SQL); a
conversation that is left without turns is a member of the root alone; an empty table has no nodes; other columns are not read.
A task holds 60 bytes a turn of the longest single conversation or of ``LIGHT`` turns, whichever is more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.llm.common import removed, written

#: Turns of paths under a node that one task peels; nodes that are peeled in one task at the top; ids in a chunk.
LIGHT, HEAVY, CHUNK = 512, 100_000, 16_384
KEY = ["k1", "k2"]
#: What a node is known by and has gathered.
NODE = "k1 long, k2 long, depth int, p1 long, p2 long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
GATHERED = ["n_convs", "n_children", "n_leaves", "saved_tokens"]


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, digest of role and text, bytes of the text) of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.select("conv_id", F.row_number().over(order).alias("place"), "digest", "n_bytes")


def rebuilt(turns: DataFrame, every: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are those of the first conversation of their run of ``every`` ids, h being crc32(conv_id) mod ``most`` + 1.

    (conv_id, part, place, digest, n_bytes) of the rebuilt turns, and all conv_ids. Each run's first turns are read at most ``every`` times.
    """
    h = lambda c: F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(most + 1))
    ids = turns.select("conv_id").distinct()
    first = F.col("conv_id") - F.col("conv_id") % every
    lead = turns.filter(F.col("place") <= most).withColumnRenamed("conv_id", "first")
    led = ids.withColumns({"first": first, "h": h(F.col("conv_id"))}).join(lead, "first").filter("place <= h")
    own = turns.filter(F.col("place") > h(F.col("conv_id")))
    part = lambda df, k: df.select("conv_id", F.lit(k).alias("part"), "place", "digest", "n_bytes")
    return part(led, 0).unionByName(part(own, 1)), ids


def prefixes(rows: DataFrame, order: list[str]) -> DataFrame:
    """(conv_id, depth, k1, k2, n_bytes) of every prefix of every conversation but the empty one; ``rows`` has a digest and n_bytes of each turn."""
    by = W.partitionBy("conv_id").orderBy(*order)
    rows = rows.withColumn("depth", F.row_number().over(by))
    key = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "depth", "digest")).over(by.rowsBetween(W.unboundedPreceding, 0))
    return rows.select("conv_id", "depth", key(1).alias("k1"), key(2).alias("k2"), "n_bytes")


class Peeled:
    """Peels the nodes of whole subtrees, given as arrays: depth, parent's place (-1 at the top), bytes, and what each has gathered already."""

    def __init__(self, depth: np.ndarray, parent: np.ndarray, n_bytes: np.ndarray, conv: np.ndarray, gathered: list[np.ndarray]):
        self.conv = conv.copy()
        self.convs, self.children, self.leaves, self.saved = (g.astype(np.int64) for g in gathered)
        for at in _by_depth(depth):
            self.leaves[at[self.children[at] == 0]] += 1
            self.saved[at] += (self.convs[at] - 1) * n_bytes[at]
            here = at[parent[at] >= 0]
            up = parent[here]
            for mine, theirs in ((self.convs, self.convs), (self.leaves, self.leaves), (self.saved, self.saved)):
                np.add.at(theirs, up, mine[here])
            np.add.at(self.children, up, 1)
            np.minimum.at(self.conv, up, self.conv[here])
        self.parent_conv = np.where(parent >= 0, self.conv[np.maximum(parent, 0)], np.int64(-1))


def _by_depth(depth: np.ndarray) -> Iterator[np.ndarray]:
    """Places of each depth, deepest first."""
    order = np.argsort(-depth, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else ()


def _numbered(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each distinct key's first row, and each row's number among the distinct keys."""
    both = np.empty(len(k1), [("a", np.int64), ("b", np.int64)])
    both["a"], both["b"] = k1, k2
    _, first, number = np.unique(both, return_index=True, return_inverse=True)
    return first, number


def _node_batch(k1, k2, depth, p1, p2, inner, peeled: Peeled) -> pa.RecordBatch:
    parent_conv = pa.array(peeled.parent_conv, pa.int64(), mask=~inner)
    columns = [k1, k2, depth.astype(np.int32), p1, p2, peeled.conv]
    arrays = [*map(pa.array, columns), parent_conv, *map(pa.array, (peeled.convs, peeled.children, peeled.leaves, peeled.saved))]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in NODE.split(", ")])


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of whole subtrees from rows of paths, sorted by subtree, path and depth."""
    rest: pa.Table | None = None

    def peel(t: pa.Table) -> Iterator[pa.RecordBatch]:
        path, depth, k1, k2, p1, p2, n_bytes, ends = (t.column(c).to_numpy() for c in ("path", "depth", "k1", "k2", "p1", "p2", "n_bytes", "ends"))
        first, node = _numbered(k1, k2)
        parent = np.full(len(first), -1, np.int64)
        below = np.flatnonzero(path[1:] == path[:-1]) + 1  # rows whose row before is the same path, one turn shorter
        parent[node[below]] = node[below - 1]
        conv, convs = np.full(len(first), np.iinfo(np.int64).max), np.zeros(len(first), np.int64)
        np.minimum.at(conv, node, path)
        np.add.at(convs, node, ends)
        zero = np.zeros(len(first), np.int64)
        done = Peeled(depth[first], parent, n_bytes[first], conv, [convs, zero, zero, zero])
        yield _node_batch(k1[first], k2[first], depth[first], p1[first], p2[first], parent >= 0, done)

    for batch in batches:
        rows = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        if not len(rows):
            continue
        c1, c2 = rows.column("c1").to_numpy(), rows.column("c2").to_numpy()
        last = np.flatnonzero((c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from peel(rows.slice(0, cut).combine_chunks())
        rest = rows.slice(cut)
    if rest is not None and len(rest):
        yield from peel(rest.combine_chunks())


def _top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes above, all in one task, with what they have gathered from below."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    k1, k2, depth, p1, p2, n_bytes, conv = (rows.column(c).to_numpy() for c in ("k1", "k2", "depth", "p1", "p2", "n_bytes", "conv_id"))
    place = {key: k for k, key in enumerate(zip(k1.tolist(), k2.tolist(), strict=True))}
    parent = np.array([place[key] if d else -1 for key, d in zip(zip(p1.tolist(), p2.tolist(), strict=True), depth.tolist(), strict=True)], np.int64)
    done = Peeled(depth, parent, n_bytes, conv, [rows.column(c).to_numpy() for c in GATHERED])
    yield _node_batch(k1, k2, depth, p1, p2, parent >= 0, done)


def _merged(rows: DataFrame) -> DataFrame:
    """What several sources have gathered for a node, in one row."""
    return rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in GATHERED))


def _stripped(nodes: DataFrame) -> DataFrame:
    """What finished nodes give to the nodes that are left when their last turn is stripped."""
    return nodes.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens")


def peeled(paths: DataFrame, light: int = LIGHT, heavy: int = HEAVY) -> DataFrame:
    """NODE rows of all nodes. ``paths``: (path, depth, k1, k2, n_bytes, ends, size) of every prefix of every path, the empty one included.

    ``path`` names the path by its smallest conversation, ``ends`` is the number of conversations where it ends and else 0, ``size`` its turns.
    """
    paths = written(paths, "every-path")
    # a table of its own, so that both sides of the join are dealt for it and a hot key's paths can be split
    under = written(paths.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight")), "under")
    by = W.partitionBy("path").orderBy("depth")
    small = (F.col("depth") > 0) & ((F.col("n") == 1) | (F.col("weight") <= light))
    top = lambda c: F.first(F.when(small, F.col(c)), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0))
    rows = paths.join(under, KEY).select("path", "depth", *KEY, "n_bytes", "ends", F.lag("k1").over(by).alias("p1"), F.lag("k2").over(by).alias("p2"), top("k1").alias("c1"), top("k2").alias("c2"))
    rows = written(rows, "paths")
    parts = rows.filter("c1 IS NOT NULL").repartition("c1", "c2").sortWithinPartitions("c1", "c2", "path", "depth")
    low = written(parts.mapInArrow(_subtrees, NODE), "subtrees")
    above = rows.filter("c1 IS NULL").withColumns({"p1": F.coalesce("p1", F.lit(0).cast("long")), "p2": F.coalesce("p2", F.lit(0).cast("long"))})
    above = above.groupBy(*KEY, "depth", "p1", "p2", "n_bytes").agg(F.min("path").alias("conv_id"), F.sum("ends").alias("n_convs"))
    above = written(above.withColumns({c: F.lit(0).cast("long") for c in GATHERED[1:]}), "above")
    tops = low.filter("parent_conv_id IS NULL")
    gathered = _merged(above.select(*KEY, "conv_id", *GATHERED).unionByName(_stripped(tops)))
    left = written(above.select(*KEY, "depth", "p1", "p2", "n_bytes").join(gathered, KEY), "left")
    removed(rows)
    found: list[DataFrame] = []
    while True:
        n, deepest = left.agg(F.count(F.lit(1)), F.max("depth")).first()
        if n <= heavy or deepest == 0:
            break
        level = left.filter(F.col("depth") == deepest).withColumns(
            {"n_leaves": F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("n_leaves")).cast("long"), "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("n_bytes")}
        )
        level = written(level.select(*KEY, "depth", "p1", "p2", "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), *GATHERED), "level")
        found.append(level)
        rest = left.filter(F.col("depth") < deepest)
        gathered = _merged(rest.select(*KEY, "conv_id", *GATHERED).unionByName(_stripped(level)))
        left = written(rest.select(*KEY, "depth", "p1", "p2", "n_bytes").join(gathered, KEY), "left")
    top_nodes = written(left.coalesce(1).mapInArrow(_top, NODE), "top")
    high = top_nodes
    for level in found:
        high = high.unionByName(level)
    # the nodes whose parent was peeled elsewhere look up its name; all such parents are among the few above
    names = high.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above_id"))
    nodes = low.unionByName(high)
    known = nodes.filter("parent_conv_id IS NOT NULL OR depth = 0")
    asked = nodes.filter("parent_conv_id IS NULL AND depth > 0").join(names, ["p1", "p2"]).withColumn("parent_conv_id", F.col("above_id"))
    return known.unionByName(asked.select(*known.columns))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, first id, ids as text) from rows sorted by node and id."""
    for batch in batches:
        k1, k2, ids = (batch.column(c).to_numpy() for c in ("k1", "k2", "conv_id"))
        begin = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])) if len(ids) else np.zeros(0, np.int64)
        spans = [(a, min(a + CHUNK, e)) for s, e in zip(begin, np.append(begin[1:], len(ids)), strict=True) for a in range(s, e, CHUNK)]
        start = np.array([a for a, _ in spans], np.int64)
        text = [",".join(map(str, ids[a:b].tolist())) for a, b in spans]
        yield pa.RecordBatch.from_arrays([pa.array(k1[start]), pa.array(k2[start]), pa.array(ids[start]), pa.array(text, pa.string())], names=["k1", "k2", "first_id", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each node's chunks, which come in order."""
    node, state = None, None
    for batch in batches:
        out: list[tuple[int, int, str]] = []
        for a, b, ids in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if (a, b) == node:
                state.update(b",")
            else:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (a, b), hashlib.sha256()
            state.update(ids.encode())
        yield _digest_batch(out)
    if node is not None:
        yield _digest_batch([(*node, state.hexdigest())])


def _digest_batch(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the nodes where conversations end; ``ends`` has k1, k2 and conv_id of each conversation."""
    count = max(1, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = ends.repartitionByRange(count, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    chunks = ordered.mapInArrow(_chunks, "k1 long, k2 long, first_id long, ids string")
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first_id").mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")


def trie(rows: DataFrame, ids: DataFrame, order: list[str], light: int = LIGHT, heavy: int = HEAVY) -> DataFrame:
    """All nodes of the conversations ``ids`` with turns ``rows`` (conv_id, digest, n_bytes and the columns of ``order``)."""
    every = written(prefixes(rows, order), "prefixes")
    last = every.groupBy("conv_id").agg(F.max_by(F.struct(*KEY), "depth").alias("end"), F.max("depth").alias("size"))
    zero: Column = F.lit(0).cast("long")
    ends = ids.join(last, "conv_id", "left").select("conv_id", F.coalesce("end.k1", zero).alias("k1"), F.coalesce("end.k2", zero).alias("k2"), F.coalesce("size", F.lit(0)).alias("size"))
    ends = written(ends, "ends")
    groups = written(ends.groupBy(*KEY).agg(F.min("conv_id").alias("path"), F.count(F.lit(1)).alias("members"), F.max("size").alias("size")), "groups")
    path = every.withColumnRenamed("conv_id", "path").join(groups.select("path", "members", "size"), "path")
    empty = groups.select("path", F.lit(0).alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("n_bytes"), "members", "size")
    paths = path.select(*empty.columns).unionByName(empty)
    paths = paths.select("path", "depth", *KEY, "n_bytes", F.when(F.col("depth") == F.col("size"), F.col("members")).otherwise(zero).alias("ends"), F.col("size").cast("long").alias("size"))
    nodes = peeled(paths, light, heavy).join(end_digests(ends.select(*KEY, "conv_id")), KEY, "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", *GATHERED, F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame, every: int = 5, most: int = 8, light: int = LIGHT, heavy: int = HEAVY) -> DataFrame:
    turns = written(turn_rows(conversations), "turns")
    rows, ids = rebuilt(turns, every, most)
    return trie(rows, ids, ["part", "place"], light, heavy)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
