"""Packing token sequences by patterns of lengths fitted with non-negative least squares.

Documents become tokens and, beyond the sequence length, pieces. Only the histogram of piece lengths, at most ``LENGTH``
counts, goes to the driver. There patterns of one to three lengths (in steps of ``STEP`` tokens) that fill a sequence are
enumerated, non-negative least squares fits how often each is used to the histogram, the counts are rounded down, and the
remaining pieces are packed best-fit into what space is left, longest first. Steps are coarser than lengths, so patterns
leave gaps; a share of the shortest pieces is left out of the fit to fill them, and of several shares that with the fewest
sequences is taken. The plan says for the k-th piece of a length
which sequence and offset it gets, so its size depends on the number of lengths, not of documents. Pieces are ranked within
their length by counting in salted groups, so no length has to fit into one task.

Defined results: a null or empty text is the single end token; rows that repeat a doc_id are packed as often as they
stand there; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.llm.common import portions, written

LENGTH, STEP, END = 2048, 32, 0
#: Shares of all tokens, in the shortest pieces, that a fit leaves out for filling.
RESERVES = (0.0, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where printable, else 256 and up in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class ChunkIds(dict):
    """Token ids, as little-endian bytes, of the parts of a text between ASCII white space; remembered up to a bound of their characters.

    The tokenizer's own pre-tokenizer ends every token at white space and its normaliser works within such parts, so a
    text's ids are those of its parts, one after the other. A final punctuation mark after a letter is a token of its own,
    and a part of plain lower-case letters is one word of the model; all other parts take the whole tokenizer.
    """

    #: Characters of the parts that are remembered, each counted with ``OWN`` more: some tens of MB.
    BOUND, OWN = 30_000_000, 100
    MARKS = ".,!?;:"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.ends = {c: self.encode(c) for c in self.MARKS}
        self.four = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.held = 0
        self[""] = b""

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def plain(part: str) -> bool:
        """Whether lower-casing and composing letters beyond ASCII does the same here as in the tokenizer."""
        lower = part.lower()
        return "\u03a3" not in part and lower.isalpha() and unicodedata.is_normalized("NFC", part) and unicodedata.is_normalized("NFC", lower)

    def __missing__(self, part: str) -> bytes:
        if part[-1] in self.ends and len(part) > 1 and unicodedata.normalize("NFC", part[-2]).lower().isalpha():
            ids = self[part[:-1]] + self.ends[part[-1]]
        elif part.isalpha() and (part.isascii() or self.plain(part)):
            lower = part.lower()
            if lower != part:
                ids = self[lower]
            else:
                shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
                ids = b"".join([self.four[t.id] for t in self.tokenizer.model.tokenize(shown)])
        else:
            ids = self.encode(part)
        self.held += len(part) + self.OWN
        if self.held > self.BOUND:
            self.forget()
        if len(part) < self.BOUND // 100:
            self[part] = ids
        return ids

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and where each text's begin (one more than there are texts)."""
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = parts.flatten().dictionary_encode()
        known = [self[p] for p in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts, at = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        ids, each = np.frombuffer(b"".join(known), "<u4"), sizes[at]
        ends = np.concatenate([[0], np.cumsum(each)])
        places = np.repeat((starts[at] - ends[:-1]).astype(np.int32), each)
        places += np.arange(len(places), dtype=np.int32)
        offsets = parts.offsets.to_numpy()
        return ids[places], ends[offsets - offsets[0]]


_chunks: dict[str, ChunkIds] = {}


def _pieces(tokenizer: str, length: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _chunks:
            _chunks[tokenizer] = ChunkIds(tokenizer)
        known = _chunks[tokenizer]
        end = np.array([END], "<u4").tobytes()
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            for a, b in portions(batch.column(1)):
                out: list[list] = [[], [], [], [], []]
                ids, begins = known.of(batch.column(1).slice(a, b - a))
                for k, doc in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                    tokens = ids[begins[k] : begins[k + 1]].tobytes() + end
                    n = len(tokens) // 4
                    for piece, start in enumerate(range(0, n, length)):
                        part = tokens[4 * start : 4 * (start + length)]
                        for column, value in zip(out, (doc, piece, start, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
        known.forget()  # the worker may serve other operators next

    return of


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, length), PIECES)


def patterns(length: int = LENGTH, step: int = STEP) -> list[tuple[int, ...]]:
    """All multisets of one to three steps that add up to a sequence."""
    n = length // step
    pairs = [(a, n - a) for a in range(n - 1, 0, -1) if a >= n - a]
    triples = [(a, b, n - a - b) for a in range(n - 2, 0, -1) for b in range(min(a, n - a - 1), 0, -1) if b >= n - a - b > 0]
    return [(n,), *pairs, *triples]


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """The x >= 0 nearest to a x = b, by an active set: columns enter by their gradient and leave when they turn negative."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(3 * a.shape[1]):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        enter = int(np.argmax(gradient))
        if gradient[enter] <= tolerance * max(1.0, float(np.abs(b).max(initial=0))):
            break
        active[enter] = True
        while True:
            z = np.zeros_like(x)
            z[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if z[active].min(initial=1) > 0:
                break
            falling = active & (z <= 0)
            ratio = (x[falling] / np.maximum(x[falling] - z[falling], 1e-300)).min()
            x = x + ratio * (z - x)
            active &= x > 1e-12
            x[~active] = 0
        x = z
    return x


def plan(histogram: dict[int, int], length: int = LENGTH, step: int = STEP) -> list[tuple[int, list[tuple[int, int]]]]:
    """Sequences that hold every piece: (how many sequences, [(length, pieces of it in each)]).

    Fitted once for every share of ``RESERVES``; the plan with the fewest sequences is taken, the first one that meets the bound by volume at once.
    """
    least = -(-sum(n * count for n, count in histogram.items()) // length)
    best: list[tuple[int, list[tuple[int, int]]]] | None = None
    for reserve in RESERVES:
        made = _plan(histogram, reserve, length, step)
        if best is None or sum(count for count, _ in made) < sum(count for count, _ in best):
            best = made
        if sum(count for count, _ in best) <= least:
            break
    return best or []


def _plan(histogram: dict[int, int], reserve: float, length: int, step: int) -> list[tuple[int, list[tuple[int, int]]]]:
    left = np.zeros(length + 1, np.int64)
    for n, count in histogram.items():
        left[n] = count
    groups: list[tuple[int, list[tuple[int, int]]]] = []
    if left[length]:
        groups.append((int(left[length]), [(length, 1)]))
        left[length] = 0
    # the shortest pieces, together the reserved share of all tokens, fill what space the patterns leave
    upto = np.cumsum(left * np.arange(length + 1))
    short = upto <= reserve * upto[-1]
    kept, left = np.where(short, left, 0), np.where(short, 0, left)
    bins = length // step
    supply = np.zeros(bins + 1)
    np.add.at(supply, -(-np.arange(length + 1) // step), left)
    shapes = patterns(length, step)
    a = np.zeros((bins, len(shapes)))
    for k, shape in enumerate(shapes):
        for s in shape:
            a[s - 1, k] += 1
    uses = np.floor(nonnegative_least_squares(a, supply[1:]) + 1e-9).astype(np.int64)
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def add(count: int, items: list[tuple[int, int]]) -> None:
        space = length - sum(n * m for n, m in items)
        (room.setdefault(space, []) if space else groups).append((count, items))

    for shape, use in zip(shapes, uses, strict=True):
        while use > 0:
            taken = left.copy()
            items: list[tuple[int, int]] = []
            count = int(use)
            space = length
            for k, s in enumerate(sorted(shape, reverse=True), 1):
                # the last place takes the longest piece that fits, so that the sequence is as full as it can be
                most = space if k == len(shape) else s * step
                n = next((n for n in range(most, (s - 1) * step, -1) if taken[n] > 0), 0)
                space -= n
                if not n:
                    break
                taken[n] -= 1
                items.append((n, 1))
            if len(items) < len(shape):
                break  # rounding of the fit has asked for more than there is; what is left goes to the residual
            merged: dict[int, int] = {}
            for n, _ in items:
                merged[n] = merged.get(n, 0) + 1
            count = min(count, *(int(left[n]) // m for n, m in merged.items()))
            for n, m in merged.items():
                left[n] -= m * count
            add(count, sorted(merged.items(), reverse=True))
            use -= count
    left += kept
    for n in range(length, 0, -1):
        while left[n]:
            fits = [space for space in room if space >= n]
            if fits:
                space = min(fits)
                count, items = room[space].pop()
                if not room[space]:
                    del room[space]
                each = min(space // n, int(left[n]))
                use = min(count, int(left[n]) // each)
                if use < count:
                    room.setdefault(space, []).append((count - use, items))
                left[n] -= use * each
                add(use, [*items, (n, each)])
            else:
                each = min(length // n, int(left[n]))
                use = int(left[n]) // each
                left[n] -= use * each
                add(use, [(n, each)])
    return groups + [g for kept in room.values() for g in kept]


def slots(groups: list[tuple[int, list[tuple[int, int]]]], length: int = LENGTH) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: the first rank of each run of places, its first sequence, the pieces in each sequence and their first offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks = np.zeros(length + 1, np.int64)
    sequence = 0
    for count, items in groups:
        offset = 0
        for n, each in items:
            rows.setdefault(n, []).append((int(ranks[n]), sequence, each, offset))
            ranks[n] += count * each
            offset += n * each
        sequence += count
    return {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in rows.items()}


def _places(places: dict[int, tuple[np.ndarray, ...]]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for one in np.unique(n):
                at = np.flatnonzero(n == one)
                first, start, each, begin = places[int(one)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                within = rank[at] - first[k]
                sequence[at], offset[at] = start[k] + within // each[k], begin[k] + within % each[k] * one
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=names)

    return of


def ranked(cut: DataFrame) -> DataFrame:
    """``cut`` with ``rank``, counting from 0 within each length; a length's rows are ranked in as many salted groups as there are shuffle partitions."""
    groups = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    starts = written(counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "starts")
    within = F.row_number().over(W.partitionBy("salt", "length").orderBy("doc_id", "piece")) - 1
    return salted.withColumn("within", within).join(starts.hint("merge"), ["length", "salt"]).withColumn("rank", (F.col("first") + F.col("within")).cast("long"))


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    cut = written(pieces(docs, tokenizer, length), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `length` rows
    places = slots(plan(histogram, length), length)
    return ranked(cut).mapInArrow(_places(places), PIECES + ", sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
