"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the base spans of four kinds: email, ip, card and phone. The field then labels words: all that hold a digit,
``@`` or ``+`` (candidates) and the ``BEFORE`` words before and ``AFTER`` words after each, which introduce them; all other
words are observed as outside. It adds what the patterns miss, such as a number that is repeated without its prefix or two
numbers that stand side by side. Its factors are one per word (hashed features of shape, affixes and neighbours, of whole
words), one per pair of adjacent words, and two kinds of skip edges, each to the next such word of the document: words with
the same key (their last seven digits, or their letters and digits) and similar words (numbers written in the same form).
Marginals come from loopy belief propagation in the log domain, which runs until a document's messages are settled; where
its loops keep them moving, at most 8 rounds and two per node.

Training takes the whole texts of at most ``SAMPLE`` documents (those whose id's hash comes first), in that order and as long
as their nodes are at most ``NODES``, labelled by the base spans. Numbers and addresses outside the base spans are not called
clean: their labels are hidden. All factors are trained together: each step moves them by the difference of the marginals
given the observed labels and of those without, both from the same message passing (Adagrad, after a start of word factors
alone), with the own factors of a random half of the candidates left out, so that edges learn what they can tell. Word features
leave out the exact forms that the patterns test (no full match, no check digit).

An added span is a run of adjacent candidates of one kind, each with a marginal of ``SURE`` or more, that has what any value of its
kind has (a card its check digit); words that overlap a base span end a run and belong to none; numbers that are whole by
themselves are spans of their own; punctuation at the ends is left out.

Defined results: a null text counts as empty and has no spans; spans count code points, end exclusive; the counts are those
of base spans; rows that repeat are treated alike, and of training rows that repeat a doc_id the one whose text is first is
taken; rows without doc_id are searched but not trained on; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.common import first_rows

#: Patterns and limits of the contract.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The same, begun only where a run of digits begins (a later start fails, or ends, alike); and the parts of an address.
IP_RUN = re.compile("(?<![0-9])" + IP.pattern)
LOCAL, HOST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
KINDS = ("email", "ip", "card", "phone")
CARD_DIGITS, PHONE_DIGITS = (16, 19), (8, 15)

SAMPLE, BUCKETS, FEATURES, LABELS = 3000, 1 << 15, 12, 1 + len(KINDS)
EPOCHS, BATCH, RATE, SEED = 25, 256, 0.5, 11
#: Steps of the joint training, each over one part of the texts, its rate and pull towards zero, nodes of a batch and of all.
JOINT, JOINT_RATE, RIDGE, PART, NODES = 300, 0.4, 5e-3, 500, 60_000
#: Share of candidates whose own factors a step of the joint training leaves out, so that edges have to tell their labels.
DROPPED = 0.5
#: What skip edges start from, and are pulled towards: that words of one key, or of one form, agree.
AGREE = 3.0
BEFORE, AFTER, EVIDENCE = 2, 1, 30.0
#: Digits that an added card or phone has at least: also the older and the local forms, that the patterns leave out.
LEAST_CARD, LEAST_PHONE = 13, 7
#: Written forms of numbers that count as similar have this many digits at least; and what numbers are written with.
FORM_DIGITS, NUMBER = 7, re.compile(r"[+(]*[0-9][0-9().\-/]*")
ROUNDS, DAMPING, SURE, REACH = 8, 0.3, 0.65, 6.0
EDGES_OF = ("chain", "skip", "alike")
SETTLED = 1e-3
WORD, CANDIDATE = re.compile(r"\S+"), re.compile(r"[0-9@+]")
DIGITS, REST = re.compile(r"[^0-9]"), re.compile(r"[\W_]+")
EDGE = "\"'()[]{}<>,;:!?*|.`"

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """What ``EMAIL.finditer`` finds, in time linear in the text: from each mark back over the local part, and on over the host."""
    out, done, mark = [], 0, text.find("@")
    while mark >= 0:
        start = mark
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        host = HOST.match(text, mark + 1) if start < mark else None
        if host:
            out.append((start, host.end()))
            done = host.end()
        mark = text.find("@", max(mark + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of every pattern's leftmost non-overlapping matches that pass its test, by kind, then start."""
    out: list[Span] = [(0, *span) for span in emails(text)]
    out += [(1, *m.span()) for m in IP_RUN.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= CARD_DIGITS[0]:
            digits = DIGITS.sub("", m[0])
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if PHONE_DIGITS[0] <= len(DIGITS.sub("", m[0])) <= PHONE_DIGITS[1]]
    return out


def tokens(text: str) -> list[tuple[int, int, int, bool]]:
    """(place, start, end, candidate) of the candidates among a text's words and of the words about them."""
    if not CANDIDATE.search(text):
        return []
    words = [m.span() for m in WORD.finditer(text)]
    asked = [k for k, (start, end) in enumerate(words) if CANDIDATE.search(text, start, end)]
    near = sorted({k + d for k in asked for d in range(-BEFORE, AFTER + 1) if 0 <= k + d < len(words)})
    chosen = set(asked)
    return [(k, *words[k], k in chosen) for k in near]


def shape(word: str) -> str:
    """Classes of characters, runs of a class as one."""
    out = []
    for c in word:
        k = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def features(word: str, before: str, after: str) -> list[int]:
    asked, word = bool(CANDIDATE.search(word)), word.strip(EDGE)
    digits = DIGITS.sub("", word)
    names = [
        f"bias:{asked}", "s:" + shape(word), "p:" + word[:3].lower(), "e:" + word[-4:].lower(), f"d:{min(len(digits), 20)}", f"l:{min(len(word), 24)}",
        f"at:{'@' in word}:{'.' in word[word.find('@') :] if '@' in word else ''}", f"dots:{min(word.count('.'), 5)}", f"plus:{word[:1] == '+'}",
        "b:" + (shape(before) or "^"), "bw:" + (before.lower() or "^"), "a:" + (shape(after) or "$"),
    ]
    return [xxhash.xxh32_intdigest(n.encode("utf-8", "replace")) % BUCKETS for n in names]


def key(word: str) -> str:
    """What similar tokens share: the last seven digits of numbers, else all letters and digits; empty where too short."""
    digits = DIGITS.sub("", word)
    if len(digits) >= 7:
        return digits[-7:]
    bare = REST.sub("", word.lower())
    return bare if len(bare) >= 5 else ""


def form(word: str) -> str:
    """How a number is written: its digits as one letter each; empty for what is no number, or a short one."""
    bare = word.strip(EDGE)
    return re.sub("[0-9]", "9", bare) if len(DIGITS.sub("", bare)) >= FORM_DIGITS and NUMBER.fullmatch(bare) else ""


class Field:
    """Words of some texts as a graph: features, chain edges and skip edges. ``candidate`` tells those that may be added, ``open`` those whose label outside base spans is hidden in training."""

    def __init__(self, texts: list[str]):
        self.text, self.spans, rows, candidate, hidden = [], [], [], [], []
        edges: dict[str, list[tuple[int, int]]] = {name: [] for name in EDGES_OF}
        for t, text in enumerate(texts):
            last: dict[str, dict[str, int]] = {"skip": {}, "alike": {}}
            found = tokens(text)
            for i, (place, start, end, asked) in enumerate(found):
                node, word = len(self.spans), text[start:end]
                touching = i > 0 and found[i - 1][0] == place - 1
                if touching:
                    edges["chain"].append((node - 1, node))
                for name, k in (("skip", key(word)), ("alike", form(word))) if asked else ():
                    if k:
                        if k in last[name] and (name == "skip" or (last[name][k], node) not in edges["skip"][-1:]):
                            edges[name].append((last[name][k], node))
                        last[name][k] = node
                before = text[found[i - 1][1] : found[i - 1][2]] if touching else ""
                after = WORD.search(text, end)
                rows.append(features(word, before, after[0] if after else ""))
                self.text.append(t)
                self.spans.append((start, end))
                candidate.append(asked)
                hidden.append(asked and bool(form(word) or "@" in word.strip(EDGE)[1:]))
        self.rows = np.array(rows, np.int64).reshape(-1, FEATURES)
        self.candidate, self.open = np.array(candidate, bool), np.array(hidden, bool)
        self.edges = {name: np.array(e, np.int64).reshape(-1, 2) for name, e in edges.items()}

    @property
    def chain(self) -> np.ndarray:
        return self.edges["chain"]

    @property
    def skip(self) -> np.ndarray:
        return self.edges["skip"]

    def labels(self, base: list[list[Span]]) -> np.ndarray:
        """0 or 1 + the kind of a base span that overlaps the word; of several kinds the first. Spans of one kind do not overlap, so both lists are in order."""
        out = np.zeros(len(self.spans), np.int64)
        starts, ends = np.array(self.spans, np.int64).reshape(-1, 2).T
        bounds = np.searchsorted(np.array(self.text, np.int64), np.arange(len(base) + 1))
        for t, spans in enumerate(base):
            words = slice(bounds[t], bounds[t + 1])
            for kind in range(len(KINDS) - 1, -1, -1):
                own = np.array(sorted((s, e) for k, s, e in spans if k == kind), np.int64).reshape(-1, 2)
                if len(own):
                    at = np.searchsorted(own[:, 1], starts[words], side="right")  # the first span that ends after the word begins
                    hit = (at < len(own)) & (own[np.minimum(at, len(own) - 1), 0] < ends[words])
                    out[words][hit] = 1 + kind
        return out


class Taken:
    """Whether a stretch of a text overlaps one of its spans."""

    def __init__(self, spans: list[Span]):
        self.starts = sorted(s for _, s, _ in spans)
        self.reach = list(itertools.accumulate((e for _, _, e in sorted(spans, key=lambda x: x[1])), max))

    def overlaps(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts, end)
        return k > 0 and self.reach[k - 1] > start


class Model:
    def __init__(self):
        self.weights = np.zeros((BUCKETS, LABELS), np.float32)
        self.pair = {name: np.zeros((LABELS, LABELS)) for name in EDGES_OF}

    def unary(self, rows: np.ndarray) -> np.ndarray:
        return self.weights[rows].sum(1).astype(np.float64) if len(rows) else np.zeros((0, LABELS))

    def marginals(self, field: Field, known: np.ndarray | None = None) -> np.ndarray:
        """Marginals of every node. Labels in ``known`` above 0 are evidence."""
        unary = self.unary(field.rows)
        if known is not None:
            at = np.flatnonzero(known)
            unary[at, known[at]] += 4 * REACH
        return self.inferred(field, unary)[0]

    def inferred(self, field: Field, unary: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Loopy belief propagation: messages both ways along every edge, damped, each text until none of its messages moves by more than ``SETTLED``. Marginals of nodes and, by kind, of edges."""
        edges = np.concatenate([field.edges[k] for k in EDGES_OF])
        kinds = np.concatenate([np.full(len(field.edges[k]), j) for j, k in enumerate(EDGES_OF)]).astype(np.int64)
        factor = np.stack([self.pair[k] for k in EDGES_OF])[kinds]
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        factor = np.concatenate([factor, factor.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        messages = np.zeros((len(source), LABELS))
        belief = unary.copy()
        text = np.array(field.text, np.int64)
        most, of = ROUNDS + 2 * np.bincount(text), text[source]  # rounds of a text, twice the longest path in it; the text of an edge
        live, done = np.arange(len(source)), 0
        while len(live):
            to, held = target[live], messages[live]
            rest = (belief[source[live]] - messages[back[live]])[:, :, None] + factor[live]
            top = rest.max(1)
            sent = top + np.log(np.exp(rest - top[:, None]).sum(1))
            sent -= sent.max(1, keepdims=True)
            messages[live] = DAMPING * held + (1 - DAMPING) * sent
            belief[to] = unary[to]
            np.add.at(belief, to, messages[live])
            moved, done = np.zeros(len(most)), done + 1
            np.maximum.at(moved, of[live], np.abs(messages[live] - held).max(1))
            live = live[((moved > SETTLED) & (done < most))[of[live]]]
        both = (belief[edges[:, 0]] - messages[back[: len(edges)]])[:, :, None] + factor[: len(edges)] + (belief[edges[:, 1]] - messages[: len(edges)])[:, None, :]
        joint = np.exp(both - both.max((1, 2), keepdims=True)) if len(both) else both
        joint = joint / joint.sum((1, 2), keepdims=True) if len(both) else joint
        top = np.exp(belief - belief.max(1, keepdims=True)) if len(belief) else belief
        return (top / top.sum(1, keepdims=True) if len(top) else top), {k: joint[kinds == j] for j, k in enumerate(EDGES_OF)}


def _parts(texts: list[str]) -> list[tuple[Field, np.ndarray, np.ndarray]]:
    """The texts, in their order, as fields of about ``PART`` nodes and at most ``NODES`` in all (a text that would pass that is left out): each with labels and whether they are observed."""
    out, group, held, total = [], [], 0, 0
    for k, text in enumerate(texts):
        n = len(tokens(text))
        n = n if total + n <= NODES or not total else 0
        total, held = total + n, held + n
        if n:
            group.append(text)
        if group and (held >= PART or k + 1 == len(texts)):
            out.append(group)
            group, held = [], 0
    out += [group] if group else []
    fields = [(Field(g), [base_spans(t) for t in g]) for g in out]
    truths = [(f, f.labels(b)) for f, b in fields]
    return [(f, truth, (truth > 0) | ~f.open) for f, truth in truths]


def train(texts: list[str]) -> Model:
    model, rng = Model(), np.random.default_rng(SEED)
    parts = _parts(texts)
    if not parts:
        return model
    rows = np.concatenate([f.rows[seen] for f, _, seen in parts])
    truth = np.concatenate([t[seen] for _, t, seen in parts])
    grown = np.full((BUCKETS, LABELS), 1e-2, np.float32)
    for epoch in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(truth)), max(1, len(truth) // BATCH)):
            z = model.unary(rows[part])
            p = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
            p = p / p.sum(1, keepdims=True) if len(p) else p
            p[np.arange(len(part)), truth[part]] -= 1
            _step(model.weights, grown, rows[part], p / max(1, len(part)), RATE / (1 + epoch))
    prior = {name: AGREE * np.eye(LABELS) * (name != "chain") for name in EDGES_OF}
    model.pair = {name: at.copy() for name, at in prior.items()}
    pair_grown = {name: np.full((LABELS, LABELS), 1e-2) for name in EDGES_OF}
    grown[:] = 1e-2
    done = 0
    for step in range(JOINT):
        field, labels, seen = parts[step % len(parts)]
        if done > JOINT * PART:
            break  # parts of very long texts count as the steps that they are worth
        done += len(seen)
        unary = model.unary(field.rows)
        dropped = field.candidate & (rng.random(len(seen)) < DROPPED)
        unary[dropped] = 0
        clamped = unary.copy()
        at = np.flatnonzero(seen)
        clamped[at, labels[at]] += EVIDENCE
        (free, free_edges), (held, held_edges) = model.inferred(field, unary), model.inferred(field, clamped)
        rate = JOINT_RATE / np.sqrt(1 + step / 50)
        for name, grown_pair in pair_grown.items():
            n = max(1, len(field.edges[name]))
            g = (free_edges[name] - held_edges[name]).sum(0) / n + RIDGE * (model.pair[name] - prior[name])
            g = (g + g.T) / 2 if name != "chain" else g
            grown_pair += g**2
            model.pair[name] = np.clip(model.pair[name] - rate * g / np.sqrt(grown_pair), -REACH, REACH)
        _step(model.weights, grown, field.rows, np.where(dropped[:, None], 0, free - held) / max(1, len(free)), rate)
    return model


def _step(weights: np.ndarray, grown: np.ndarray, rows: np.ndarray, off: np.ndarray, rate: float) -> None:
    """One Adagrad step of the word factors, of the buckets that the rows hold."""
    held, at = np.unique(rows, return_inverse=True)
    g = np.zeros((len(held), LABELS), np.float32)
    np.add.at(g, at.reshape(rows.shape), off.astype(np.float32)[:, None])
    grown[held] += g**2
    weights[held] -= np.float32(rate) * g / np.sqrt(grown[held])


def added_spans(texts: list[str], base: list[list[Span]], model: Model) -> list[list[Span]]:
    field = Field(texts)
    out: list[list[Span]] = [[] for _ in texts]
    if not field.spans:
        return out
    known = field.labels(base)
    p = model.marginals(field, known)
    best = p.argmax(1)
    best[(p.max(1) < SURE) | (known > 0) | ~field.candidate] = 0  # a word of a base span ends a run, so that its neighbours are still added
    adjacent = np.zeros(len(best), bool)
    adjacent[field.chain[:, 1]] = True
    taken = [Taken(b) for b in base]
    i = 0
    while i < len(best):
        j = i + 1
        if best[i]:
            # numbers that are whole by themselves stay apart; parts of one are joined
            while j < len(best) and adjacent[j] and best[j] == best[i] and not (_whole(texts, field, j - 1) and _whole(texts, field, j)):
                j += 1
            text, start, end = texts[field.text[i]], field.spans[i][0], field.spans[j - 1][1]
            while start < end and text[start] in EDGE:
                start += 1
            while end > start and text[end - 1] in EDGE:
                end -= 1
            if start < end and _may_be(int(best[i]) - 1, text[start:end]) and not taken[field.text[i]].overlaps(start, end):
                out[field.text[i]].append((int(best[i]) - 1, start, end))
        i = j
    return out


def _may_be(kind: int, found: str) -> bool:
    """What every value of a kind has however it is written: a card its digits and check digit, a phone its digits, an address its mark."""
    digits = DIGITS.sub("", found)
    if KINDS[kind] == "card":
        return LEAST_CARD <= len(digits) <= CARD_DIGITS[1] and luhn(digits)
    return {"email": "@" in found, "ip": len(re.findall("[0-9]+", found)) >= 4, "phone": LEAST_PHONE <= len(digits) <= PHONE_DIGITS[1]}[KINDS[kind]]


def _whole(texts: list[str], field: Field, node: int) -> bool:
    start, end = field.spans[node]
    word = texts[field.text[node]][start:end]
    return "@" in word or len(DIGITS.sub("", word)) >= PHONE_DIGITS[0]


def recovered(texts: list[str], model: Model) -> tuple[int, int, int]:
    """Every second base span (by a hash of its text's place and its own) withheld as if the patterns had missed it: how many there were, how many came back
    as added spans of their kind that overlap, and how many added spans overlap no base span at all."""
    withheld = back = other = 0
    for t, text in enumerate(texts):
        base = base_spans(text)
        gone = [s for s in base if xxhash.xxh32_intdigest(f"{t}:{s}") % 2]
        kept = [s for s in base if s not in gone]
        added = added_spans([text], [kept], model)[0]
        withheld += len(gone)
        back += sum(any(k == kind and s < e2 and s2 < e for k, s2, e2 in added) for kind, s, e in gone)
        other += sum(not any(s < e2 and s2 < e for _, s2, e2 in base) for _, s, e in added)
    return withheld, back, other


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def _find(shared):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, base, model)
                counts = [pa.array([sum(s[0] == kind for s in b) for b in base], pa.int64()) for kind in range(len(KINDS))]
                digest = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
                every = [joined(b + m) for b, m in zip(base, more, strict=True)]
                names = ["doc_id", *(f"n_{n}" for n in KINDS), "base_sha256", "spans", "n_added"]
                arrays = [part.column(0), *counts, pa.array(digest), pa.array(every), pa.array([len(m) for m in more], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return of


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if len(b)]
    if held:
        table = pa.Table.from_batches(held).sort_by([("place", "ascending"), ("doc_id", "ascending")])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(table.column("text").to_pylist()))], pa.binary())], names=["model"])


def fitted(docs: DataFrame) -> Model:
    """The model of at most ``SAMPLE`` documents, those first by a hash of doc_id and in its order, trained in one task: no text comes to the driver."""
    rows = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).distinct()
    chosen = first_rows(rows.join(F.broadcast(ids), "doc_id"), ["doc_id"]).withColumn("place", F.xxhash64("doc_id"))  # at most SAMPLE rows
    models = chosen.repartition(1).mapInArrow(_fit, "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else train([])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, their digest, all spans, and how many the field added."""
    model = fitted(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select("doc_id", "text").mapInArrow(_find(shared), kinds)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
