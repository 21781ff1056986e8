"""What the contracts say, written as plainly as can be, for tables that fit into one process."""

import bisect
import hashlib
import re
import struct
import zlib
from collections import defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        total = 0
        for k, c in enumerate(digits(s)[::-1]):
            d = int(c) * (1 + k % 2)
            total += d if d < 10 else d - 9
        return total % 10 == 0

    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(s)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    )
    return [(kind, m.start(), m.end()) for kind, pattern, fits in kinds for m in re.finditer(pattern, text or "") if fits(m[0])]


def substring_dedup(rows, window=50):
    """{doc_id: (n_words, n_removed, kept_sha256)}."""
    first = {}
    words = {i: SPACE.findall(t or "") for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def exact(rows):
    """Sorted (doc_id, keep_id, group_size, kept, text_sha256)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(ASCII_LOWER)].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, sha(text)) for i in ids]
    return sorted(out, key=repr)


def near(rows):
    """{doc_id: (n_shingles, component_id)} from every pair of documents that share a shingle."""
    sets = {}
    for i, t in rows:
        w = SPACE.findall((t or "").translate(ASCII_LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    done = set()
    for ids in holders.values():
        for p, a in enumerate(ids):
            for b in ids[:p]:
                if (a, b) in done:
                    continue
                done.add((a, b))
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def pieces(rows, tokenizer, length):
    """Sorted (doc_id, piece, start, length, ids_crc32)."""
    out = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), length)):
            part = ids[start : start + length]
            out.append((i, piece, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    return sorted(out)


def best_fit_decreasing(lengths, length):
    """How many sequences the pieces take, each put where it leaves the least space, longest first."""
    spaces, n = [], 0
    for piece in sorted(lengths, reverse=True):
        k = bisect.bisect_left(spaces, piece)
        if k == len(spaces):
            n += 1
            space = length - piece
        else:
            space = spaces.pop(k) - piece
        bisect.insort(spaces, space)
    return n


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target} from {source: size}: shares by weight, the excess of full sources given to the others until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= full
    return out
