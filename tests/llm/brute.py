"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text: str | None) -> str:
    return (text or "").translate(UPPER)


def sha(value: str | bytes) -> str:
    return hashlib.sha256(value if isinstance(value, bytes) else value.encode()).hexdigest()


def contamination(docs, items, window=10):
    """[(doc_id, n_words, n_hit, items)] of (doc_id, text) and (item_id, text)."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = defaultdict(set)
    for item, text in items:
        ws = words(text)
        size = min(window, len(ws))
        for k in range(len(ws) - size + 1 if size else 0):
            windows[tuple(ws[k : k + size])].add(str(item))
    out = []
    for doc, text in docs:
        ws, hit, found = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(ws) - size + 1):
                if (w := tuple(ws[k : k + size])) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[w]
        out.append((doc, len(ws), len(hit), sorted(found)))
    return out


def shingle_sets(docs):
    out = []
    for _, text in docs:
        ws = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        out.append(frozenset(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))) if ws else frozenset())
    return out


def components(docs, threshold=80):
    """[(doc_id, n_shingles, component_id)]; rows are documents of their own, ids may repeat."""
    sets, parent = shingle_sets(docs), list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and docs[i][0] is not None and docs[j][0] is not None and 100 * len(a & b) >= threshold * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for k, (doc, _) in enumerate(docs):
        if doc is not None:
            least[root(k)] = min(doc, least.get(root(k), doc))
    return [(doc, len(sets[k]), None if doc is None else least[root(k)]) for k, (doc, _) in enumerate(docs)]


def line_dedup(docs, min_chars=20, min_docs=3):
    """[(doc_id, n_lines, n_dropped, text)]."""
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars and doc is not None:
                holders[key(line)].add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def repeats(docs, size=200):
    """[(doc_id, n_bytes, n_removed, n_spans, kept bytes)]."""
    counts = Counter()
    raws = [(doc, (text or "").encode()) for doc, text in docs]
    for _, raw in raws:
        counts.update(raw[k : k + size] for k in range(len(raw) - size + 1))
    out = []
    for doc, raw in raws:
        gone, reach = bytearray(len(raw)), 0
        for k in range(len(raw) - size + 1):
            if counts[raw[k : k + size]] > 1:
                for j in range(max(k, reach), k + size):
                    gone[j] = 1
                reach = k + size
        spans = sum(1 for j in range(len(raw)) if gone[j] and (not j or not gone[j - 1]))
        out.append((doc, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def successor_texts(docs):
    """The text of the next document of each row."""
    ids = sorted({d for d, _ in docs if d is not None})
    first = {d: min(t or "" for e, t in docs if e == d) for d in ids}
    return [None if d is None else first[ids[(ids.index(d) + 1) % len(ids)]] for d, _ in docs]


def edited(text, follow):
    cut = len(text) // 4
    return text[: len(text) - cut] + (follow or "")[:cut]
