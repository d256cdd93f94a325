"""Brute-force versions and awkward inputs."""

import collections
import re

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, rows):
    """Rows of (doc_id, text[, lang[, source]]) as a documents table."""
    full = [(*r, *[None] * (4 - len(r)))[:4] for r in rows]
    return spark.createDataFrame([(i, t, lang, src, len(t) if t is not None else None) for i, t, lang, src in full], DOCUMENTS)


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    long = " ".join(f"wort{i % 977} and{i % 31}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, long, "en", "a"), (7, long, "en", None), (None, "no key here at all", "de", "b"), (9, "same row twice, words enough to matter", "fr", "c"), (9, "same row twice, words enough to matter", "fr", "c"), (10, "Ünïcödé ß 中文 🎉", None, "c"), (11, "12 34 !!", "en", "")]
    return documents(spark, rows)


def repeats(rows, width=50):
    """doc_id -> (n_bytes, n_removed, n_spans, kept): the law of repeated windows, window by window."""
    first, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            w = b[s : s + width]
            if first.setdefault(w, i) < i:
                gone[s : s + width] = b"\1" * width
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOW))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1)))


def components(n, links):
    parent = {i: i for i in n}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in n}


def jaccard(rows, width, num, den):
    """doc_id -> (n_shingles, component_id)."""
    sets = {i: shingles(t, width) for i, t in rows}
    holders = collections.defaultdict(list)
    links = []
    for i, s in sets.items():
        for j, k in collections.Counter(j for t in s for j in holders[t]).items():
            if den * k >= num * (len(s) + len(sets[j]) - k):
                links.append((i, j))
        for t in s:
            holders[t].append(i)
    c = components(sets, links)
    return {i: (len(sets[i]), c[i]) for i in sets}
