"""Spelling variants against a plain search of near words, automata against sorted lists."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spendgrid.llm import spelling

from . import helpers as H

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows, slip=199, length=6):
    n = Counter()
    for i, t in rows:
        for w in RUN.findall((t or "").translate(H.LOW)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if slip and h % slip == 0 else w] += 1
    return {w: c for w, c in n.items() if len(w) >= length}


def near(a, b):
    """One inserted, deleted or replaced character apart, told by cutting what both begin and end with."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else (a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :])


def grouped(n, least=5, ratio=5):
    n = {w: c for w, c in n.items() if c >= least}
    close = {w: [y for y in n if near(w, y)] for w in n}
    form = {}
    for w in n:
        best = min(((-n[y], y) for y in close[w]), default=None)
        form[w] = best[1] if best and -best[0] >= ratio * n[w] else None
    out = {}
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        out[w] = (form[w], r, n[w], len(close[w]), n[form[w]] if form[w] else None)
    return out


def _groups(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def _counts(spark, n):
    return spark.createDataFrame(sorted(n.items()), "word string, n long")


def _lexicon(seed, size):
    """Words of few letters, some beyond ASCII, many of them near each other, with counts that make chains of forms."""
    r = random.Random(seed)
    words = {"".join(r.choice("abé") for _ in range(r.randint(6, 8))) for _ in range(size)} | {"abcdef", "bcdefg", "aaaaaa", "aaaaaaa", "aaaaaaaa", "÷×ÿÀÉa"}
    return {w: r.choice([3, 5, 6, 30, 31, 200, 1500, 10**6]) for w in words}


@pytest.mark.parametrize("shard", [1 << 15, 40])
def test_groups_against_all_pairs(spark, monkeypatch, shard):
    """With one shard, and with so many that words look up halves in several."""
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard)
    n = _lexicon(2, 500)
    assert _groups(spelling.spelling_groups(_counts(spark, n))) == grouped(n)


def test_other_limits(spark):
    n = _lexicon(3, 120)
    assert _groups(spelling.spelling_groups(_counts(spark, n), least=30, ratio=2)) == grouped(n, 30, 2)


def test_chains_of_forms_end_at_the_last(spark):
    n = {"x" * 6 + "abcdefghi"[: k]: 6**k for k in range(1, 10)}
    got = _groups(spelling.spelling_groups(_counts(spark, n)))
    assert got == grouped(n) and {r for _, r, *_ in got.values()} == {"xxxxxxabcdefghi"}


def test_counts_of_words_with_slips(spark):
    r = random.Random(4)
    stock = ["Straße", "ÉCOLE", "naïveté", "multiplication", "wordword", "x" * 70, "÷" * 40, "abcdef", "abcdefg", "short"]
    rows = [(i, " ".join(r.choice(stock) + r.choice(["", ",", "1", "ŵ", "中"]) for _ in range(40))) for i in range(300)]
    for slip in (199, 7, 0):
        got = {x.word: x.n for x in spelling.word_counts(H.documents(spark, rows), slip=slip).collect()}
        assert got == counted(rows, slip)


def test_joined_checksums():
    r = random.Random(5)
    names = [bytes(r.randrange(256) for _ in range(k)) for k in (0, 1, 2, 5, 63, 64, 65, 300)]
    prefix = [f"{i}:".encode() for i in (0, 1, -7, 10**15)]
    doc, word = zip(*[(d, w) for d in range(4) for w in range(8)], strict=True)
    import numpy as np

    got = spelling._checksums(prefix, np.array(doc), np.array(word), names)
    assert got.tolist() == [zlib.crc32(prefix[d] + names[w]) for d, w in zip(doc, word, strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abc", min_size=0, max_size=7), max_size=60), st.text("abc", min_size=2, max_size=7))
def test_automaton(held, asked):
    """Numbers are places in the sorted list, both ways; one error in the rest is found wherever it is; equal endings are one state."""
    order = sorted(held)
    a = spelling.Automaton(iter(order))
    assert [a.word(i) for i in range(len(order))] == order and [a.number(w) for w in order] == list(range(len(order)))
    assert a.number(asked) == (order.index(asked) if asked in held else None)
    for cut in range(len(asked) + 1):
        exact, rest = asked[:cut], asked[cut:]
        assert {a.word(i) for i in a.one_error(exact, rest)} == {w for w in held if w.startswith(exact) and near(w[cut:], rest)}
    endings = defaultdict(set)  # what may follow each beginning
    for w in order:
        for i in range(len(w) + 1):
            endings[w[:i]].add(w[i:])
    assert len(a.edges) == max(len({frozenset(e) for e in endings.values()}), 1)


def test_awkward_rows(spark):
    docs = H.awkward(spark).withColumn("word", spelling.F.lit("clash"))
    counts = spelling.word_counts(docs)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.word: r.n for r in counts.collect()} == counted(rows)
    assert _groups(spelling.spelling_groups(counts, least=1)) == grouped(counted(rows), 1)
    empty = spelling.word_counts(H.documents(spark, []))
    assert empty.count() == 0 and spelling.spelling_groups(empty).count() == 0
    odd = spark.createDataFrame([(None, 9), ("abcdef", 9), ("abcdeg", None)], "word string, n long")
    assert _groups(spelling.spelling_groups(odd)) == {"abcdef": (None, "abcdef", 9, 0, None)}
