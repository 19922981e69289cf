"""Suffix-tree scores against a plain version of the same tree in dictionaries."""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltmark.llm import suffixtree
from tests.llm import fixtures

END = "<end>"


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lowered = lowered.replace(c, " ")
    return tuple([w for w in lowered.split(" ") if w] + [END])


def plain(rows, depth, min_count, threshold, weight, sure=1 << 20):
    """(tokens, known, base, score) of each (text, train), and the states with their distributions."""
    texts = [words(t) for t, _ in rows]
    learned = [w for w, (_, train) in zip(texts, rows) if train]
    grams = Counter(w[i - k : i + 1] for w in learned for i in range(len(w)) for k in range(min(depth, i) + 1))
    every = {w[i - k : i] for w in texts for i in range(len(w)) for k in range(1, min(depth, i) + 1)}
    n, v = sum(len(w) for w in learned), sum(len(g) == 1 for g in grams)
    follow = {}
    for g, c in grams.items():
        follow.setdefault(g[:-1], {})[g[-1]] = c
    examined, states = {()}, {()}

    def p(word, context):
        if not context:
            return (grams[(word,)] + 0.1) / (n + 0.1 * (v + 1))
        shorter = p(word, context[1:])
        return (grams[(*context, word)] + weight * shorter) / (grams[context] + weight)

    for k in range(1, depth + 1):
        for s in (s for s in every if len(s) == k):
            if s[1:] in states and s[:-1] in examined and grams[s] >= min_count:
                examined.add(s)
                gain = 0.0
                for word, c in follow.get(s, {}).items():
                    q = float(suffixtree._fine(suffixtree._coarse(np.array([p(word, s[1:])])))[0])
                    gain += c * math.log((c - 1 + weight * q) / ((grams[s] - 1 + weight) * q))
                if gain > threshold or grams[s] > sure:
                    states.add(s)
    out = []
    for w in texts:
        score = 0.0
        for i, word in enumerate(w):
            s = max((w[i - k : i] for k in range(min(depth, i) + 1) if w[i - k : i] in states), key=len)
            score += math.log10(p(word, s))
        out.append((len(w), sum(grams[(x,)] > 0 for x in w), sum(math.log10(p(x, ())) for x in w), score))
    return out, n, states, p, [g[0] for g in grams if len(g) == 1]


def texts_of(seed):
    """Texts with a second-order habit, so that longer contexts tell more."""
    rng = random.Random(seed)
    out = []
    for _ in range(60):
        w = ["a", "B"]
        for _ in range(rng.randint(0, 120)):
            w.append(rng.choice("abcdef") if rng.random() < 0.3 else {"a": "bc", "b": "ca", "c": "ab"}.get(w[-2].lower(), "de")[w[-1].lower() < "c"])
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block,part", [(1 << 20, 1 << 19), (100, 100)])
def test_against_plain_version(spark, monkeypatch, block, part):
    monkeypatch.setattr(suffixtree, "PART", part)
    rows = [(i, t) for i, t in enumerate([*texts_of(3), *(r[1] for r in fixtures.documents())])] + [(5, "repeated row"), (5, "repeated row"), (None, "no id")]
    train = [crc32(str(i).encode()) % 10 != 0 if i is not None else False for i, _ in rows]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, size string")
    kw = dict(depth=3, min_count=3, threshold=1.0, weight=5.0)
    got = suffixtree.score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0, block=block, **kw).collect()
    want, n, states, *_ = plain([(t, tr) for (_, t), tr in zip(rows, train)], **kw)
    assert any(len(s) == 3 for s in states) and any(len(s) == 1 for s in states)
    assert {r.train_tokens for r in got} == {n}

    def key(r):
        return (r[0] is None, r[0] or 0, *r[1:])

    mine = sorted(((r.doc_id, r.train, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), key=key)
    theirs = sorted(((i, tr, *w) for (i, _), tr, w in zip(rows, train, want)), key=key)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=1e-5)


def test_distributions_add_up():
    rows = [(t, True) for t in texts_of(4)]
    _, _, states, p, known = plain(rows, 3, 3, 1.0, 5.0)
    for s in states:
        assert sum(p(w, s) for w in known) + p("never seen", s) == pytest.approx(1.0)


def test_longer_contexts_and_sure_states(spark):
    texts = texts_of(5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = F.col("doc_id") >= 20
    kw = dict(min_count=3, threshold=1.0, weight=5.0)
    total = {d: suffixtree.score_texts(docs, train, depth=d, **kw).where("not train").agg(F.sum("score")).first()[0] for d in (0, 1, 3)}
    assert total[0] < total[1] < total[3]
    got = {r.doc_id: r.score for r in suffixtree.score_texts(docs, train, depth=2, sure=50, **kw).collect()}
    want = plain([(t, i >= 20) for i, t in enumerate(texts)], depth=2, sure=50, **kw)[0]
    assert got == pytest.approx({i: w[3] for i, w in enumerate(want)}, rel=1e-5)


def test_frequent_contexts_are_tested_too(spark, monkeypatch):
    """Contexts dealt in buckets get the verdicts that they get whole, those that fail included."""
    rng = random.Random(9)
    texts = [*texts_of(6), *(" ".join(rng.choice("ghijk") for _ in range(100)) for _ in range(30))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = F.col("doc_id") >= 20
    kw = dict(min_count=3, threshold=12.0, weight=5.0, depth=2)
    want, _, states, *_ = plain([(t, i >= 20) for i, t in enumerate(texts)], sure=1 << 40, **kw)
    assert ("a", "b") in states and not any((a, b) in states for a in "ghijk" for b in "ghijk")  # each is seen over 20 times
    monkeypatch.setattr(suffixtree, "PART", 100)
    got = {r.doc_id: r.score for r in suffixtree.score_texts(docs, train, frequent=20, block=500, **kw).collect()}
    assert got == pytest.approx({i: w[3] for i, w in enumerate(want)}, rel=1e-5)


def test_empty_and_nothing_to_learn(spark):
    assert suffixtree.score_texts(fixtures.empty(spark), F.lit(True)).count() == 0
    rows = suffixtree.score_texts(fixtures.frame(spark), F.lit(None).cast("boolean")).collect()
    assert len(rows) == len(fixtures.documents())
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in rows} == {(0, 0, 0.0, 0.0)}
