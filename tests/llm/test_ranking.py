"""Top-k search and mixing against plain computations."""

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash

from siltmark.llm import mixing, topk
from tests.llm.fixtures import documents, empty, frame


def plain_top(rows, k=5):
    good = [(i, [math.floor(256 * np.float64(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, v in good:
        if q % 50 == 0 and q not in out:
            v = min(w for i, w in good if i == q)
            width = max(len(w) for _, w in good)
            pad = lambda w: w + [0] * (width - len(w))
            scored = sorted((-sum(a * b for a, b in zip(pad(v), pad(w))), i) for i, w in good if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(n)]
    common = rows[3][1]
    rows += [(n + i, common) for i in range(60)]  # ties
    rows += [(5000, None), (None, common), (5050, [float("nan")] * 8), (5100, [float("inf")] + [0.0] * 7), (5150, [None] * 8), (5200, common[:4]), (0, rows[0][1]), (7, rows[7][1]), (5250, [])]
    return rows


@pytest.mark.parametrize("shard,block,leaf", [(4096, 2048, 128), (60, 3, 8)])
def test_top_k(spark, shard, block, leaf):
    rows = vectors(300)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, shard int")
    got = {}
    for r in sorted(topk.top_k(df, shard_rows=shard, block_rows=block, leaf=leaf).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert got == plain_top(rows)


def test_top_k_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    few = topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], schema)).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 1, 512 * 256), (2, 2, 512 * 256)]


def test_top_k_of_large_components(spark):
    """Products beyond doubles, and beyond longs, where the score is the largest long."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(120)]
    rows += [(150, [1e12, -3.0, 0.5, 2.0]), (151, [1e12, 1.0, 1.0, 1.0]), (152, [-1e12, 7e9, 1.0, 0.25]), (153, [4.0e9, 1.0, 2.0, 3.0]), (154, [4.0e9 + 1, 1.0, 2.0, 3.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard in (4096, 40):
        got = {}
        for r in sorted(topk.top_k(docs, shard_rows=shard, block_rows=2, leaf=8).collect(), key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        want = {q: [(i, min(s, 2**63 - 1)) for i, s in top] for q, top in plain_top(rows).items()}
        assert got[0] == want[0] and got[50] == want[50] and got[100] == want[100]
        assert [s for _, s in got[150]] == [s for _, s in want[150]]
    huge = topk.top_k(spark.createDataFrame([(0, [1e30]), (1, [1e30]), (2, [-1e30])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in huge) == [(1, 1, 2**63 - 1), (2, 2, -(2**63))]


def test_ball_tree_prunes_clusters():
    """Of clustered points most pairs are never multiplied."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 400
    points = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 20)
    tree = topk.BallTree(np.arange(4000), points, 32)
    tree.search(np.full(50, -1), np.floor(centres[rng.integers(0, 40, 50)]), 5, np.full(50, -np.inf))
    assert tree.scored < 0.35 * tree.asked


def test_ball_tree_shares_floors():
    rng = np.random.default_rng(1)
    points = rng.integers(-500, 500, (700, 6)).astype(float)
    tree = topk.BallTree(np.arange(700), points, 16)
    queries = rng.integers(-500, 500, (20, 6)).astype(float)
    scores = queries @ points.T
    floors = np.sort(scores, axis=1)[:, -3]
    best, _ = tree.search(np.full(20, -1), queries, 5, floors)
    assert (np.isfinite(best).sum(axis=1) == (scores >= floors[:, None]).sum(axis=1).clip(max=5)).all()


def plain_targets(sizes, share=1.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values()) * share
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        level = rest / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if 3 * sizes[s] < level * weight[s]}
        if not more:
            return {s: 3.0 * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= more


def plain_mix(rows):
    """(doc_id, size, source size, target, taken) of every row."""
    sizes, docs = {}, {}
    for at, (i, text, source) in enumerate(rows):
        n = len((text or "").encode().split())
        h = xxhash.xxh64_intdigest((text or "").encode(), 42)
        name = f"0:null:{h:X}" if i is None else f"0:{i}"
        signed = h - (1 << 64) if h >> 63 else h
        docs.setdefault(source, []).append((hashlib.md5(name.encode()).hexdigest(), i is not None, i or 0, n, signed, at))
        sizes[source] = sizes.get(source, 0) + n
    targets = plain_targets(sizes)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    packets = []
    for rank, s in enumerate(names):
        served = 0
        for key, *rest, n, h, at in sorted(docs[s]):
            served += n
            if n and targets[s]:
                packets += [((c * sizes[s] + served) / targets[s], rank, key, *rest, n, h, at) for c in range(3)]
    sent, taken = 0, {}
    for *_, n, _, at in sorted(packets):
        if (sent := sent + n) > sum(sizes.values()):
            break
        taken[at] = taken.get(at, 0) + n
    return [(i, len((text or "").encode().split()), sizes[s], round(targets[s], 6), taken.get(at, 0)) for at, (i, text, s) in enumerate(rows)]


def repeated_documents():
    """Documents with repeated and null doc_ids, equal and other texts under one doc_id, and rows that repeat."""
    rows = documents()
    for i in range(40):
        rows.append((None, f"w {i % 7} " * (i % 9), "en", "s1", 5, "x", 1))
        rows.append((7, "v " * (i % 5 + 1), "en", "s2", 5, "x", 1))
        rows.append((8, "same words again", "en", "s3", 5, "x", 1))
    return rows


def _rounded(rows):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in rows), key=str)


def test_mix(spark):
    rows = repeated_documents()
    want = sorted(plain_mix([(r[0], r[1], r[3]) for r in rows]), key=str)
    assert all(r[4] <= 3 * r[1] for r in want)
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, frame(spark).schema).repartition(seed + 1)
        assert _rounded(mixing.mix(docs).collect()) == want


def test_many_sources(spark):
    """As many sources as documents, with ties in size."""
    rows = [(i, "w " * (i % 7), None if i == 0 else f"host{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert _rounded(mixing.mix(docs).collect()) == sorted(plain_mix(rows), key=str)


def test_small_sources_are_capped(spark):
    rows = [(i, "w " * 50, "big") for i in range(40)] + [(100 + i, "w " * 10, s) for i, s in enumerate(["a", "b", None, "empty"])]
    rows[-1] = (103, None, "empty")
    out = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[100].target == 30 and out[100].taken == 30 and out[103].target == 0 and out[103].taken == 0
    total = sum(r.size for r in out.values())
    assert sum(r.target for r in {r.source_size: r for r in out.values()}.values()) <= total and sum(r.taken for r in out.values()) <= total


def test_mixed_documents(spark):
    rows = repeated_documents()
    docs = spark.createDataFrame(rows, frame(spark).schema)
    want = {}
    for (i, *_, taken), r in zip(plain_mix([(r[0], r[1], r[3]) for r in rows]), rows):
        n = len((r[1] or "").encode().split())
        if taken:
            want[i, r[1], r[3]] = want.get((i, r[1], r[3]), 0) + taken // n
    out = mixing.mixed(docs)
    got = {}
    for r in out.collect():
        got[r.doc_id, r.text, r.source] = got.get((r.doc_id, r.text, r.source), 0) + 1
    assert got == want and out.columns == docs.columns
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0
    assert mixing.mix(frame(spark)).count() == len(documents())
