"""Near duplicates, components, line dedup and shared passages against plain computations."""

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from siltmark.llm import components, linededup, neardup, substr
from tests.llm.fixtures import documents, empty, frame


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    pieces = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(p, seed=42).intdigest() for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(items, linked):
    """Least member by item, by plain search."""
    out = {}
    for x in items:
        if x in out:
            continue
        seen, todo = {x}, [x]
        while todo:
            y = todo.pop()
            for z in items:
                if z not in seen and linked(y, z):
                    seen.add(z)
                    todo.append(z)
        for y in seen:
            out[y] = min(seen)
    return out


def test_near_duplicates(spark):
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in neardup.near_duplicates(frame(spark)).collect()}
    prints = {r[0]: plain_fingerprint(r[1]) for r in documents()}
    groups = groups_of(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert got == {d: (prints[d], groups[d]) for d in prints}
    assert neardup.near_duplicates(frame(spark)).count() == len(documents())
    assert neardup.near_duplicates(empty(spark)).count() == 0


def near_fingerprints(n: int) -> list[int]:
    """Clusters with chains of near fingerprints, unsigned."""
    rng = np.random.default_rng(n)
    fps = {int(c) for c in rng.integers(0, 2**63, 6)}
    while len(fps) < n:
        base = int(rng.choice(np.array(sorted(fps), np.uint64)))
        for b in rng.integers(0, 64, rng.integers(1, 6)):
            base ^= 1 << int(b)
        fps.add(base)
    return sorted(fps)


def near(a: int, b: int) -> bool:
    return (a ^ b).bit_count() <= 4


@pytest.mark.parametrize("n", [30, 400])
def test_search_of_a_long_list(n):
    fps = near_fingerprints(n)
    a, b = neardup.search_run(np.array(fps, np.uint64), 4)
    found = {(int(x), int(y)) for p, q in zip(a, b) for x, y in zip(p, q)}
    assert len(found) < n and all(near(x, y) for x, y in found)
    assert groups_of(fps, lambda x, y: (x, y) in found or (y, x) in found) == groups_of(fps, near)


@pytest.mark.parametrize("n,long_run", [(30, 4096), (400, 4096), (400, 1), (400, 30)])
def test_index_finds_all_links(spark, n, long_run):
    signed = {int(np.uint64(f).astype(np.int64)): f for f in near_fingerprints(n)}
    links = neardup.links(spark.createDataFrame([(f,) for f in signed], "fp long"), long_run=long_run)
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    want = groups_of(sorted(signed), lambda a, b: near(signed[a], signed[b]))
    assert {f: got.get(f, f) for f in signed} == want


def test_long_lists_are_split(spark):
    """Fingerprints that share four bytes and hardly any links, with a few near pairs, in small batches."""
    rng = np.random.default_rng(11)
    fps = {0x1234ABCD00000000 + int(x) for x in rng.integers(0, 2**32, 3000)}
    for f in sorted(fps)[::100]:
        fps.add(f ^ sum(1 << int(b) for b in rng.choice(32, 4, replace=False)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        found = neardup.links(spark.createDataFrame([(f,) for f in sorted(fps)], "fp long"), long_run=500)
        got = {r.node: r.component for r in components.connected_components(found).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    array = np.array(sorted(fps), np.uint64)
    near_ones = np.bitwise_count(array[:, None] ^ array[None, :]) <= 4
    pairs = [(int(array[i]), int(array[j])) for i, j in np.argwhere(np.triu(near_ones, 1))]
    assert len(pairs) >= 30 and all(got[a] == got[b] for a, b in pairs)
    assert set(got) == {x for p in pairs for x in p}


def test_deduplicated_keeps_one_of_each(spark):
    docs = frame(spark)
    kept = neardup.deduplicated(docs)
    groups = {r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(groups)


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(int(a), int(b)) for a, b in rng.integers(100, 160, (25, 2))] + [(500, x) for x in range(501, 560)] + [(7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    pairs = set(edges) | {(b, a) for a, b in edges}
    assert got == groups_of(nodes, lambda a, b: (a, b) in pairs)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup(spark):
    rows = documents()
    for i in range(30):
        rows.append((1000 + i, f"line {i}\n  Read more here\t\n\nend {i % 3}", "en", f"site{i % 7}", 9, "x", 1))
    rows += [(2000 + i, "Read more here\nthree sites", "en", f"q{i}", 9, "x", 1) for i in range(3)] + [(3000, "Read more here", None, None, 1, "x", 1)]
    docs = spark.createDataFrame(rows, frame(spark).schema)
    sites = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if line.strip(" \t\r"):
                sites.setdefault(line.strip(" \t\r"), set()).add(r[3])
    bad = {k for k, v in sites.items() if len(v) >= 5}
    assert "Read more here" in bad and "three sites" not in bad
    out = linededup.without_boilerplate(docs)
    got = sorted(((r.doc_id, r.text, r["_sm_removed"], r.size) for r in out.collect()), key=str)
    want = []
    for r in rows:
        lines = None if r[1] is None else r[1].split("\n")
        keep = lines and [x for x in lines if x.strip(" \t\r") not in bad]
        text = r[1] if lines is None or len(keep) == len(lines) else "\n".join(keep)
        want.append((r[0], text, 0 if lines is None else len(lines) - len(keep), r[5]))
    assert got == sorted(want, key=str)
    assert linededup.cleaned(docs).columns == docs.columns and linededup.cleaned(empty(spark)).count() == 0


def test_lines_of_long_texts_and_repeated_ids(spark):
    """Long blank runs, many lines of which many go, and texts that share a doc_id."""
    common = [f"common {i}" for i in range(3000)]
    rows = [(i, "\n".join(common + [f"own {i}"]), None, f"s{i}", 1, "x", 1) for i in range(6)]
    rows += [(50, "a" + " " * 200_000 + "b\ncommon 1", None, "s1", 1, "x", 1), (50, "common 2\nkept", None, "s1", 1, "x", 1), (None, "common 3\nnull id", None, "s1", 1, "x", 1)]
    docs = spark.createDataFrame(rows, frame(spark).schema)
    out = {(r.doc_id, r.text): (r["_sm_lines"], r["_sm_removed"]) for r in linededup.without_boilerplate(docs).collect()}
    assert out == {(i, f"own {i}"): (3001, 3000) for i in range(6)} | {(50, rows[6][1].split("\n")[0]): (2, 1), (50, "kept"): (2, 1), (None, "null id"): (2, 1)}


def test_shared_passages(spark):
    rows = documents()
    found = substr.shared_passages(frame(spark)).collect()
    words = {r[0]: substr.words_of(r[1]) for r in rows}
    cover = {}
    for r in found:
        assert r.ref_doc_id < r.doc_id and r.n_words == r.end - r.start >= 50 and r.similarity >= 0.8
        n = substr.common(words[r.doc_id][r.start : r.end], words[r.ref_doc_id][r.ref_start : r.ref_end])
        assert n >= 0.8 * max(r.n_words, r.ref_end - r.ref_start)
        cover.setdefault(r.doc_id, []).append((r.start, r.end))
    first = {}
    for d in sorted(words):
        for p in range(len(words[d]) - 49):
            if first.setdefault(tuple(words[d][p : p + 50]), d) != d:
                assert any(s <= p and p + 50 <= e for s, e in cover.get(d, [])), d
    assert {40, 41, 42, 43, 44} <= set(cover) and not {10, 11, 12, 30} & set(cover)
    assert substr.shared_passages(empty(spark)).count() == 0
    assert substr.shared_passages(spark.createDataFrame([(None, "a " * 80), (1, "b " * 80)], "doc_id long, text string")).count() == 0


def test_texts_that_share_a_doc_id(spark, monkeypatch):
    """No link is lost where a doc_id is repeated with other texts; a hot text goes to several tasks."""
    rng = np.random.default_rng(9)
    a, b, c = (" ".join(f"v{x}" for x in rng.integers(0, 10**6, 120)) for _ in range(3))
    rows = [(1, a), (1, b), (2, b), (3, a), (1, a), (4, a + " " + b), (5, c), (5, c + " " + a), (3, a)]
    monkeypatch.setattr(substr, "TASK_CHAINS", 1)
    monkeypatch.setattr(substr, "HELD_WORDS", 16)
    found = substr.shared_passages(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, words string, place int")).collect()
    got = sorted((r.doc_id, r.ref_doc_id, r.start, r.end, r.ref_start, r.ref_end) for r in found)
    assert got == [(2, 1, 0, 120, 0, 120), (3, 1, 0, 120, 0, 120), (4, 1, 0, 120, 0, 120), (4, 1, 120, 240, 0, 120), (5, 1, 120, 240, 0, 120)]


def test_passages_are_cut(spark):
    out = {r.doc_id: r.text for r in substr.without_passages(frame(spark).where("doc_id <> 3")).collect()}
    texts = {r[0]: r[1] for r in documents()}
    empty_id = next(d for d, t in texts.items() if t is None)
    assert out[0] == texts[0] and out[empty_id] is None and len(texts) == len(out) + 1
    assert len(out[45]) < 0.2 * len(texts[45]) and len(out[40]) < len(texts[40])
    assert substr._cut("a b\nc  d", [{"start": 1, "end": 3}]) == "a d"


def test_chains_by_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 9))
        b, a = rng.integers(0, 60, n), rng.integers(0, 60, n)
        best = -1.0
        for pick in range(1, 1 << n):
            at = sorted((int(b[i]), int(a[i])) for i in range(n) if pick >> i & 1)
            if all(p[0] < q[0] and p[1] < q[1] for p, q in zip(at, at[1:])):
                best = max(best, 5 * len(at) - 0.05 * (at[-1][0] - at[0][0] + at[-1][1] - at[0][1]))
        chain = substr.chains(b, a)[0]
        score = 5 * len(chain) - 0.05 * (b[chain[-1]] - b[chain[0]] + a[chain[-1]] - a[chain[0]])
        assert score == pytest.approx(best)


def test_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = ([bytes([c]) for c in rng.integers(97, 101, rng.integers(0, 12))] for _ in range(2))
        table = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                table[i + 1, j + 1] = table[i, j] + 1 if p == q else max(table[i, j + 1], table[i + 1, j])
        assert substr.common(x, y) == table[-1, -1]


def test_line_keys_need_no_python(spark):
    plan = linededup.without_boilerplate(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert frame(spark).select(linededup.line_key(F.lit("  \t")).alias("k")).first().k is None


def test_fuzzy_passages_are_found(spark):
    """Passages of 50 to 100 words with words replaced, at a similarity of 0.9 and more, between other words."""
    rng = np.random.default_rng(5)

    def some(n):
        return [f"w{x}" for x in rng.integers(0, 50_000, n)]

    rows, pairs = [], 100
    for i in range(pairs):
        passage = some(int(rng.integers(50, 101)))
        copy = list(passage)
        for at in rng.choice(np.arange(1, len(copy) - 1), len(copy) // 10, replace=False):
            copy[at] = f"new{i}x{at}"
        rows += [(i, " ".join(some(40) + passage + some(40))), (1000 + i, " ".join(some(60) + copy + some(60)))]
    found = substr.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.ref_doc_id + 1000 == r.doc_id and r.similarity >= 0.8 for r in found)
    assert len({r.doc_id for r in found}) >= 0.97 * pairs
    changed = some(60)
    other = list(changed)
    other[3] = other[-3] = "edited"
    assert max(r[1] - r[0] for r in substr.align(changed, other, [20], [20])) == 60




def test_a_passage_whose_parts_have_earlier_holders(spark):
    """Three documents hold overlapping thirds of a passage, each too short; of the two that hold it whole the later one repeats the earlier."""
    rng = np.random.default_rng(8)
    rows, n = [], 0
    for case in range(20):
        word = iter(f"w{case}x{x}" for x in rng.permutation(100_000))
        passage = [next(word) for _ in range(125)]
        for a, z in ((0, 45), (40, 85), (80, 125), (0, 125), (0, 125)):
            own = [next(word) for _ in range(60)]
            rows.append((n, " ".join(own[:30] + passage[a:z] + own[30:])))
            n += 1
    found = {r.doc_id: r for r in substr.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for case in range(20):
        r = found[5 * case + 4]
        assert (r.ref_doc_id, r.start, r.end, r.ref_start, r.ref_end, r.similarity) == (5 * case + 3, 30, 155, 30, 155, 1.0)
    assert len(found) == 20


def test_ends_that_grow_near_are_those_of_whole_texts(monkeypatch):
    """The same ends as over whole texts, and of texts that soon differ only the nearest words are taken."""
    rng = np.random.default_rng(7)
    for _ in range(400):
        x = [b"%d" % i for i in rng.integers(0, rng.choice([3, 50, 5000]), rng.integers(0, 200))]
        y = [b"%d" % rng.integers(0, 50) if rng.random() < rng.choice([0, 0.1, 0.5]) else w for w in x if rng.random() > 0.05]
        y = y[: int(rng.integers(0, len(y) + 1))] if rng.random() < 0.3 else y
        assert substr.grow_near(lambda n: (x[:n], y[:n]), len(x), len(y)) == substr.grow(x, y)
    asked = []
    substr.grow_near(lambda n: (asked.append(n), ([b"a", *[b"x"] * n][:n], [b"a", *[b"y"] * n][:n]))[1], 500, 500)
    assert asked == [substr.NEAR]


def test_columns_equal_their_lists():
    lists = pa.array([[1, 2], [], None, [3]], pa.list_(pa.int32()))
    assert substr._column(lists) == [[1, 2], [], [], [3]] and substr._column(lists[1:]) == [[], [], [3]]
    assert substr._column(pa.array([5, None, 7])) == [5, 0, 7] and substr._column(pa.array([b"a b", None], pa.binary())) == [b"a b", None]
