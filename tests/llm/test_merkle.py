"""Merkle manifests against a plain version, with blocks of one level and of many."""

from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from siltmark.llm import merkle, queries
from tests.llm import fixtures

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def plain(rows, fanout):
    """(row, leaf, subroot, root, path) for rows of COLUMNS."""
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    held = {s: levels_of([x[2] for x in sorted(trees[s], key=lambda x: x[:3])], fanout) for s in names}
    top = levels_of([held[s][-1][0] for s in names], fanout)

    def path(levels, i):
        for level in levels[:-1]:
            a = i - i % fanout
            yield "".join(level[a:i]), "".join(level[i + 1 : a + fanout])
            i //= fanout

    for k, s in enumerate(names):
        for i, (*_, leaf, row) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            yield row, leaf, held[s][-1][0], top[-1][0], [*path(held[s], i), *path(top, k)]


@pytest.mark.parametrize("fanout,block", [(3, 20_000), (3, 9), (2, 2), (4, 5)])
def test_against_plain_version(spark, fanout, block):
    rows = [r[:5] for r in fixtures.documents()]
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in rows] + [(None, "no id", "en", "s1", 5), (None, None, None, None, None), (900, "alone", "en", "étude", 5), (3, "same id", "en", "s3", 1)]
    docs = spark.createDataFrame([(*r, "clash", "clash", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, tree string, path string, at int")
    got = merkle.manifest(docs, COLUMNS, also={"words": F.size(F.split("text", " "))}, fanout=fanout, block=block)
    assert got.columns == ["doc_id", "source", "words", "leaf", "subroot", "root", "path"]
    got = got.withColumn("folded", merkle.folded(F.col("leaf"), F.col("path"))).withColumn("joined", merkle.siblings(F.col("path"))).collect()
    want = list(plain([(r[0], r[3], r[2], r[4], r[1]) for r in rows], fanout))
    mine = sorted((str(r.doc_id), str(r.source), r.leaf, r.subroot, r.root, str([tuple(s) for s in r.path]), r.joined) for r in got)
    theirs = sorted((str(row[0]), str(row[1]), leaf, sub, root, str(path), "".join(b + a for b, a in path)) for row, leaf, sub, root, path in want)
    assert mine == theirs
    assert all(r.folded == r.root for r in got)


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(7, "t", None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = merkle.manifest(one, COLUMNS).collect()
    assert row.leaf == row.subroot == row.root == leaf_of((7, "s", None, 1, "t")) and row.path == []
    assert merkle.manifest(fixtures.empty(spark), COLUMNS).count() == 0


def test_query_finds_what_was_changed(spark, sf_dir):
    rows = queries.op12_merkle(spark, sf_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {row[0]: (leaf, sub, root, path) for row, leaf, sub, root, path in plain([tuple(d[c] for c in COLUMNS) for d in docs.values()], 3)}
    for r in rows:
        d = docs[r.doc_id]
        leaf, sub, root, path = want[r.doc_id]
        held = leaf
        if crc32(str(r.doc_id).encode()) % 2 == 0:
            held = leaf_of((d.doc_id, d.source, d.lang, d.n_chars, d.text and d.text.replace("\n", "")))
        for before, after in path:
            held = digest(before, held, after)
        assert (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) == (leaf, sub, root, digest(*(b + a for b, a in path)), held)
        assert r.verified == (held == root)
    assert len(rows) == len(docs) and 0 < sum(r.verified for r in rows) < len(rows)
