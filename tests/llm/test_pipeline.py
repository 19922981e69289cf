"""The pipeline's stages, one after the other, against the operators they call."""

import corpus_pipeline
from pyspark.sql import functions as F
from siltmark.llm import linededup, mixing, neardup, packing, quality, queries
from siltmark.plans.session import written
from tests.llm.fixtures import empty, frame

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    verdicts = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    one = written(corpus_pipeline.quality_rules(spark, docs, sf_dir), "t1")
    assert {r.doc_id for r in one.collect()} == {d for d, k in verdicts.items() if k}
    two = written(corpus_pipeline.line_dedup(spark, one, sf_dir), "t2")
    assert {(r.doc_id, r.text) for r in two.collect()} == {(r.doc_id, r.text) for r in linededup.without_boilerplate(one).collect()}
    assert all(r.n_chars == len(r.text) for r in two.collect())
    three = written(corpus_pipeline.near_dedup(spark, two, sf_dir), "t3")
    assert sorted(r.doc_id for r in three.collect()) == sorted({r.component_id for r in neardup.near_duplicates(two).collect()})
    four = written(corpus_pipeline.mix_sources(spark, three, sf_dir), "t4")
    copies = {r.doc_id: r.taken // r.size for r in mixing.mix(three).collect() if r.taken}
    assert four.count() == sum(copies.values())
    for stage in (one, two, three, four):
        assert stage.columns == COLUMNS
    five = corpus_pipeline.pack_sequences(spark, four, sf_dir)
    assert five.count() == packing.pack(four).count() > 0
    assert corpus_pipeline.run(spark, sf_dir).count() == five.count()


def test_stages_take_odd_tables(spark, sf_dir):
    for docs in (empty(spark), frame(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert name == "packing" or out.columns == docs.columns
            out.count()


def test_copied_documents_keep_their_lines(spark, sf_dir):
    text = "first line of a story\nand its second line"
    rows = [(i, text, "en", f"s{i}", len(text), "x", 1) for i in range(7)]
    rows += [(100 + i, f"own {i}\nRead more here", "en", f"s{i}", 20, "x", 1) for i in range(7)]
    out = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, frame(spark).schema), sf_dir)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {i: text for i in range(7)} | {100 + i: f"own {i}" for i in range(7)}


def test_every_operator_is_registered():
    names = queries.queries()
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 11)}
    assert set(queries.oracle_sql()) <= set(names)


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    """Columns named as the operators name their own in between."""
    names = "middle spread typical entropy copies off limit key row rank target size finish site at fp bucket words lines bad part n h place base a b tree block".split()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wide = docs.select("*", *[F.lit(n).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, docs, wide = docs, written(stage(spark, docs, sf_dir), "t"), written(stage(spark, wide, sf_dir), "t")
        assert wide.columns == [*plain.columns, *names], name
        assert sorted(map(str, wide.select(*plain.columns).collect())) == sorted(map(str, docs.collect()))
        assert wide.select(*names).distinct().collect() == [tuple(names)]
