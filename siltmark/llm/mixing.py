"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document is a packet of its source's queue. Its virtual finish time is
the number of words that its source has served up to and with it, divided by the
source's target. Serving packets by ascending finish time and stopping at the total
budget gives every source its share to within a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.operators.ranking import running_total, running_totals
from siltmark.plans.session import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, share: float = 1.0) -> DataFrame:
    """Targets per source: (source, rank, base, source_size, weight, target).

    ``sizes`` has source and size. Sources are ranked by code point, null last, and weigh
    ``weights`` in turn. They share ``share`` of all sizes by weight, at most
    ``max_repeat`` times their own size each; the excess is shared again among the others
    until none is above. The level of the water (words per weight) comes from running
    sums in order of cap per weight. The table has one row per source; ``base`` is the
    size of the sources before. Sources may be as many as hosts: ranks and running sums
    are taken by ranges, and only the level and the total meet on the driver.
    """
    turn = F.array(*[F.lit(float(w)) for w in weights])
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    ranked = running_totals(one, [F.col("source").asc_nulls_last()], {"one": "rank", "source_size": "base"})
    sources = ranked.select(
        *["source", "rank", "base", "source_size"],
        F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size").cast("double") * max_repeat).alias("cap"),
    )
    full = F.col("cap") / F.col("weight")
    filled = written(running_totals(sources, [full, F.col("rank")], {"cap": "caps", "weight": "weights"}), "filled")
    total = filled.agg((F.sum("source_size") * float(share)).alias("words"), F.sum("weight").alias("weights")).first()
    level = (F.lit(total.words) - F.col("caps")) / (F.lit(total.weights) - F.col("weights"))
    # The first source, by cap per weight, whose cap its share doesn't reach: its level holds for all that follow.
    reached = filled.withColumn("level", level).where(F.col("cap") >= F.col("level") * F.col("weight"))
    water = reached.agg(F.min_by("level", F.struct(full, "rank"))).first()[0]
    target = F.col("cap") if water is None else F.least(F.col("cap"), F.lit(water) * F.col("weight"))
    return filled.select("source", "rank", "base", "source_size", "weight", target.alias("target"))


def _mixed_rows(rows: DataFrame, weights, max_repeat: int, share: float, seed: int) -> DataFrame:
    """``mix`` over rows (doc_id, source, size, text_key, row), with the column row; row is unique.

    Rows that agree in all but row are the same document again: which of them is taken is one, so row may break ties.
    """
    shuffle = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.hex("text_key")))))
    targets = written(source_targets(rows, weights, max_repeat, share), "targets")
    place = ["key", "doc_id", "size", "text_key", "row"]
    # Documents without words are never taken: they needn't be sorted.
    some = rows.where("size > 0").withColumn("key", shuffle)
    served = running_total(some, [F.col("source").asc_nulls_last(), *map(F.col, place)], "size", "before")
    named = targets.withColumnRenamed("source", "_sm_source").drop("weight")
    served = (
        served.join(named, F.col("source").eqNullSafe(F.col("_sm_source")))
        .withColumn("served", F.col("before") - F.col("base") + F.col("size"))
        .drop("_sm_part", "_sm_source", "before", "base")
    )
    served = written(served, "served")

    def finish(copy: Column) -> Column:
        return F.try_divide((copy * F.col("source_size") + F.col("served")).cast("double"), F.col("target"))

    place = ["finish", "rank", *place]
    copies = served.where("target > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1)))).withColumn("finish", finish(F.col("copy")))
    budget = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)) * float(share)).first()[0]
    queue = running_total(copies.select(*place), [F.col(c) for c in place], "size", "sent")
    last = queue.where(F.col("sent") + F.col("size") <= F.lit(budget)).agg(F.max(F.struct(*place))).first()[0]
    taken = F.lit(0)
    if last is not None:
        kinds = dict(queue.dtypes)
        cut = F.struct(*[F.lit(last[c]).cast(kinds[c]) for c in place])
        taken = sum((F.when(F.struct(finish(F.lit(c)), *place[1:]) <= cut, 1).otherwise(0) for c in range(max_repeat)), F.lit(0))
        taken = F.when(F.col("target") > 0, taken).otherwise(0)
    columns = ["row", "doc_id", "size", "source_size", "target"]
    blank = rows.where("size = 0").join(named, F.col("source").eqNullSafe(F.col("_sm_source")))
    out = served.select(*columns, (F.col("size") * taken).cast("long").alias("taken"))
    return out.unionByName(blank.select(*columns, F.lit(0).cast("long").alias("taken")))


def _sizes(docs: DataFrame, row: Column) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(text).alias("text_key"), row.alias("row"))


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, share: float = 1.0, seed: int = 0) -> DataFrame:
    """How many words the mix takes of each document.

    ``docs`` has doc_id, text and source; other columns are ignored. Returns doc_id, size,
    source_size, target and taken (``size`` times the number of copies taken), one row per
    input row. Documents of a source are shuffled by the MD5 of seed and doc_id (of the
    text's hash where doc_id is null), then by doc_id, size and the text's hash, so that
    reruns agree in whatever order rows come; every pass over a source keeps that order. A
    null text has size 0, and null is a source of its own. Repeated rows are documents of
    their own: rows that agree in doc_id, source and text share what is taken of them in
    any order. Documents without words are never taken. Texts of any length are counted
    whole. An empty table gives an empty result.

    Words are counted once and only narrow rows are sorted: by (source, shuffle) for the
    service of each queue and by finish time for the truncation, both as range sorts in
    which a large source, or one document that is repeated very often, is spread over many ranges.
    """
    rows = written(_sizes(docs, F.monotonically_increasing_id()), "sizes")
    return _mixed_rows(rows, weights, max_repeat, share, seed).drop("row")


def mixed(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, share: float = 1.0, seed: int = 0) -> DataFrame:
    """``docs`` as the mix takes them: a row for each copy taken, with the columns of ``docs``; all else as in ``mix``.

    Rows are numbered and written first, so that each gets its own number of copies, whatever doc_ids repeat or are null.
    """
    numbered = written(docs.withColumn("_sm_row", F.monotonically_increasing_id()), "numbered")
    rows = written(_sizes(numbered, F.col("_sm_row")), "sizes")
    taken = _mixed_rows(rows, weights, max_repeat, share, seed).where("taken > 0")
    wanted = taken.select(F.col("row").alias("_sm_taken"), (F.col("taken") / F.col("size")).cast("int").alias("_sm_n"))
    out = numbered.join(wanted, F.col("_sm_row") == F.col("_sm_taken"))
    return out.withColumn("_sm_copy", F.explode(F.sequence(F.lit(1), F.col("_sm_n")))).select(*[F.col(f"`{c}`") for c in docs.columns])
