"""Removal of lines that stand on many sites, by HyperLogLog sketches and exact counts near the threshold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.plans.session import written

MIN_SITES = 5
LG_BUCKETS = 12


def line_key(line: Column) -> Column:
    """128 bits that stand for a line (without its outer blanks and tabs); null for a line of blanks alone."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("h1"), F.xxhash64(bare, F.lit(1)).alias("h2")))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def site_counts(lines: DataFrame, min_sites: int = MIN_SITES, lg_buckets: int = LG_BUCKETS) -> DataFrame:
    """Keys (h1, h2) of the lines that stand on ``min_sites`` sites or more.

    ``lines`` has h1, h2 and site, a row an occurrence. A sketch of the sites of each line
    is built where the line is read and merged by aggregation. An estimate is off by more
    than three standard errors (and a site) only by rare chance; lines whose estimate lies
    so close to the threshold, and no others, get their sites counted exactly.
    """
    estimate = F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_buckets))
    margin = max(1, math.ceil(3 * 1.04 / math.sqrt(1 << lg_buckets) * min_sites))
    sketched = written(lines.groupBy("h1", "h2").agg(estimate.alias("sites")).where(F.col("sites") >= min_sites - margin), "sketched")
    sure = sketched.where(F.col("sites") > min_sites + margin).select("h1", "h2")
    near = sketched.where(F.col("sites") <= min_sites + margin).select(F.col("h1").alias("n1"), F.col("h2").alias("n2"))
    pairs = lines.join(near, (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2")), "left_semi").distinct()
    exact = pairs.groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return sure.unionByName(exact.select("h1", "h2"))


def without_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, lg_buckets: int = LG_BUCKETS, copies_once: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, site and more) with cross-site boilerplate lines taken out of text.

    A line is boilerplate if it, without outer blanks and tabs, stands in documents of
    ``min_sites`` different sites or more; a null site is a site of its own. Every
    occurrence goes; other lines, empty ones among them, stay in their order, joined by
    line ends. Two columns are added: ``_sm_lines`` and ``_sm_removed``, lines before and
    lines taken out. A null text stays null, with 0 lines; an empty one has one line. Texts
    are told apart by doc_id and a hash, null-safe, so rows that repeat one are cleaned each.
    All other columns are kept; an empty table gives an empty result. A line or a text may
    be as long as a row can be: time is in proportion to its length.
    With ``copies_once`` rows of equal text count as one document, of the least of their
    sites, so that a whole document that is copied over sites is no boilerplate.

    Only keys and numbers of lines are shuffled by line, where partial aggregation and skew
    splitting take care of very frequent ones; texts meet the numbers of their own bad lines
    by doc_id and hash. The numbers of the lines that stay are a set difference, in linear time.
    """
    text = F.col("text")
    digest = F.xxhash64(F.coalesce(text, F.lit("")))
    place = F.coalesce(F.col(site).cast("string"), F.lit("\u0000null"))
    occurrences = docs.select(F.col("doc_id").alias("_sm_id"), digest.alias("_sm_hash"), F.xxhash64(text, F.lit(1)).alias("_sm_hash2"), place.alias("site"), F.posexplode(_lines(text)).alias("at", "line"))
    keyed = occurrences.withColumn("k", line_key(F.col("line"))).where("k is not null")
    more = ["_sm_hash2"] if copies_once else []
    narrow = written(keyed.select("_sm_id", "_sm_hash", *more, "site", "at", "k.h1", "k.h2"), "lines")
    counted = narrow.select("h1", "h2", "site")
    if copies_once:
        firsts = narrow.groupBy(F.col("_sm_hash").alias("t1"), F.col("_sm_hash2").alias("t2")).agg(F.min("site").alias("first"), F.count_distinct("site").alias("n"))
        moved = written(firsts.where("n > 1").drop("n"), "firsts")
        counted = narrow.join(moved, (F.col("_sm_hash") == F.col("t1")) & (F.col("_sm_hash2") == F.col("t2")), "left").select("h1", "h2", F.coalesce("first", "site").alias("site"))
    bad = written(site_counts(counted, min_sites, lg_buckets), "boilerplate")
    hit = narrow.join(bad.toDF("b1", "b2"), (F.col("h1") == F.col("b1")) & (F.col("h2") == F.col("b2")))
    per_doc = hit.groupBy("_sm_id", "_sm_hash").agg(F.collect_set("at").alias("_sm_bad"))
    joined = docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_sm_id")) & (digest == F.col("_sm_hash")), "left")
    split = joined.withColumn("_sm_split", F.when(F.col("_sm_bad").isNotNull(), _lines(text)))
    last = F.size("_sm_split") - 1
    stay = F.array_except(F.sequence(F.lit(0), last), F.col("_sm_bad"))
    clean = F.when(F.col("_sm_bad").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_sm_split", i)), "\n"))
    n = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    columns = [clean.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return split.select(*columns, n.cast("long").alias("_sm_lines"), F.coalesce(F.size("_sm_bad"), F.lit(0)).cast("long").alias("_sm_removed"))


def cleaned(docs: DataFrame, **options) -> DataFrame:
    """``docs`` after ``without_boilerplate``, with the same columns; n_chars, if there, is the new length.

    Rows whose text loses all its lines stay, with an empty text.
    """
    out = without_boilerplate(docs, **options)
    changed = F.col("_sm_removed") > 0
    length = F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))
    return out.select(*[F.when(changed, length).otherwise(F.col("n_chars")).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
