"""Personal data by seed patterns and bootstrapped contextual extraction, in DataFrame operations.

Seeds are entities that fixed patterns find (e-mail addresses, IP addresses, card and phone
numbers). The words around them are lexical patterns. Patterns and the identifiers in their
slots make a graph on which scores are passed back and forth: a pattern is as good as the
identifiers that it holds, an identifier as the patterns that hold it. Patterns of high
confidence extract identifiers that no fixed pattern knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.plans.session import remove, written

KINDS = ("email", "ip", "card", "phone")
#: Identifiers that only contexts confirm: seeds of the graph, but no base spans.
SECRET = "secret"
ALL_KINDS = (*KINDS, SECRET)
#: The patterns of the four kinds, in a form that runs in linear time and constant stack on any text: a quantifier never
#: gives back what nothing behind it could use, and a run of characters is only tried from its start (or from the end of
#: the match before), as no later start in it could do better. What they match is the same.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]|)"
#: A slot: a phone-like run, or a word with a digit or an at sign.
SLOT = rf"{PHONE}|(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Anything that a slot or a seed needs; texts without it are clean at once.
_ANY = "[0-9@]"
#: Places are summed in blocks of so many matches, so that a text with very many costs little more than their number.
_BLOCKS = (4096, 64)

ROUNDS = 3
MIN_SEEDS = 3
PATTERN_SCORE = 0.8
INSTANCE_SCORE = 0.8


def valid(kind: str, found: Column) -> Column:
    """Whether a match of a kind's pattern counts: IP parts up to 255, 14 to 19 digits with a Luhn sum, 10 to 15 digits."""
    digits = F.regexp_replace(found, "[^0-9]++", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return found.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))
    return F.length(digits).between(10, 15)


def _blocks(values: Column, size: int) -> Column:
    last = F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * size + 1, size))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)


def _sums(values: Column, before: Column, sizes: tuple[int, ...]) -> Column:
    """Running sums of ``values`` after ``before``; beyond a size they are taken block by block, each after the blocks before it."""
    if not sizes:
        start = F.struct(before.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(values, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out")))["out"]

    def by_block(blocks: Column) -> Column:
        ends = _sums(F.transform(blocks, _total), before, ())
        return F.flatten(F.zip_with(blocks, ends, lambda b, end: _sums(b, end - _total(b), sizes[1:])))

    many = F.transform(F.array(_blocks(values, sizes[0])), by_block)[0]  # blocks are made once and used twice
    return F.when(F.size(values) <= sizes[0], _sums(values, before, sizes[1:])).otherwise(many)


def running_sums(sizes: Column) -> Column:
    """Sums of an array of ints up to and with each item; an array is copied with every item that is appended, so they are short."""
    return _sums(sizes, F.lit(0), _BLOCKS)


def _found(text: Column, pattern: str, needs: Column) -> tuple[Column, Column]:
    """All matches of a pattern from left to right, and the texts around them (one more); empty arrays where there is none."""
    none = F.expr("cast(array() as array<string>)")
    have = needs & text.rlike(pattern)
    return F.when(have, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), F.when(have, F.split(text, pattern, -1)).otherwise(none)


def _ends(found: Column, gap_sizes: Column) -> Column:
    """Where each match ends in its text, in code points, from the sizes of matches and of the texts before them."""
    return running_sums(F.zip_with(found, F.slice(gap_sizes, F.lit(1), F.size(found)), lambda m, g: F.length(m) + g))


def _base_spans(kind: str, found: Column, ends: Column) -> Column:
    """Valid matches of one kind: array of (start, order, kind, end)."""
    placed = F.zip_with(found, ends, lambda m, e: F.struct(m.alias("m"), e.alias("e")))
    good = F.filter(placed, lambda r: valid(kind, r["m"]))
    return F.transform(good, lambda r: F.struct((r["e"] - F.length(r["m"])).alias("start"), F.lit(KINDS.index(kind)).alias("order"), F.lit(kind).alias("kind"), r["e"].alias("end")))


def _slots(found: Column, gaps: Column, ends: Column) -> Column:
    """Slots with their words around: array of (start, end, core, prev, prev2, next)."""
    n = F.size(found)
    rows = F.arrays_zip(found.alias("found"), ends.alias("stop"), F.slice(gaps, F.lit(1), n).alias("gap"), F.slice(gaps, F.lit(2), n).alias("after"))

    def row(r: Column) -> Column:
        lead = F.length(F.regexp_extract(r["found"], r"^([^0-9A-Za-z+@]*+)", 1))
        core = F.regexp_extract(r["found"], r"(?s)^[^0-9A-Za-z+@]*+(.*[0-9A-Za-z])", 1)
        start = r["stop"] - F.length(r["found"]) + lead
        before = F.lower(r["gap"])
        return F.struct(
            start.alias("start"),
            (start + F.length(core)).alias("end"),
            core.alias("core"),
            F.regexp_extract(before, r"(?<!\S)(\S++)\s*+$", 1).alias("prev"),
            F.regexp_extract(before, r"(?<!\S)(\S++\s++\S++)\s*+$", 1).alias("prev2"),
            F.regexp_extract(F.lower(r["after"]), r"^\s*+(\S++)", 1).alias("next"),
        )

    return F.filter(F.transform(rows, row), lambda s: s["core"] != "")


def located(docs: DataFrame) -> DataFrame:
    """(doc_id, base, slots) of ``docs``: base spans and slots of each text.

    Matches and the texts around them are columns of their own, so that each pattern runs
    twice over a text that holds it, however often they are used afterwards.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    any_ = text.rlike(_ANY)
    needs = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": any_ & F.contains(text, F.lit("."))}
    columns = []
    for kind in KINDS:
        found, gaps = _found(text, _BASE[kind], needs.get(kind, any_))
        columns += [found.alias(f"m_{kind}"), F.transform(gaps, F.length).alias(f"g_{kind}")]
    found, gaps = _found(text, SLOT, any_)
    rows = docs.select("doc_id", *columns, found.alias("m"), gaps.alias("g"))
    placed = rows.select(
        "doc_id",
        *[c for k in KINDS for c in (f"m_{k}", _ends(F.col(f"m_{k}"), F.col(f"g_{k}")).alias(f"e_{k}"))],
        *["m", "g", _ends(F.col("m"), F.transform("g", F.length)).alias("e")],
    )
    base = F.concat(*[_base_spans(k, F.col(f"m_{k}"), F.col(f"e_{k}")) for k in KINDS])
    return placed.select("doc_id", base.alias("base"), _slots(F.col("m"), F.col("g"), F.col("e")).alias("slots"))


def shape(core: Column) -> Column:
    """Runs of digits as 9 and of letters as a, other characters as they are."""
    return F.regexp_replace(F.regexp_replace(core, r"\p{L}++", "a"), "[0-9]++", "9")


def seed_kind(core: Column) -> Column:
    """The kind of an identifier that is a valid seed as a whole, else null.

    Hexadecimal strings of 32 digits or more with letters and figures are seeds of ``secret``: keys and access tokens
    look so, and other things too, which is why only a context of high confidence makes spans of them.
    """
    out = F.when(core.rlike("^[0-9A-Fa-f]{32,128}$") & core.rlike("[0-9]") & core.rlike("[A-Fa-f]"), F.lit(SECRET))
    for kind in reversed(KINDS):
        out = F.when(core.rlike(f"^(?:{_BASE[kind]})$") & valid(kind, core), F.lit(kind)).otherwise(out)
    return out


def _patterns(s: Column) -> Column:
    """Lexical patterns of a slot: two words before; the words on both sides; the word before with the shape."""
    both = F.when((s["prev"] != "") & (s["next"] != ""), F.concat(F.lit("b:"), s["prev"], F.lit(" _ "), s["next"]))
    left = F.when(s["prev2"] != "", F.concat(F.lit("l:"), F.regexp_replace(s["prev2"], r"\s+", " ")))
    form = F.when(s["prev"] != "", F.concat(F.lit("s:"), s["prev"], F.lit(" _ "), shape(s["core"])))
    return F.array_compact(F.array(left, both, form))


def bootstrap(slots: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, pattern_score: float = PATTERN_SCORE) -> tuple[DataFrame, DataFrame]:
    """Scored patterns (pattern, kind, pscore) and identifiers (core, kind, score).

    ``slots`` has core and patterns (an array). Different (pattern, identifier) pairs are the
    graph. In each round a pattern's score for a kind is the sum of its identifiers' scores
    over their number plus one, for patterns that hold ``min_seeds`` different seeds of the
    kind; an identifier's is one minus the product of what its good patterns leave (seeds
    keep 1 for their kind). Rounds are written, so a lost executor costs one of them.
    """
    graph = written(slots.select("core", F.explode("patterns").alias("pattern")).distinct(), "graph")
    seeds = graph.select("core").distinct().withColumn("kind", seed_kind(F.col("core"))).where("kind is not null")
    scores = written(seeds.select("core", "kind", F.lit(1.0).alias("score"), F.lit(1).alias("seed")), "scores")
    sizes = written(graph.groupBy(F.col("pattern").alias("p")).agg(F.count("*").alias("n")), "sizes")
    seeds = scores
    for i in range(rounds):
        held = graph.join(scores.withColumnRenamed("core", "c"), F.col("core") == F.col("c")).groupBy("pattern", "kind")
        held = held.agg(F.sum("score").alias("total"), F.sum("seed").alias("seeds")).where(F.col("seeds") >= min_seeds)
        patterns = held.join(sizes, F.col("pattern") == F.col("p")).select("pattern", "kind", (F.col("total") / (F.col("n") + 1)).alias("pscore"))
        patterns = written(patterns, f"patterns{i}")
        good = patterns.where(F.col("pscore") >= pattern_score / 2).select(F.col("pattern").alias("g"), "kind", "pscore")
        passed = graph.join(good, F.col("pattern") == F.col("g")).groupBy("core", "kind")
        passed = passed.agg((1 - F.exp(F.sum(F.log(1 - F.least("pscore", F.lit(0.99)))))).alias("score"))
        known = seeds.select(F.col("core").alias("k"), F.col("kind").alias("kk"))
        fresh = passed.join(known, (F.col("core") == F.col("k")) & (F.col("kind") == F.col("kk")), "left_anti").withColumn("seed", F.lit(0))
        after = written(seeds.unionByName(fresh), f"scores{i}")
        if i:
            remove(scores)
        scores = after
    return patterns, scores.select("core", "kind", "score")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, pattern_score: float = PATTERN_SCORE, instance_score: float = INSTANCE_SCORE) -> DataFrame:
    """Spans of personal data for every row of ``docs`` (doc_id, text).

    Returns doc_id, base and added: arrays of (start, order, kind, end) in code points, the
    end exclusive. ``base`` has the valid matches of the fixed patterns; matches of a kind
    are leftmost and don't overlap; invalid ones are dropped. ``added`` has identifiers that
    lie outside base spans, where a pattern with a score of ``pattern_score`` or more holds
    them and their own score is ``instance_score`` or more, with the kind of that pattern's
    seeds; keys and tokens (kind ``secret``) are only found so. A null text counts as
    empty; a null doc_id and repeated rows are kept; an empty table gives an empty result;
    other columns are ignored.

    Texts are read once; what goes on are spans and slots, a few for each document. Patterns
    run in linear time and constant stack on any text, however long its words, numbers
    or lists of numbers are; a text's matches are one row, so it must fit a row itself.
    """
    rows = written(located(docs).withColumn("row", F.monotonically_increasing_id()), "slots")
    slots = rows.where(F.size("slots") > 0).select("row", "base", F.explode("slots").alias("s"))
    outside = ~F.exists("base", lambda b: (b["start"] < F.col("s.end")) & (F.col("s.start") < b["end"]))
    slots = slots.select("row", "s.start", "s.end", "s.core", _patterns(F.col("s")).alias("patterns"), outside.alias("outside"))
    patterns, scores = bootstrap(slots, rounds, min_seeds, pattern_score)
    strong = patterns.where(F.col("pscore") >= pattern_score).select(F.col("pattern").alias("g"), F.col("kind").alias("gk"))
    likely = scores.where(F.col("score") >= instance_score).select(F.col("core").alias("c"), "kind")
    held = slots.where("outside").select("row", "start", "end", "core", F.explode("patterns").alias("pattern"))
    held = held.join(strong, F.col("pattern") == F.col("g")).join(likely, (F.col("core") == F.col("c")) & (F.col("gk") == F.col("kind")))
    order = F.array_position(F.array(*map(F.lit, ALL_KINDS)), F.col("kind")).cast("int") - 1
    added = held.groupBy(F.col("row").alias("r")).agg(F.collect_set(F.struct("start", order.alias("order"), "kind", "end")).alias("added"))
    none = F.expr("cast(array() as array<struct<start:int,order:int,kind:string,end:int>>)")
    return rows.join(added, F.col("row") == F.col("r"), "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def summary(found: DataFrame) -> DataFrame:
    """Counts and digests of ``find_pii``: see ``op9_pii``; ``n_spans`` counts base and added spans."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )
