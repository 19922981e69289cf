"""Language identification and quality rules against plain models."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltmark.llm import langid, ngram, quality
from tests.llm.fixtures import documents, empty, frame, prose

LETTERS = {"en": "etaoinshrdlu", "xx": "bcdfgkmpqvwz", "gr": "αβγδεζηθλμνπ"}


def plain_kneser_ney(counts: Counter, order: int, symbols: int, modified: bool):
    """log p(newest class | others) by dictionaries, over tuples of classes."""
    levels = {order: dict(counts)}
    for k in range(order - 1, 0, -1):
        lower = defaultdict(int)
        for g in levels[k + 1]:
            lower[g[1:]] += 1
        levels[k] = dict(lower)
    taken, total, kinds = {}, {}, {}
    for k, grams in levels.items():
        n1, n2, n3, n4 = (max(1, sum(c == i for c in grams.values())) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        taken[k] = [0, y, y, y] if not modified else [0, *(min(max(v, 0), t) for v, t in zip((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), (0.95, 1.9, 2.85)))]
        total[k], kinds[k] = defaultdict(int), defaultdict(float)
        for g, c in grams.items():
            total[k][g[:-1]] += c
            kinds[k][g[:-1]] += taken[k][min(c, 3)]

    def p(g):
        k = len(g)
        if not k:
            return 1 / symbols
        if g[:-1] not in total[k]:
            return p(g[1:])
        c = levels[k].get(g, 0)
        t = total[k][g[:-1]]
        return max((c - taken[k][min(c, 3)]) / t + kinds[k][g[:-1]] / t * p(g[1:]), 1e-12)

    return p


@pytest.mark.parametrize("modified", [False, True])
def test_model_equals_plain_one(modified):
    rng = np.random.default_rng(2)
    classes = rng.zipf(1.5, 4000) % 12
    codes = ngram.codes_of(classes, 3)
    have, n = ngram.add_counts(codes)
    model = ngram.CharModel(have, n, 3, 16, modified)
    tuples = lambda cs: [tuple(int(c) >> 8 * i & 255 for i in (2, 1, 0)) for c in cs]
    plain = plain_kneser_ney(Counter(dict(zip(tuples(have), n.tolist()))), 3, 16, modified)
    asked = np.concatenate([have, ngram.codes_of(rng.integers(0, 16, 300), 3)])
    want = [math.log(plain(g)) for g in tuples(asked)]
    assert np.allclose(model.log_prob(asked), want)
    assert np.allclose(ngram.Scorer([model]).score(asked)[:, 0], want, atol=1e-4)
    context = tuples(have)[0][:2]
    assert sum(plain((*context, x)) for x in range(16)) == pytest.approx(1)


def test_hash_array():
    rng = np.random.default_rng(4)
    codes = np.unique(rng.integers(0, 2**40, 5000).astype(np.uint64))
    array = ngram.HashArray(codes)
    at = array.find(codes)
    assert (codes[array.order[at]] == codes).all()
    other = np.setdiff1d(rng.integers(0, 2**40, 5000).astype(np.uint64), codes)
    assert (array.find(other) == -1).all() and (ngram.HashArray(codes[:1]).find(other) == -1).all()


def speech(n: int) -> list[tuple]:
    rng = random.Random(5)
    langs = list(LETTERS)
    return [(i, prose(rng, rng.randint(3, 60), LETTERS[langs[i % 3]]), langs[i % 3]) for i in range(n)]


def test_languages_are_told_apart(spark):
    rows = speech(300) + [(900, None, "en"), (901, "123 !?", "en"), (902, "", None), (903, "ΑΒΓΔ αβγδ", None), (None, "etaoin", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    out = langid.identify(docs, langid.fit(docs, ~held)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    truth = {r[0]: r[2] for r in rows[:300]}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out if r.doc_id in truth]) > 0.98
    odd = {r.doc_id: r for r in out}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 and odd[i].rejected for i in (900, 901, 902)) and odd[903].lang_pred == "gr"


def test_rejection_and_calibration(spark):
    """Of unseen texts few are rejected, of texts in no known language nearly all; limits and sharpness equal plain ones."""
    rows = speech(900)
    rng = random.Random(77)
    junk = [(5000 + i, " ".join("".join(rng.choice("etaoinshrdlubcdfgkmpqvwz") for _ in range(9)) for _ in range(rng.randint(20, 60))), None) for i in range(60)]
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.col("doc_id") < 600)
    out = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert np.mean([out[i].rejected for i in range(600, 900)]) < 0.05 and np.mean([out[5000 + i].rejected for i in range(60)]) > 0.9
    held = docs.where("doc_id < 600 and pmod(xxhash64(doc_id, 23), 5) = 0").collect()
    entropy, length = model.entropies([r.text for r in held])
    for i, lang in enumerate(model.langs):
        mine = [j for j, r in enumerate(held) if r.lang == lang]
        own, n = entropy[mine, i], length[mine]
        assert model.middle[i] == pytest.approx(np.median(own)) and model.typical[i] == np.median(n)
        rejected = own > model.limits(np.full(len(mine), i), n)
        assert rejected.mean() <= langid.REJECTED
    loss = lambda s: np.mean([-math.log(math.exp(-entropy[j, model.langs.index(r.lang)] * s * math.sqrt(length[j])) / sum(math.exp(-e * s * math.sqrt(length[j])) for e in entropy[j])) for j, r in enumerate(held)])
    assert loss(model.sharpness) <= min(loss(model.sharpness * f) for f in (0.8, 1.25)) + 1e-9


def test_labels_are_never_read_in_prediction(spark):
    docs = spark.createDataFrame(speech(60), "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    turned = docs.withColumn("lang", F.lit("en"))
    assert langid.identify(docs, model).collect() == langid.identify(turned, model).collect()


def test_nothing_to_learn(spark):
    assert langid.fit(empty(spark), F.lit(True)) is None
    assert {r.lang_pred for r in langid.identify(frame(spark), None).collect()} == {"und"}
    assert langid.identify(empty(spark), None).count() == 0


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    covered = {i + d for at in places.values() if len(at) > 1 for i in at for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts():
    for text in [r[1] for r in documents()] + ["a b c a b c a", "x\nx\n x\n\n", "a|b <c> ##", "a b a b a b", "\x85 \xa0 a\x1cb"]:
        assert quality.base_counts(text) == plain_counts(text), text


def corpus():
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(60, 300)), "en") for i in range(150)]
    rows += [(500 + i, prose(rng, 120, "qxzjkvw"), "en") for i in range(3)]
    rows += [(600 + i, "".join(rng.choice("#$%&*<>| ") for _ in range(900)), "en") for i in range(3)]
    return rows + [(700, None, "en"), (701, "", None), (702, "few words", None), (703, "a b c " * 60, "en")]


def test_quality_bands(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert len(out) == 160
    for doc_id, text, _ in corpus():
        r = out[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert sum(out[i].kept for i in range(150)) >= 147
    assert not any(out[i].kept for i in (500, 501, 502, 600, 601, 602, 700, 701, 702, 703))
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.kept}


def test_copies_do_not_narrow_a_band(spark):
    """Exact and near copies are most of a language, and another language has two texts."""
    rng = random.Random(8)
    copy = prose(rng, 200)
    rows = [(i, copy, "en") for i in range(90)]
    rows += [(100 + i, copy + f"\n{i}", "de") for i in range(90)]
    rows += [(200 + i, prose(rng, 200), "en") for i in range(60)] + [(300 + i, prose(rng, 200), "de") for i in range(60)]
    rows += [(400, prose(rng, 300), "fr"), (401, prose(rng, 100), "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id for r in quality.quality(docs).collect() if r.kept}
    assert set(range(90)) <= out, sorted(out)
    assert {400, 401} <= out and sum(i in out for i in range(200, 260)) >= 57, sorted(out)
    assert sum(i in out for i in range(300, 360)) >= 57, sorted(out)
    assert {r.doc_id for r in quality.kept_documents(docs).collect()} == out


def test_model_learns_from_every_different_text(spark):
    """Texts that share most of their shingles count each; exact copies count once."""
    first = "".join(f"word{i} " for i in range(60))
    texts = [first + end for end in ("zebra", "quartz crystal", "jumping fox over", "zebra", "zebra")]
    assert len({quality.copies_key(t) for t in texts}) < len(set(texts))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    letters = quality.alphabets(docs)
    want = Counter()
    for t in set(texts):
        want.update(ngram.codes_of(quality.classes(t, letters["en"]), quality.ORDER).tolist())
    assert {r.code: r.n for r in quality.grams(docs, letters).collect()} == want


def test_entropy_equals_plain_model(spark):
    docs = spark.createDataFrame([r for r in corpus() if r[1]][:40], "doc_id long, text string, lang string")
    counts = Counter()
    texts = {r.doc_id: r.text for r in docs.collect()}
    letters = quality.alphabets(docs)["en"]
    assert set(letters) == {c for t in texts.values() for c in t if c.isalpha()}
    grams = {}
    for d, t in texts.items():
        c = [0, 0, 0, *quality.classes(t, letters).tolist()]
        grams[d] = [tuple(c[i : i + 4]) for i in range(len(c) - 3)]
        counts.update(grams[d])
    plain = plain_kneser_ney(counts, 4, quality.CLASS_COUNT, True)
    out = {r.doc_id: r.entropy for r in quality.quality(docs).collect()}
    for d in list(texts)[:5]:
        assert out[d] == pytest.approx(-sum(math.log(plain(g)) for g in grams[d]) / len(grams[d]), abs=1e-4)


def test_other_scripts_have_classes_of_their_own(spark):
    """Scrambled Cyrillic words are told from real ones by their letters alone."""
    rng = random.Random(12)
    syllables = ["на", "то", "ко", "ли", "ва", "ре", "ми", "до"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    text = lambda: " ".join(word() for _ in range(rng.randint(100, 200)))

    def scrambled(t):
        return " ".join("".join(rng.sample(list(w), len(w))) for w in t.split())

    rows = [(i, text(), "ru") for i in range(80)] + [(100 + i, scrambled(text()), "ru") for i in range(3)]
    out = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(out[i] for i in range(80)) >= 78 and not any(out[100 + i] for i in range(3))


def test_models_too_large_to_send_take_turns(spark, monkeypatch):
    """The same scores if each language is a round of its own; languages without a model and clashing columns go along."""
    rows = [(*r, "clash") for r in speech(200)] + [(900, None, "none", "clash"), (901, "αβ " * 60, None, "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, entropy string")
    once = {r.doc_id: (r.entropy, r.kept) for r in quality.quality(docs).collect()}
    monkeypatch.setattr(quality, "MODEL_BYTES", 1)
    turns = {r.doc_id: (r.entropy, r.kept) for r in quality.quality(docs).collect()}
    assert turns == once and len(once) == 202
    assert {r.doc_id for r in quality.kept_documents(docs).collect()} == {d for d, (_, k) in once.items() if k}


def test_quality_of_odd_tables(spark):
    assert quality.quality(empty(spark)).count() == 0 and quality.kept_documents(empty(spark)).count() == 0
    out = quality.kept_documents(frame(spark))
    assert out.columns == frame(spark).columns
    assert quality.quality(frame(spark)).count() == len(documents())
