"""Language identification by interpolated Kneser-Ney character models, one a language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.llm.ngram import CharModel, Scorer, add_counts, codes_of, parts
from siltmark.plans.session import ship_package, written

ORDER = 4
#: About so many documents of each language are learned from, and a fifth of them calibrates.
SAMPLE_DOCS = 2500
UNKNOWN = "und"
#: Of a language's calibration texts such a share is rejected, were they all of median length.
REJECTED = 0.005
#: A text is never rejected that is less than this share above its language's median.
LEAST_ABOVE = 0.02
_MAX_MODEL_BYTES = 256 << 20


class Letters:
    """Classes of characters: 0 anything that is no letter, 1 to 254 known letters, 255 other letters."""

    def __init__(self, known: str):
        self.table = np.zeros(1 << 16, np.uint8)
        for c in range(1 << 16):
            if chr(c).isalpha():
                self.table[c] = 255
        for i, c in enumerate(known[:254]):
            self.table[ord(c)] = i + 1

    def classes(self, text: str) -> np.ndarray:
        """Classes of the lower-cased text, with a 0 in front and runs of 0 as one."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
        found = self.table[np.minimum(points, (1 << 16) - 1)]
        if len(points) and points.max() >= 1 << 16:
            wide = np.flatnonzero(points >= 1 << 16)
            found[wide] = [255 if chr(p).isalpha() else 0 for p in points[wide]]
        found = np.concatenate([np.zeros(1, np.uint8), found])
        return found[np.r_[True, (found[1:] != 0) | (found[:-1] != 0)]]


class Identifier:
    """Models of all languages with their calibration; ``predict`` needs nothing else."""

    def __init__(self, langs: list[str], letters: Letters, scorer: Scorer):
        self.langs, self.letters, self.scorer = langs, letters, scorer
        self.sharpness = 1.0
        #: Per language: median cross-entropy and length of its own texts, and how far above the median a text is rejected.
        self.middle, self.typical, self.above = np.zeros(len(langs)), np.ones(len(langs)), np.full(len(langs), np.inf)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per class under each model (texts x languages), and classes per text; 0 classes mean no letter."""
        out = np.zeros((len(texts), len(self.langs)))
        length = np.zeros(len(texts), np.int64)
        for a, b in parts([len(t or "") for t in texts]):
            rows = [self.letters.classes(t or "") for t in texts[a:b]]
            used = [i for i, r in enumerate(rows) if r.any()]
            if not used:
                continue
            codes = np.concatenate([codes_of(rows[i], ORDER) for i in used])
            sizes = np.array([len(rows[i]) for i in used])
            sums = np.add.reduceat(self.scorer.score(codes), np.r_[0, np.cumsum(sizes)[:-1]], axis=0)
            at = a + np.array(used)
            out[at], length[at] = -sums / sizes[:, None], sizes
        return out, length

    def limits(self, lang: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The cross-entropy above which texts are rejected: a mean over fewer characters strays farther, by the root of their number."""
        shorter = np.sqrt(self.typical[lang] / np.maximum(length, 1))
        return self.middle[lang] + self.above[lang] * np.maximum(1.0, shorter)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score from 0 to 1 and whether it is rejected."""
        entropy, length = self.entropies(texts)
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(len(best)), best]
        lead = np.sqrt(np.maximum(length, 1))[:, None] * self.sharpness * (least[:, None] - entropy)
        score = np.where(length > 0, 1 / np.exp(lead).sum(axis=1), 0.0)
        rejected = (length == 0) | (least > self.limits(best, length))
        return [self.langs[i] if n else UNKNOWN for i, n in zip(best, length)], score, rejected


def _sampled(docs: DataFrame, learn: Column, sample_docs: int) -> DataFrame:
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    limits = known.groupBy("lang").agg(F.ceil(F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.count("*")) * (1 << 30)).cast("long").alias("_sm_limit"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30))
    picked = known.join(written(limits, "limits"), "lang").where(part < F.col("_sm_limit"))
    return picked.select("lang", "text", (F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(5)) == 0).alias("calibrates"))


def _letters_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        joined = "".join(batch.column("text").to_pylist()).lower()
        points, counts = np.unique(np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4"), return_counts=True)
        keep = [i for i, p in enumerate(points) if p < 1 << 16 and chr(p).isalpha()]
        yield pa.record_batch([pa.array(points[keep].astype(np.int32)), pa.array(counts[keep])], names=["point", "n"])


def _ngrams_of(letters: Letters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                held = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                mine = [t for x, t in zip(langs, texts) if x == lang]
                for a, b in parts([len(t) for t in mine]):
                    rows = [letters.classes(t) for t in mine[a:b]]
                    new = add_counts(np.concatenate([codes_of(r, ORDER) for r in rows if r.any()] or [np.zeros(0, np.uint64)]))
                    held = add_counts(np.concatenate([held[0], new[0]]), np.concatenate([held[1], new[1]]))
                yield pa.record_batch([pa.array([lang] * len(held[0]), pa.string()), pa.array(held[0].astype(np.int64)), pa.array(held[1])], names=["lang", "code", "n"])

    return run


def fit(docs: DataFrame, learn: Column, sample_docs: int = SAMPLE_DOCS) -> Identifier | None:
    """Learns from the rows of ``docs`` (doc_id, text, lang) that satisfy ``learn`` and have a language.

    About ``sample_docs`` documents of each language (chosen by a hash of doc_id; all where
    there are fewer) are used, whole: the bound of this classifier's training sample. Four
    fifths count n-grams, the rest calibrate: the sharpness of scores so that they fit how
    often predictions are right, and per language the cross-entropy above which a text of
    its length is rejected (``REJECTED`` of the calibration texts are). None if nothing can be learned. Rows without text or
    language are left out, repeated rows count each; texts are read whole.
    """
    ship_package(docs.sparkSession)
    sample = _sampled(docs, learn, sample_docs).persist()
    try:
        train, held = sample.where(~F.col("calibrates")), sample.where("calibrates")
        points = train.select("text").mapInArrow(_letters_of, "point int, n long").groupBy("point").agg(F.sum("n").alias("n"))
        top = points.orderBy(F.desc("n"), "point").limit(254).collect()
        letters = Letters("".join(chr(r.point) for r in top))
        grams = train.select("lang", "text").mapInArrow(_ngrams_of(letters), "lang string, code long, n long")
        table = grams.groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
        if not len(table):
            return None
        langs = sorted(table["lang"].unique())
        models = []
        for lang in langs:
            mine = table[table["lang"] == lang]
            models.append(CharModel(mine["code"].to_numpy().view(np.uint64), mine["n"].to_numpy(), ORDER))
        out = Identifier(langs, letters, Scorer(models))
        if out.scorer.nbytes > _MAX_MODEL_BYTES:
            raise ValueError("the language models are too large to send to executors; learn from fewer documents")
        _calibrate(out, held)
        return out
    finally:
        sample.unpersist()


def _calibrate(model: Identifier, held: DataFrame) -> None:
    shared = held.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entropy, length = shared.value.entropies(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("lang"), pa.array(list(entropy), pa.list_(pa.float64())), pa.array(length)], names=["lang", "entropy", "length"])

    rows = held.select("lang", "text").mapInArrow(run, "lang string, entropy array<double>, length long").where("length > 0").toPandas()
    rows = rows[rows["lang"].isin(model.langs)]
    if not len(rows):
        return
    entropy = np.stack(rows["entropy"].to_list())
    truth = rows["lang"].map({x: i for i, x in enumerate(model.langs)}).to_numpy()
    root = np.sqrt(rows["length"].to_numpy())[:, None]
    best = None
    for sharpness in np.geomspace(0.05, 50, 60):
        z = -entropy * root * sharpness
        z -= z.max(axis=1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]))
        if best is None or loss < best[0]:
            best = (loss, sharpness)
    model.sharpness = float(best[1])
    for i in range(len(model.langs)):
        own, length = entropy[truth == i, i], rows["length"].to_numpy()[truth == i]
        if len(own):
            model.middle[i], model.typical[i] = np.median(own), np.median(length)
            # Each text's distance as it would be at the median length; a small sample's largest stands for the quantile.
            far = (own - model.middle[i]) / np.maximum(1.0, np.sqrt(model.typical[i] / length))
            model.above[i] = max(np.quantile(far, 1 - REJECTED, method="higher"), LEAST_ABOVE * model.middle[i])


def identify(docs: DataFrame, model: Identifier | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of ``docs`` (doc_id, text).

    lang_pred has the lowest cross-entropy per character; ``score`` is its calibrated
    probability. ``rejected`` tells that even the best model fits worse than all but a few texts of its
    language and length in the sample. A null text, one without a letter, and every text if the model
    is None, get ``und``, score 0 and rejected. Repeated rows and null doc_ids get a row each, other columns are
    ignored, texts are read whole (in parts, if many or long), and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    names = ["doc_id", "lang_pred", "score", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if shared.value is None:
                langs, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            else:
                langs, score, rejected = shared.value.predict(texts)
            yield pa.record_batch([batch.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
