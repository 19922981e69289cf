"""Language-model scores from a probabilistic suffix tree over words.

A state of the tree is a context of up to ``depth`` words. The tree grows from the root, one
word further back a level: a context is examined if it was seen ``min_count`` times, the
context without its oldest word is a state, and the one without its newest word was
examined. It becomes a state if its next words diverge enough from those of the state that
it extends: the sum over its next words of count * ln(P(word | context) / P(word | shorter)),
where P(word | context) leaves out the occurrence that it predicts, must exceed
``threshold``. The test takes P(word | shorter) in 16 bits. Distributions are smoothed
towards those of the next shorter state, (count + weight * P(word | shorter)) / (total + weight), and the
root's is (count + 0.1) / (all + 0.1 * (distinct + 1)); each adds up to 1 over known words and one
unknown one. A word is scored by the longest state that its history ends with.

Texts are cut into blocks of words, read once. At each level every block sends its distinct
n-grams, with their counts in training texts, to the part of the table that owns their
context, and gets total counts and verdicts back, so the model is nowhere whole; it has as
many n-grams as the corpus. N-grams of a frequent context are dealt in buckets, as many as its
count asks for, so that they do not meet in one task; the buckets' shares of its divergence are added up
before the verdict, so it is tested like any other. Words and n-grams are told apart by
64-bit hashes.
"""

from __future__ import annotations

import contextlib
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.llm.memory import give_back
from siltmark.plans.session import remove, ship_package, written

DEPTH, MIN_COUNT, THRESHOLD, WEIGHT = 3, 4, 2.0, 64.0
#: A context seen more often is dealt in buckets of about ``BUCKET`` occurrences.
FREQUENT, BUCKET = 1 << 20, 1 << 18
#: Bytes of a block of texts, and words of the corpus for each part of the table.
BLOCK, PART = 3 << 20, 1 << 19
#: Turns in which blocks meet their answers.
TURNS = 2
#: The end as a word; none holds a space.
_END_WORD = b" end"
_SPACES = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")
_LOW = np.uint64((1 << 40) - 1)
#: Bytes of keys that a block sends at once, and rows that Python takes at once.
_ASK_BYTES, _ROWS = 1 << 20, 4

_DOC = np.dtype([("row", "<i8"), ("doc_id", "<i8"), ("null", "?"), ("train", "?"), ("skip", "<i4"), ("size", "<i4"), ("known", "<i8"), ("base", "<f8"), ("score", "<f8")])
_STATE = "block long, size long, docs binary, words binary, counts binary, ids binary, at binary, p binary, n binary"
_ASKED = "part int, block long, sizes binary, contexts binary, context_n binary, keys binary, counts binary, p binary"
_ANSWER = "block long, part int, totals binary, kept binary, n_total long, n_distinct long, contexts binary, gains binary"
_RESULT = "row long, doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def _packed(a: np.ndarray) -> bytes:
    """Compressed with equal bytes of the items side by side, as high bytes mostly agree."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def _table(shape: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in shape.split(", ")])
    return pa.table([pa.array(v, f.type) for v, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The items that a column's binary values hold, one after the other."""
    out = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        a, z = np.frombuffer(offsets, np.int32)[[chunk.offset, chunk.offset + len(chunk)]]
        out.append(np.frombuffer(data, np.uint8)[a:z].view(kind) if data else np.zeros(0, kind))
    return np.concatenate(out)


def _pieces(text: bytes, depth: int, most: int) -> Iterator[tuple[bytes, int, bool]]:
    """(words, how many of them stand before the piece, whether it is the last) of a text in pieces of about ``most`` bytes, cut between words."""
    before, at = b"", 0
    while True:
        z = at + most
        while z < len(text) and text[z : z + 1] not in _SPACES:
            z += 1
        piece = before + text[at:z]
        yield piece, len(before.split()), z >= len(text)
        if z >= len(text):
            return
        before, at = b" ".join(piece.rsplit(None, depth)[-depth:]) + b" " if depth else b"", z


def _cutter(depth: int, most: int):
    """Blocks of about ``most`` bytes; a longer text goes on in further blocks, each beginning with the last ``depth`` words before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        rows, blocks = count(task << 40), count(task << 40)
        texts: list[bytes] = []
        docs: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).view(pa.string())))
            size = split.value_lengths().to_numpy()
            encoded = split.flatten().dictionary_encode()
            words = encoded.dictionary.view(pa.binary()).to_pylist()
            ids = encoded.indices.to_numpy()
            # White space at the ends of a text makes empty words; an end follows each text that ends here.
            doc = np.repeat(np.arange(len(docs)), size)
            full = np.ones(len(ids), bool) if b"" not in words else ids != words.index(b"")
            doc, ids = doc[full], ids[full]
            ends = np.flatnonzero([d[4] for d in docs])
            at = np.searchsorted(doc, ends, "right")
            ids, doc = np.insert(ids, at, len(words)), np.insert(doc, at, ends)
            sizes = np.bincount(doc, minlength=len(docs))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, [*words, _END_WORD]), np.uint64, len(words) + 1)
            stored = np.array([(*d[:4], d[5], n, 0, 0.0, 0.0) for d, n in zip(docs, sizes.tolist())], _DOC)
            state = (next(blocks), len(ids), stored.tobytes(), hashes.tobytes(), b"", _packed(ids.astype(np.uint32)), b"", b"", b"")
            texts.clear()
            docs.clear()
            held = 0
            del split, encoded, words, ids, doc, full
            give_back()
            return _table(_STATE, [state]).to_batches()[0]

        for batch in batches:
            for row, doc_id, train, text in zip(rows, batch.column("doc_id").to_pylist(), batch.column("train").to_pylist(), batch.column("text").cast(pa.binary())):
                for piece, skip, last in _pieces(text.as_py() or b"", depth, most):
                    texts.append(piece)
                    docs.append((row, doc_id or 0, doc_id is None, train, last, skip))
                    held += len(piece) + 1
                    if held >= most:
                        yield flush()
        if docs:
            yield flush()

    return run


class _Block:
    """A block's words and the places where the tree still grows."""

    def __init__(self, row: dict, min_count: int, root: Root):
        self.block = row["block"]
        self.docs = np.frombuffer(row["docs"], _DOC).copy()
        self.words = np.frombuffer(row["words"], np.uint64)
        self.ids = _unpacked(row["ids"], "<u4")
        self.doc = np.repeat(np.arange(len(self.docs), dtype=np.int32), self.docs["size"])
        starts = np.cumsum(self.docs["size"]) - self.docs["size"]
        self.depth = np.arange(len(self.ids), dtype=np.int32) - starts.astype(np.int32)[self.doc]  # words before it in its block's part of the text
        self.scored = self.depth >= self.docs["skip"][self.doc]
        self.counts = row["counts"]
        if row["at"]:
            self.at = np.flatnonzero(np.unpackbits(_unpacked(row["at"], "u1"), count=len(self.ids))).astype(np.int32)
            self.p, self.n = _unpacked(row["p"], "<f4"), _unpacked(row["n"], "<i8")
        elif self.counts:  # after the root: what is known follows from the counts of words
            c = _unpacked(self.counts, "<i8")
            seen = c[self.ids]
            self.at = np.flatnonzero(self.first_level(seen, min_count)).astype(np.int32)
            self.p, self.n = root.p(seen[self.at]).astype(np.float32), seen[self.at - 1]

    def first_level(self, seen: np.ndarray, min_count: int) -> np.ndarray:
        """Whether the tree grows beyond the root before each word."""
        return (self.depth > 0) & (np.roll(seen, 1) >= min_count)

    def stored(self, counts: np.ndarray | None = None) -> tuple:
        here = (self.block, len(self.ids), self.docs.tobytes(), self.words.tobytes())
        if counts is not None:
            return (*here, _packed(counts), _packed(self.ids), b"", b"", b"")
        mask = np.zeros(len(self.ids), bool)
        mask[self.at] = True
        return (*here, b"", _packed(self.ids), _packed(np.packbits(mask)), _packed(self.p), _packed(self.n))

    def add(self, field: str, at: np.ndarray, values: np.ndarray) -> None:
        mine = self.scored[at]
        self.docs[field] += np.bincount(self.doc[at[mine]], values[mine], len(self.docs)).astype(_DOC[field])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = b * np.uint64(0x9E3779B97F4A7C15) + (a << np.uint64(6))
    x += a >> np.uint64(2)
    x ^= a
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def _coarse(p: np.ndarray) -> np.ndarray:
    """Probabilities in 16 bits: the upper half of a 32-bit float, rounded up."""
    return ((p.astype(np.float32).view(np.uint32) >> np.uint32(16)) + np.uint32(1)).astype(np.uint16)


def _fine(coarse: np.ndarray) -> np.ndarray:
    return (coarse.astype(np.uint32) << np.uint32(16)).view(np.float32).astype(float)


class _Grams:
    """The distinct n-grams of a level in a block, in the order in which parts are asked about them.

    The upper 24 bits of a key are those of its context's hash, which choose its part, or of
    its context's and bucket's where the context is frequent; the others are the n-gram's.
    """

    def __init__(self, b: _Block, level: int, parts: int, frequent: int):
        h = b.words[b.ids] if level else b.words
        if level == 0:
            keys, context, n = h, np.zeros(len(h), np.uint64), np.zeros(len(h), np.int64)
        else:
            context = h[b.at - 1]
            for i in range(2, level + 1):
                context = _mixed(context, h[b.at - i])
            keys = _mixed(_mixed(context, np.full(1, level, np.uint64)), h[b.at])
            del h
            n = b.n
            owner = context.copy()
            many = np.flatnonzero(n > frequent)
            if len(many):
                buckets = (1 + n[many] // min(BUCKET, frequent)).astype(np.uint64)
                owner[many] = _mixed(context[many], keys[many] % buckets)
            keys ^= (owner ^ keys) & ~_LOW
            del owner, many
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        self.place = np.empty(len(keys), np.int32)
        self.place[order] = np.cumsum(new, dtype=np.int32) - 1
        self.keys = ordered[new]
        first = order[new]
        del keys, order, ordered, new
        trained = b.docs["train"][b.doc] & b.scored
        if level == 0:
            self.place = self.place[b.ids]
            self.counts = np.bincount(self.place, trained, len(self.keys)).astype(np.int64)
            self.p = np.zeros(len(first), np.uint16)
        else:
            self.counts = np.bincount(self.place, trained[b.at], len(self.keys)).astype(np.int64)
            self.p = _coarse(b.p[first])
        context, n = context[first], n[first]
        self.part = ((self.keys >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)
        new = np.ones(len(first), bool)
        new[1:] = (self.part[1:] != self.part[:-1]) | (context[1:] != context[:-1])
        self.heads = np.flatnonzero(new)
        self.contexts, self.context_n = context[self.heads], n[self.heads]
        self.frequent = self.context_n > frequent

    def asked(self, block: int) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(np.append(self.heads, len(self.keys)))
        bounds = np.flatnonzero(np.diff(self.part, prepend=-1))
        rows = []
        for a, z in zip(bounds, np.append(bounds[1:], len(self.keys))):
            i, j = np.searchsorted(self.heads, (a, z))
            arrays = (sizes[i:j].astype(np.int32), self.contexts[i:j], self.context_n[i:j], self.keys[a:z], self.counts[a:z], self.p[a:z])
            # Sorted keys of one part differ little in their upper bytes.
            rows.append((int(self.part[a]), block, *(_packed(x) if x is arrays[3] else x.tobytes() for x in arrays)))
            if sum(len(r[5]) for r in rows) > _ASK_BYTES:
                yield from _table(_ASKED, rows).to_batches()
                rows = []
        if rows:
            yield from _table(_ASKED, rows).to_batches()

    def at_places(self, totals: np.ndarray, kept: np.ndarray, failed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Answers, given in the order of questions, at the places of the block that asked; ``failed`` are the frequent contexts that are no states."""
        if len(totals) != len(self.keys) or len(kept) != len(self.heads):
            raise ValueError("a part of the table did not answer")
        kept = np.where(self.frequent, ~np.isin(self.contexts, failed), kept)
        kept = np.repeat(kept, np.diff(np.append(self.heads, len(self.keys))))
        return totals[self.place], kept[self.place]


@dataclass
class Root:
    """The distribution of words without a context."""

    n_all: int = 0
    distinct: int = 0

    def p(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.1) / (self.n_all + 0.1 * (self.distinct + 1))


def _asker(level: int, parts: int, frequent: int, min_count: int, root: Root):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _Block(batch.slice(i, 1).to_pylist()[0], min_count, root)
                if level == 0 or len(b.at):
                    yield from _Grams(b, level, parts, frequent).asked(b.block)
                del b
                give_back()

    return run


def _answerer(weight: float, threshold: float, frequent: int, sure: int | None):
    """Adds up what blocks counted, and tests contexts that lie whole in this part; of frequent ones it gives the shares of their divergence, a bucket each."""

    def run(asked: pa.Table) -> pa.Table:
        asked = asked.combine_chunks()
        sizes, contexts, context_n, keys, counts, p = (
            np.concatenate([_unpacked(k, kind) for k in asked.column(c).to_pylist()]) if c == "keys" else _joined(asked.column(c), kind)
            for c, kind in (("sizes", "<i4"), ("contexts", "<u8"), ("context_n", "<i8"), ("keys", "<u8"), ("counts", "<i8"), ("p", "<u2"))
        )
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        place = np.empty(len(keys), np.int64)
        place[order] = np.cumsum(new) - 1
        first = order[new]
        totals = np.bincount(place, counts, len(first)).astype(np.int64)  # sums of doubles are exact below 2 ** 53
        which, group = np.unique(contexts, return_inverse=True)
        owner = np.repeat(group, sizes)[first]
        n = np.repeat(context_n, sizes)[first]
        tested = (totals > 0) & (n > 0)
        t, before, n = totals[tested], _fine(p[first[tested]]), n[tested]
        gain = t * np.log((t - 1 + weight * before) / ((n - 1 + weight) * before))
        kept = (np.bincount(owner[tested], gain, len(which)) > threshold)[group]
        if sure is not None:
            kept |= context_n > sure
        # Buckets are told apart by the upper bits of keys, so that shares do not depend on the number of parts.
        shared = np.flatnonzero(n > frequent)
        pairs = np.stack([which[owner[tested][shared]], ordered[new][tested][shared] >> np.uint64(40)], axis=1)
        buckets, at = np.unique(pairs, axis=0, return_inverse=True)
        shares = np.bincount(at.reshape(-1), gain[shared], len(buckets)).astype(float)
        if sure is not None:
            shares[np.bincount(at.reshape(-1), n[shared] > sure, len(buckets)) > 0] = np.inf
        out, a, i = [], 0, 0
        answers = totals[place]
        part = asked.column("part")[0].as_py()
        for block, m, g in zip(asked.column("block").to_pylist(), pc.binary_length(asked.column("counts")).to_pylist(), pc.binary_length(asked.column("sizes")).to_pylist()):
            m, g = m // 8, g // 4
            out.append((block, part, _packed(answers[a : a + m]), _packed(kept[i : i + g]), 0, 0, b"", b""))
            a, i = a + m, i + g
        out.append((-1, part, b"", b"", int(totals.sum()), int((totals > 0).sum()), np.ascontiguousarray(buckets[:, 0]).tobytes(), shares.tobytes()))
        return _table(_ANSWER, out)

    return run


def _failed(answers: DataFrame, threshold: float) -> np.ndarray:
    """Frequent contexts that are no states, by the sums of their buckets' shares; there is at most one for ``FREQUENT`` words of the corpus."""
    shares = defaultdict(list)
    for r in answers.where("block = -1 and length(contexts) > 0").select("contexts", "gains").toLocalIterator():
        for context, gain in zip(np.frombuffer(r.contexts, "<u8").tolist(), np.frombuffer(r.gains, "<f8").tolist()):
            shares[context].append(gain)
    return np.array([c for c, gains in shares.items() if not math.fsum(gains) > threshold], np.uint64)


def _taker(level: int, last: bool, parts: int, frequent: int, failed: np.ndarray, min_count: int, weight: float, root: Root):
    """Takes the answers of a level into a block: what the level settles is scored, the rest goes on."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        rows = sorted(answers.to_pylist(), key=lambda r: r["part"])
        for row in blocks.to_pylist():
            b = _Block(row, min_count, root)
            counts = None
            t, go_on, p = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.float32)
            if level == 0 or len(b.at):
                totals = np.concatenate([_unpacked(r["totals"], "<i8") for r in rows])
                kept = np.concatenate([_unpacked(r["kept"], "?") for r in rows])
                grams = _Grams(b, level, parts, frequent)
                t, go_on = grams.at_places(totals, kept, failed)
            if level == 0:
                counts = np.zeros(len(b.words), np.int64)
                counts[b.ids] = t
                b.at, p = np.arange(len(b.ids), dtype=np.int32), root.p(t)
                b.add("base", b.at, np.log10(p))
                b.add("known", b.at, (t > 0).astype(float))
                goes = b.first_level(t, min_count) & (not last)
            elif len(b.at):
                p = np.where(go_on, (t + weight * b.p.astype(float)) / (b.n + weight), b.p).astype(np.float32)
                seen = np.zeros(len(b.ids), np.int64)
                seen[b.at] = t
                n = seen[b.at - 1]  # how often the context one word longer was seen
                goes = go_on & (b.depth[b.at] > level) & (n >= min_count) & (not last)
            else:
                goes = go_on
            b.add("score", b.at[~goes], np.log10(p[~goes].astype(float)))
            if last:
                for row_id, doc_id, null, train, skip, size, known, base, score in b.docs.tolist():
                    out.append((row_id, None if null else doc_id, train, size - skip, known, base, score))
                continue
            if level > 0:
                b.at, b.p = b.at[goes], p[goes]
                b.n = n[goes] if len(goes) else np.zeros(0, np.int64)
            out.append(b.stored(counts))
        give_back()
        return _table(_RESULT if last else _STATE, out)

    return run


def score_texts(
    docs: DataFrame, train: Column, depth: int = DEPTH, min_count: int = MIN_COUNT, threshold: float = THRESHOLD, weight: float = WEIGHT, sure: int | None = None, block: int = BLOCK, frequent: int = FREQUENT
) -> DataFrame:
    """Scores of whole texts of ``docs`` (doc_id, text) by a tree learned from the rows where ``train`` is true.

    Returns doc_id, train, n_tokens, n_known, train_tokens, base_score and score, a row for
    every row, repeated ones included. Tokens are a text's words, A-Z lower-cased and cut at
    ASCII white space, and an end, so a null or empty text has one token. base_score uses the root alone. Both are sums of log10. A null ``train`` is
    false; contexts seen more than ``sure`` times, if given, are states untested;
    ``frequent`` is the count from which a context's n-grams are dealt in buckets, and changes no result; without training rows every word is the unknown one, of probability 1. Texts
    of any length go over several blocks. Other columns are ignored. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.coalesce(train, F.lit(False)).alias("train"))
    state = written(rows.mapInArrow(_cutter(depth, block), _STATE), "words")
    parts = 1 + (state.agg(F.sum("size")).first()[0] or 0) // PART
    with _small_batches(docs.sparkSession):
        return _scored(state, parts, depth, min_count, threshold, weight, sure, frequent)


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Sends few rows to Python at once, as each holds a block."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _scored(state: DataFrame, parts: int, depth: int, min_count: int, threshold: float, weight: float, sure: int | None, frequent: int) -> DataFrame:
    """Scores of the texts in the blocks ``state``, level by level; every level's tables are written."""
    root, held = Root(), [state]
    for level in range(depth + 1):
        asked = state.mapInArrow(_asker(level, parts, frequent, min_count, root), _ASKED)
        answers = written(asked.groupBy("part").applyInArrow(_answerer(weight, threshold, frequent, sure), _ANSWER), "answers")
        if level == 0:
            root = Root(*(x or 0 for x in answers.where("block = -1").agg(F.sum("n_total"), F.sum("n_distinct")).first()))
        last = level == depth
        failed = _failed(answers, threshold) if level else np.zeros(0, np.uint64)
        take = _taker(level, last, parts, frequent, failed, min_count, weight, root)
        after = []
        for i in range(TURNS):  # blocks take turns, so that the copies of them on the way to their answers are a fraction
            mine, theirs = (t.where(F.pmod("block", F.lit(TURNS)) == i).groupBy("block") for t in (state, answers.where("block >= 0")))
            after.append(written(mine.cogroup(theirs).applyInArrow(take, _RESULT if last else _STATE), "scores" if last else "grown"))
        for table in (*held, answers):
            remove(table)
        held, state = after, reduce(DataFrame.unionByName, after)
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    out = state.groupBy("row", "doc_id", "train").agg(*sums)
    return out.select("doc_id", "train", "n_tokens", "n_known", F.lit(root.n_all).cast("long").alias("train_tokens"), "base_score", "score")
