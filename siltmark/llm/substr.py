"""Passages that documents share, found by collinear chaining of k-mer seeds and alignment."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.operators.ordered import carried
from siltmark.operators.ranking import running_total
from siltmark.plans.session import remove, ship_package, written

K = 5
WINDOW = 4
MIN_WORDS = 50
SIMILARITY = 0.8
#: A chain pays so much for each word that it skips on either side.
GAP_COST = 0.05
#: Words taken on both sides of a chain, over which a passage may go on, and of a single seed. Their seeds may have an earlier holder.
MARGIN, SINGLE_MARGIN = 256, 64
#: Seeds are matched in so many parts, one after the other, so that shuffles of one part at a time are on disk.
PARTS = 4
#: A document's chains are cut by so many a task, and aligned by so many words of the later document at a time.
TASK_CHAINS, HELD_WORDS = 4096, 4096
#: Seeds that two documents share for a comparison beyond least holders.
AGAIN = 2
#: Seeds are taken of texts of about so many words at a time.
SEED_WORDS = 100_000
#: Growing ends go on after a mismatch if words agree again within so many, and stop after so many words that don't agree.
REACH, LOST = 8, 10
#: So many words are tried first when an end grows.
NEAR = 32
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, cut at ASCII white space."""
    return (text or "").encode("utf-8", "replace").lower().split()


def seeds_of(texts: list[list[bytes]], k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, hash, place) of the k-mers of each text that are least in one of its windows of ``window`` k-mers.

    A text of fewer k-mers is one window. Two texts that share ``window + k - 1`` words in a row share a seed there. The second
    and later occurrences of a k-mer in a text are seeds of their own too (hashed with their
    number), so that texts that repeat a phrase are matched occurrence by occurrence.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    words = [w for t in texts for w in t]
    none = np.zeros(0, np.int64)
    if len(words) < k:
        return none, none.view(np.uint64), none
    single = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    run = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    n = len(words) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h ^ single[i : i + n]) * _MULTIPLIERS[i % len(_MULTIPLIERS)]
        h ^= h >> np.uint64(29)
    run, at = run[:n], at[:n]
    begin = np.cumsum(sizes) - sizes
    inside = max(0, n - window + 1)
    starts = np.zeros(inside, np.int32)  # windows that lie in one text
    whole = np.flatnonzero(sizes >= k + window - 1)
    np.add.at(starts, begin[whole], 1)
    ends = begin[whole] + sizes[whole] - k - window + 2
    np.add.at(starts, ends[ends < inside], -1)
    starts = np.cumsum(starts) > 0
    least = h[:inside].copy()
    for d in range(1, window):
        np.minimum(least, h[d : d + inside], out=least)
    chosen = np.zeros(n, bool)
    for d in range(window):
        chosen[d : d + inside] |= (h[d : d + inside] == least) & starts
    for i in np.flatnonzero((sizes >= k) & (sizes < k + window - 1)).tolist():
        own = slice(int(begin[i]), int(begin[i] + sizes[i]) - k + 1)
        chosen[own] = h[own] == h[own].min()
    pick = np.flatnonzero(chosen)
    run, at, h = run[pick], at[pick], h[pick]
    order = np.lexsort((h, run))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (run[order][1:] != run[order][:-1])] if len(order) else np.zeros(0, bool)
    if new.all():
        return run, h, at
    number = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    later = order[number > 0]
    again = (h[later] ^ number[number > 0].astype(np.uint64) * _MULTIPLIERS[0]) * _MULTIPLIERS[1]
    return np.concatenate([run, run[later]]), np.concatenate([h, again]), np.concatenate([at, at[later]])


class Fenwick:
    """Largest value over a prefix of places, with the item that holds it."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, at: int, value: float, item: int) -> None:
        at += 1
        while at < len(self.best):
            if self.best[at][0] < value:
                self.best[at] = (value, item)
            at += at & -at

    def before(self, at: int) -> tuple[float, int]:
        out = (-1e18, -1)
        while at:
            if self.best[at][0] > out[0]:
                out = self.best[at]
            at -= at & -at
        return out


def chains(b: np.ndarray, a: np.ndarray, k: int = K, gap_cost: float = GAP_COST) -> list[list[int]]:
    """Collinear chains of matches (b[i], a[i]), best first; each match lies in one chain at most.

    A chain rises in both texts. It scores k for each match less ``gap_cost`` for each word
    between matches on either side. As that cost is a difference of sums of places, the best
    predecessor of a match is a prefix maximum over places in ``a``, kept in a Fenwick tree
    while matches are taken by place in ``b``.
    """
    order = np.lexsort((-a, b)).tolist()
    places = {v: i for i, v in enumerate(np.unique(a).tolist())}
    tree = Fenwick(len(places))
    bs, az = b.tolist(), a.tolist()
    score, parent = [0.0] * len(bs), [-1] * len(bs)
    waiting: list[int] = []
    for i in order:
        if waiting and bs[waiting[0]] != bs[i]:
            for j in waiting:
                tree.put(places[az[j]], score[j] + gap_cost * (bs[j] + az[j]), j)
            waiting = []
        value, j = tree.before(places[az[i]])
        joined = value - gap_cost * (bs[i] + az[i]) if j >= 0 else 0.0
        score[i] = k + max(0.0, joined)
        parent[i] = j if joined > 0 else -1
        waiting.append(i)
    used = [False] * len(bs)
    out = []
    for i in sorted(range(len(bs)), key=lambda i: (-score[i], bs[i], az[i])):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = parent[i]
        if chain:
            out.append(chain[::-1])
    return out


def common(x: list[bytes], y: list[bytes]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if x == y:
        return len(x)
    if not x or not y:
        return 0
    masks: dict[bytes, int] = {}
    for i, w in enumerate(x):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for w in y:
        hit = row & masks.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(x) - row.bit_count()


def _hop(x: list[bytes], i: int, y: list[bytes], j: int) -> tuple[int, int] | None:
    """The least numbers of words to pass over from x[i] and y[j] on, up to ``REACH``, behind which words agree again.

    Where the numbers differ two words have to agree; of equally large ones those that differ least come first.
    """
    near_x, near_y = x[i : i + REACH + 1], y[j : j + REACH + 1]
    if set(near_x).isdisjoint(near_y):
        return None
    n_x, n_y = len(near_x), len(near_y)
    for m in range(1, min(REACH + 1, max(n_x, n_y))):
        a, b = near_x[m] if m < n_x else None, near_y[m] if m < n_y else None
        if a is not None and a == b:
            return m, m
        with_b, with_a = b is not None and b in near_x[:m], a is not None and a in near_y[:m]
        if with_a or with_b:
            for p in range(m - 1, -1, -1):
                if with_b and p < n_x and near_x[p] == b and x[i + p : i + p + 2] == y[j + m : j + m + 2]:
                    return p, m
                if with_a and p < n_y and near_y[p] == a and x[i + m : i + m + 2] == y[j + p : j + p + 2]:
                    return m, p
    return None


def grow(x: list[bytes], y: list[bytes], similarity: float = SIMILARITY) -> list[tuple[int, int, int]]:
    """Where a passage may end in ``x`` and in ``y``, with the words in common up to there, from their starts on.

    Every end follows an equal word. Words that differ are passed over, the fewest first; where
    the lengths passed over differ, two words have to agree behind them. A run of equal words
    makes up for as many others as ``similarity`` allows, and ``LOST`` others are borne in advance.
    """
    i = j = n = 0
    price = similarity / max(1e-9, 1 - similarity)
    score = best = 0.0
    ends = [(0, 0, 0)]
    n_x, n_y = len(x), len(y)
    while True:
        start = i
        while i < n_x and j < n_y and x[i] == y[j]:
            i, j = i + 1, j + 1
        if i > start:
            n += i - start
            score += i - start
            best = max(best, score)
            ends.append((i, j, n))
        hop = _hop(x, i, y, j)
        if hop is None:
            return ends
        score -= price * max(hop)
        if score < best - price * LOST:
            return ends
        i, j = i + hop[0], j + hop[1]


def grow_near(near: Callable[[int], tuple[list[bytes], list[bytes]]], n_x: int, n_y: int, similarity: float = SIMILARITY) -> list[tuple[int, int, int]]:
    """``grow`` over texts of ``n_x`` and ``n_y`` words, of which ``near(n)`` gives the first n: most ends lie near, and no word behind their reach is looked at."""
    n = NEAR
    while True:
        ends = grow(*near(n), similarity)
        i, j, _ = ends[-1]
        if (n >= n_x or i + REACH + 2 <= n) and (n >= n_y or j + REACH + 2 <= n):
            return ends
        n = max(n_x, n_y)


def align(wb: list[bytes], wa: list[bytes], b: list[int], a: list[int], k: int = K, similarity: float = SIMILARITY, min_words: int = 0) -> list[tuple[int, int, int, int, int]]:
    """Passages (b start, b end, a start, a end, words in common) of a chain of matches, those that can't reach ``min_words`` left out.

    Words between matches are aligned by their longest common subsequence. Where more than
    ``2 * k`` words lie between two matches and under half of them agree, the chain is cut.
    Ends grow over equal words, and over others as long as ``similarity`` of the passage is kept.
    """
    out = []
    start_b, start_a, end_b, end_a = b[0], a[0], b[0] + k, a[0] + k
    same = k

    def close() -> None:
        lefts = grow_near(lambda n: (wb[max(0, start_b - n) : start_b][::-1], wa[max(0, start_a - n) : start_a][::-1]), start_b, start_a, similarity)
        rights = grow_near(lambda n: (wb[end_b : end_b + n], wa[end_a : end_a + n]), len(wb) - end_b, len(wa) - end_a, similarity)
        if end_b - start_b + lefts[-1][0] + rights[-1][0] < min_words:
            return
        # Growth over equal words alone is the second end at most, and the least that is taken.
        best = None
        for lb, la, ln in reversed(lefts):
            for rb, ra, rn in reversed(rights):
                size, n = end_b - start_b + lb + rb, same + ln + rn
                if best and size <= best[1] - best[0]:
                    break
                if n >= similarity * max(size, end_a - start_a + la + ra):
                    best = (start_b - lb, end_b + rb, start_a - la, end_a + ra, n)
                    break
        if best is None:
            lb, rb = 0, 0
            while lb < min(start_b, start_a) and wb[start_b - lb - 1] == wa[start_a - lb - 1]:
                lb += 1
            while end_b + rb < len(wb) and end_a + rb < len(wa) and wb[end_b + rb] == wa[end_a + rb]:
                rb += 1
            best = (start_b - lb, end_b + rb, start_a - lb, end_a + rb, same + lb + rb)
        out.append(best)

    for nb, na in zip(b[1:], a[1:]):
        if nb < end_b or na < end_a:  # overlaps the match before: only a shift of both by the same adds words
            if nb - end_b == na - end_a:
                same += nb + k - end_b
                end_b, end_a = nb + k, na + k
            continue
        gap_b, gap_a = wb[end_b:nb], wa[end_a:na]
        n, longest = common(gap_b, gap_a), max(len(gap_b), len(gap_a))
        if longest > 2 * k and 2 * n < longest:
            close()
            start_b, start_a, same = nb, na, 0
        else:
            same += n
        same += k
        end_b, end_a = nb + k, na + k
    close()
    return out


def _seeder(k: int, window: int, place_bits: int):
    schema = pa.schema([("seed", pa.int64()), ("at", pa.int64()), ("part", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, n = np.asarray(batch.column(0)), [], 0
            for i, text in enumerate(batch.column(1)):
                texts.append(words_of(text.as_py()))
                n += len(texts[-1])
                if n > SEED_WORDS or i == batch.num_rows - 1:
                    own, h, at = seeds_of(texts, k, window)
                    at = at + (docs[i - len(texts) + 1 :][own] << place_bits)
                    yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(at), pa.array((h % np.uint64(PARTS)).astype(np.int32))], schema=schema)
                    texts, n = [], 0

    return run


def _chainer(k: int):
    """Chains of each pair of documents, whose matches stand in neighbouring rows, by place."""
    lists = pa.list_(pa.int32())
    schema = pa.schema([("b_doc", pa.int64()), ("a_doc", pa.int64()), ("b", lists), ("a", lists)])

    def of_pairs(ids: list[np.ndarray], b: np.ndarray, a: np.ndarray, cut: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, sizes = int(cut[-1]), np.diff(cut)
        if not n:
            return
        ids, b, a = [x[:n] for x in ids], b[:n], a[:n]
        # On one diagonal, with steps that cost less than a match scores, a pair's matches are one chain: each step raises the score.
        straight = np.ones(n, bool)
        step = b[1:] - b[:-1]
        straight[1:] = (step == a[1:] - a[:-1]) & (step > 0) & (2 * GAP_COST * step < k)
        straight[cut[:-1]] = True
        plain = np.logical_and.reduceat(straight, cut[:-1])
        if plain.any():
            rows = np.repeat(plain, sizes)
            offsets = pa.array(np.r_[0, np.cumsum(sizes[plain])].astype(np.int32))
            whole = [pa.ListArray.from_arrays(offsets, pa.array(x[rows].astype(np.int32))) for x in (b, a)]
            yield pa.record_batch([*(pa.array(x[cut[:-1][plain]]) for x in ids), *whole], schema=schema)
        out: list[tuple] = []
        for s, e in zip(cut[:-1][~plain].tolist(), cut[1:][~plain].tolist()):
            for chain in chains(b[s:e], a[s:e], k):
                at = s + np.array(chain)
                out.append((*(int(x[s]) for x in ids), b[at], a[at]))
            if len(out) >= 2000:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(c) for c in batch.columns]
            if rest is not None:
                columns = [np.concatenate(c) for c in zip(rest, columns)]
            new = np.zeros(len(columns[0]) + 1, bool)
            new[[0, -1]] = True
            for x in columns[:2]:
                new[1:-1] |= x[1:] != x[:-1]
            cut = np.flatnonzero(new)
            # The last pair may go on in the next batch.
            rest = [x[cut[-2] :] for x in columns]
            yield from of_pairs(columns[:2], columns[2].astype(np.int64), columns[3].astype(np.int64), cut[:-1])
        if rest is not None:
            yield from of_pairs(rest[:2], rest[2].astype(np.int64), rest[3].astype(np.int64), np.array([0, len(rest[0])]))

    return run


_CHAIN = ("b_doc", "a_doc", "b", "a")


def _slicer(k: int):
    """Cuts the words of a chain, and some on both sides, out of the earlier document's text, which stands before its chains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[bytes] = []
        for batch in batches:
            texts = batch.column("text")
            is_text = np.asarray(texts.is_valid())
            chained = batch.filter(pa.array(~is_text))
            lists = chained.column("a")
            sizes = np.asarray(lists.value_lengths())
            values, ends = np.asarray(lists.flatten()), np.cumsum(sizes)
            low, high = values[ends - sizes] if len(sizes) else values, values[ends - 1] if len(sizes) else values
            margin = np.where(sizes > 1, MARGIN, SINGLE_MARGIN)
            first = np.maximum(0, low - margin).astype(np.int32)
            bounds = zip(first.tolist(), (high + k + margin).tolist())
            cut = []
            for row in np.split(np.arange(batch.num_rows), np.flatnonzero(is_text)):
                if len(row) and is_text[row[0]]:
                    words = words_of(texts[int(row[0])].as_py())
                    row = row[1:]
                for _ in range(len(row)):
                    start, end = next(bounds)
                    cut.append(b" ".join(words[start:end]))
            if cut:
                yield pa.record_batch([*(chained.column(c) for c in _CHAIN), pa.array(first), pa.array(cut, pa.binary())], names=[*_CHAIN, "first", "words"])

    return run


def _column(values: pa.Array) -> list:
    """``to_pylist`` without a scalar for each value; nulls of numbers are 0, those of lists are empty."""
    if pa.types.is_list(values.type):
        flat = np.asarray(values.flatten()).tolist()
        ends = np.append(0, np.cumsum(np.asarray(values.value_lengths().fill_null(0)))).tolist()
        return [flat[s:e] for s, e in zip(ends, ends[1:])]
    if pa.types.is_integer(values.type):
        return np.asarray(values.fill_null(0)).tolist()
    return values.to_numpy(zero_copy_only=False).tolist()


def _aligner(k: int, min_words: int, similarity: float):
    """Aligns each chain's words of the earlier document with the later document's text, which stands before its chains."""
    names = ["b_doc", "a_doc", "start", "end", "ref_start", "ref_end", "n_words", "similarity"]
    kinds = [*[pa.int64()] * 7, pa.float64()]

    def passages(doc: int, whole: list[bytes], held: list[tuple], done: dict) -> Iterator[tuple]:
        """Longest chains first; a chain within a passage of its pair adds nothing."""
        for a_doc, b, a, first, cut in sorted(held, key=lambda h: (-len(h[1]), h[:3])):
            spans = done.setdefault(a_doc, [])
            if any(s <= b[0] and b[-1] + k <= e for s, e in spans):
                continue
            wa = cut.split(b" ")
            a = [x - first for x in a]
            low = max(0, b[0] - 2 * MARGIN)
            wb, b = whole[low : b[-1] + k + 2 * MARGIN], [x - low for x in b]
            for sb, eb, sa, ea, n in align(wb, wa, b, a, k, similarity, min_words):
                share = n / max(eb - sb, ea - sa)
                if eb - sb >= min_words and share >= similarity:
                    spans.append((low + sb, low + eb))
                    yield doc, a_doc, low + sb, low + eb, first + sa, first + ea, eb - sb, share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, words, done, held, out = None, [], {}, [], []
        for batch in batches:
            columns = [_column(batch.column(c)) for c in _CHAIN] + [_column(batch.column(c)) for c in ("first", "words")]
            texts = batch.column("text")
            is_text = np.asarray(texts.is_valid()).tolist()
            for i, (b_doc, a_doc, b, a, first, cut) in enumerate(zip(*columns)):
                # Chains come by place; so many words of them are held at once.
                if held and (is_text[i] or b[0] >= held[0][1][0] + HELD_WORDS):
                    out += passages(doc, words, held, done)
                    held = []
                if is_text[i]:
                    doc, words, done = b_doc, words_of(texts[i].as_py()), {}
                else:
                    held.append((a_doc, b, a, first, cut))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out = []
        out += passages(doc, words, held, done) if held else []
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return run


def _documents(docs: DataFrame) -> tuple[DataFrame, int, int | DataFrame]:
    """(doc, text) of the documents of ``docs``, each once; the bits that a place in a text needs; and what doc stands for.

    doc is a number from 0 in the order of doc_ids. Where each doc_id has one text and their range leaves
    room for places in a long, it is the distance from the least doc_id, which is returned. Otherwise
    documents are numbered in the order of doc_id and a hash of the text, and a table (doc, doc_id, text_key) is returned.
    """
    rows = docs.where("doc_id is not null and text is not null")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text"))
    by_id = rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("size"))
    by_id = by_id.groupBy("doc_id").agg(F.max("n").alias("n"), F.count("*").alias("texts"), F.max("size").alias("size"))
    found = by_id.agg(*[f(c).alias(a) for f, c, a in ((F.max, "n", "n"), (F.max, "texts", "texts"), (F.max, "size", "size"), (F.min, "doc_id", "low"), (F.max, "doc_id", "high"))]).first()
    if (found.n or 0) > 1:
        rows = rows.groupBy("doc_id", "text_key").agg(F.min("text").alias("text"))
    place_bits = ((found["size"] or 0) // 2 + 1).bit_length()
    if (found.texts or 0) <= 1 and (((found.high or 0) - (found.low or 0)) + 1 << place_bits) < 1 << 63:
        low = found.low or 0
        return rows.select((F.col("doc_id") - low).alias("doc"), "text"), place_bits, low
    names = rows.select("doc_id", "text_key", F.lit(1).alias("one")).distinct()
    names = written(running_total(names, [F.col("doc_id"), F.col("text_key")], "one", "doc").select("doc", "doc_id", "text_key"), "names")
    numbered = rows.join(names.toDF("doc", "_id", "_key"), (F.col("doc_id") == F.col("_id")) & (F.col("text_key") == F.col("_key")))
    return written(numbered.select("doc", "text"), "numbered"), place_bits, names


def shared_passages(docs: DataFrame, k: int = K, window: int = WINDOW, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Passages of ``docs`` (doc_id, text) that repeat an earlier document.

    Returns (doc_id, ref_doc_id, start, end, ref_start, ref_end, n_words, similarity):
    words start to end of doc_id (counted from 0, the end exclusive) align with words
    ref_start to ref_end of ref_doc_id, n_words is the length of doc_id's passage, and
    similarity is the number of words in common over those of the longer side. Passages have ``min_words`` words and
    ``similarity`` at least. The earlier document is the one with the least doc_id that
    holds a seed, so a passage in m documents gives m - 1 rows, not a row a pair.

    Seeds are winnowed k-mers of lower-cased words. Null texts and texts shorter than k
    words have none. Rows with a null doc_id take no part, as nothing could refer to them.
    Rows with one doc_id and one text are one document; rows with one doc_id and different texts are documents
    of their own that don't match each other. Other columns are ignored; an empty table gives an empty result.

    Two texts that share ``window + k - 1`` words in a row share a seed; a single seed is enough
    for a candidate, and its ends grow over words that differ. What is in no passage then, though
    earlier documents hold its seeds, is compared once more with the nearest of these, of which two seeds are asked.

    The least holder of each seed comes from a partial aggregation; joining it back uses a
    join that adaptive execution splits where a seed is very frequent. This is done for one
    part of the seeds after the other. Then texts and chains are sorted together, so that a text
    is sent to its chains once and is split into words once: first the earlier document's, out of which the words of each
    chain are cut (a document with very many chains is sent to several tasks), then the later document's, with which they are
    aligned, a stretch of its words at a time.
    """
    return _passages(docs, k, window, min_words, similarity).drop("text_key").distinct()


def _passages(docs: DataFrame, k: int = K, window: int = WINDOW, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``shared_passages`` with the hash of the later document's text (``text_key``; null if doc_id is enough); a passage may stand in several rows."""
    spark = docs.sparkSession
    ship_package(spark)
    rows, place_bits, names = _documents(docs)
    seeds = written(rows.mapInArrow(_seeder(k, window, place_bits), "seed long, at long, part int"), "seeds", by="part")
    matched = []
    for i in range(PARTS):
        matched.append(_matches(seeds.where(F.col("part") == i).drop("part"), place_bits))
        remove(seeds, f"part={i}")
    remove(seeds)
    found = _chained(reduce(DataFrame.unionByName, matched), k)
    for table in matched:
        remove(table)
    out = _passages_of(found, rows, k, min_words, similarity)
    later = _second_holders(found, out)
    remove(found)
    named = later.select("b_doc").unionByName(later.select(F.col("a_doc").alias("b_doc"))).distinct()
    few = rows.join(_sized(written(named, "named")), F.col("doc") == F.col("b_doc"), "left_semi")
    again = _chained(later, k)
    remove(later)
    out = out.unionByName(_passages_of(again, few, k, min_words, similarity))
    remove(again)
    spans = ["start", "end", "ref_start", "ref_end", "n_words", "similarity"]
    if not isinstance(names, DataFrame):
        return out.select((F.col("b_doc") + names).alias("doc_id"), F.lit(None).cast("long").alias("text_key"), (F.col("a_doc") + names).alias("ref_doc_id"), *spans)
    out = out.join(names.toDF("b_doc", "doc_id", "text_key"), "b_doc").join(names.select(F.col("doc").alias("a_doc"), F.col("doc_id").alias("ref_doc_id")), "a_doc")
    return out.where("ref_doc_id < doc_id").select("doc_id", "text_key", "ref_doc_id", *spans)


def _chained(matches: DataFrame, k: int) -> DataFrame:
    """Chains (b_doc, a_doc, b, a) of matches (b_doc, b, a_doc, a) of two documents, written."""
    ordered = matches.repartition("b_doc", "a_doc").sortWithinPartitions("b_doc", "a_doc", "b", "a")
    return written(ordered.select(*_CHAIN).mapInArrow(_chainer(k), "b_doc long, a_doc long, b array<int>, a array<int>"), "chains")


def _passages_of(found: DataFrame, rows: DataFrame, k: int, min_words: int, similarity: float) -> DataFrame:
    """Passages of chains, written."""
    hot = found.groupBy(F.col("a_doc").alias("hot")).agg(F.ceil(F.count("*") / TASK_CHAINS).cast("int").alias("tasks")).where("tasks > 1")
    hot = written(hot, "hot")
    return written(_aligned(found, rows, hot, k, min_words, similarity), "passages")


def _second_holders(found: DataFrame, passages: DataFrame) -> DataFrame:
    """Matches of the chained seeds that no passage covers with the nearest earlier document that holds them too, written.

    The least holders of a passage's seeds may be several documents that hold parts of it, each too short. What
    is left over then meets the document before it among the holders of each seed, however many there are;
    matches of the same two documents come along. Two documents need ``AGAIN`` seeds for this.
    """
    matches = found.select("b_doc", "a_doc", F.inline(F.arrays_zip("b", "a")))
    spans = passages.groupBy(F.col("b_doc").alias("s_doc")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    covered = F.coalesce(F.exists("spans", lambda s: (F.col("b") >= s["start"]) & (F.col("b") < s["end"])), F.lit(False))
    joined = matches.join(_sized(written(spans, "spans")), F.col("b_doc") == F.col("s_doc"), "left")
    left = written(joined.where(~covered).select("b_doc", "b", "a_doc", "a"), "left")
    # A seed is known by the place of its least holder.
    known = _sized(written(left.select("a_doc", "a").distinct(), "known"))
    holders = matches.join(known, ["a_doc", "a"], "left_semi").groupBy("a_doc", "a", "b_doc").agg(F.min("b").alias("b"))
    before = carried(holders, ["a_doc", "a"], ["b_doc"], {"before": F.struct("b_doc", "b")}, before=True).where("before is not null")
    new = left.join(before.select("a_doc", "a", "b_doc", "before"), ["a_doc", "a", "b_doc"])
    new = new.select("b_doc", "b", F.col("before.b_doc").alias("a_doc"), F.col("before.b").alias("a"))
    new = written(new, "again")
    pairs = new.groupBy("b_doc", "a_doc").agg(F.count("*").alias("n")).where(F.col("n") >= AGAIN).drop("n")
    out = written(new.unionByName(left).join(pairs, ["b_doc", "a_doc"], "left_semi").select("b_doc", "b", "a_doc", "a"), "again")
    remove(left)
    remove(new)
    return out


def _sized(table: DataFrame, most: int = 1 << 20) -> DataFrame:
    """A written table of small rows, to be sent to every task if it has at most ``most`` of them."""
    return F.broadcast(table) if table.count() <= most else table


def _aligned(found: DataFrame, rows: DataFrame, hot: DataFrame, k: int, min_words: int, similarity: float) -> DataFrame:
    """Passages of chains: (b_doc, a_doc, start, end, ref_start, ref_end, n_words, similarity)."""
    shape = "b_doc long, a_doc long, b array<int>, a array<int>"
    task = F.when(F.col("tasks").isNull(), 0).otherwise(F.pmod(F.xxhash64("b_doc"), F.col("tasks"))).cast("int")
    cuts = found.join(hot, F.col("a_doc") == F.col("hot"), "left").select(*_CHAIN, task.alias("task"))
    sent = rows.join(hot, F.col("doc") == F.col("hot"), "left")
    sent = sent.select(F.col("doc").alias("a_doc"), "text", F.explode(F.sequence(F.lit(0), F.coalesce("tasks", F.lit(1)) - 1)).alias("task"))
    cuts = cuts.unionByName(sent, allowMissingColumns=True).repartition("a_doc", "task").sortWithinPartitions("a_doc", "task", F.col("text").isNull())
    slices = cuts.select(*_CHAIN, "text").mapInArrow(_slicer(k), f"{shape}, first int, words binary")
    later = rows.select(F.col("doc").alias("b_doc"), "text")
    pairs = slices.unionByName(later, allowMissingColumns=True).repartition("b_doc").sortWithinPartitions("b_doc", F.col("text").isNull(), F.col("b")[0])
    return pairs.mapInArrow(_aligner(k, min_words, similarity), "b_doc long, a_doc long, start long, end long, ref_start long, ref_end long, n_words long, similarity double")


def _matches(seeds: DataFrame, place_bits: int) -> DataFrame:
    """(b_doc, b, a_doc, a): each seed of ``seeds`` (seed, at: document and place in one number) with its least holder, if that is another document."""
    doc = F.shiftright("at", place_bits)
    place = F.col("at").bitwiseAND(F.lit((1 << place_bits) - 1)).cast("int")
    first = seeds.groupBy(F.col("seed").alias("s")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    first = first.where(F.shiftright("last", place_bits) > F.shiftright("first", place_bits)).drop("last")
    first = written(first, "first")  # so that the join deals both sides itself, and may split frequent seeds
    matches = seeds.join(first, (F.col("seed") == F.col("s")) & (doc > F.shiftright("first", place_bits)))
    first_place = F.col("first").bitwiseAND(F.lit((1 << place_bits) - 1)).cast("int")
    out = written(matches.select(doc.alias("b_doc"), F.shiftright("first", place_bits).alias("a_doc"), place.alias("b"), first_place.alias("a")), "matches")
    remove(first)
    return out


def without_passages(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the passages of ``shared_passages`` taken out of text; the earliest copy stays.

    A passage goes with the white space after its words; other columns are kept as they are.
    """
    spans = _passages(docs, **options).groupBy(F.col("doc_id").alias("_sm_id"), F.col("text_key").alias("_sm_key"))
    spans = spans.agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_sm_spans"))
    joined = docs.join(spans, (F.col("doc_id") == F.col("_sm_id")) & (F.coalesce("_sm_key", F.xxhash64("text")) == F.xxhash64("text")), "left").drop("_sm_id", "_sm_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [_cut(t, s) if s else t for t, s in zip(batch.column(at).to_pylist(), batch.column("_sm_spans").to_pylist())]
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.record_batch(columns[:-1], names=batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)


def _cut(text: str, spans: list[dict]) -> str:
    gone = np.zeros(len(words_of(text)) + 1, bool)
    for s in spans:
        gone[s["start"] : s["end"]] = True
    out, word = [], -1
    for piece in _PIECES.findall(text):
        word += not piece[0] in _SPACES
        if word < 0 or not gone[word]:
            out.append(piece)
    return "".join(out)


_SPACES = " \t\n\v\f\r"
_PIECES = re.compile(r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+")
