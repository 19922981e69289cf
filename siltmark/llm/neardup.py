"""SimHash near-duplicates through an inverted index over the positions of fingerprint bytes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.llm.components import connected_components
from siltmark.plans.session import ship_package, written

SHINGLE = 4
MAX_BITS = 4
#: Runs up to this length are compared by shifts of the whole partition, longer ones each by a search.
SHORT_RUN = 24
#: Posting lists of more fingerprints than this are posted again, by more positions.
LONG_RUN = 4096
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)
_BYTE_BASE = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text as a signed long; see ``near_duplicates``."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        pieces = [whole]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-1].tolist()]
        pieces = [whole[a : b - 1] for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in pieces), dtype="<u8", count=len(pieces))
    places = hashes.view(np.uint8).reshape(-1, 8) + _BYTE_BASE
    ones = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = (2 * ones > len(pieces)).ravel()
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little", signed=True)


def _fingerprints(shingle: int):
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], schema=schema)

    return run


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component) that connect what the links (a, b) connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        np.minimum.at(least, label[x], label[y])
        np.minimum.at(least, label[y], label[x])
        least = np.minimum(least, least[label])
        while (jump := least[least]).any() and not np.array_equal(jump, least):
            least = jump
        if np.array_equal(least, label):
            break
        label = least
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _close(x: np.ndarray, y: np.ndarray, max_bits: int) -> np.ndarray:
    """Tallies the bytes that pairs share in place; pairs with enough of them are verified bit by bit."""
    differ = x ^ y
    shared = (np.ascontiguousarray(differ).view(np.uint8).reshape(*differ.shape, 8) == 0).sum(axis=-1)
    near = shared >= 8 - max_bits
    near[near] = np.bitwise_count(differ[near]) <= max_bits
    return near


def search_run(fps: np.ndarray, max_bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect all fingerprints of one posting list that are linked.

    Fingerprints that are reached once are compared no more, so a list of near copies
    costs about its length, and no more links than fingerprints come out.
    """
    a, b = [], []
    rest = fps
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            some, front = front[:64], front[64:]
            near = _close(np.broadcast_to(some[:, None], (len(some), len(rest))), np.broadcast_to(rest[None, :], (len(some), len(rest))), max_bits)
            got = near.any(axis=0)
            if got.any():
                a.append(rest[got])
                b.append(some[near.argmax(axis=0)[got]])
                front = np.concatenate([front, rest[got]])
                rest = rest[~got]
    return a, b


def _links_of_lists(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node) that connect what is linked in posting lists, whose rows stand side by side."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    longest = np.repeat(sizes, sizes)
    short = (longest > 1) & (longest <= SHORT_RUN)
    key_s, fp_s = key[short], fp[short]
    for d in range(1, SHORT_RUN):
        at = np.flatnonzero(key_s[d:] == key_s[:-d])
        if not len(at):
            break
        at = at[_close(fp_s[at], fp_s[at + d], max_bits)]
        a.append(fp_s[at])
        b.append(fp_s[at + d])
    for s, n in zip(starts[sizes > SHORT_RUN].tolist(), sizes[sizes > SHORT_RUN].tolist()):
        more_a, more_b = search_run(fp[s : s + n], max_bits)
        a += more_a
        b += more_b
    if not a or not sum(map(len, a)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))


def _linker(max_bits: int, long_run: int | None):
    """Searches posting lists as they come, sorted by key; lists of more than ``long_run`` are passed on instead, as (a, key)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])

    def links(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, root = _links_of_lists(key, fp, max_bits)
        if len(node):
            yield pa.record_batch([pa.array(node), pa.array(root), pa.nulls(len(node), pa.int64())], schema=schema)

    def passed_on(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key):
            yield pa.record_batch([pa.array(fp.view(np.int64)), pa.nulls(len(key), pa.int64()), pa.array(key)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        long_key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            more, fps = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64)
            if long_key is not None:  # the long list may go on
                n = int(np.searchsorted(more != long_key, True))
                yield from passed_on(more[:n], fps[:n])
                more, fps = more[n:], fps[n:]
                if not len(more):
                    continue
                long_key = None
            key, fp = np.concatenate([key, more]), np.concatenate([fp, fps])
            last = len(key) - int(np.searchsorted(key[::-1] != key[-1], True))
            done, done_fp, key, fp = key[:last], fp[:last], key[last:], fp[last:]
            if long_run is not None and len(done):
                size = np.diff(np.flatnonzero(np.r_[True, done[1:] != done[:-1], True]))
                far = np.repeat(size, size) > long_run
                yield from passed_on(done[far], done_fp[far])
                done, done_fp = done[~far], done_fp[~far]
            if len(done):
                yield from links(done, done_fp)
            if long_run is not None and len(key) > long_run:
                yield from passed_on(key, fp)
                long_key, key, fp = key[0], key[:0], fp[:0]
        if len(key):
            yield from links(key, fp)

    return run


def _refiner(max_bits: int):
    """Posts the fingerprints of long lists anew, under half-bytes too; each row is (list's number of kept positions, fp)."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
    masks = []
    for kept in combinations(range(8), 8 - max_bits):
        whole = sum(255 << 8 * p for p in kept)
        halves = [15 << 4 * h for h in range(16) if h // 2 not in kept]
        masks.append([whole | sum(some) for some in combinations(halves, max_bits)])
    table = np.array(masks, np.uint64)
    numbers = np.arange(table.size, dtype=np.uint64).reshape(table.shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, fp = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64)
            for a in range(0, len(fp), 8192):
                some = fp[a : a + 8192, None]
                h = (some & table[kept[a : a + 8192]]) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ h >> np.uint64(31) ^ numbers[kept[a : a + 8192]] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
                yield pa.record_batch([pa.array(h.ravel().view(np.int64)), pa.array(np.repeat(some.ravel().view(np.int64), table.shape[1]))], schema=schema)

    return run


def _keys_of(fp: Column, max_bits: int) -> list[Column]:
    """The keys of the posting lists of a fingerprint, one for each choice of positions."""
    keys = []
    for i, kept in enumerate(combinations(range(8), 8 - max_bits)):
        mask = int.from_bytes(bytes(255 if p in kept else 0 for p in range(8)), "little", signed=True)
        keys.append(F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(mask))))
    return keys


def links(distinct: DataFrame, max_bits: int = MAX_BITS, long_run: int = LONG_RUN) -> DataFrame:
    """(a, b): links that connect all fingerprints of ``distinct`` (fp) that differ in ``max_bits`` bits at most.

    Lists come sorted, so that a task holds one list and no partition. A list of more than ``long_run``
    is not searched: its fingerprints are posted again, under the kept bytes and each choice of ``max_bits`` of the
    2 * ``max_bits`` half-bytes that are left, of which a linked pair shares so many at least; so
    what one task would compare is spread over many.
    """
    shape = "a long, b long, key long"
    postings = distinct.select(F.explode(F.array(*_keys_of(F.col("fp"), max_bits))).alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    found = written(postings.mapInArrow(_linker(max_bits, long_run), shape), "links")
    near = found.where("b is not null").select("a", "b")
    far = found.where("b is null").select((F.array_position(F.array(*_keys_of(F.col("a"), max_bits)), F.col("key")) - 1).cast("long").alias("kept"), F.col("a").alias("fp"))
    again = far.mapInArrow(_refiner(max_bits), "key long, fp long").repartition("key").sortWithinPartitions("key")
    return near.unionByName(again.mapInArrow(_linker(max_bits, None), shape).select("a", "b"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text).

    Text is lower-cased (A-Z), cut into words at ASCII white space and into shingles of
    ``shingle`` words, repeats included (a shorter text is one shingle). A bit of fp is 1
    if it is set in more than half of the shingles' XXH64 hashes (seed 42). A null text or
    one without words has fp 0 and is linked like any other. Fingerprints that differ in
    ``max_bits`` bits at most are linked; component_id is the least doc_id that can be
    reached. Repeated rows and rows with a null doc_id keep a row each (a group of null ids alone has a null
    component_id); whole texts are read, however long; other columns are ignored; an empty table gives an empty result.

    Two linked fingerprints differ in at most ``max_bits`` of their 8 bytes, so they share
    at least 8 - ``max_bits`` bytes in place. The index posts every distinct fingerprint
    under each choice of that many positions with its bytes there; a linked pair meets in
    at least one posting list. In the lists, shared bytes are tallied per pair, pairs with
    fewer than the minimum are dropped and the rest verified. Copies are collapsed before,
    long lists are searched without forming their pairs, and only links that connect go on.
    """
    if not 0 < max_bits < 8:
        raise ValueError("max_bits must be 1 to 7")
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    prints = written(rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = connected_components(links(distinct, max_bits))
    linked = found.join(distinct, found.node == distinct.fp).select("fp", "component", "least")
    best = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = linked.join(best, "component").select("fp", "component_id")
    final = written(distinct.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "final")
    return prints.join(final, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of every group: the one with the least doc_id.

    Of repeated rows with that doc_id one stays. Rows with a null doc_id stay only if all
    of their group are null, one of them.
    """
    groups = written(near_duplicates(docs, **options), "groups")
    keep = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_sm_id"))
    keep = keep.groupBy("_sm_id").agg(F.count("*").alias("_sm_n"))
    out = docs.join(keep, docs.doc_id.eqNullSafe(F.col("_sm_id")))
    if keep.where("_sm_n > 1").isEmpty():
        return out.select(*[F.col(f"`{c}`") for c in docs.columns])
    # Repeated rows: those whose fingerprint is a kept one's, one row of each.
    first = Window.partitionBy("_sm_id", "_sm_fp").orderBy(F.xxhash64("text"))
    ship_package(docs.sparkSession)
    twice = out.where("_sm_n > 1").withColumn("_sm_fp", _fingerprint_column(options.get("shingle", SHINGLE))("text"))
    one = twice.withColumn("_sm_row", F.row_number().over(first)).where("_sm_row = 1")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return out.where("_sm_n = 1").select(*columns).unionByName(one.select(*columns))


def _fingerprint_column(shingle: int):
    @F.pandas_udf("long")
    def column(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t, shingle))

    return column
