"""Token ids in compressed, checksummed chunks on any store that Spark can write.

A store is a folder of Parquet files; each row is one chunk: (segment, chunk, n_tokens,
n_docs, data). Segments follow each other in ascending doc_id order, chunks in their
segment. ``data`` can stand alone:

    magic b"SLTK1\\0", then little-endian: documents u32, blocks u32, ids a block u32
    per document: doc_id i64, is null u8, ids u64
    per block: coded bytes u32, CRC-32 of its ids (as unsigned 16 bits) u32
    the coded blocks (see rangecoder), each with fresh statistics

The last block is filled up with id 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.llm import rangecoder
from siltmark.llm.memory import give_back
from siltmark.llm.tokens import forget, kept_encoder, no_collection, tokenizer_path
from siltmark.operators.ranking import running_total
from siltmark.plans.session import ship_package, written

MAGIC = b"SLTK2\0"
BLOCK_IDS = 2048
#: A chunk is closed at so many ids; documents stay whole, so a long one makes a larger chunk.
CHUNK_IDS = 1 << 20
#: About so many blocks are coded in lockstep at most, over chunks.
LANES = 4096
_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n", "<u8")])
_BLOCK = np.dtype([("size", "<u4"), ("crc", "<u4")])


class _Chunk:
    def __init__(self):
        self.docs: list[tuple] = []
        self.ids: list[bytes] = []
        self.n = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids) // 2))
        self.ids.append(ids)
        self.n += len(ids) // 2


def _shares(n: int) -> list[tuple[int, int]]:
    """Ranges of equal size of about ``LANES`` blocks: a small rest would take as many steps as the others."""
    count = -(-n * 3 // (LANES * 4))
    cuts = [n * i // count for i in range(count + 1)] if n else []
    return list(zip(cuts, cuts[1:]))


def pack_chunks(chunks: list[_Chunk]) -> list[bytes]:
    """The bytes of chunks, whose blocks are coded together."""
    blocks, spans = [], []
    for c in chunks:
        ids = np.frombuffer(b"".join(c.ids), "<u2")
        size = min(BLOCK_IDS, max(1, len(ids)))
        full = np.zeros(-(-len(ids) // size) * size, np.uint16)
        full[: len(ids)] = ids
        blocks.append(full.reshape(-1, size))
        spans.append(size)
    coded: dict[int, list[bytes]] = {}
    for size in set(spans):
        rows = np.concatenate([b for b, s in zip(blocks, spans) if s == size])
        coded[size] = [x for a, b in _shares(len(rows)) for x in rangecoder.encode(np.ascontiguousarray(rows[a:b].T))]
    used = dict.fromkeys(coded, 0)
    out = []
    for c, b, size in zip(chunks, blocks, spans):
        own = coded[size][used[size] : used[size] + len(b)]
        used[size] += len(b)
        index = np.array([(len(x), zlib.crc32(r.astype("<u2").tobytes())) for x, r in zip(own, b)], _BLOCK)
        head = np.array([len(c.docs), len(b), size], "<u4").tobytes()
        out.append(b"".join([MAGIC, head, np.array(c.docs, _DOC).tobytes(), index.tobytes(), *own]))
    return out


def unpack_chunks(data: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(document table, ids) of each chunk; a wrong checksum raises."""
    heads, coded = [], {}
    for d in data:
        if d[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token chunk")
        n_docs, n_blocks, size = np.frombuffer(d, "<u4", 3, len(MAGIC)).tolist()
        at = len(MAGIC) + 12
        docs = np.frombuffer(d, _DOC, n_docs, at)
        at += docs.nbytes
        index = np.frombuffer(d, _BLOCK, n_blocks, at)
        ends = at + index.nbytes + np.cumsum(index["size"], dtype=np.int64)
        starts = ends - index["size"]
        mine = coded.setdefault(size, [])
        heads.append((docs, index, size, len(mine)))
        mine += [d[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    ids = {}
    for size, blocks in coded.items():
        parts = [rangecoder.decode(blocks[a:b], size).T for a, b in _shares(len(blocks))]
        ids[size] = np.ascontiguousarray(np.concatenate(parts)) if parts else np.zeros((0, size), np.uint16)
    out = []
    for docs, index, size, first in heads:
        rows = ids[size][first : first + len(index)]
        for r, crc in zip(rows, index["crc"].tolist()):
            if zlib.crc32(r.astype("<u2").tobytes()) != crc:
                raise ValueError("a block fails its checksum")
        out.append((docs, rows.reshape(-1)[: int(docs["n"].sum())]))
    return out


def _writer(tokenizer: str, end_id: int):
    names = ["segment", "chunk", "n_tokens", "n_docs", "data"]
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, written, open_, ready = TaskContext.get().partitionId(), 0, _Chunk(), []

        def flush() -> pa.RecordBatch:
            nonlocal written, ready
            data = pack_chunks(ready)
            n = len(ready)
            columns = [pa.array([segment] * n, pa.int32()), pa.array(range(written, written + n), pa.int32()), pa.array([c.n for c in ready], pa.int64()), pa.array([len(c.docs) for c in ready], pa.int64()), pa.array(data, pa.binary())]
            written, ready = written + n, []
            return pa.record_batch(columns, names=names)

        e = kept_encoder(tokenizer_path(tokenizer))
        with no_collection():
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), e.ids_of(batch.column(1))):
                    open_.add(doc_id, ids + end)
                    if open_.n >= CHUNK_IDS:
                        ready.append(open_)
                        open_ = _Chunk()
                        if sum(c.n for c in ready) >= LANES * BLOCK_IDS:
                            yield flush()
        if open_.docs:
            ready.append(open_)
        if ready:
            yield flush()
        give_back()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1) -> None:
    """Encodes ``docs`` (doc_id, text) and stores the ids at ``path``, by ascending doc_id.

    ``end_id`` follows each document. A null text is empty; null doc_ids come first;
    repeated rows are stored each, and those with one doc_id by a hash of their texts, so that they too are spread
    over ranges. Other columns are ignored. Texts are dealt by ranges, which is the one
    shuffle, and encoded where they arrive, whole, however long; Spark's own writer commits the files, so a
    task that is run again leaves nothing behind. An empty table makes an empty store.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    order = [F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(_writer(tokenizer, end_id), "segment int, chunk int, n_tokens long, n_docs long, data binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a store; ids are little-endian unsigned 32 bits.

    ``start`` counts the ids of all documents before. It comes from the chunks' counts (a
    row for about a million ids), which are summed up by ranges; then chunks are
    decoded where they are read.
    """
    ship_package(spark)
    chunks = spark.read.parquet(path)
    counts = chunks.select(F.col("segment").alias("s"), F.col("chunk").alias("c"), "n_tokens")
    base = running_total(counts, [F.col("s"), F.col("c")], "n_tokens", "base").select("s", "c", "base")
    base = written(base, "bases")  # its size is known then, so a small one is broadcast and data isn't shuffled
    placed = chunks.join(base, (F.col("segment") == F.col("s")) & (F.col("chunk") == F.col("c"))).select("base", "data")
    names = ["doc_id", "start", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            bases, data = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(data), 8):
                for base, (docs, ids) in zip(bases[a : a + 8], unpack_chunks(data[a : a + 8])):
                    n = docs["n"].astype(np.int64)
                    ends = np.cumsum(n)
                    # The ids of a chunk's documents lie side by side: only the offsets are new.
                    offsets = pa.py_buffer(np.append(0, 4 * ends).astype(np.int64))
                    cut = pa.Array.from_buffers(pa.large_binary(), len(n), [None, offsets, pa.py_buffer(ids.astype("<u4"))])
                    doc_ids = pa.array(docs["doc_id"].astype(np.int64), mask=docs["null"].astype(bool))
                    yield pa.record_batch([doc_ids, pa.array(base + ends - n), pa.array(n), cut.cast(pa.binary())], names=names)

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
