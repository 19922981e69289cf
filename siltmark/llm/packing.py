"""Packing by power-of-two decomposition: no sequence crosses documents, and none is padded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.llm.tokens import encoder, no_collection, tokenizer_path
from siltmark.plans.session import new_path, ship_package

MAX_LENGTH = 1024
FLUSH_BYTES = 8 << 20


def piece_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Powers of two that add up to n, descending, none above ``longest`` (itself a power of two)."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _packer(tokenizer: str, end_id: int, longest: int):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])
    end = np.array([end_id], dtype="<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in schema]
        held = 0

        def flush():
            nonlocal out, held
            batch = pa.record_batch([pa.array(c, t.type) for c, t in zip(out, schema)], schema=schema)
            out, held = [[] for _ in schema], 0
            return batch

        with encoder(tokenizer_path(tokenizer)) as e, no_collection():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = np.frombuffer(e.ids(text.as_py()) + end, dtype="<u2").astype("<u4").tobytes()
                    n, at = len(ids) // 4, 0
                    for length in piece_lengths(n, longest):
                        for c, v in zip(out, (doc_id, at, length, ids[4 * at : 4 * (at + length)], n)):
                            c.append(v)
                        at += length
                    held += len(ids)
                    if held >= FLUSH_BYTES:
                        yield flush()
        if out[0]:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, max_length: int = MAX_LENGTH) -> DataFrame:
    """Sequences of ``docs`` (doc_id, text; other columns are ignored), in buckets of equal lengths.

    The ids of a document, with ``end_id`` after them, are split into pieces whose lengths
    are the powers of two of its length, longest first. Every piece is a sequence of its
    own, so none crosses documents and none is padded: (doc_id, start, length, ids,
    doc_tokens, sequence_id, offset), ids as little-endian unsigned 32 bits, offset always 0.
    ``length`` is the bucket. Buckets are written apart, a folder of files each
    (``write_buckets``): a training step takes ``max_length / length`` sequences of one
    bucket for the room of a longest one. sequence_ids of a bucket lie in a range of their own.

    A null text is empty, so its document is the end id alone; a null
    doc_id is kept; repeated rows are packed each; a text of any length is encoded whole; an empty table gives no rows.

    There is no shuffle: documents are encoded where they are read, and a task writes what it
    has for each bucket.
    """
    spark = docs.sparkSession
    path = new_path(spark, "buckets")
    write_buckets(docs, path, tokenizer, end_id, max_length)
    found = spark.read.schema(f"{_SCHEMA}, sequence_id long, bucket long").parquet(path)
    return found.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))


_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long"


def write_buckets(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, max_length: int = MAX_LENGTH) -> None:
    """Writes the sequences of ``docs`` to Parquet at ``path`` with a folder for each length (``bucket=length``)."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    pieces = rows.mapInArrow(_packer(tokenizer, end_id, max_length), _SCHEMA)
    # 58 bits are room for 2 ** 25 tasks; the bits above tell the buckets apart.
    number = F.shiftleft(F.log2("length").cast("long"), 58).bitwiseOR(F.monotonically_increasing_id())
    pieces.withColumn("sequence_id", number).withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
