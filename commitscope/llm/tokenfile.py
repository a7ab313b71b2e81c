"""Token ids in a compact binary table.

``write`` tokenises documents in ascending doc_id order and stores them in blocks of the adaptive context-mixing range
coder (see ``idcoder``); ``read`` decodes the blocks again. A block holds whole documents, is reset and checksummed on
its own, and so is the unit of recovery and of parallel reading. Blocks are rows of a Parquet table, so that any store
that Spark can reach holds them and lost tasks leave nothing behind: part (range of doc_id, ascending), block (within
the part), doc_ids and n_tokens per document, and the coded payload.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, table_path, text_or_empty
from .idcoder import decode_block, encode_block
from .wordbpe import WordTokenizer

BLOCK_IDS = 1 << 19
SLICE = 6 << 20
BLOCK_SCHEMA = "part int, block int, doc_ids array<long>, n_tokens array<long>, payload binary"


def _parts(df: DataFrame) -> int:
    """Range partitions: enough for the input's own splits and for the session's shuffle setting."""
    return max(df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Write the table of blocks to ``path`` (a folder that Spark can reach).

    A null text is empty: its only id is ``end_id``. Null doc_ids come first. Documents of equal doc_id are ordered by
    text. A document is never split over blocks; one longer than ``block_ids`` has a block of its own.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, words, number = TaskContext.get().partitionId(), WordTokenizer.of(tokenizer), 0
        keys, sizes, held, count = [], [], [], 0

        def block():
            nonlocal number, count
            ids = np.concatenate(held)
            out = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([number], pa.int32()), "doc_ids": pa.array([keys.copy()], pa.list_(pa.int64())),
                "n_tokens": pa.array([sizes.copy()], pa.list_(pa.int64())), "payload": pa.array([encode_block(ids, words.vocab)], pa.binary()),
            })
            number, count = number + 1, 0
            keys.clear(), sizes.clear(), held.clear()
            return out

        for b in batches:
            for i, j in slices([range(n) for n in pc.binary_length(b.column(1)).to_pylist()], SLICE):
                ids, n = words.encode(b.column(1).slice(i, j - i), end_id)
                start = 0
                for key, size in zip(b.column(0).slice(i, j - i).to_pylist(), n.tolist()):
                    keys.append(key)
                    sizes.append(size)
                    held.append(ids[start : start + size])
                    start, count = start + size, count + size
                    if count >= block_ids:
                        yield block()
        if keys:
            yield block()

    rows = text_or_empty(docs, "doc_id")
    ranged = rows.repartitionByRange(_parts(rows), "doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(encode, BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(part, block, doc_id, seq, n_tokens, ids)`` of every document; ids as little-endian uint32 in a binary.

    Raises CorruptBlock where a block's checksum does not hold.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, block, keys, sizes, payload in zip(*(c.to_pylist() for c in b.columns)):
                ids = decode_block(payload).astype("<u4")
                end = np.cumsum(sizes)
                cut = [ids[e - n : e].tobytes() for e, n in zip(end.tolist(), sizes)]
                n = len(keys)
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(keys, pa.int64()), pa.array(range(n), pa.int64()), pa.array(sizes, pa.int64()), pa.array(cut, pa.binary()),
                ], ["part", "block", "doc_id", "seq", "n_tokens", "ids"])

    return spark.read.schema(BLOCK_SCHEMA).parquet(path).mapInArrow(decode, "part int, block int, doc_id long, seq long, n_tokens long, ids binary")


def positions(spark: SparkSession, path: str) -> DataFrame:
    """``(part, block, start)``: ids before each block. Sums per part first, so no window grows with the input's rows."""
    sizes = spark.read.schema(BLOCK_SCHEMA).parquet(path).select("part", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    base = parts.select("part", before(Window.orderBy("part")).alias("base"))  # one row a part
    return sizes.withColumn("own", before(Window.partitionBy("part").orderBy("block"))).join(base, "part").select("part", "block", (F.col("own") + F.col("base")).alias("start"))


def summary(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` as read back from the files; one row per document, an empty table gives none."""
    spark = docs.sparkSession
    path = table_path(spark, "tokens")
    write(docs, path, tokenizer, end_id)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, keys, sizes, payload in zip(*(c.to_pylist() for c in b.columns)):
                ids = memoryview(decode_block(payload).astype("<u4").tobytes())
                end = np.cumsum(sizes)
                crc = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(end.tolist(), sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start + end - sizes), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path).join(positions(spark, path), ["part", "block"])
    return blocks.select("start", "doc_ids", "n_tokens", "payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
