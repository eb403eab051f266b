"""Counting over a corpus by blocks.

Operators that look up every word or window of a corpus in corpus-wide counts would have to shuffle a row per word.
Here documents are grouped into blocks of a few megabytes, written once as a table bucketed by block, and each block
sends one packed list of its distinct keys per key range. A key range is one reduce task's work; its answer is a packed list
in the same order. Since keys are sorted, what belongs to a range is a slice, and the answers of all ranges, put
together in order, line up with the block's distinct keys. A key that occurs everywhere is one entry per block, so
frequent keys do not skew anything.

Reading the bucketed table by block needs no shuffle; only keys and answers move.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from caseloom.llm.common import parts, scratch

#: Bytes of text in a block, about.
BLOCK_BYTES = 4 << 20
#: Keys that one range task holds, about.
RANGE_KEYS = 2_000_000


def pack(x: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed; ``unpack`` needs the kind only."""
    raw = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if len(x) else bytes(8)


def unpack(data: bytes, kind: str) -> np.ndarray:
    n, kind = int.from_bytes(data[:8], "little"), np.dtype(kind)
    if not n:
        return np.empty(0, kind)
    raw = pa.decompress(data[8:], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(data: bytes, kind: str) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


def pack_bits(x: np.ndarray) -> bytes:
    return pack(np.packbits(x)) if len(x) else bytes(8)


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(unpack(data, "u1"), count=n).astype(bool) if n else np.empty(0, bool)


def block_number(sequence: int) -> int:
    """A number for a task's next block; the same in every attempt of the task."""
    return TaskContext.get().partitionId() << 24 | sequence


def in_blocks(size_column: int, limit: int = BLOCK_BYTES):
    """Puts a block number in front of each row; a new block begins when ``limit`` bytes of texts are in one."""

    def run(batches):
        sequence, size = 0, 0
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(size_column)), 0).to_numpy().astype(np.int64) + 16
            number = np.empty(len(sizes), np.int64)
            at = 0
            while at < len(sizes):
                upto = np.cumsum(sizes[at:])
                n = min(len(upto), int(np.searchsorted(upto, limit - size, "left")) + 1)
                number[at : at + n] = block_number(sequence)
                size += int(upto[n - 1])
                at += n
                if size >= limit:
                    sequence, size = sequence + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(number), *batch.columns], names=["block", *batch.schema.names])

    return run


def bucketed(df: DataFrame, *folders: str) -> DataFrame:
    """``df(block, ...)`` as a table in the shared folder, bucketed by block: grouping by block needs no shuffle.

    Rows that differ in the columns ``folders`` are in folders of their own.
    """
    spark = df.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*folders).bucketBy(parts(spark), "block").sortBy("block")
    writer.option("path", scratch(spark, "blocks")).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def ranges(total: int, most: int = RANGE_KEYS) -> int:
    """Number of key ranges, a power of two."""
    n = 1
    while n * most < total:
        n *= 2
    return n


def range_cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` equal ranges of 64-bit keys begins in the sorted ``keys``; n + 1 places."""
    if n == 1:
        return np.array([0, len(keys)])
    step = np.uint64((1 << 64) // n)
    return np.concatenate([[0], np.searchsorted(keys, np.arange(1, n, dtype=np.uint64) * step), [len(keys)]])


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
