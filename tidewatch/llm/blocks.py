"""Blocks of documents that ask for each of their distinct items once and put the answers back by position.

A task cuts its documents into blocks of about BLOCK_BYTES. A block keeps the positions of all its
items (the payload) and sends its distinct items, dealt into buckets by hash, one packed row per
(block, bucket); so a frequent item costs one entry per block, and no row or group grows with how
often an item occurs. The tasks of the buckets answer, and the blocks reassemble. Buckets follow from
the size of the table, so a bucket stays as large at any size.
"""
from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text per block and per bucket; a longer document is a block by itself.
BLOCK_BYTES, BUCKET_BYTES = 48 << 20, 8 << 20
ROWS = "block long, bucket long, data binary"


def buckets(docs: DataFrame, each: int = BUCKET_BYTES) -> int:
    """Number of buckets for all texts of docs."""
    return max(4, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // each))


def dump(*arrays) -> bytes:
    """The arrays, their bytes laid out by place value (high bytes are mostly equal), compressed piece by piece."""
    z, out = zlib.compressobj(1), []
    for a in map(np.ascontiguousarray, arrays):
        out.append(z.compress(struct.pack("<3sQ", a.dtype.str.encode(), len(a))))
        out += [z.compress(a.view("u1")[k :: a.dtype.itemsize].tobytes()) for k in range(a.dtype.itemsize)]
    return b"".join(out) + z.flush()


def load(data: bytes) -> list[np.ndarray]:
    raw, at, out = zlib.decompress(data), 0, []
    while at < len(raw):
        kind, n = struct.unpack_from("<3sQ", raw, at)
        kind, at = np.dtype(kind.decode()), at + 11
        planes = np.frombuffer(raw, "u1", n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return out


def dump_ids(ids: list) -> list[np.ndarray]:
    """Whole numbers or None as two arrays."""
    return [np.array([x or 0 for x in ids], "<i8"), np.array([x is None for x in ids], "u1")]


def load_ids(value: np.ndarray, null: np.ndarray) -> list:
    return [None if n else v for v, n in zip(value.tolist(), null.tolist())]


def by_rank(at: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of n items by falling frequency, lengths of the lists, all positions in that order); empties at."""
    lens = np.array([len(a) for a in at], "<u4")
    pos = np.concatenate(at) if at else np.zeros(0, "<u4")
    at.clear()
    order = np.argsort(-np.bincount(pos, minlength=n), kind="stable")
    rank = np.empty(n, "<u4")
    rank[order] = np.arange(n, dtype="<u4")
    return order, lens, rank[pos]


def starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def blocks(docs: DataFrame, find, pack, binary: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """ROWS of docs (doc_id, text): find(text) lists items, pack(items, ids, positions) yields (bucket, data) of a block.

    Bucket -1 is the payload. Its key is made unique, so that grouping by bucket moves it alone.
    """

    def run(batches):
        import pyarrow as pa

        part, n = TaskContext.get().partitionId(), 0
        seen, ids, at, size = {}, [], [], 0

        def flush():
            name = (part << 32) + n
            rows = [(b if b >= 0 else -1 - name, d) for b, d in pack(list(seen), ids, at)]
            return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()),
                                               pa.array([r[1] for r in rows], pa.binary())], ["block", "bucket", "data"])

        for batch in batches:
            text = batch.column(1)
            for doc_id, t in zip(batch.column(0).to_pylist(), text.cast(pa.binary()) if binary else text):
                t = t.as_py()
                t = t if t is not None else b"" if binary else ""
                found = find(t)
                ids.append(doc_id)
                at.append(np.fromiter((seen.setdefault(w, len(seen)) for w in found), "<u4", len(found)))
                size += len(t)
                if size >= block_bytes:
                    yield flush()
                    n += 1
                    seen, ids, at, size = {}, [], [], 0
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ROWS)
