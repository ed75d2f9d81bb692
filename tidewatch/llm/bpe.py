"""Byte-level BPE encoding and decoding by a global shuffle of distinct pre-tokens.

Documents are cut into pre-tokens; each block of documents keeps their positions and sends its
distinct pre-tokens, dealt by hash (blocks.py). The task of a bucket encodes every distinct
pre-token of the corpus that hashes there once and answers every block; a block reassembles its
documents by position. Decoding looks every id up in the token-byte table, which is broadcast: its
size is that of the vocabulary.

Null text counts as empty and gives 0 tokens; a null doc_id stays null; repeated rows give repeated
rows; an empty table gives an empty one. A pre-token of any length is one item. Other columns of docs
are ignored.
"""
from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from .blocks import BLOCK_BYTES, ROWS, blocks, buckets, by_rank, dump, dump_ids, load, load_ids, starts


def _pattern(pattern: str):
    import regex

    return regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


def _ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


def token_table(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, bytes): the token-byte table of a rank file; the bytes of id i lie from starts[i] to starts[i + 1]."""
    of = {i: t for t, i in _ranks(raw).items()}
    every = [of.get(i, b"") for i in range(max(of, default=-1) + 1)]
    return starts(np.array([len(t) for t in every], np.int64)), np.frombuffer(b"".join(every), "u1")


def _gather(start: np.ndarray, values: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The stretches numbered p of values, end to end."""
    size = start[p + 1] - start[p]
    return values[np.repeat(start[p] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _file(ranks_path: str) -> bytes:
    with open(ranks_path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids with with_ids, from smaller blocks)."""
    n = buckets(docs)
    shared = docs.sparkSession.sparkContext.broadcast(_file(ranks_path))

    def pack(words, ids, at):
        order, lens, pos = by_rank(at, len(words))
        words = [words[i].encode() for i in order]
        bucket = np.fromiter((zlib.crc32(w) % n for w in words), "<u4", len(words))
        yield -1, dump(*dump_ids(ids), lens, pos, bucket)
        for b in np.unique(bucket):
            own = [words[i] for i in np.flatnonzero(bucket == b)]
            yield int(b), dump(np.array([len(w) for w in own], "<u4"), np.frombuffer(b"".join(own), "u1"))

    cache: dict = {}

    def answer(f: pd.DataFrame) -> pd.DataFrame:
        if f["bucket"].iloc[0] < 0:
            return f
        if not cache:
            import tiktoken

            cache["enc"] = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=_ranks(shared.value), special_tokens={})
        enc, known, out = cache["enc"]._encode_single_piece, {}, []
        for data in f["data"]:
            lens, raw = load(data)
            raw, at, got = raw.tobytes(), starts(lens).tolist(), []
            for a, b in zip(at, at[1:]):
                w = raw[a:b]
                if w not in known:
                    known[w] = enc(w)
                got.append(known[w])
            out.append(dump(np.array([len(x) for x in got], "<u4"), np.array([i for x in got for i in x], "<u4")))
        return f.assign(data=out)

    def reassemble(f: pd.DataFrame) -> pd.DataFrame:
        head = f["bucket"] < 0
        value, null, lens, pos, bucket = load(f.loc[head, "data"].iloc[0])
        own = f[~head].sort_values("bucket")
        got = [load(d) for d in own["data"]]
        # answers come by bucket, and by rank within it
        place = np.empty(len(bucket), np.int64)
        place[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))
        start = starts(np.concatenate([g[0] for g in got])) if got else np.zeros(1, np.int64)
        tokens = np.concatenate([g[1] for g in got]) if got else np.zeros(0, "<u4")
        if "table" not in cache:
            cache["table"] = token_table(shared.value)
        out, at = [], starts(lens)
        for a, b in zip(at, at[1:]):
            t = _gather(start, tokens, place[pos[a:b]])
            out.append((len(t), hashlib.sha256(t.tobytes()).hexdigest(), hashlib.sha256(_gather(*cache["table"], t.astype(np.int64)).tobytes()).hexdigest(), t.astype("i4") if with_ids else None))
        d = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids"])
        d.insert(0, "doc_id", pd.array(load_ids(value, null), "Int64"))
        return d if with_ids else d.drop(columns="ids")

    rx = _pattern(pattern)
    # the ids of a block leave its task together
    rows = blocks(docs, rx.findall, pack, block_bytes=BLOCK_BYTES // 4 if with_ids else BLOCK_BYTES)
    rows = rows.groupBy("bucket").applyInPandas(answer, ROWS)
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.groupBy("block").applyInPandas(reassemble, kind)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded (..., ids array<int>) with the column decoded, the bytes of its ids; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(_file(ranks_path))

    def run(batches):
        import pyarrow as pa

        start, values = token_table(shared.value)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            out = [None if x.as_py() is None else _gather(start, values, np.asarray(x.values, np.int64)).tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", BinaryType())]))


def op10_byte_bpe(spark, sf_dir):
    import public_tokenizers as P

    from .common import table

    return encode(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
