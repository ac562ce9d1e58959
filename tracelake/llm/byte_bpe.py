"""Byte-level BPE: ids, offsets and the way back."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import map_steps, texts_of

ENCODED = "doc_id long, ids array<int>, starts array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, starts): the token ids, and the code point at which every pre-token begins.

    A null or empty text has no ids. Ids stay as given, repeated or null.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, offs, starts, cut = bpe.byte_bpe(ranks).encode(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offs.astype("int32")), pa.array(ids.astype("int32"))), pa.ListArray.from_arrays(pa.array(cut.astype("int32")), pa.array(starts.astype("int32")))],
            ["doc_id", "ids", "starts"],
        )

    return map_steps(texts_of(docs, id_col, text_col), work, ENCODED)


def decode(encoded: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, content): the bytes that the ids stand for; null or empty ids give no bytes."""

    def run(batches):
        of = bpe.byte_bpe(ranks)
        for batch in batches:
            out = [of.decode(x.values.to_numpy()) if x.is_valid and len(x.values) else b"" for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "content"])

    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids")
    return encoded.select(F.col(id_col).alias("doc_id"), ids).mapInArrow(run, "doc_id long, content binary")


def round_trip(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, digests of the ids and of the decoded bytes): ``encode`` then ``decode`` in one pass, without moving the ids."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = bpe.byte_bpe(ranks)
        ids, offs, _, _ = of.encode(batch.column("text").to_pylist())
        digit, n, a, b = of.digits.__getitem__, [], [], []
        for lo, hi in zip(offs.tolist(), offs[1:].tolist()):
            own = ids[lo:hi]
            n.append(hi - lo)
            a.append(hashlib.sha256(" ".join(map(digit, own.tolist())).encode()).hexdigest())
            b.append(hashlib.sha256(of.decode(own)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_steps(texts_of(docs, id_col, text_col), work, DIGESTS)
