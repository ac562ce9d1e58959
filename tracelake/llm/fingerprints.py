"""SimHash fingerprints and the search among them.

Terms are pairs of neighbouring words (the word itself where a text has one).
Each term's 128-bit hash votes for or against every bit with the term's weight,
which grows with its length: long terms are rarer than short ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import STEP_BYTES, map_steps, steps, table, texts_of

BITS = 128
_CHUNK = 60  # terms of weight 4 at most whose votes fit in a byte
_LANES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.uint8)).copy().view(np.uint64).ravel()  # a byte's bits as the bytes of a word


def fingerprints(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, 16) bytes: the fingerprint of data[offs[i]:offs[i+1]]. Without words: zeros."""
    n = len(offs) - 1
    out = np.zeros((n, BITS // 8), np.uint8)
    starts, ends, first = words.word_spans(data, offs)
    if not len(starts):
        return out
    h = words.word_hashes(data, starts)
    size = ends - starts
    count = np.diff(first)
    own = words.owners(first)
    last = np.zeros(len(h), bool)
    last[first[1:][count > 0] - 1] = True
    lone = np.repeat(count == 1, count)
    with np.errstate(over="ignore"):
        nxt = np.append(h[1:], np.uint64(0))
        term = np.where(last, words.mix(h), words.mix(h * np.uint64(3) + words.mix(nxt)))
    size = size + np.where(last, 0, np.append(size[1:], 0))
    use = ~last | lone
    term, own, weight = term[use], own[use], np.clip(size[use] // 5, 1, 4).astype(np.uint64)
    begin = np.searchsorted(own, np.arange(n + 1))
    place = np.arange(len(own)) - begin[own]
    cuts = np.flatnonzero(place % _CHUNK == 0)
    owner = own[cuts]
    both = np.stack((term, words.mix(term ^ np.uint64(0x5851F42D4C957F2D))), 1).view(np.uint8)
    votes = np.empty((len(cuts), 16), np.uint64)
    for k in range(16):
        votes[:, k] = np.add.reduceat(_LANES[both[:, k]] * weight, cuts)
    per_chunk = votes.view(np.uint8).reshape(len(cuts), BITS)
    has, at = np.unique(owner, return_index=True)
    yes = np.add.reduceat(per_chunk.astype(np.int64), at, axis=0)
    total = np.add.reduceat(np.add.reduceat(weight.astype(np.int64), cuts), at)
    out[has] = np.packbits(2 * yes > total[:, None], axis=1)
    return out


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum(lens)))


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - np.unpackbits(a ^ b, axis=1).sum(1) / BITS


def _hex(x: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in x]


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint): 32 hex digits for every row; null and empty texts get zeros."""

    def work(batch):
        x = fingerprints(*_joined([t.encode() for t in batch.column("text").to_pylist()]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_hex(x), pa.string())], ["doc_id", "fingerprint"])

    return map_steps(texts_of(docs, id_col, text_col), work, "doc_id long, fingerprint string")


def _longs(fingerprint):
    """Four 32-bit parts of the hex digits."""
    return [F.conv(F.substring(fingerprint, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def near_fingerprints(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(left, right, distance): every pair of different fingerprints within ``radius`` bits, left < right.

    The bits are cut into radius + 1 blocks, so fingerprints within the radius
    have one block alike: each table holds the distinct fingerprints under one
    block's value, and candidates are verified in full. Rows with one fingerprint
    are one entry, so a group of copies costs one row; the caller's table gives
    membership. Blocks of a wide radius are short and tell little apart: at 20 bits
    they have six, so candidates grow with the square of the fingerprints.
    """
    if not 0 <= radius < BITS:
        raise ValueError("radius must be from 0 to 127")
    one = prints.select("fingerprint").where(F.col("fingerprint").isNotNull()).distinct()
    bits = F.concat(*[F.lpad(F.conv(F.substring("fingerprint", 1 + 8 * k, 8), 16, 2), 32, "0") for k in range(4)])
    edges = [round(i * BITS / (radius + 1)) for i in range(radius + 2)]
    keys = [F.concat(F.lit(f"{i}:"), F.substring(F.col("bits"), a + 1, b - a)) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    tables = one.withColumn("bits", bits).select("fingerprint", F.explode(F.array(*keys)).alias("block"))
    l, r = tables.alias("l"), tables.alias("r")
    apart = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(_longs("l.fingerprint"), _longs("r.fingerprint"))), F.lit(0))
    pairs = l.join(r, (F.col("l.block") == F.col("r.block")) & (F.col("l.fingerprint") < F.col("r.fingerprint")))
    return pairs.select(F.col("l.fingerprint").alias("left"), F.col("r.fingerprint").alias("right"), apart.alias("distance")).where(F.col("distance") <= radius).distinct()


NEIGHBOURS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _in_order(docs: DataFrame, parts: int) -> DataFrame:
    """Rows by (bucket, descending doc_id, text), each bucket closed by a guest: the row that follows its last one.

    Buckets are ranges of doc_id between quantiles; only the quantiles and one id
    a bucket come to the driver.
    """
    spark = docs.sparkSession
    at = [(i + 1) / parts for i in range(parts - 1)]
    cuts = docs.select(F.percentile_approx("doc_id", at, 20 * parts)).first()[0] if at else None
    cuts = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def bucket(ids):
        import pandas as pd

        return pd.Series(np.searchsorted(-cuts[::-1], -ids.to_numpy(np.int64), "left").astype(np.int32))

    rows = docs.withColumn("bucket", bucket("doc_id"))
    heads = sorted((r[0], r[1]) for r in docs.select("doc_id").withColumn("bucket", bucket("doc_id")).groupBy("bucket").agg(F.max("doc_id")).collect())
    if not heads:
        return rows.withColumn("guest", F.lit(False))
    guests = [(heads[i - 1][0], heads[i][1]) for i in range(len(heads))]  # the first bucket's head follows the last bucket
    names = spark.createDataFrame(guests, T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("doc_id", T.LongType())]))
    lead = docs.join(F.broadcast(names), "doc_id").groupBy("bucket", "doc_id").agg(F.max("text").alias("text"))
    both = rows.select("bucket", "doc_id", "text", F.lit(False).alias("guest")).unionByName(lead.select("bucket", "doc_id", "text", F.lit(True).alias("guest")))
    return both.repartition(max(1, parts // 3), "bucket").sortWithinPartitions("bucket", "guest", F.desc("doc_id"), F.desc("text"))


def against_next(docs: DataFrame, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint against its edited text's and the next row's.

    Rows follow each other by descending id (ids that repeat: by descending text),
    the first after the last. The edited text has the last floor(n_chars / 3) code
    points replaced by as many first ones of the next text, or all it has. Null
    texts are empty; rows with a null id are left out, having no place in the order.
    """
    spark = docs.sparkSession
    parts = parts or 3 * max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = _in_order(texts_of(docs, id_col, text_col).where("doc_id is not null"), parts)

    def run(batches):
        last = None  # the row before, still without its next one
        for batch in steps(batches, STEP_BYTES // 2):
            at = list(zip(batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("guest").to_pylist()))
            rows = ([last] if last else []) + at
            last = rows[-1] if not rows[-1][3] else None
            texts = [r[2] for r in rows]
            own = fingerprints(*_joined([t.encode() for t in texts]))
            keep = [i for i in range(len(rows) - 1) if not rows[i][3]]
            if not keep:
                continue
            edited = []
            for i in keep:
                t = texts[i]
                k = len(t) // 3
                edited.append((t[: len(t) - k] + texts[i + 1][:k]).encode())
            changed = fingerprints(*_joined(edited))
            mine, following = own[keep], own[[i + 1 for i in keep]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][1] for i in keep], pa.int64()),
                    pa.array([len(texts[i]) for i in keep], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                    pa.array(_hex(mine), pa.string()),
                    pa.array(_hex(changed), pa.string()),
                    pa.array(_alike(mine, changed)),
                    pa.array(_alike(mine, following)),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return rows.select("bucket", "doc_id", "text", "guest").mapInArrow(run, NEIGHBOURS)


def query(spark, sf_dir):
    return against_next(table(spark, sf_dir, "documents"))
