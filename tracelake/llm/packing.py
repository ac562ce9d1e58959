"""Order-preserving packing by dynamic programming.

Documents follow each other by id in one stream a shard. A sequence costs the
padding it needs, and every cut a penalty: none at a document's end, some behind
a sentence, more elsewhere. best(j) = min over i of best(i) + padding(j - i) +
penalty(j). Padding falls with i, so best(i) + i has to be least in a window that
slides along with j; the monotone queue's minima are kept as running minima from
the left and from the right of neighbouring blocks, which take whole blocks of j
at a time.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import steps, texts_of

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
END_ID = 1
_BIG = np.int64(1) << 60
_SEGMENT = 1 << 19
#: Shards at most, whatever the corpus.
MOST_SHARDS = 1 << 15


def cuts(n: int, penalty: np.ndarray, limit: int, last: bool, inner: int) -> np.ndarray:
    """Cut positions, from 0, of a stream of n tokens; penalty[j]: of a cut before token j.

    last: the stream ends here, and what is left over after whole sequences goes
    into sequences of powers of two or one padded one, whichever costs less. If not,
    the cuts end where the rest is best begun anew.
    """
    half = limit // 2
    if n < half:
        return np.concatenate(([0], _tail(0, n, limit, inner)[1])).astype(np.int64) if last else np.zeros(1, np.int64)
    best = np.full(n + 1, _BIG)
    best[0] = 0
    back = np.zeros(n + 1, np.int64)
    key = np.full(n + 1 + limit, _BIG)  # (best(i) + i, i) in one number, behind ``limit`` positions that aren't there
    bits = int(n + 1).bit_length()
    key[limit] = 0
    for b in range(half, n + 1, half):
        to = min(b + half, n + 1)
        t = to - b
        older = np.minimum.accumulate(key[b - limit + limit : b - half + limit][::-1])[::-1][:t]
        newer = np.minimum.accumulate(key[b - half + limit : b + limit][:t])
        least = np.minimum(older, newer)
        j = np.arange(b, to)
        cost = (least >> bits) + limit - j
        i = least & ((1 << bits) - 1)
        cost[least >= _BIG] = _BIG
        exact = best[j - half]  # a power of two needs no padding
        use = exact < cost
        cost = np.where(use, exact, cost)
        back[b:to] = np.where(use, j - half, i)
        cost = np.where(cost >= _BIG, _BIG, cost + penalty[b:to])
        best[b:to] = cost
        key[b + limit : to + limit] = np.where(cost >= _BIG, _BIG, ((cost + j) << bits) | j)
    lo = max(0, n - limit + 1)
    ends = np.arange(lo, n + 1)
    if last:
        tails = np.array([_tail_cost(n - e, limit, inner) for e in ends])
        total = np.where(best[ends] >= _BIG, _BIG, best[ends] + tails - np.where(ends == n, penalty[n], 0))
    else:
        total = np.where(ends > 0, best[ends], _BIG)
    e = int(ends[np.argmin(total)])
    out = [e]
    while out[-1] > 0:
        out.append(int(back[out[-1]]))
    out = out[::-1]
    return np.concatenate((out, _tail(e, n, limit, inner)[1])).astype(np.int64) if last else np.array(out, np.int64)


def _tail_cost(r: int, limit: int, inner: int) -> int:
    return 0 if r == 0 else min(limit - r, (bin(r).count("1") - 1) * inner)


def _tail(at: int, n: int, limit: int, inner: int) -> tuple[int, list[int]]:
    r = n - at
    if not r:
        return 0, []
    if limit - r < (bin(r).count("1") - 1) * inner:
        return limit - r, [n]
    out = []
    for k in range(int(r).bit_length() - 1, -1, -1):
        if r >> k & 1:
            at += 1 << k
            out.append(at)
    return 0, out


def pack(docs: DataFrame, vocabulary: str, limit: int = 2048, sentence: int = 2, inner: int = 4, shard_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents by sequence: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Every document is its token ids and a closing id; a null or empty text is the
    closing id alone. Rows go by id, equal ids by a hash of their text, null ids first.
    Shards are ranges in this order of about ``shard_bytes``, or larger so that there
    are at most MOST_SHARDS of them. They are streamed in segments, so a task holds one
    segment and the longest document. limit: a power of two.
    """
    if limit < 4 or limit & (limit - 1):
        raise ValueError("limit must be a power of two, 4 or more")
    rows = texts_of(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(MOST_SHARDS, max(1, round(total / shard_bytes)))
    order = ["doc_id", F.xxhash64("text")]  # rows that share an id can lie in several shards
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches):
        of = bpe.word_bpe(vocabulary)
        stops = np.unique(of.encode(["a. a! a?"])[0])
        stops = stops[stops != of.encode(["a"])[0][0]]
        shard = TaskContext.get().partitionId()
        sequence = shard << 32
        ids, names, lens, done = [], [], [], 0  # the open stream; done: tokens of its first document that are packed
        held = 0

        def flush(last: bool):
            nonlocal ids, names, lens, done, held, sequence
            if not held:
                return None
            stream = np.concatenate(ids)
            lengths = np.array(lens, np.int64)
            bounds = np.concatenate(([0], np.cumsum(lengths) - done))
            penalty = np.full(len(stream) + 1, inner, np.int64)
            penalty[1:][np.isin(stream, stops)] = sentence
            penalty[bounds[1:]] = 0
            cut = cuts(len(stream), penalty, limit, last, inner)
            end = int(cut[-1])
            edge = np.unique(np.concatenate((cut, bounds[bounds < end])))
            a, b = edge[:-1], edge[1:]
            doc = np.searchsorted(bounds, a, "right") - 1
            seq = np.searchsorted(cut, a, "right") - 1
            begin = a - bounds[doc] + np.where(doc == 0, done, 0)
            raw = stream.astype("<u4")
            crc = [zlib.crc32(raw[x:y]) for x, y in zip(a.tolist(), b.tolist())]
            out = pa.RecordBatch.from_arrays(
                [pa.array([names[d] for d in doc.tolist()], pa.int64()), pa.array(begin), pa.array(b - a), pa.array(crc, pa.int64()), pa.array(lengths[doc]), pa.array(seq + sequence), pa.array(a - cut[seq])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            sequence += len(cut) - 1
            first = int(np.searchsorted(bounds, end, "right")) - 1
            rest = len(stream) - end
            if rest:
                done = end - int(bounds[first]) + (done if first == 0 else 0)
                ids, names, lens = [stream[end:]], names[first:], lens[first:]
            else:
                ids, names, lens, done = [], [], [], 0
            held = rest
            return out if out.num_rows else None

        for batch in steps(batches):
            got, offs = of.encode(batch.column("text").to_pylist())
            size = np.diff(offs)
            ids.append(np.insert(got, offs[1:], END_ID))
            lens += (size + 1).tolist()
            names += batch.column("doc_id").to_pylist()
            held += len(ids[-1])
            if held >= _SEGMENT and (out := flush(False)) is not None:
                yield out
        if (out := flush(True)) is not None:
            yield out

    return rows.mapInArrow(run, SCHEMA)
