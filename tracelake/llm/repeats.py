"""Which windows of a fixed size are found elsewhere: the part that byte and word dedup share.

A caller cuts every text into *runs*: neighbouring window starts [s1, s2] that
share one anchor, a short gram chosen by the windows' content alone, so equal
windows have equal anchors. Each run has a ``key`` (its gram's name) and a
``ctx`` (the name of all it covers). Three rounds follow, each over less:

1. Names are counted. A key found once cannot be part of a repeat, and its runs
   are dropped (most of the corpus). Runs are pre-aggregated by name before they
   are shuffled, so a passage that a third of the rows hold is a few rows a task.
2. Runs whose ctx is found elsewhere are repeated as a whole. Of each ctx only
   one run stays as its representative, if its key has other contexts as well.
3. The windows of the representatives are compared one by one.

Everything is keyed by names that depend on content alone; nothing is gathered
on the driver and no pairs of occurrences are made.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import buffers, discard, steps, stored

_U = np.uint64
#: Slices of text whose names are merged before the shuffle.
_GATHER = 8


@dataclass(frozen=True)
class Runs:
    """Arrays over the runs of a slice: text index, names, first and last window start; base: where each text begins; lag: from the first start to the anchor."""

    owner: np.ndarray
    key: np.ndarray
    ctx: np.ndarray
    first: np.ndarray
    last: np.ndarray
    base: np.ndarray
    lag: np.ndarray


@dataclass(frozen=True)
class Kind:
    """runs(data, offs) of a slice; windows(data, offs, text, start): names of the halves of each window, or of its quarters where ``step`` is set; earlier: only later occurrences count as repeats."""

    runs: Callable[[np.ndarray, np.ndarray], Runs]
    windows: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, ...]]
    size: int
    earlier: bool
    #: Where not 0, a round between: starts are taken in steps of this many from the anchor, and what all windows of
    #: a step have in common is ranked before the windows themselves. For data whose symbols are bytes.
    step: int = 0


def _tag(key: str):
    """31 bits of a key, which tell names of different keys apart where their ctx agrees."""
    return F.col(key).bitwiseAND(0x7FFFFFFF).cast("int").alias("tag")


def least_in_window(value: np.ndarray, width: int) -> np.ndarray:
    """For each p, the leftmost place of the least of value[p : p + width]; p to len - width."""
    n = len(value) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    v, at, have = value, np.arange(len(value)), 1
    while have < width:
        step = min(have, width - have)
        right = v[step:] < v[:-step]
        v, at = np.where(right, v[step:], v[:-step]), np.where(right, at[step:], at[:-step])
        have += step
    return at[:n]


_POWERS: list[np.ndarray] = []
_BASE, _INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << int(n).bit_length()
        _POWERS[:] = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, _U)
            p[0] = 1
            with np.errstate(over="ignore"):
                _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


class Stretches:
    """Names of arbitrary stretches of a sequence of random values, in constant time each."""

    def __init__(self, values: np.ndarray):
        up, self.down = _powers(len(values) + 1)
        with np.errstate(over="ignore"):
            self.total = np.concatenate(([_U(0)], np.cumsum(values * up[: len(values)], dtype=_U)))

    def name(self, begin: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.total[end] - self.total[begin]) * self.down[begin]
            return words.mix(raw + words.mix((end - begin).astype(_U) * _U(65537) + salt.astype(_U)))


def runs_of(anchor: np.ndarray, start: np.ndarray, owner: np.ndarray, key: np.ndarray, values: Stretches, size: int, base: np.ndarray) -> Runs:
    """Neighbouring window starts with one anchor, named."""
    if not len(start):
        z = np.zeros(0, np.int64)
        return Runs(z, z.astype(_U), z.astype(_U), z, z, base, z)
    cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1))))
    end = np.append(cut[1:], len(start)) - 1
    a, first, last = anchor[cut], start[cut], start[end]
    return Runs(owner[cut], key[a], values.name(first, last + size, a - first), first, last, base, a - first)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _once_a_text(r: Runs) -> np.ndarray:
    """Index of each text's first run of every ctx."""
    with np.errstate(over="ignore"):
        k = words.mix(r.ctx + words.mix(r.owner.astype(_U) + _U(1)))
    return np.unique(k, return_index=True)[1]


def repeated_starts(docs: DataFrame, kind: Kind) -> DataFrame:
    """(doc_id, spans array<struct<a, b>>): window starts a to b of a text that are repeats; only texts that have any.

    docs: (doc_id, text), ids unique and not null.
    """
    spark = docs.sparkSession
    runs, windows, size, earlier = kind.runs, kind.windows, kind.size, kind.earlier

    def names(batches):
        held = []

        def merged():
            doc, key, ctx, n = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((doc, ctx))
            doc, key, ctx, n = doc[order], key[order], ctx[order], n[order]
            at = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1])))
            held.clear()
            return pa.RecordBatch.from_arrays([_signed(key[at]), _signed(ctx[at]), pa.array(doc[at]), pa.array(np.add.reduceat(n, at))], ["key", "ctx", "doc_id", "n"])

        for batch in steps(batches):
            data, offs = buffers(batch.column("text"))
            r = runs(data, offs)
            if len(r.key):
                held.append((_ids(batch)[r.owner], r.key, r.ctx, np.ones(len(r.key), np.int64)))
            if len(held) >= _GATHER:
                yield merged()
        if held:
            yield merged()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = docs.mapInArrow(names, "key long, ctx long, doc_id long, n long").repartition(parts, "key")
    counted = counted.groupBy("key", "ctx").agg(F.min("doc_id").alias("lead"), F.sum("n").alias("n"))
    by_key = Window.partitionBy("key")
    counted = counted.withColumn("kinds", F.count("*").over(by_key)).where((F.col("n") > 1) | (F.col("kinds") > 1))
    counted = stored(counted.select("ctx", _tag("key"), "lead", "n", (F.col("kinds") > 1).alias("open")), "names")

    def places(batches):
        for batch in steps(batches):
            data, offs = buffers(batch.column("text"))
            r = runs(data, offs)
            at = _once_a_text(r)
            if len(at):
                own = r.owner[at]
                columns = [_signed(r.ctx[at]), pa.array((r.key[at] & _U(0x7FFFFFFF)).astype(np.int32)), pa.array(_ids(batch)[own]), pa.array((r.first[at] - r.base[own]).astype(np.int32)), pa.array((r.last[at] - r.first[at]).astype(np.int32)), pa.array(r.lag[at].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["ctx", "tag", "doc_id", "a", "more", "lag"])

    found = docs.mapInArrow(places, "ctx long, tag int, doc_id long, a int, more int, lag int").join(counted, ["ctx", "tag"])
    whole = F.col("lead") < F.col("doc_id") if earlier else F.col("n") > 1
    found = stored(found.select("doc_id", "a", (F.col("a") + F.col("more")).alias("b"), "lag", whole.alias("whole"), (F.col("open") & (F.col("lead") == F.col("doc_id"))).alias("lead")).where("whole or lead"), "runs")

    discard(counted)
    leads = found.where("lead").groupBy("doc_id").agg(F.collect_list(F.struct("a", "b", "lag")).alias("spans"))

    def compared(batches):
        for batch in steps(batches):
            data, offs = buffers(batch.column("text"))
            owner, a, b, _ = _flat(batch.column("spans"))
            count = b - a + 1
            start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
            owner = np.repeat(owner, count)
            x, y = windows(data, offs, owner, start)
            yield pa.RecordBatch.from_arrays([_signed(x), _signed(y), pa.array(_ids(batch)[owner]), pa.array(start.astype(np.int32))], ["x", "y", "doc_id", "a"])

    def cores(batches):
        for batch in steps(batches):
            data, offs = buffers(batch.column("text"))
            owner, a, b, lag = _flat(batch.column("spans"))
            least, most = (a + lag - b) // kind.step, lag // kind.step
            count = most - least + 1
            k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(least, count)
            owner, a, b, anchor = (np.repeat(x, count) for x in (owner, a, b, a + lag))
            near, far = anchor - kind.step * k, anchor - kind.step * k - kind.step + 1
            lo, hi, at = np.maximum(a, far), np.minimum(b, near), offs[owner]
            value = Stretches(words.byte_values(9, True)[data])
            core = value.name(at + near, at + far + size, k)
            cut = hi - lo + size
            flat = data[np.arange(int(cut.sum())) - np.repeat(np.cumsum(cut) - cut, cut) + np.repeat(at + lo, cut)]
            part = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(cut))).astype(np.int64)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([_signed(core), pa.array(_ids(batch)[owner]), pa.array(lo.astype(np.int32)), part.cast(pa.binary())], ["core", "doc_id", "a", "text"])

    def opened(batches):
        for batch in steps(batches):
            data, offs = buffers(batch.column("text"))
            count = np.diff(offs) - size + 1
            owner = np.repeat(np.arange(batch.num_rows), count)
            start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            a = pa.array((batch.column("a").to_numpy()[owner] + start).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*map(_signed, windows(data, offs, owner, start)), pa.array(_ids(batch)[owner]), a], ["p", "q", "r", "s", "doc_id", "a"])

    named = docs.join(leads, "doc_id").select("doc_id", "text", "spans")
    schema = "x long, y long, doc_id long, a int"
    if kind.step:
        named = named.mapInArrow(cores, "core long, doc_id long, a int, text binary").withColumn("k", F.count("*").over(Window.partitionBy("core"))).where("k > 1").drop("k", "core")
        named = pieces = stored(named, "steps")  # so that the texts that were shuffled for it can go
        named = named.mapInArrow(opened, "p long, q long, r long, s long, doc_id long, a int")
        # a round: both halves of a window get the name of their pair of quarters, and one that is unique takes the window out
        for half, pair in (("x", ["p", "q"]), ("y", ["r", "s"])):
            named = named.withColumn("k", F.count("*").over(Window.partitionBy(*pair))).where("k > 1").withColumn(half, F.xxhash64(*pair)).drop("k", *pair)
    else:
        named = named.mapInArrow(compared, schema)
    pair = Window.partitionBy("x", "y")
    if earlier:
        single = named.withColumn("k", F.row_number().over(pair.orderBy("doc_id", "a"))).where("k > 1")
    else:
        single = named.withColumn("k", F.count("*").over(pair)).where("k > 1")
    single = stored(single.select("doc_id", "a", F.col("a").alias("b")), "windows")
    if kind.step:
        discard(pieces)
    both = found.where("whole").select("doc_id", "a", "b").unionByName(single)
    return both.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _flat(spans: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, a, b, lag) of every span."""
    owner = np.repeat(np.arange(len(spans)), np.diff(np.asarray(spans.offsets)))
    flat = spans.flatten()
    return owner, *(np.asarray(flat.field(k)).astype(np.int64) for k in range(3))


def covered(spans: pa.Array, base: np.ndarray, size: int, total: int, local: Runs) -> np.ndarray:
    """Whether each symbol lies in a repeated window: given spans (relative to their text), and runs that a text repeats itself."""
    edge = np.zeros(total + 1, np.int64)
    if len(spans):
        filled = spans.fill_null([]) if spans.null_count else spans
        owner = np.repeat(np.arange(len(filled)), np.diff(np.asarray(filled.offsets)))
        flat = filled.flatten()
        if len(flat):
            a, b = (np.asarray(flat.field(k)).astype(np.int64) for k in (0, 1))
            np.add.at(edge, base[owner] + a, 1)
            np.add.at(edge, base[owner] + b + size, -1)
    if len(local.first):
        np.add.at(edge, local.first, 1)
        np.add.at(edge, local.last + size, -1)
    return np.cumsum(edge[:-1]) > 0


def own_repeats(r: Runs) -> Runs:
    """Runs whose ctx the same text has earlier."""
    again = np.ones(len(r.ctx), bool)
    with np.errstate(over="ignore"):
        k = words.mix(r.ctx + words.mix(r.owner.astype(_U) + _U(1)))
    again[np.unique(k, return_index=True)[1]] = False
    return Runs(r.owner[again], r.key[again], r.ctx[again], r.first[again], r.last[again], r.base, r.lag[again])
