"""N-gram Jaccard join by a token-group matrix.

A document is its set of word-shingle hashes. Documents with one set are one
entry. Let o = ceil(s * n) for an entry of n tokens: what it links with shares at
least o of them, and at most H = (n + m) * (1 - s) / (1 + s) tokens lie in only
one of two linked entries of n and m.

1. A sample of each entry, its first n - o + l tokens by hash, must have l tokens
   in common with the sample of a partner. Entries whose samples do not meet
   others' that often are out; with l = n * (1 - s) / 2 that is nearly every
   document that merely shares a passage or a line. Only what is left is read whole.
2. Entries with a minimal hash in common are compared with one of them, the one that
   has least to itself, and the links that hold make *groups* of similar entries. A
   second round does the same for the holders of each token that step 3 reads.
3. The token-group matrix has a row for each token and group cell whose union holds
   it; a large group has several cells. Tokens are taken rarest first, and those of
   one group alone are out of question. Of two linked entries one has its first MARK
   common tokens among its first n * (1 - s) / (1 + s) + MARK, the other among its
   first n - o + MARK, so a cell pair qualifies with MARK tokens in those columns.
4. A qualifying cell is opened: the entries of the smaller cell go to the larger one
   and are counted against its members, whole sets, in one pass over an inverted
   list. One link a cell is kept, as its members are one group already.

Nothing is compared within a group after step 2, so a group of near copies costs one
comparison a member, whatever its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import buffers, discard, map_steps, one_an_id, stored, table, texts_of
from .components import components

_U = np.uint64
#: Tokens that linked entries share in the columns of the matrix that are read.
MARK = 2
#: Independent minimal hashes that groups are made by, and how many make one key.
BANDS, ROWS = 3, 2
#: Tokens that a cell of a group holds, about, and entries that are held against one copy of a cell.
CELL, ASKS = 1 << 16, 256
#: Counters that one comparison step works on.
_COUNTERS = 1 << 22
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, offsets): each text's distinct shingle hashes in rising order."""
    data = _LOWER[data]
    starts, _, first = words.word_spans(data, offs)
    h = words.word_hashes(data, starts)
    own = words.owners(first)
    count = np.diff(first)
    gram = words.window_hash(h, n, 31)
    inside = np.flatnonzero(own[: len(gram)] == own[n - 1 :]) if len(gram) else np.zeros(0, np.int64)
    token, owner = gram[inside], own[: len(gram)][inside]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.zeros(len(short), _U)
        with np.errstate(over="ignore"):
            for k in range(n - 1):
                has = count[short] > k
                extra[has] = words.mix(extra[has] * _U(5) + h[first[short[has]] + k] + _U(k + 1))
        token, owner = np.concatenate((token, extra)), np.concatenate((owner, short))
    order = np.argsort(token)
    order = order[np.argsort(owner[order].astype(np.uint16 if len(offs) <= 1 << 16 else np.int64), kind="stable")]
    token, owner = token[order], owner[order]
    keep = np.ones(len(token), bool)
    keep[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[keep], owner[keep]
    return token, np.searchsorted(owner, np.arange(len(offs)))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _least(n, threshold: int):
    """Tokens that an entry of n has in common with any partner, at least. For arrays and columns."""
    return -(-threshold * n // 100) if isinstance(n, np.ndarray) else F.ceil(n * threshold / 100)


def _extra(n, threshold: int):
    """Sampled tokens beyond those that a partner may lack, which two samples must share."""
    return n * (100 - threshold) // 200 + MARK if isinstance(n, np.ndarray) else F.floor(n * (100 - threshold) / 200) + MARK


class _Cell:
    """The members of one cell as an inverted list, for entries to be counted against."""

    def __init__(self, reps: list[int], sets: list[np.ndarray]):
        self.reps, self.size = np.array(reps), np.array([len(x) for x in sets])
        token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(token, kind="stable")
        token, self.owner = token[order], owner[order]
        at = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        self.token, self.begin, self.count = token[at], at, np.diff(np.append(at, len(token)))

    def first_links(self, sets: list[np.ndarray], threshold: int) -> np.ndarray:
        """For each set the member it links with, of several the first; -1 if none."""
        out, members = np.full(len(sets), -1), len(self.reps)
        most = max(1, _COUNTERS // members // max(1, max(len(x) for x in sets)))
        for lo in range(0, len(sets), most):
            part = sets[lo : lo + most]
            size = np.array([len(x) for x in part])
            token, ask = np.concatenate(part), np.repeat(np.arange(len(part)), size)
            at = np.minimum(np.searchsorted(self.token, token), len(self.token) - 1)
            hit = self.token[at] == token
            at, ask = at[hit], ask[hit]
            n = self.count[at]
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[at], n)
            both = np.bincount(np.repeat(ask, n) * members + self.owner[place], minlength=len(part) * members).reshape(len(part), members)
            ok = 100 * both >= threshold * (size[:, None] + self.size[None, :] - both)
            out[lo : lo + most] = np.where(ok.any(1), ok.argmax(1), -1)
        return out


def _opened(asks: DataFrame, cells: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) between entries and the members of the cells they ask, one for each entry and cell.

    asks: (rep, cell); cells: (rep, cell); sets: (rep, tokens). A cell that very many
    ask is opened in several tasks, each with a copy of the cell and ASKS of them.
    """
    asks = stored(asks, "asks")
    load = stored(asks.groupBy("cell").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("copies")), "asked")
    members = cells.join(load, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), "rep")
    asking = asks.join(load, "cell").select("cell", F.pmod(F.xxhash64("rep"), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("kind"), "rep")

    def run(batches):
        at, reps, have, cell = None, [], [], None
        for batch in batches:
            keys = list(zip(batch.column("cell").to_pylist(), batch.column("copy").to_pylist()))
            kind, rep = batch.column("kind").to_pylist(), batch.column("rep").to_pylist()
            tokens = batch.column("tokens")
            offs = np.asarray(tokens.offsets).astype(np.int64)
            flat = np.asarray(tokens.flatten()).view(_U)
            sets_ = [flat[a:b] for a, b in zip(offs - offs[0], offs[1:] - offs[0])]
            found, i = [], 0
            while i < len(keys):
                if keys[i] != at:
                    at, reps, have, cell = keys[i], [], [], None
                if kind[i] == 0:
                    reps.append(rep[i])
                    have.append(sets_[i].copy())
                    i += 1
                    continue
                j = i
                while j < len(keys) and keys[j] == at and kind[j] == 1:
                    j += 1
                if reps:
                    cell = cell or _Cell(reps, have)
                    link = cell.first_links(sets_[i:j], threshold)
                    found += [(rep[i + k], int(cell.reps[m])) for k, m in enumerate(link) if m >= 0]
                i = j
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = _merged(members.unionByName(asking), sets, "rep").select("cell", "copy", "kind", "rep", "tokens")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = stored(rows.repartition(parts, "cell", "copy").sortWithinPartitions("cell", "copy", "kind").mapInArrow(run, "a long, b long"), "links")
    discard(asks, load)
    return out


def _merged(a: DataFrame, b: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join whose sides both grow with the corpus: merged at every size, so that what is measured is what a large input does."""
    return a.join(b.hint("merge"), on, how)


def _met(tokens: DataFrame, sizes: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(tokens that several entries sample, entries that meet others often enough to link, with the share of their tokens that they were met in)."""
    shared = stored(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token"), "shared")
    tokens = stored(_merged(tokens, shared, "token", "left_semi"), "met")
    discard(shared)
    hits = tokens.groupBy("rep").agg(F.count("*").alias("hits"))
    low = _least(F.col("n"), threshold)
    live = _merged(hits, sizes, "rep").where(F.col("hits") >= F.least(_extra(low, threshold), low)).select("rep", "n", (F.col("hits") / F.col("n")).alias("share"))
    return tokens, stored(live, "live")


def _grouped(live: DataFrame, labels: DataFrame) -> DataFrame:
    """(rep, n, group) of every live entry, its own group where nothing links it."""
    return _merged(live, labels.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "n", F.coalesce("component", "rep").alias("group"))


def jaccard_components(docs: DataFrame, threshold: int = 90, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; threshold in percent.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text of fewer than n
    words is one shingle, one without words (or null) has none and links with nothing.
    Links: 100 * intersection >= threshold * union. Rows with a null id are left
    out; of rows that share an id the one with the smallest text that is not blank counts.
    """
    if not 50 < threshold <= 100:
        raise ValueError("threshold must be over 50 and at most 100")
    rows = one_an_id(texts_of(docs, id_col, text_col))

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        token, offs = shingle_sets(*buffers(batch.column("text")), n)
        size = np.diff(offs)
        full = size > 0
        at = offs[:-1][full]
        set_a, set_b = np.zeros(len(size), _U), np.zeros(len(size), _U)
        keys = np.zeros((len(size), BANDS), _U)
        if len(token):
            with np.errstate(over="ignore"):
                set_a[full] = words.mix(np.add.reduceat(words.mix(token), at))
                set_b[full] = words.mix(np.add.reduceat(words.mix(token ^ _U(0x5851F42D4C957F2D)), at) + _U(1))
                for k in range(BANDS):
                    for r in range(ROWS):
                        least = np.minimum.reduceat(words.mix(token + _U((k * ROWS + r + 1) * 7919)), at)
                        keys[full, k] = words.mix(keys[full, k] * _U(3) + least + _U(k))
        length = np.minimum(size, size - _least(size, threshold) + _extra(size, threshold))
        sample = token[np.arange(len(token)) - np.repeat(offs[:-1], size) < np.repeat(length, size)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(size), _signed(set_a), _signed(set_b), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), _signed(sample)), pa.FixedSizeListArray.from_arrays(_signed(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))],
            ["doc_id", "n", "set_a", "set_b", "sample", "bands"],
        )

    feats = stored(map_steps(rows, features, "doc_id long, n long, set_a long, set_b long, sample array<long>, bands array<long>"), "sets")
    # documents with one set are one entry; an entry of one token links with no other
    alike = stored(feats.where("n > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")), "reps")
    reps = _merged(feats.where("n > 1"), alike.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "rep")
    sampled = stored(reps.select("rep", F.explode("sample").alias("token")), "sampled")
    # 1. twice, as tokens shared with an entry that is out count no more
    first, live = _met(sampled, feats.select(F.col("doc_id").alias("rep"), "n"), threshold)
    second, live2 = _met(_merged(first, live, "rep", "left_semi"), live.select("rep", "n"), threshold)
    discard(sampled, first, second, live)
    live = live2

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        token, offs = shingle_sets(*buffers(batch.column("text")), n)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), _signed(token))], ["rep", "tokens"])

    own = _merged(rows, live.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sets = stored(map_steps(own, whole, "rep long, tokens array<long>"), "live-sets")
    # 2. groups by minimal hashes: every entry against the first with the same hash
    banded = feats.select(F.col("doc_id").alias("rep"), F.posexplode("bands").alias("band", "key"))
    banded = _merged(banded, live, "rep")
    banded = stored(banded, "bands")
    lead = stored(banded.groupBy("band", "key").agg(F.max(F.struct("share", "rep", "n")).alias("lead"), F.count("*").alias("size")).where("size > 1").select("band", "key", "lead"), "leads")
    fits = 100 * F.least("n", "lead.n") >= threshold * F.greatest("n", "lead.n")
    stars = _merged(banded, lead, ["band", "key"]).where((F.col("rep") != F.col("lead.rep")) & fits).select("rep", F.col("lead.rep").alias("cell")).distinct()
    near = _opened(stars, live.select("rep", F.col("rep").alias("cell")), sets, threshold)
    labels = components(near)
    discard(banded, lead)
    grouped = stored(_grouped(live, labels), "grouped")
    tokens = _merged(sets, grouped, "rep").select("rep", "group", F.explode("tokens").alias("token"))
    mixed = tokens.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count("*").alias("df")).where("lo < hi").select("token", "df")
    mixed = stored(mixed, "mixed")
    ranked = _merged(tokens.select("rep", "token"), mixed, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("by_df"))
    # tokens of one group alone stand before these
    own, c = F.col("n") - F.size("by_df"), F.floor(F.col("n") * (100 - threshold) / (100 + threshold)) + MARK
    wide = F.col("n") - _least(F.col("n"), threshold) + MARK
    cut = F.slice("by_df", 1, F.greatest(wide - own, F.lit(0)).cast("int"))
    columns = _merged(ranked, grouped, "rep").select("rep", "n", "group", (own / F.col("n")).alias("alone"), F.posexplode(cut).alias("pos", "t"), (c - own).alias("c"))
    columns = stored(columns.select("rep", "n", "group", "alone", F.col("t.token").alias("token"), (F.col("pos") < F.col("c")).alias("first")), "columns")
    discard(mixed)
    # the second round of groups: every holder of a token against the one that has least to itself
    front = columns.groupBy("token").agg(F.min(F.struct("alone", "rep", "n", "group", "first")).alias("lead"), F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("token", "lead")
    front = stored(front, "leads")
    reach = _merged(columns, front, "token").where((F.col("group") != F.col("lead.group")) & (F.col("first") | F.col("lead.first")) & fits)
    reach = reach.groupBy("rep", F.col("lead.rep").alias("cell")).agg(F.count("*").alias("hits")).where(F.col("hits") >= MARK).select("rep", "cell")
    mid = _opened(reach, live.select("rep", F.col("rep").alias("cell")), sets, threshold)
    near = stored(near.unionByName(mid), "links")
    discard(front, labels)
    labels = components(near)
    # 3. the matrix over cells of groups
    regrouped = stored(_grouped(live, labels), "grouped")
    large = stored(regrouped.groupBy("group").agg(F.ceil(F.sum("n") / CELL).cast("int").alias("cells")), "large")
    cells = _merged(regrouped, large, "group").select("rep", "n", "group", F.xxhash64("group", F.pmod(F.xxhash64("rep"), F.col("cells"))).alias("cell"))
    cells = stored(cells, "cells")
    matrix = _merged(columns.select("rep", "token", "first"), cells, "rep").groupBy("token", "cell", "group").agg(F.max("first").alias("first"))
    matrix = stored(matrix, "matrix")
    other = matrix.select("token", F.col("cell").alias("other"), F.col("group").alias("other_group"))
    pairs = _merged(matrix.where("first"), other, "token").where("group <> other_group")
    pairs = pairs.groupBy("cell", "other").agg(F.count("*").alias("hits")).where(F.col("hits") >= MARK).select("cell", "other")
    # 4. the smaller cell of a pair asks the larger one
    size = stored(cells.groupBy("cell").agg(F.count("*").alias("members")), "cell-sizes")
    sized = pairs.join(size, "cell").join(size.select(F.col("cell").alias("other"), F.col("members").alias("others")), "other")
    forth = (F.col("members") < F.col("others")) | ((F.col("members") == F.col("others")) & (F.col("cell") < F.col("other")))
    turned = sized.select(F.when(forth, F.col("cell")).otherwise(F.col("other")).alias("from"), F.when(forth, F.col("other")).otherwise(F.col("cell")).alias("cell")).distinct()
    asks = turned.join(cells.select(F.col("cell").alias("from"), "rep"), "from").select("rep", "cell")
    far = _opened(asks, cells.select("rep", "cell"), sets, threshold)
    found = components(near.unionByName(far)).select(F.col("id").alias("rep"), "component")
    discard(matrix, columns, size, cells, large, grouped, regrouped, labels, sets, live, near, mid, far)
    out = _merged(feats.select("doc_id", "n", "set_a", "set_b"), alike, ["set_a", "set_b"], "left")
    out = out.withColumn("rep", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")))
    out = _merged(out, found, "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s
  FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
ways AS (SELECT x AS a, y AS b FROM links UNION SELECT y, x FROM links),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, e.b FROM reach r JOIN ways e ON e.a = r.b),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id))::BIGINT AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_of l ON l.a = d.doc_id
"""
