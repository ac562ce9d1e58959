"""Removal of bytes covered by a string of ``size`` bytes that also starts earlier.

Prefix doubling: the rank of a position's first 2h bytes is the pair (rank of h bytes
here, rank of h bytes h further on). Ranks are 64-bit names of the pairs, equal for
equal bytes everywhere. Positions leave as soon as their rank is unique:

* offsets 1 to 16 name the grams of 32 bytes inside a slice of text. Every string of
  ``size`` bytes is tied to the least-ranked gram in it, which equal strings share, so
  only those positions, one in 35, go through Spark's first ranking;
* a gram found once drops all strings tied to it; strings around a gram that are
  alike as a whole are settled together;
* the positions around what is left are taken in steps of ``size`` // 6, and what
  the strings of a step have in common (5 / 6 of ``size``) is ranked next;
* what is left then is ranked position by position. Spark groups the pairs of ranks at
  offset ``size`` // 4 and names them anew, for both halves of the string; a half that
  is unique takes its position out. The pairs of the new ranks at offset ``size`` // 2
  are sorted with the place, and all but the first place of a pair are covered.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import buffers, one_an_id, steps, table, texts_of
from .repeats import Kind, Runs, Stretches, covered, least_in_window, own_repeats, repeated_starts, runs_of

GRAM = 32
_STEPS = words.randoms(8, 41)
SPANS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def doubled(rank: np.ndarray, to: int) -> np.ndarray:
    """Ranks of stretches of ``to`` (a power of two) from ranks of single positions."""
    h, k = 1, 0
    with np.errstate(over="ignore"):
        while h < to:
            rank = rank[:-h] * _STEPS[k] + rank[h:]
            h, k = 2 * h, k + 1
    return words.mix(rank)


def _kind(size: int) -> Kind:
    value = words.byte_values(9, True)

    def runs(data: np.ndarray, offs: np.ndarray) -> Runs:
        lens = np.diff(offs)
        if len(data) < size:
            z = np.zeros(0, np.int64)
            return runs_of(z, z, z, z.astype(np.uint64), None, size, offs[:-1])
        v = value[data]
        key = doubled(v, GRAM)
        at = least_in_window(key, size - GRAM + 1)
        owner = np.repeat(np.arange(len(lens)), lens)[: len(at)]
        start = np.flatnonzero(np.arange(len(at)) + size <= offs[1:][owner])
        return runs_of(at[start], start, owner[start], key, Stretches(v), size, offs[:-1])

    def windows(data, offs, owner, start):
        at = offs[owner] + start
        s = Stretches(value[data])
        cut = [0, size // 4, size // 2, size // 2 + size // 4, size]
        zero = np.zeros(len(at), np.int64)
        return tuple(s.name(at + a, at + b, zero) for a, b in zip(cut, cut[1:]))

    return Kind(runs, windows, size, True, size // 6)


def suffix_dedup(docs: DataFrame, size: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document.

    Texts are UTF-8 bytes, null ones empty. A byte goes if a string of ``size``
    bytes that covers it also starts earlier (in a smaller id, or earlier in the
    same text); strings are judged on the input. n_spans: maximal removed runs.
    kept: the remaining text, in which a character that lost only some of its bytes
    stays whole. Rows with a null id are left out; of rows that share an id the one
    with the smallest text counts. Texts shorter than ``size`` stay as they are.
    """
    if size < GRAM + 8:
        raise ValueError(f"size must be {GRAM + 8} or more")
    rows = one_an_id(texts_of(docs, id_col, text_col))
    kind = _kind(size)
    spans = repeated_starts(rows, kind)

    def cut(batches):
        for batch in steps(batches):
            data, offs = buffers(batch.column("text"))
            gone = covered(batch.column("spans"), offs[:-1], size, len(data), own_repeats(kind.runs(data, offs)))
            begins = gone & ~np.concatenate(([False], gone[:-1]))
            begins[offs[:-1][np.diff(offs) > 0]] = gone[offs[:-1][np.diff(offs) > 0]]
            # a character goes only with all its bytes
            lead = np.flatnonzero((data & 0xC0) != 0x80)
            whole = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.append(lead, len(data)))) if len(lead) else gone
            digest, kept = [], []
            for a, b in zip(offs.tolist(), offs[1:].tolist()):
                digest.append(hashlib.sha256(data[a:b][~gone[a:b]]).hexdigest())
                kept.append(data[a:b][~whole[a:b]].tobytes().decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offs)), pa.array(words.per_text(gone, offs)), pa.array(words.per_text(begins, offs)), pa.array(digest, pa.string()), pa.array(kept, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    joined = rows.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, SPANS)


def query(spark, sf_dir):
    return suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLE_SQL = r"""
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, i, substring(h, 2 * i - 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 - 98)) AS i FROM bytes)),
firsts AS (SELECT s, min({'d': doc_id, 'i': i}) AS f FROM strings GROUP BY s HAVING count(*) > 1),
starts AS (SELECT doc_id, i FROM strings JOIN firsts USING (s) WHERE {'d': doc_id, 'i': i} > f),
every AS (SELECT doc_id, substring(h, 2 * j - 1, 2) AS x, j FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 + 1)) AS j FROM bytes)),
marked AS (
  SELECT e.doc_id, e.j, e.x, max(s.i) OVER (PARTITION BY e.doc_id ORDER BY e.j ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM every e LEFT JOIN starts s ON s.doc_id = e.doc_id AND s.i = e.j),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), false) AS begins FROM marked),
per AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, count(*) FILTER (WHERE begins) AS spans, string_agg(x, '' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM edges GROUP BY doc_id)
SELECT b.doc_id, (len(b.h) // 2)::BIGINT AS n_bytes, coalesce(p.n, 0)::BIGINT AS n_removed, coalesce(p.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(p.kept, ''))) AS kept_sha256
FROM bytes b LEFT JOIN per p ON p.doc_id = b.doc_id
"""
