"""Removal of words covered by a window of ``size`` words that is found elsewhere.

Recompression: a text is a sequence of symbols, at first its words. A round names
runs (a symbol beside its equal) and then pairs (a symbol of the left class before
one of the right class, classes being a bit of the name), so that whether two
neighbours join depends on them and their neighbours alone. A new name is a hash of
the names it is made of, the same on every executor. After two rounds of pairs a
symbol has at most 8 words, and two equal windows have the same symbols except within
8 words of their ends. Most symbols are still a word or two, which common words make
common too, so a last round names each symbol together with those after it, as far as
they end within 8 words. The least-named of the interior blocks stands for a window:
Spark counts it over the whole corpus, a window whose block is found once is out, and
a repeat is then verified by the names of all its words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words
from .common import buffers, one_an_id, steps, table, texts_of
from .repeats import Kind, Runs, Stretches, covered, least_in_window, own_repeats, repeated_starts, runs_of

_U = np.uint64
#: Words of a symbol at most, and how far off the words are, at most, that a border's place depends on.
SYMBOL = REACH = 8
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
_LAST = _U(2**64 - 1)


def _join(sym: np.ndarray, own: np.ndarray, at: np.ndarray, merge: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins each marked symbol with the next one."""
    i = np.flatnonzero(merge)
    out = sym.copy()
    with np.errstate(over="ignore"):
        out[i] = words.mix(sym[i] * _U(2 * seed + 3) + words.mix(sym[i + 1] + _U(seed)))
    keep = np.ones(len(sym), bool)
    keep[i + 1] = False
    return out[keep], own[keep], at[keep]


def _pairs(sym: np.ndarray, own: np.ndarray, seed: int) -> np.ndarray:
    left = (words.mix(sym + _U(seed * 977)) & _U(1)) == 0
    merge = np.zeros(len(sym), bool)
    merge[:-1] = left[:-1] & ~left[1:] & (own[1:] == own[:-1])
    return merge


def symbols(sym: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, index of the word that each begins with) after a round of runs and two of pairs."""
    at = np.arange(len(sym))
    if len(sym) < 2:
        return sym, at
    alike = np.zeros(len(sym) + 1, bool)  # alike[i]: symbols i - 1 and i
    alike[1:-1] = (sym[1:] == sym[:-1]) & (own[1:] == own[:-1])
    twin = alike[1:] & ~alike[:-1] & ~np.append(alike[2:], False)  # a run of exactly two
    sym, own, at = _join(sym, own, at, twin, 11)
    for seed in (12, 13):
        sym, own, at = _join(sym, own, at, _pairs(sym, own, seed), seed)
    return sym, at


def blocks(sym: np.ndarray, at: np.ndarray, total: int) -> np.ndarray:
    """Name of each symbol and those that follow it and end within SYMBOL words of its beginning; total: number of words."""
    end = np.searchsorted(np.append(at[1:], total), at + SYMBOL, "right")
    begin = np.arange(len(sym))
    return Stretches(sym).name(begin, end, np.zeros(len(sym), np.int64))


def _kind(size: int) -> Kind:
    def runs(data: np.ndarray, offs: np.ndarray) -> Runs:
        starts, _, first = words.word_spans(data, offs)
        h = words.word_hashes(data, starts)
        own = words.owners(first)
        if len(h) < size:
            z = np.zeros(0, np.int64)
            return runs_of(z, z, z, z.astype(_U), None, size, first[:-1])
        sym, at = symbols(h, own)
        name = np.full(len(h), _LAST, _U)
        name[at] = blocks(sym, at, len(h))
        # blocks that begin REACH words after a window's start and end, with what their end depends on, in it
        best = least_in_window(name, size - 2 * REACH - SYMBOL + 1)
        start = np.arange(len(h) - size + 1)
        anchor = best[start + REACH]
        ok = own[start] == own[start + size - 1]
        return runs_of(anchor[ok], start[ok], own[start][ok], name, Stretches(h), size, first[:-1])

    def windows(data, offs, owner, start):
        starts, _, first = words.word_spans(data, offs)
        h = words.word_hashes(data, starts)
        s = Stretches(h)
        at = first[:-1][owner] + start
        zero = np.zeros(len(at), np.int64)
        s2 = Stretches(words.mix(h ^ _U(0x5851F42D4C957F2D)))
        return s.name(at, at + size, zero), s2.name(at, at + size, zero)

    return Kind(runs, windows, size, False)


def substring_dedup(docs: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every document.

    Words are ``[^\\x20\\x09-\\x0D]+``, null texts have none. A word goes if a window
    of ``size`` words that covers it starts anywhere else too, in any text; every
    place of a repeat goes, the first included. kept: the other words, joined by one
    space. Rows with a null id are left out; of rows that share an id the one with
    the smallest text counts.
    """
    if size < 2 * (REACH + SYMBOL):  # every window is to have a symbol inside
        raise ValueError(f"size must be {2 * (REACH + SYMBOL)} or more")
    rows = one_an_id(texts_of(docs, id_col, text_col))
    kind = _kind(size)
    spans = repeated_starts(rows, kind)

    def cut(batches):
        for batch in steps(batches):
            data, offs = buffers(batch.column("text"))
            starts, ends, first = words.word_spans(data, offs)
            gone = covered(batch.column("spans"), first[:-1], size, len(starts), own_repeats(kind.runs(data, offs)))
            # the kept words with the byte after each, which becomes a space
            spaced = np.append(data, np.uint8(32))
            a, lens = starts[~gone], (ends - starts)[~gone] + 1
            total = np.cumsum(lens)
            n = int(total[-1]) if len(total) else 0
            out = spaced[np.arange(n) - np.repeat(total - lens, lens) + np.repeat(a, lens)]
            out[total - 1] = 32
            left = np.diff(np.concatenate(([0], np.cumsum(~gone)))[first])
            end = np.concatenate(([0], total))[np.concatenate(([0], np.cumsum(left)))].tolist()
            kept = [out[x : max(x, y - 1)].tobytes() for x, y in zip(end, end[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(first)), pa.array(words.per_text(gone, first)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k.decode() for k in kept], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    joined = rows.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, KEPT)


def query(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH split AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM split)),
again AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
starts AS (SELECT doc_id, i FROM windows WHERE s IN (SELECT s FROM again)),
every AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM split),
marked AS (
  SELECT e.doc_id, e.j, e.x, max(s.i) OVER (PARTITION BY e.doc_id ORDER BY e.j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM every e LEFT JOIN starts s ON s.doc_id = e.doc_id AND s.i = e.j),
per AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, string_agg(x, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_removed, sha256(coalesce(p.kept, '')) AS kept_sha256 FROM split d LEFT JOIN per p ON p.doc_id = d.doc_id
"""
