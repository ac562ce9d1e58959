import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tracelake.llm.common import buffers
from tracelake.llm.substring_dedup import ORACLE_SQL as substring_dedup_sql
from tracelake.llm.substring_dedup import _kind as kind_of_words
from tracelake.llm.substring_dedup import substring_dedup
from tracelake.llm.suffix_dedup import ORACLE_SQL as suffix_dedup_sql
from tracelake.llm.suffix_dedup import suffix_dedup


def brute_bytes(texts, size):
    first, out = {}, {}
    for i in sorted(texts):
        b = texts[i].encode()
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            w = b[s : s + size]
            if first.setdefault(w, (i, s)) != (i, s):
                gone[s : s + size] = b"\1" * size
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def brute_words(texts, size):
    where = defaultdict(int)
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in texts.items()}
    for w in split.values():
        for s in range(len(w) - size + 1):
            where[tuple(w[s : s + size])] += 1
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            if where[tuple(w[s : s + size])] > 1:
                gone[s : s + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def made(seed):
    """Texts of shared stretches of every length around the bounds, runs and periods."""
    rnd = random.Random(seed)
    vocab = ["a", "bb", "é", "the", "of", "漢字", "Word.", "x" * 30]
    pool = [[rnd.choice(vocab) for _ in range(rnd.choice([20, 34, 35, 36, 40, 70, 150]))] for _ in range(8)]
    pool += [["the"] * 60, ["the"] * 35, ["a", "bb"] * 30, ["é"] * 120]
    texts = {}
    for i in range(90):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(pool)
            lo = rnd.randint(0, 5)
            parts += p[lo : len(p) - rnd.randint(0, 5)] if rnd.random() < 0.7 else [rnd.choice(vocab) for _ in range(rnd.randint(1, 50))]
        texts[i * 7] = rnd.choice([" ", "\n", "  "]).join(parts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, texts, seed):
    every = {i + 10**4: t for i, t in texts.items()} | made(seed)
    df = spark.createDataFrame(list(every.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df).collect()}
    want = brute_bytes(every, 100)
    assert {i: (got[i], want[i]) for i in want if got.get(i) != want[i]} == {} and len(got) == len(want)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df).collect()}
    want = brute_words(every, 35)
    assert {i: (got[i], want[i]) for i in want if got.get(i) != want[i]} == {} and len(got) == len(want)


def test_common_words_open_few_windows():
    """Texts of common words without repeats: what Spark counts tells them apart, so few windows are left to compare."""
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    common = rnd.choices(vocab, [1 / (i + 1) for i in range(300)], k=400 * 200)
    texts = [" ".join(common[i : i + 200]) for i in range(0, len(common), 200)]
    r = kind_of_words(35).runs(*buffers(pa.array(texts)))
    windows = r.last - r.first + 1
    assert windows.sum() == 400 * (200 - 34)
    _, key, kinds = np.unique(r.key, return_inverse=True, return_counts=True)
    assert len(np.unique(r.ctx)) == len(r.ctx)
    assert windows[kinds[key] > 1].sum() < 0.1 * windows.sum()


def test_real_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    every = {r.doc_id: r.text for r in df.collect()}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df).collect()} == brute_bytes(every, 100)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df).collect()} == brute_words(every, 35)


def test_awkward_tables(docs, texts, none, spark):
    for f in (suffix_dedup, substring_dedup):
        assert f(none).count() == 0
        assert f(docs).count() == len(texts)
        twice = docs.union(docs).union(spark.createDataFrame([("x", None, "b", 1, "g")], docs.schema))
        assert sorted(map(tuple, f(twice).collect())) == sorted(map(tuple, f(docs).collect()))
    for r in suffix_dedup(docs).collect():
        assert r.n_removed or r.kept == texts[r.doc_id]


def test_oracles():
    """The SQL that Spark's rows are held against, against plain Python."""
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    texts = dict(con.sql("select doc_id, coalesce(text, '') from documents").fetchall())
    assert {r[0]: r[1:] for r in con.sql(suffix_dedup_sql).fetchall()} == brute_bytes(texts, 100)
    assert {r[0]: r[1:] for r in con.sql(substring_dedup_sql).fetchall()} == brute_words(texts, 35)
