import re

import duckdb
import pytest

from tracelake.llm import jaccard_join


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(texts, threshold, n):
    sets = {i: shingles(t, n) for i, t in texts.items()}
    top = {i: i for i in texts}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    at = {}
    for i, s in sets.items():
        for g in s:
            at.setdefault(g, []).append(i)
    for i, s in sets.items():
        common = {}
        for g in s:
            for j in at[g]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, k in common.items():
            if 100 * k >= threshold * (len(s) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return {i: (len(sets[i]), root(i)) for i in texts}


def found(df, **how):
    rows = jaccard_join.jaccard_components(df, **how).collect()
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(out) == len(rows)
    return out


def test_awkward_rows(docs, texts):
    assert found(docs) == brute(texts, 90, 3)


@pytest.mark.parametrize(("threshold", "n"), [(90, 3), (80, 5)])
def test_chains_and_copies(spark, threshold, n):
    """Chains of small changes, groups of copies, and texts of one and two shingles."""
    texts, word = {}, iter(f"v{i}" for i in range(100_000))
    for g in range(6):
        base = [next(word) for _ in range(60 + 40 * g)]
        for step in range(12):
            texts[len(texts) * 7 + 3] = " ".join(base)
            texts[len(texts) * 7 + 3] = " ".join(base).upper()
            for _ in range(1 + g % 3):
                base[(step * 17 + 5) % len(base)] = next(word)
    for t in ("a", "a b", "a b c", "a b c d", "A  B\tC", "", " \n"):
        texts[len(texts) * 7 + 3] = t
    got = found(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5), threshold=threshold, n=n)
    assert got == brute(texts, threshold, n)


def test_real_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(df) == brute({r.doc_id: r.text or "" for r in df.collect()}, 90, 3)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_oracle(sf):
    """The SQL, which Spark's rows are held against, against plain sets."""
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '/root/testdata/{sf}/documents.parquet'")
    texts = dict(con.sql("select doc_id, coalesce(text, '') from documents").fetchall())
    assert {i: (n, c) for i, n, c in con.sql(jaccard_join.ORACLE_SQL).fetchall()} == brute(texts, 90, 3)


def test_no_rows(none):
    assert found(none) == {}
    with pytest.raises(ValueError):
        jaccard_join.jaccard_components(none, 50)


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "b c d"), (1, "a b c"), (2, "A B C"), (None, "a b c"), (3, None)], "doc_id long, text string")
    assert found(df) == {1: (1, 1), 2: (1, 1), 3: (0, 3)}
