import random
import re

import duckdb

from tracelake.llm.line_dedup import ORACLE_SQL, line_dedup


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :]


def brute(texts, least=1, near=1):
    first, order = {}, []
    for d in sorted(texts):
        for p, raw in enumerate(texts[d].split("\n")):
            line = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", raw)
            if len(line) >= least and line not in first:
                first[line] = (d, p)
                order.append(line)
    bad = {b for j, b in enumerate(order) if len(b) >= near and any(len(a) >= near and one_edit(a, b) for a in order[:j])}
    out = {}
    for d, t in texts.items():
        kept, n = [], 0
        for p, raw in enumerate(t.split("\n")):
            line = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", raw)
            if len(line) >= least and (line in bad or (d, p) > first[line]):
                n += 1
            else:
                kept.append(raw)
        out[d] = (len(t.split("\n")), n, "\n".join(kept))
    return out


def made():
    rnd = random.Random(9)
    base = ["".join(rnd.choice("abcé 漢x") for _ in range(n)) for n in (19, 20, 23, 24, 25, 40, 63, 64, 65, 66, 127, 128, 129, 130, 300, 700)]
    base += ["a" * 64, "a" * 65, "a" * 200, "ab" * 50]
    texts = {}
    for i in range(120):
        lines = []
        for _ in range(rnd.randint(0, 6)):
            s = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                p = rnd.randrange(len(s) + 1)
                act = rnd.randrange(3)
                if act == 0:
                    s.insert(p, rnd.choice("abz"))
                elif p < len(s):
                    s[p : p + 1] = [] if act == 1 else [rnd.choice("abz")]
            lines.append("".join(s) + rnd.choice(["", " ", "\r"]))
        texts[i * 2] = "\n".join(lines)
    return texts


def test_against_brute_force(spark, texts):
    every = made() | {i + 10**4: t for i, t in texts.items()}
    df = spark.createDataFrame(list(every.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in line_dedup(df).collect()}
    want = brute(every)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {} and len(got) == len(want)


def test_awkward_tables(docs, texts, none):
    assert line_dedup(none).count() == 0
    assert line_dedup(docs.union(docs)).count() == len(texts)


def test_oracle(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}'")
    want = sorted(con.sql(ORACLE_SQL).fetchall())
    from pyspark.sql import functions as F

    got = line_dedup(spark.read.parquet(path)).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept"), 256))
    assert sorted(map(tuple, got.collect())) == want


def short():
    rnd = random.Random(4)
    lines = ["", " ", "a", "b", "é", "ab", "ba", "abc", "Les.", "Les. ", "Des.", "Erheed. Titionly.", "Erheed. Titionly", "x" * 15, "x" * 16, "x" * 17, "x" * 19]
    lines += ["".join(rnd.choice("abé漢") for _ in range(n)) for n in (5, 6, 7, 7, 8, 8, 9, 12, 15, 16, 17, 23, 24) for _ in range(3)]
    texts = {}
    for i in range(40):
        out = []
        for _ in range(rnd.randint(0, 5)):
            s = list(rnd.choice(lines))
            if s and rnd.random() < 0.5:
                p = rnd.randrange(len(s))
                s[p : p + rnd.randint(0, 1)] = rnd.choice(["", "z", "é"])
            out.append("".join(s))
        texts[i * 2] = "\n".join(out)
    return texts


def test_short_lines(spark, texts):
    every = made() | short() | {i + 10**4: t for i, t in texts.items()} | {i + 10**5: t for i, t in short().items()}
    df = spark.createDataFrame(list(every.items()), "doc_id long, text string").repartition(4)
    for least, near in ((1, 1), (1, 16), (20, 24)):
        got = {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in line_dedup(df, least, near).collect()}
        want = brute(every, least, near)
        assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {} and len(got) == len(want)


def test_stage_removes_short_repeats(spark):
    import corpus_pipeline

    rows = [(1, "Les.\n\n\nfirst text"), (2, "second one\n\nLes."), (3, "Les."), (4, "Erheed. Titionly.\nother words\nErheed, Titionly.")]
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got == {1: "Les.\n\n\nfirst text", 2: "second one\n", 4: "Erheed. Titionly.\nother words"}


def test_real_text_wins_over_blank(spark):
    rows = [(1, None), (1, "b real"), (1, "c real"), (2, " \n"), (2, "real"), (3, ""), (3, None)]
    got = {r.doc_id: r.kept for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "b real", 2: "real", 3: ""}
