import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tracelake.llm import fingerprints, quality_rules


def test_against_next(docs, texts, none, spark):
    got = {r.doc_id: r for r in fingerprints.against_next(docs).collect()}
    assert got.keys() == texts.keys()
    order = sorted(texts, reverse=True)
    for i, nxt in zip(order, order[1:] + order[:1]):
        t, k = texts[i], len(texts[i]) // 3
        edited = t[: len(t) - k] + texts[nxt][:k]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1
        bits = bin(int(r.fingerprint, 16) ^ int(got[nxt].fingerprint, 16)).count("1")
        assert r.near_next == 1 - bits / 128
        if edited == t:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
    prints = {}
    for i, t in texts.items():
        assert prints.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert fingerprints.against_next(none).count() == 0
    one = docs.where("doc_id = 40")
    assert fingerprints.against_next(one).first().near_next == 1
    twice = docs.union(docs)
    assert fingerprints.against_next(twice).count() == 2 * len(texts)
    table = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint_table(docs).collect()}
    assert table == {i: r.fingerprint for i, r in got.items()}


def test_edits_stay_near(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars > 400")
    r = fingerprints.against_next(docs).agg(F.avg((F.col("near_edited") > F.col("near_next")).cast("int")), F.avg("near_edited"), F.avg("near_next")).first()
    assert r[0] > 0.95 and r[1] > 0.65 and r[2] < 0.6


def test_radius_search(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**62, (40, 2), dtype=np.int64)
    values = [(int(a) << 64) | int(b) for a, b in base]
    for v in list(values):
        for flips in (1, 3, 4):
            x = v
            for k in rng.choice(128, flips, replace=False):
                x ^= 1 << int(k)
            values.append(x)
    values += values[:5]
    df = spark.createDataFrame([(f"{v:032x}",) for v in values], "fingerprint string")
    got = {(r.left, r.right, r.distance) for r in fingerprints.near_fingerprints(df, 3).collect()}
    one = sorted({f"{v:032x}" for v in values})
    want = {(a, b, d) for i, a in enumerate(one) for b in one[i + 1 :] if (d := bin(int(a, 16) ^ int(b, 16)).count("1")) <= 3}
    assert got == want and want
    assert fingerprints.near_fingerprints(df.limit(0)).count() == 0


def brute_stats(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = Counter(grams)
    hit = set()
    for i, g in enumerate(grams):
        if many[g] > 1:
            hit.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_stats(docs, texts, none, spark):
    got = {r.doc_id: r for r in quality_rules.judge(docs, []).collect()}
    real = {r.doc_id + 10**6: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    df = spark.createDataFrame(list(real.items()), "doc_id long, text string")
    got |= {r.doc_id: r for r in quality_rules.judge(df, []).collect()}
    for i, t in (texts | real).items():
        r, want = got[i], brute_stats(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (i, t[:50])
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r.base_failed == failed and r.kept == (not failed)
    assert quality_rules.judge(none, []).count() == 0


def test_learned_list():
    rng = np.random.default_rng(3)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    reject = (x["a"] > 0.8) & (x["b"] < 0.5) | (x["c"] > 0.95)
    rules = quality_rules.learn(x, reject)
    hit = np.zeros(3000, bool)
    for rule in rules:
        m = np.ones(3000, bool)
        for c in rule:
            m &= c.holds(x)
        hit |= m
    assert (hit == reject).mean() > 0.98
    assert quality_rules.learn({"a": np.zeros(0)}, np.zeros(0, bool)) == []
    assert quality_rules.learn({"a": np.zeros(5)}, np.zeros(5, bool)) == []


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.fit(docs, labels.where("doc_id % 2 = 0"))
    rows = quality_rules.judge(docs, rules).join(labels.where("doc_id % 2 = 1"), "doc_id")
    n, right, clean, lost = rows.agg(
        F.count("*"), F.sum((F.col("kept") == (F.col("quality") == 1)).cast("int")), F.sum("quality"), F.sum(((F.col("quality") == 1) & ~F.col("kept")).cast("int"))
    ).first()
    assert right / n > 0.9 and lost / clean < 0.05
    assert quality_rules.fit(docs, labels.limit(0)) == []


def test_wide_radius(spark):
    rnd = np.random.default_rng(2)
    values = [(int(a) << 64) | int(b) for a, b in rnd.integers(0, 2**62, (20, 2), dtype=np.int64)]
    for v in list(values):
        for flips in (15, 16, 19, 20, 21):
            values.append(v ^ sum(1 << int(k) for k in rnd.choice(128, flips, replace=False)))
    one = sorted({f"{v:032x}" for v in values})
    df = spark.createDataFrame([(x,) for x in one], "fingerprint string")
    want = {(a, b, d) for i, a in enumerate(one) for b in one[i + 1 :] if (d := bin(int(a, 16) ^ int(b, 16)).count("1")) <= 20}
    got = {(r.left, r.right, r.distance) for r in fingerprints.near_fingerprints(df, 20).collect()}
    assert got == want and len(want) >= 80
