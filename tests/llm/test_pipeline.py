"""Every stage of the pipeline, and their chain, against plain Python; nulls, blanks, repeated ids, no rows and clashing columns."""

import re

import corpus_pipeline as pipe
import public_tokenizers as P
import pytest
from test_documents import brute_stats
from test_jaccard import brute as brute_groups
from test_lines import brute as brute_lines
from test_tokens import pieces_ok

from tracelake.llm import quality_rules

REAL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def by_id(df):
    rows = df.collect()
    out = {r.doc_id: r for r in rows}
    assert len(out) == len(rows) and df.columns == pipe.COLUMNS
    assert all(r.n_chars == len(r.text) for r in rows)
    return out


def kept_lines(texts):
    return {i: t for i, (_, _, t) in brute_lines(texts).items() if WORD.search(t)}


def kept_groups(texts):
    return {i: texts[i] for i, (_, root) in brute_groups(texts, 80, 5).items() if i == root}


def kept_bytes(texts, size=100):
    first, out = {}, {}
    for i in sorted(texts):
        b = texts[i].encode()
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if first.setdefault(b[s : s + size], (i, s)) != (i, s):
                gone[s : s + size] = b"\1" * size
        at, left = 0, []
        for c in texts[i]:  # a character goes only with all its bytes
            n = len(c.encode())
            if not all(gone[at : at + n]):
                left.append(c)
            at += n
        if WORD.search("".join(left)):
            out[i] = "".join(left)
    return out


def all_stats(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    count = lambda chars: sum(t.count(c) for c in chars)
    more = {"n_lines": sum(bool(WORD.search(x)) for x in t.split("\n")), "n_distinct_words": len(set(w)), "n_digits": count("0123456789"), "n_upper": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "n_punct": count(".,;:!?"), "longest_word": max(map(len, w), default=0)}
    return dict(zip(names, brute_stats(t))) | more


def judged(texts, rules):
    """Ids that the base rules and the learned list keep, from statistics in plain Python."""
    out = set()
    for i, t in texts.items():
        stats = all_stats(t)
        failed = stats["n_words"] < 20 or 100 * stats["n_repeat_words"] > 30 * stats["n_words"]
        x = {k: float(stats[top]) if low is None else stats[top] / stats[low] if stats[low] else 0.0 for k, (top, low) in quality_rules.FEATURES.items()}
        if not failed and not any(all(c.holds(x) for c in rule) for rule in rules):
            out.add(i)
    return out


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{REAL}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Null and blank texts, ids that repeat or are null, null columns, and columns named like the operators' own."""
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, base, "en", "s"), (1, None, "de", None), (2, base.upper(), None, "s"), (3, None, "en", "s"), (4, " \n ", "en", "s"), (None, base, "en", "s"), (5, base.replace("word30", "other"), "en", "s"), (6, "é" * 150 + "\n" + "é" * 150, "fr", "s"), (7, f"Les.\n{base}\nLes.", "en", "s"), (7, f"Les.\n{base}\nLes.", "en", "s")]
    names = "doc_id long, text string, lang string, source string, n_chars long, kept string, gone string, component_id long, n long, label int, rep long"
    return spark.createDataFrame([(i, t, a, b, None, "k", "g", 1, 2, 3, 4) for i, t, a, b in rows], names).repartition(3)


def test_stages_on_real_rows(spark, real):
    texts = {r.doc_id: r.text or "" for r in real.collect()}
    rules = quality_rules.fit(real, spark.read.parquet(f"{REAL}/labels.parquet"))
    want = {i: texts[i] for i in judged(texts, rules)}
    assert {i: r.text for i, r in by_id(pipe.quality(spark, real, REAL)).items()} == want
    for stage, plain in ((pipe.lines, kept_lines), (pipe.near_copies, kept_groups), (pipe.substrings, kept_bytes)):
        assert {i: r.text for i, r in by_id(stage(spark, real, REAL)).items()} == plain(texts)
        want = plain(want)
    assert pieces_ok(pipe.run(spark, REAL).collect(), want) < 0.02


def test_odd_rows(spark, odd):
    assert pipe.quality(spark, odd, REAL).columns == pipe.COLUMNS
    texts = {r.doc_id: r.text for r in odd.where("doc_id is not null and text is not null").collect()} | {3: ""}
    for stage, plain in ((pipe.lines, kept_lines), (pipe.substrings, kept_bytes)):
        got = by_id(stage(spark, odd, REAL))
        assert {i: r.text for i, r in got.items()} == plain(texts)
    groups = {r.doc_id for r in pipe.near_copies(spark, odd, REAL).collect()}
    assert groups == set(kept_groups(texts))
    packed = pipe.packed(spark, odd.where("doc_id in (2, 3, 4, 5, 6)"), REAL).collect()
    assert pieces_ok(packed, {i: texts[i] for i in (2, 3, 4, 5, 6)}) >= 0


def test_no_rows(spark, odd):
    for _, stage in pipe.STAGES:
        assert stage(spark, odd.limit(0), REAL).count() == 0


def test_what_is_declared():
    assert [n for n, _ in pipe.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "suffix-array dedup", "packing"] and pipe.ORACLE_SQL is None
    assert P.path("word_bpe_49k.json")
