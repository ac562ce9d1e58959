"""Quality rules: text statistics, and a decision list learned from labelled ones.

Sequential covering: rules for the rejected class are grown condition by
condition (the threshold with the best information gain) on two thirds of the
rows, pruned from the end on the other third, and kept while they are right more
often than not. The list becomes one Spark CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import buffers, map_steps, texts_of

#: Labelled rows that the rules are fitted on, at most; the ones with the smallest hash of their id.
FIT_ROWS = 20_000
WINDOW = 8
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_digits", "n_upper", "n_punct", "longest_word"]
FEATURES = {
    "mean_word": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "digit_share": ("n_digits", "word_chars"),
    "upper_share": ("n_upper", "word_chars"),
    "punct_share": ("n_punct", "word_chars"),
    "words": ("n_words", None),
    "words_per_line": ("n_words", "n_lines"),
    "longest_word": ("longest_word", None),
}
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_PUNCT = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))
_DIGIT = np.isin(np.arange(256), np.frombuffer(b"0123456789", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LEAD = (np.arange(256) & 0xC0) != 0x80


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, STATS...) of every row; null and empty texts are all zeros."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = buffers(batch.column("text"))
        starts, ends, first = words.word_spans(data, offs)
        own = words.owners(first)
        n = np.diff(first)
        h = words.word_hashes(data, starts)
        lead = _LEAD[data] & ~words.SPACE[data]
        windows = words.window_hash(h, WINDOW)
        inside = own[: len(windows)] == own[WINDOW - 1 :] if len(windows) else np.zeros(0, bool)
        twice = np.zeros(len(windows), bool)
        twice[inside] = words.repeats_within(windows[inside], own[: len(windows)][inside])
        cover = np.zeros(len(h) + 1, np.int64)
        at = np.flatnonzero(twice)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
        repeated = np.cumsum(cover[:-1]) > 0
        # lines
        newline = np.flatnonzero(data == 10)
        line = np.unique(np.concatenate((offs[:-1][np.diff(offs) > 0], newline + 1)))
        line = line[line < len(data)]
        line_own = np.searchsorted(offs, line, "right") - 1
        line_end = np.append(line[1:], len(data))
        has_word = np.searchsorted(starts, line) < np.searchsorted(starts, line_end)
        lk, lo = _line_hash(data, line, line_end)[has_word], line_own[has_word]
        lines = np.bincount(lo, minlength=len(n))
        pair = np.unique(np.stack((lk, lo.astype(np.uint64)), 1), axis=0) if len(lk) else np.zeros((0, 2), np.uint64)
        distinct_lines = np.bincount(pair[:, 1].astype(np.int64), minlength=len(n))
        with np.errstate(over="ignore"):
            wk = words.mix(h + words.mix(own.astype(np.uint64) + np.uint64(1)))
        _, wi = np.unique(wk, return_index=True)
        distinct_words = np.bincount(own[wi], minlength=len(n)) if len(wi) else np.zeros(len(n), np.int64)
        longest = np.zeros(len(n), np.int64)
        if len(starts):
            chars = np.concatenate(([0], np.cumsum(lead)))
            np.maximum.at(longest, own, chars[ends] - chars[starts])
        values = {
            "n_words": n,
            "word_chars": words.per_text(lead, offs),
            "n_symbols": words.per_text(_SYMBOL[data], offs),
            "n_dup_lines": lines - distinct_lines,
            "n_repeat_words": words.per_text(repeated, first),
            "n_lines": lines,
            "n_distinct_words": distinct_words,
            "n_digits": words.per_text(_DIGIT[data], offs),
            "n_upper": words.per_text(_UPPER[data], offs),
            "n_punct": words.per_text(_PUNCT[data], offs),
            "longest_word": longest,
        }
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.asarray(values[k], np.int64)) for k in STATS)], ["doc_id", *STATS])

    return map_steps(texts_of(docs, id_col, text_col), work, "doc_id long, " + ", ".join(f"{k} long" for k in STATS))


def _line_hash(data: np.ndarray, line: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each line without its line break; the lines cover all of data."""
    if not len(line):
        return np.zeros(0, np.uint64)
    lens = end - line
    size = lens - (data[end - 1] == 10)
    place = np.arange(line[0], len(data)) - np.repeat(line, lens)
    with np.errstate(over="ignore"):
        v = words.byte_values(5, True)[data[line[0] :]] * words.places(int(lens.max()) + 1, 5)[place]
        v[place >= np.repeat(size, lens)] = 0
        return words.mix(np.add.reduceat(v, line - line[0]) + size.astype(np.uint64))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        f = feature(self.feature)
        return f > F.lit(self.threshold) if self.above else f <= F.lit(self.threshold)

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold


def feature(name: str) -> Column:
    top, bottom = FEATURES[name]
    if bottom is None:
        return F.col(top).cast("double")
    return F.when(F.col(bottom) > 0, F.col(top).cast("double") / F.col(bottom)).otherwise(F.lit(0.0))


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    """FOIL's gain of going from (p0, n0) covered to (p, n)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, g, -np.inf)


def _best(x: dict[str, np.ndarray], y: np.ndarray, live: np.ndarray) -> tuple[float, Condition | None]:
    best: tuple[float, Condition | None] = (1e-9, None)
    p0, n0 = float(y[live].sum()), float((~y[live]).sum())
    for name, v in x.items():
        order = np.argsort(v[live], kind="stable")
        s, t = v[live][order], y[live][order]
        cut = np.flatnonzero(s[1:] > s[:-1])
        if not len(cut):
            continue
        p, n = np.cumsum(t)[cut].astype(float), np.cumsum(~t)[cut].astype(float)
        for above, g in ((False, _gain(p, n, p0, n0)), (True, _gain(p0 - p, n0 - n, p0, n0))):
            k = int(np.argmax(g))
            if g[k] > best[0]:
                best = (float(g[k]), Condition(name, above, float((s[cut[k]] + s[cut[k] + 1]) / 2)))
    return best


def learn(x: dict[str, np.ndarray], reject: np.ndarray, seed: int = 7, most_rules: int = 20, precision: float = 0.8) -> list[list[Condition]]:
    """Ordered rules, each a conjunction, for the rows to reject.

    No rejected rows or no rows at all give no rules. A rule enters the list only
    when it is right for ``precision`` of the pruning rows it covers.
    """
    reject = reject.astype(bool)
    rules: list[list[Condition]] = []
    left = np.ones(len(reject), bool)
    rng = np.random.default_rng(seed)
    while reject[left].any() and len(rules) < most_rules:
        grow = left & (rng.random(len(left)) < 2 / 3)
        prune = left & ~grow
        rule: list[Condition] = []
        live = grow.copy()
        while reject[live].any() and (~reject[live]).any() and len(rule) < 6:
            _, c = _best(x, reject, live)
            if c is None:
                break
            rule.append(c)
            live &= c.holds(x)
        if not rule:
            break

        def worth(k: int) -> tuple[float, int, int]:
            m = prune.copy()
            for c in rule[:k]:
                m &= c.holds(x)
            p, n = int(reject[m].sum()), int((~reject[m]).sum())
            return (p - n) / max(p + n, 1), p, n

        k = max(range(1, len(rule) + 1), key=lambda k: (worth(k)[0], worth(k)[1]))
        _, p, n = worth(k)
        if p == 0 or p < precision * (p + n):
            break
        rule = rule[:k]
        covered = left.copy()
        for c in rule:
            covered &= c.holds(x)
        rules.append(rule)
        left &= ~covered
    return rules


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[list[Condition]]:
    """Rules from at most ``most`` labelled rows (label 0: reject); null labels and ids don't count, repeated ones count once, with the smallest label and text.

    The sample is the rows with the smallest hash of their id, so it is the same
    in every run; statistics are computed for these rows alone.
    """
    sample = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("label"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    own = texts_of(docs, id_col, text_col).join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    own = own.groupBy("doc_id").agg(F.min("text").alias("text"))  # a row for each sampled id, however many share it
    rows = text_stats(own).join(F.broadcast(sample), "doc_id").where(~_base_failed()).select(*[feature(k).alias(k) for k in FEATURES], "label").toPandas()
    return learn({k: rows[k].to_numpy(float) for k in FEATURES}, rows["label"].to_numpy() == 0)


def _base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one CASE: the base rules, then each learned rule in order, otherwise kept."""
    out = F.when(_base_failed(), F.lit(False))
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = out.when(test, F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[list[Condition]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, statistics, base_failed, kept) of every row; a null or empty text fails the base rules."""
    return text_stats(docs, id_col, text_col).withColumn("base_failed", _base_failed()).withColumn("kept", verdict(rules))
