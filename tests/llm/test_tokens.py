import base64
import hashlib
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracelake.llm import bpe, byte_bpe, packing, token_counts

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
TOKENIZER = Tokenizer.from_file(WORD)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXT = st.text(alphabet="abstmdrvel'' \n\t   019!?.,éÉßΣσ́漢😀<|>", max_size=80)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_library_ids(texts):
    ids, offs = bpe.word_bpe(WORD).encode(texts)
    for t, a, b in zip(texts, offs, offs[1:]):
        assert ids[a:b].tolist() == TOKENIZER.encode(t, add_special_tokens=False).ids
    ids, offs, starts, cut = bpe.byte_bpe(BYTE).encode(texts)
    for i, t in enumerate(texts):
        assert ids[offs[i] : offs[i + 1]].tolist() == TIKTOKEN.encode_ordinary(t)
        assert bpe.byte_bpe(BYTE).decode(ids[offs[i] : offs[i + 1]]) == t.encode()


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "aab", "漢字テスト", "ABab01+/"])
def test_long_words(letters):
    """Words that merge by themselves, beside ordinary ones; a million letters take seconds."""
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    texts = [word(700), f"a {word(5000)} b {word(513)}", "a b", word(20_000) + "!"]
    ids, offs = bpe.word_bpe(WORD).encode(texts)
    also, cut, *_ = bpe.byte_bpe(BYTE).encode(texts)
    for i, t in enumerate(texts):
        assert ids[offs[i] : offs[i + 1]].tolist() == TOKENIZER.encode(t, add_special_tokens=False).ids
        assert also[cut[i] : cut[i + 1]].tolist() == TIKTOKEN.encode_ordinary(t)


def test_a_million_letters():
    rnd = random.Random(4)
    text = "".join(rnd.choices("etaoinshrdlu", k=1_000_000))
    began = time.time()
    assert len(bpe.ByteBpe(BYTE).encode([text])[0]) == len(TIKTOKEN.encode_ordinary(text))
    assert bpe.WordBpe(WORD).count([text])[0] > 0
    assert time.time() - began < 90


def test_counts(docs, texts, none):
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, WORD).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        n = len(TOKENIZER.encode(t, add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 2048)
    assert token_counts.count_tokens(none, WORD).count() == 0


def test_round_trip(docs, texts, none):
    got = {r.doc_id: r for r in byte_bpe.round_trip(docs, BYTE).collect()}
    for i, t in texts.items():
        ids = TIKTOKEN.encode_ordinary(t)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert byte_bpe.round_trip(none, BYTE).count() == 0
    enc = byte_bpe.encode(docs, BYTE)
    back = {r.doc_id: bytes(r.content) for r in byte_bpe.decode(enc, BYTE).collect()}
    assert back == {i: t.encode() for i, t in texts.items()}
    for r in enc.collect():
        assert list(r.starts) == sorted(r.starts)


def pieces_ok(rows, texts):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for i, t in texts.items():
        ids = np.array([*TOKENIZER.encode(t, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    waste = total = 0
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        waste += 0 if at & (at - 1) == 0 else 2048 - at
        total += at
    return waste / total


def test_packing(docs, texts, none, spark):
    assert pieces_ok(packing.pack(docs, WORD).collect(), texts) < 0.01
    assert pieces_ok(packing.pack(docs, WORD, shard_bytes=4000).collect(), texts) < 0.01
    assert packing.pack(none, WORD).count() == 0
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert pieces_ok(packing.pack(real, WORD, shard_bytes=300_000).collect(), {r.doc_id: r.text for r in real.collect()}) < 0.01
    with pytest.raises(ValueError):
        packing.pack(docs, WORD, limit=1000)


def best_cost(n, penalty, limit):
    """Plain dynamic programming over lengths from half the limit, which is what cuts() searches before its tail."""
    best = [0] + [10**9] * n
    for j in range(1, n + 1):
        for i in range(max(0, j - limit), j - limit // 2 + 1):
            pad = 0 if (j - i) & (j - i - 1) == 0 else limit - (j - i)
            best[j] = min(best[j], best[i] + pad + penalty[j])
    return best


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 200), st.randoms())
def test_cuts_are_optimal(n, rnd):
    penalty = np.array([rnd.choice([0, 2, 4, 4, 4]) for _ in range(n + 1)])
    cut = packing.cuts(n, penalty, 16, False, 4)
    best = best_cost(n, penalty, 16)
    cost = sum((0 if (b - a) & (b - a - 1) == 0 else 16 - (b - a)) + penalty[b] for a, b in zip(cut, cut[1:]))
    if n >= 8:
        assert cost == min(best[max(1, n - 15) : n + 1])
    last = packing.cuts(n, penalty, 16, True, 4)
    assert last[0] == 0 and last[-1] == n and (np.diff(last) > 0).all() and (np.diff(last) <= 16).all()
