"""Byte-pair merging of whole batches of pre-tokens as ragged numpy arrays.

Each round finds every sequence's lowest-ranked pair and applies it in all
sequences at once; a sequence without a ranked pair leaves the arrays. Where a
vocabulary's ranks only rise along a token's making (checked when it is loaded),
all places of that pair merge in the same round, from the left; otherwise one
place a round, which is the library's order in every case. A pre-token of over LONG
bytes (a blob, or script without blanks) would keep the rounds going alone, and
merges by itself instead, from a heap of its pairs by rank and place: the same order
in n log n steps.
"""

from __future__ import annotations

import base64
import json
import unicodedata
from heapq import heapify, heappop, heappush
from functools import lru_cache

import numpy as np
import regex

from . import scan, words

_NONE = np.int64(1) << 40
_SHIFT = 20
#: Bytes of a pre-token from which it merges by itself.
LONG = 512


class Merger:
    """pairs: (left id, right id, rank, merged id); inner and last: the first symbol of a byte within and at the end of a pre-token."""

    def __init__(self, inner: np.ndarray, last: np.ndarray, pairs: np.ndarray):
        self._slots((pairs[:, 0] << _SHIFT) | pairs[:, 1])
        self.rank, self.made = np.append(pairs[:, 2], _NONE), np.append(pairs[:, 3], -1)
        self.inner, self.last = inner, last
        born = np.full(int(pairs.max()) + 2, -1, np.int64)
        born[pairs[:, 3]] = pairs[:, 2]
        unique = len(np.unique(pairs[:, 3])) == len(pairs) or bool((pairs[:, 2] == pairs[:, 3]).all())
        self.rising = unique and bool((np.maximum(born[pairs[:, 0]], born[pairs[:, 1]]) < pairs[:, 2]).all())
        self.pairs, self.table = pairs, None

    def _slots(self, keys: np.ndarray) -> None:
        """An open-addressed table of the pairs, filled a probe at a time."""
        self.bits = int(len(keys) * 4 - 1).bit_length()
        self.slot = np.full(1 << self.bits, -1, np.int64)
        self.item = np.full(1 << self.bits, len(keys), np.int64)
        left, self.probes = np.arange(len(keys)), 0
        at = self._home(keys)
        while len(left):
            self.probes += 1
            free = self.slot[at] == -1
            self.slot[at[free]] = keys[left[free]]
            self.item[at[free]] = left[free]
            lost = self.slot[at] != keys[left]
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The pair's number, or the number of pairs where there is none."""
        at = self._home(keys)
        got = self.slot[at]
        out = np.where(got == keys, self.item[at], len(self.rank) - 1)
        left = np.flatnonzero((got != keys) & (got != -1))
        for step in range(1, self.probes):
            if not len(left):
                break
            spot = (at[left] + step) & ((1 << self.bits) - 1)
            got = self.slot[spot]
            hit = got == keys[left]
            out[left[hit]] = self.item[spot[hit]]
            left = left[~hit & (got != -1)]
        return out

    def merge(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the surviving symbols of each pre-token."""
        long = [i for i, t in enumerate(tokens) if len(t) > LONG]
        if not long:
            return self._together(tokens)
        left = list(tokens)
        for i in long:
            left[i] = b""
        ids, offs = self._together(left)
        own = [self._alone(tokens[i]) for i in long]
        counts = np.diff(offs)
        counts[long] = [len(x) for x in own]
        ids = np.insert(ids, np.repeat(offs[long], counts[long]), np.concatenate(own))
        return ids.astype(np.uint32), np.concatenate(([0], np.cumsum(counts)))

    def _alone(self, token: bytes) -> list[int]:
        """The surviving symbols of one long pre-token: always the lowest rank, of equal ones the leftmost."""
        if self.table is None:
            keys = (self.pairs[:, 0] << _SHIFT) | self.pairs[:, 1]
            self.table = dict(zip(keys.tolist(), zip(self.pairs[:, 2].tolist(), self.pairs[:, 3].tolist())))
        table, n, none = self.table, len(token), (-1, -1)
        data = np.frombuffer(token, np.uint8)
        first = self.inner[data].astype(np.int64)
        first[-1] = self.last[data[-1]]
        found = self.rank[self.find((first[:-1] << _SHIFT) | first[1:])]
        found[found == _NONE] = -1
        sym, rank = first.tolist(), [*found.tolist(), -1]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 40 | i for i, r in enumerate(rank) if r >= 0]
        heapify(heap)
        place = (1 << 40) - 1
        while heap:
            x = heappop(heap)
            i = x & place
            if rank[i] != x >> 40:
                continue  # an older state of this place
            j = after[i]
            sym[i] = table[sym[i] << _SHIFT | sym[j]][1]
            rank[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                rank[i] = r = table.get(sym[i] << _SHIFT | sym[k], none)[0]
                if r >= 0:
                    heappush(heap, r << 40 | i)
            else:
                rank[i] = -1
            h = before[i]
            if h >= 0:
                rank[h] = r = table.get(sym[h] << _SHIFT | sym[i], none)[0]
                if r >= 0:
                    heappush(heap, r << 40 | h)
        out, i = [], 0
        while i < n:
            out.append(sym[i])
            i = after[i]
        return out

    def _together(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
        data = np.frombuffer(b"".join(tokens), np.uint8)
        offs = np.concatenate(([0], np.cumsum(lens)))
        sym = self.inner[data].astype(np.int64)
        full = lens > 0
        sym[offs[1:][full] - 1] = self.last[data[offs[1:][full] - 1]]
        word = np.repeat(np.arange(len(tokens)), lens)
        done_sym, done_word = [], []
        while len(sym):
            at = self.find((sym[:-1] << _SHIFT) | sym[1:])
            rank = np.full(len(sym), _NONE)
            rank[:-1] = np.where(word[:-1] == word[1:], self.rank[at], _NONE)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            size = np.diff(np.append(first, len(word)))
            least = np.minimum.reduceat(rank, first)
            over = np.repeat(least == _NONE, size)
            chosen = (rank == np.repeat(least, size)) & ~over
            if self.rising:  # of touching places of one pair, every other from the left
                begin = chosen & ~np.concatenate(([False], chosen[:-1]))
                i = np.arange(len(sym))
                run = np.maximum.accumulate(np.where(begin, i, 0))
                chosen &= (i - run) % 2 == 0
            else:
                seen = np.cumsum(chosen)
                chosen &= seen - np.repeat((seen - chosen)[first], size) == 1
            hit = np.flatnonzero(chosen)
            sym[hit] = self.made[at[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            leave = over & keep
            done_sym.append(sym[leave])
            done_word.append(word[leave])
            keep &= ~over
            sym, word = sym[keep], word[keep]
        if not done_sym:
            return np.zeros(0, np.uint32), np.zeros(len(tokens) + 1, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        counts = np.bincount(word, minlength=len(tokens))
        return sym[order].astype(np.uint32), np.concatenate(([0], np.cumsum(counts)))


class _Cached:
    """Ids of pre-tokens by their 64-bit hash in sorted arrays, for as many as fit; emptied when full."""

    most = 1_500_000

    def __init__(self, merger: Merger):
        self.merger = merger
        self._clear()

    def _clear(self) -> None:
        self.hash, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _whole(self, word: bytes) -> int | None:
        """The id of a pre-token that takes no merging, if there is one."""
        return None

    def tokens(self, cp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) in self.ids of every pre-token cp[begin:end]."""
        if not len(begin):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, where, back = np.unique(_token_hash(cp, begin, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, keys)
        known = at < len(self.hash)
        known[known] = self.hash[at[known]] == keys[known]
        if not known.all():
            if len(self.hash) + int((~known).sum()) > self.most:
                self._clear()
                known[:] = False
            self._learn(keys[~known], cp, begin[where[~known]], end[where[~known]])
            at = np.searchsorted(self.hash, keys)
        return self.start[at][back], self.size[at][back]

    def _learn(self, keys: np.ndarray, cp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        lens = end - begin
        flat = cp[np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(begin, lens)]
        text, cut = flat.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), np.concatenate(([0], np.cumsum(lens))).tolist()
        raw = [text[a:b].encode("utf-8", "surrogatepass") for a, b in zip(cut, cut[1:])]
        whole = [self._whole(w) for w in raw]
        ids, offs = self.merger.merge([b"" if x is not None else w for w, x in zip(raw, whole)])
        size = np.diff(offs)
        start = offs[:-1].copy()
        single = np.array([i for i, x in enumerate(whole) if x is not None], np.int64)
        start[single], size[single] = len(ids) + np.arange(len(single)), 1
        ids = np.concatenate((ids, np.array([whole[i] for i in single], np.uint32)))
        spot = np.searchsorted(self.hash, keys)
        self.hash = np.insert(self.hash, spot, keys)
        self.start = np.insert(self.start, spot, start + len(self.ids))
        self.size = np.insert(self.size, spot, size)
        self.ids = np.concatenate((self.ids, ids))

    def gather(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        total = np.cumsum(size)
        n = int(total[-1]) if len(total) else 0
        return self.ids[np.arange(n) - np.repeat(total - size, size) + np.repeat(start, size)]


@lru_cache(1)
def _point_values() -> np.ndarray:
    return words.randoms(scan.END + 1, 77)


def _token_hash(cp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    lens = end - begin
    place = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    at = place + np.repeat(begin, lens)
    with np.errstate(over="ignore"):
        v = _point_values()[cp[at]] * words.places(int(lens.max()) + 1, 78)[place]
        return words.mix(np.add.reduceat(v, np.cumsum(lens) - lens))


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable Latin-1, otherwise the next letter from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe(_Cached):
    """The lower-cased, white-space dropping vocabulary with word ends."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        vocab, mark = model["model"]["vocab"], model["model"]["end_of_word_suffix"]
        letters = _byte_letters()
        inner = np.array([vocab[c] for c in letters])
        last = np.array([vocab[c + mark] for c in letters])
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        super().__init__(Merger(inner, last, np.array([(vocab[a], vocab[b], i, vocab[a + b]) for i, (a, b) in enumerate(merges)])))
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")

    def _normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # the library lowers code point by code point

    def _pieces(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(ordinary pieces, text of each, how many special strings lie before each in all texts)."""
        parts, owner, special = [], [], []
        for i, text in enumerate(texts):
            for p in self.split.split(text) if "<|" in text else (text,):
                if p in self.special:
                    special.append((i, len(parts), self.special[p]))
                else:
                    parts.append(self._normal(p))
                    owner.append(i)
        return parts, np.array(owner, np.int64), special

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets of the texts)."""
        parts, owner, special = self._pieces(texts)
        start, size, cut = self._spans(parts)
        ids = self.gather(start, size)
        ends = np.concatenate(([0], np.cumsum(size)))[cut]  # where each part's ids begin, and the total
        counts = np.bincount(owner, np.diff(ends), len(texts)).astype(np.int64) if len(owner) else np.zeros(len(texts), np.int64)
        if special:
            ids = np.insert(ids, [int(ends[k]) for _, k, _ in special], [x for _, _, x in special])
            np.add.at(counts, [i for i, _, _ in special], 1)
        return ids.astype(np.uint32), np.concatenate(([0], np.cumsum(counts)))

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text: the symbols that survive merging, and the special strings."""
        parts, owner, special = self._pieces(texts)
        _, size, cut = self._spans(parts)
        ends = np.concatenate(([0], np.cumsum(size)))[cut]
        counts = np.bincount(owner, np.diff(ends), len(texts)).astype(np.int64) if len(owner) else np.zeros(len(texts), np.int64)
        np.add.at(counts, [i for i, _, _ in special], 1)
        return counts

    def _spans(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cp, offs = scan.codepoints(parts)
        begin, end = scan.plain_tokens(cp)
        start, size = self.tokens(cp, begin, end)
        return start, size, np.searchsorted(begin, offs)


class ByteBpe(_Cached):
    """The byte-level vocabulary given as ranks."""

    def __init__(self, path: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        inner = np.array([ranks[bytes([b])] for b in range(256)])
        pairs = [(ranks[t[:i]], ranks[t[i:]], r, r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        super().__init__(Merger(inner, inner, np.array(pairs)))
        self.ranks = ranks
        of = {r: t for t, r in ranks.items()}
        every = [of.get(r, b"") for r in range(max(of) + 1)]
        self.flat = np.frombuffer(b"".join(every), np.uint8)
        self.length = np.array([len(t) for t in every], np.int64)
        self.place = np.cumsum(self.length) - self.length
        self.digits = [str(i) for i in range(len(every))]

    def _whole(self, word: bytes) -> int | None:
        return self.ranks.get(word)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offsets of the texts in them, first code point of every pre-token in its text, offsets of the texts in these)."""
        cp, offs = scan.codepoints(texts)
        begin, end = scan.spaced_tokens(cp)
        start, size = self.tokens(cp, begin, end)
        cut = np.searchsorted(begin, offs)
        return self.gather(start, size), np.concatenate(([0], np.cumsum(size)))[cut], begin - np.repeat(offs[:-1], np.diff(cut)), cut

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, by the same offsets' arithmetic: each id's bytes are copied to where the ones before it end."""
        size = self.length[ids]
        total = np.cumsum(size)
        n = int(total[-1]) if len(total) else 0
        return self.flat[np.arange(n) - np.repeat(total - size, size) + np.repeat(self.place[ids], size)].tobytes()


@lru_cache(4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


@lru_cache(4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
