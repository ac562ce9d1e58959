"""Pre-token boundaries without a regex engine.

Code points become classes; each class is a function from states to states, and
the states after every code point come from a scan over those functions. As
composing functions is associative, blocks are composed side by side first, the
blocks' functions are scanned, and a last pass fills in the states.

States: the kind of the pre-token that is open after a code point.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

# classes
BLANK, SPACE, LETTER, DIGIT, OTHER, SHORT, LONG, STOP = range(8)
# states: letters, digits, others, a run ending in a blank, a run ending in other white space,
# a contraction with two / one / no letters to come, between texts
L, N, O, W, V, K2, K1, K0, E = range(9)
_S = 9
END = 0x110000
_BLOCK = 32


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point; the apostrophe's two special classes are found by what follows it."""
    table = np.full(END + 1, OTHER, np.uint8)
    for lo in range(0, END, 1 << 16):
        chars = "".join(map(chr, range(lo, lo + (1 << 16))))
        for what, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, chars):
                table[lo + m.start() : lo + m.end()] = what
    table[0x20] = BLANK
    table[END] = STOP
    return table


def _functions(attach: bool) -> np.ndarray:
    """next state by (class, state). attach: a blank belongs to what follows it."""
    t = np.zeros((8, _S), np.uint8)
    t[BLANK], t[SPACE], t[STOP], t[DIGIT], t[OTHER] = W, V, E, N, O
    t[LETTER] = L
    t[LETTER, K2], t[LETTER, K1] = K1, K0
    for c, k in ((SHORT, K1), (LONG, K2)):
        t[c] = k
        t[c, O] = O
        if attach:
            t[c, W] = O
    return t


def scan(cls: np.ndarray, table: np.ndarray) -> np.ndarray:
    """State after each code point, from state E."""
    n = len(cls)
    flat = table.ravel()
    rows = -(-n // _BLOCK)
    padded = np.full(rows * _BLOCK, STOP, np.uint8)
    padded[:n] = cls
    base = (padded.reshape(rows, _BLOCK).T.astype(np.intp) * _S)  # one line of it for each place in a block
    whole = np.broadcast_to(np.arange(_S, dtype=np.uint8), (rows, _S))
    for j in range(_BLOCK):
        whole = flat[base[j][:, None] + whole]
    entry = np.empty(rows, np.uint8)
    if rows <= 4 * _BLOCK:
        s = E
        for i in range(rows):
            entry[i] = s
            s = whole[i, s]
    else:
        entry[:] = _entries(whole)
    out = np.empty((_BLOCK, rows), np.uint8)
    s = entry
    for j in range(_BLOCK):
        s = flat[base[j] + s]
        out[j] = s
    return out.T.reshape(-1)[:n]


def _entries(functions: np.ndarray) -> np.ndarray:
    """State before each of a row of functions, from state E."""
    n = len(functions)
    if n <= 4 * _BLOCK:
        out, s = np.empty(n, np.uint8), E
        for i in range(n):
            out[i] = s
            s = functions[i, s]
        return out
    rows = -(-n // _BLOCK)
    padded = np.empty((rows * _BLOCK, _S), np.uint8)
    padded[:n] = functions
    padded[n:] = np.arange(_S, dtype=np.uint8)
    blocks = padded.reshape(rows, _BLOCK, _S)
    whole = np.broadcast_to(np.arange(_S, dtype=np.uint8), (rows, _S))
    for j in range(_BLOCK):
        whole = np.take_along_axis(blocks[:, j], whole.astype(np.intp), 1)
    s = _entries(whole)
    out = np.empty((rows, _BLOCK), np.uint8)
    for j in range(_BLOCK):
        out[:, j] = s
        s = blocks[np.arange(rows), j, s]
    return out.reshape(-1)[:n]


def states(cls: np.ndarray, table: np.ndarray) -> np.ndarray:
    """State after each code point. A constant function forgets all before it, so only stretches
    of other functions that hold an apostrophe's class, each behind the constant before it, need the scan."""
    settled = table[:, E].copy()
    out = settled[cls]
    odd = np.flatnonzero((cls == SHORT) | (cls == LONG))
    if len(odd):
        loose = (cls == LETTER) | (cls == SHORT) | (cls == LONG)
        edge = np.flatnonzero(~loose)  # the last is a STOP
        behind = np.searchsorted(edge, odd)
        behind = np.unique(behind)
        lo = np.where(behind > 0, edge[np.maximum(behind - 1, 0)], 0)
        hi = edge[behind]
        lens = hi - lo
        at = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(lo, lens)
        out[at] = scan(cls[at], table)
    return out


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, an END after each; offsets of the texts in it."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    offs = np.concatenate(([0], np.cumsum(lens + 1)))
    out = np.full(int(offs[-1]), END, np.uint32)
    keep = np.ones(len(out), bool)
    keep[offs[1:] - 1] = False
    out[keep] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, offs


def classified(cp: np.ndarray) -> np.ndarray:
    cls = classes()[cp]
    at = np.flatnonzero(cp == 0x27)
    if len(at):
        follow = np.append(cp, [END, END])
        a, b = follow[at + 1], follow[at + 2]
        short = np.isin(a, [ord(c) for c in "stmd"])
        long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        cls[at[short]] = SHORT
        cls[at[long]] = LONG
    return cls


def _begins(cls: np.ndarray, before: np.ndarray, attach: bool) -> np.ndarray:
    """Whether a code point that isn't white space begins a pre-token."""
    begin = np.zeros((8, _S), bool)
    for c, goes_on in ((LETTER, (L, K2, K1)), (DIGIT, (N,) if attach else ()), (OTHER, (O,)), (SHORT, (O,)), (LONG, (O,))):
        begin[c] = True
        begin[c, list(goes_on)] = False
        if attach:
            begin[c, W] = False
    return begin[cls, before]


def _before(cls: np.ndarray, attach: bool) -> np.ndarray:
    return np.concatenate(([E], states(cls, _functions(attach))[:-1])).astype(np.uint8)


def spaced_tokens(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens that keep white space, in code points that end with END: begin and end of each."""
    cls = classified(cp)
    begins = _begins(cls, _before(cls, True), True)
    white = cls <= SPACE
    white_before = np.concatenate(([False], white[:-1]))
    follow = np.append(cls[1:], STOP)
    begins &= ~white
    begins |= white & (~white_before | (follow > SPACE) & (follow != STOP))
    at = np.flatnonzero(begins | (cls == STOP))
    real = cls[at] != STOP
    ends = np.append(at[1:], len(cp))
    return at[real], ends[real]


def plain_tokens(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens without white space, digits one by one: begin and end of each."""
    cls = classified(cp)
    gap = (cls <= SPACE) | (cls == STOP)
    begins = _begins(cls, _before(cls, False), False) & ~gap
    at = np.flatnonzero(begins | gap)
    real = ~gap[at]
    ends = np.append(at[1:], len(cp))
    return at[real], ends[real]
