"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks (text between block-level tags). Each has
a vector: its tag path and class words, hashed, its own words, hashed, and a few
measures. A bidirectional LSTM in numpy reads the whole sequence both ways and
labels every block as article or not. It is trained here, by gradient descent on
pages that ``sample_page`` makes from nested templates with known labels, in which
no tag and no name alone gives the answer: articles also stand in plain or unknown
containers or in none, and other parts use the article's tags. The weights are
fitted once, on the driver and from a fixed seed, and go to the workers with the
plan (tens of KB), so every attempt of a task labels alike.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, table

SCHEMA = "page_id long, url string, text string, n_chars long"
PATH_SLOTS, WORD_SLOTS, MEASURES, HIDDEN = 256, 16, 6, 16
INPUT = PATH_SLOTS + WORD_SLOTS + MEASURES
#: Fixed values of HTML: tags that end a block, that have no content, and whose content is no text.
BLOCKS = frozenset("address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript title textarea select svg iframe object".split())
#: Names of one element that are looked at; an element has a few, and a page that gives it thousands is not read slower.
NAMES = 32
#: White space that is turned into one space: HTML's five characters and the no-break space that references decode to.
SPACES = str.maketrans({c: " " for c in "\t\n\f\r\v "})


class _Leaves(HTMLParser):
    """Blocks of text with the slots of the open elements around them.

    Only block-level and silent elements are kept on the stack, each with the slots
    of its tag and names; what is open is counted by slot and by tag, so a tag costs
    the same however deep or unclosed the page is.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)  # references are decoded in whole stretches of text, as HTML has it
        self.open: list[tuple[str, tuple[int, ...]]] = []
        self.tags: Counter[str] = Counter()
        self.slots: Counter[int] = Counter()
        self.silent = 0
        self.anchor = -1  # size of the stack where a link was opened
        self.buffer: list[str] = []
        self.links = 0
        self.out: list[tuple[tuple[int, ...], str, int]] = []

    def _end_block(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).translate(SPACES).split())
            if text:
                self.out.append((tuple(self.slots), text, self.links))
            self.buffer, self.links = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.buffer.append(" ")
        elif tag == "a":
            self.anchor = len(self.open)
        if tag in BLOCKS:
            self._end_block()
            if tag == "p" and self.tags["p"]:
                self._close("p")
        if tag in VOID or tag not in BLOCKS and tag not in SILENT:
            return
        names = " ".join(v for k, v in attrs if v and k in ("class", "id", "role")).lower().replace("-", " ").replace("_", " ").split()
        # two slots a name, so that an unknown name seldom looks like a known one
        slots = (_slot("t:" + tag, PATH_SLOTS), *(_slot(kind + w, PATH_SLOTS) for w in names[:NAMES] for kind in ("c:", "d:")))
        self.open.append((tag, slots))
        self.tags[tag] += 1
        self.slots.update(slots)
        self.silent += tag in SILENT

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self._end_block()
        elif tag == "br":
            self.buffer.append(" ")

    def _close(self, tag: str) -> None:
        while True:
            t, slots = self.open.pop()
            self.tags[t] -= 1
            self.silent -= t in SILENT
            for x in slots:
                if self.slots[x] == 1:
                    del self.slots[x]
                else:
                    self.slots[x] -= 1
            if t == tag:
                break
        if len(self.open) < self.anchor:
            self.anchor = -1

    def handle_endtag(self, tag):
        if tag == "a":
            self.anchor = -1
        if tag in BLOCKS:
            self._end_block()
        if self.tags[tag]:
            self._close(tag)

    def handle_data(self, data):
        if not self.silent:
            self.buffer.append(data)
            if self.anchor >= 0:
                self.links += len(data)


def leaves(page: str) -> list[tuple[tuple[int, ...], str, int]]:
    """(slots of the path, text, characters in links) of every block."""
    parser = _Leaves()
    parser.feed(page)
    parser.close()
    parser._end_block()
    return parser.out


@lru_cache(100_000)
def _slot(word: str, n: int) -> int:
    return zlib.crc32(word.encode("utf-8", "ignore")) % n


def vectors(blocks) -> np.ndarray:
    x = np.zeros((len(blocks), INPUT), np.float32)
    for i, (slots, text, links) in enumerate(blocks):
        x[i, list(slots)] = 1
        words = text.lower().encode("utf-8", "ignore").split()
        x[i, PATH_SLOTS : PATH_SLOTS + WORD_SLOTS] = np.bincount([zlib.crc32(w) % WORD_SLOTS for w in words], minlength=WORD_SLOTS) / max(1, len(words))
        x[i, PATH_SLOTS + WORD_SLOTS :] = (min(1, len(text) / 400), min(1, len(words) / 60), links / max(1, len(text)), text[-1:] in ".!?", i / len(blocks), (len(blocks) - i) / len(blocks))
    return x


def _squash(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _pass(x, w):
    """An LSTM over (time, batch, input): states and what the way back needs."""
    wx, wh, b = w
    t, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    hs, kept = np.zeros((t, n, HIDDEN), np.float32), []
    into = x @ wx + b
    for s in range(t):
        z = into[s] + h @ wh
        i, f, o, g = _squash(z[:, :HIDDEN]), _squash(z[:, HIDDEN : 2 * HIDDEN]), _squash(z[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        kept.append((h, c, i, f, o, g))
        c = f * c + i * g
        h = o * np.tanh(c)
        kept[-1] += (c,)
        hs[s] = h
    return hs, kept


def _states(x, w, on):
    """The states of ``_pass`` alone. on: (time, batch), 0 where a state stays empty."""
    wx, wh, b = w
    t, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    hs, into = np.zeros((t, n, HIDDEN), np.float32), x @ wx + b
    for s in range(t):
        z = into[s] + h @ wh
        gates = _squash(z[:, : 3 * HIDDEN])
        c = (gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN :])) * on[s][:, None]
        h = gates[:, 2 * HIDDEN :] * np.tanh(c) * on[s][:, None]
        hs[s] = h
    return hs


def _back(x, w, kept, dhs):
    wx, wh, _ = w
    dwx, dwh, db = np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * HIDDEN, np.float32)
    dh, dc = np.zeros_like(dhs[0]), np.zeros_like(dhs[0])
    for s in range(len(x) - 1, -1, -1):
        h, c, i, f, o, g, c1 = kept[s]
        dh = dh + dhs[s]
        tc = np.tanh(c1)
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate((dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), 1)
        dwx += x[s].T @ dz
        dwh += h.T @ dz
        db += dz.sum(0)
        dh, dc = dz @ wh.T, dc * f
    return [dwx, dwh, db]


class Labeller:
    """Forward and backward LSTM and a logistic layer on both and the block's own vector."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        lstm = lambda: [rng.normal(0, 0.1, (INPUT, 4 * HIDDEN)).astype(np.float32), rng.normal(0, 0.1, (HIDDEN, 4 * HIDDEN)).astype(np.float32), np.zeros(4 * HIDDEN, np.float32)]
        self.ahead, self.behind = lstm(), lstm()
        self.out = [rng.normal(0, 0.1, (2 * HIDDEN + INPUT, 1)).astype(np.float32), np.zeros(1, np.float32)]

    def _forward(self, x):
        a, ka = _pass(x, self.ahead)
        b, kb = _pass(x[::-1], self.behind)
        top = np.concatenate((a, b[::-1], x), 2)
        return _squash(top @ self.out[0] + self.out[1])[..., 0], top, ka, kb

    def label(self, pages: list[np.ndarray], together: int = 1 << 14) -> list[np.ndarray]:
        """Whether each block of each page is article text; pages of like length are read side by side, about ``together`` blocks at a time."""
        out = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            # from the longest page down, so that what is padded is known
            t = len(pages[order[-1]])
            part = order[-max(1, together // t) :]
            del order[-len(part) :]
            x, on = np.zeros((t, len(part), INPUT), np.float32), np.zeros((t, len(part)), np.float32)
            for j, i in enumerate(part):
                x[: len(pages[i]), j], on[: len(pages[i]), j] = pages[i], 1
            w, b = self.out
            score = x @ w[2 * HIDDEN :] + b
            score += _states(x, self.ahead, on) @ w[:HIDDEN]
            score += _states(x[::-1], self.behind, on[::-1])[::-1] @ w[HIDDEN : 2 * HIDDEN]
            for j, i in enumerate(part):
                out[i] = score[: len(pages[i]), j, 0] > 0
        return out

    def fit(self, pages, epochs: int = 10, rate: float = 0.02, seed: int = 4) -> None:
        """pages: (vectors, labels); batches of pages padded to the longest of them."""
        weights = [*self.ahead, *self.behind, *self.out]
        m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        rng, step = np.random.default_rng(seed), 0
        pages = sorted(pages, key=lambda p: len(p[0]))
        batches = [pages[i : i + 20] for i in range(0, len(pages), 20)]
        steps = epochs * len(batches) + 1  # the rate falls to nothing on the way
        for _ in range(epochs):
            for k in rng.permutation(len(batches)):
                batch = batches[k]
                t, n = max(len(x) for x, _ in batch), len(batch)
                x, y, on = np.zeros((t, n, INPUT), np.float32), np.zeros((t, n), np.float32), np.zeros((t, n), np.float32)
                for j, (bx, by) in enumerate(batch):
                    x[: len(bx), j], y[: len(bx), j], on[: len(bx), j] = bx, by, 1
                p, top, ka, kb = self._forward(x)
                d = ((p - y) * on / on.sum())[..., None]
                dtop = d @ self.out[0].T
                grads = [*_back(x, self.ahead, ka, dtop[..., :HIDDEN]), *_back(x[::-1], self.behind, kb, dtop[::-1, :, HIDDEN : 2 * HIDDEN]), np.einsum("tni,tno->io", top, d), d.sum((0, 1))]
                step += 1
                for w, g, a, b in zip(weights, grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    w -= rate * (1 - step / steps) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)


#: Names that pages give to what is not the article, and to what is.
ASIDE = "ad ads advert banner promo sponsored cookie cookies consent notice gdpr sidebar widget related share social newsletter subscribe breadcrumb breadcrumbs menu navbar nav footer header masthead copyright comments comment reply respond login search pagination tags toolbar popup modal".split()
INNER = "content post entry story article body main text page container wrapper column".split()
_CHROME = ["nav", "header", "footer", "aside", "form", "div", "section", "ul", "dialog"]


def _words(rnd: random.Random, n: int, end: bool = True) -> str:
    alphabet = "etaoinshrdlucmfwypvbgk"
    w = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(2, 9))) for _ in range(n)]
    if rnd.random() < 0.1:
        w = [x + rnd.choice(["***", "###", "%%%", "$$$", ""]) for x in w]
    return " ".join(w).capitalize() + ("." if end else "")


def _class(rnd: random.Random, names: list[str]) -> str:
    """A class or id of one of the names, at times beside a word that says nothing."""
    own = rnd.choice(names)
    more = f"{rnd.choice(['x', 'col', 'js', 'l'])}{rnd.randint(1, 99)}"
    return f' {rnd.choice(["class", "class", "id"])}="{rnd.choice([own, own, f"{own} {more}", f"{more}-{own}"])}"'


def _unknown(rnd: random.Random) -> str:
    return f' {rnd.choice(["class", "id"])}="{"".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9)))}"'


def _link(rnd: random.Random, n: int) -> str:
    return f'<a href="/x">{_words(rnd, n, rnd.random() < 0.3)}</a>'


def _chrome(rnd: random.Random) -> str:
    tag = rnd.choice(_CHROME)
    kind = rnd.random()
    named = tag in ("div", "section", "dialog") and (kind >= 0.3 or rnd.random() < 0.7) or rnd.random() < 0.4
    mark = _class(rnd, ASIDE) if named else _unknown(rnd) if rnd.random() < 0.3 else ""
    if tag == "ul" or kind < 0.3:
        inner = "".join(f"<li>{_link(rnd, rnd.randint(1, 4))}</li>" for _ in range(rnd.randint(2, 8)))
        inner = inner if tag == "ul" else f"<ul>{inner}</ul>" if rnd.random() < 0.8 else " | ".join(_link(rnd, rnd.randint(1, 3)) for _ in range(rnd.randint(2, 6)))
    elif kind < 0.65:
        inner = _words(rnd, rnd.randint(1, 30), rnd.random() < 0.8)
        inner = f"&copy; {inner}" if tag == "footer" and rnd.random() < 0.5 else inner
    else:
        head = f"<h{(h := rnd.randint(1, 4))}>{_words(rnd, 3, False)}</h{h}>" if rnd.random() < 0.4 else ""
        inner = head + "".join(f"<p>{_words(rnd, rnd.randint(2, 60))}</p>" for _ in range(rnd.randint(1, 4)))
        if rnd.random() < 0.15 and mark:
            inner = f"<article>{inner}</article>"
        if tag == "form" or rnd.random() < 0.1:
            inner += f"<label>{_words(rnd, 2, False)}</label><input><button>{_words(rnd, 1, False)}</button>"
    return f"<{tag}{mark}>{inner}</{tag}>"


def _comments(rnd: random.Random) -> str:
    each = rnd.choice(["div", "li", "article", "section"])
    own = "".join(f'<{each} class="{rnd.choice(["comment", "comment", "reply", "respond"])}"><p>{_words(rnd, rnd.randint(3, 60))}</p></{each}>' for _ in range(rnd.randint(1, 5)))
    t = rnd.choice(["section", "div", "ul"])
    return f'<{t}{_class(rnd, ["comments", "comment", "replies"])}><h{(h := rnd.randint(2, 4))}>{_words(rnd, 1, False)}</h{h}>{own}</{t}>'


def sample_page(rnd: random.Random) -> tuple[str, list[str]]:
    """A page and its article's blocks."""
    true: list[str] = []

    def block(tag: str, n: int, end: bool = True) -> str:
        text = _words(rnd, n, end)
        true.append(text)
        cut = text.find(" ")
        shown = f"{text[:cut]}<br>{text[cut:]}" if cut > 0 and rnd.random() < 0.1 else f"<b>{text}" if rnd.random() < 0.05 else text
        return f"<{tag}>{shown}" + (f"</{tag}>" if tag != "p" or rnd.random() < 0.9 else "")

    body = block("h1", rnd.randint(2, 12), rnd.random() < 0.5) if rnd.random() < 0.9 else ""
    for _ in range(rnd.choice([1, 2, rnd.randint(3, 14), rnd.randint(3, 14), rnd.randint(15, 40)])):
        k = rnd.random()
        if k < 0.8:
            body += block("p", rnd.choice([1, 2, rnd.randint(3, 20), rnd.randint(20, 120)]), rnd.random() < 0.9)
        elif k < 0.87:
            body += block("h2", rnd.randint(1, 6), False)
        elif k < 0.93:
            body += "<ul>" + "".join(block("li", rnd.randint(1, 15)) for _ in range(rnd.randint(1, 4))) + "</ul>"
        elif k < 0.96:
            body += "<blockquote>" + block("p", rnd.randint(3, 30)) + "</blockquote>"
        else:
            body += _chrome(rnd) if rnd.random() < 0.5 else "<table><tr>" + block("td", 2) + block("td", 3) + "</tr></table>"
    kind = rnd.random()
    if kind < 0.22:
        body = f"<article>{body}</article>"
    elif kind < 0.32:
        body = f"<main>{body}</main>"
    elif kind < 0.4:
        body = f'<main><article class="post">{body}</article></main>'
    else:
        tag = rnd.choice(["div", "div", "div", "section", "td"])
        mark = "" if kind < 0.6 else _unknown(rnd) if kind < 0.76 else _class(rnd, INNER) if kind < 0.92 else None
        if mark is not None:  # otherwise the article stands between the other parts without an element of its own
            body = f"<table><tr><td{mark}>{body}</td></tr></table>" if tag == "td" else f"<{tag}{mark}>{body}</{tag}>"
    before = "".join(_chrome(rnd) for _ in range(rnd.randint(0, 4)))
    after = "".join(_chrome(rnd) for _ in range(rnd.randint(0, 4)))
    if rnd.random() < 0.3:
        after = _comments(rnd) + after
    page = before + body + after
    if rnd.random() < 0.4:
        tag = rnd.choice(["div", "div", "main", "section"])
        page = f"<{tag}{rnd.choice(['', _class(rnd, INNER), _unknown(rnd), _unknown(rnd)])}>{page}</{tag}>"
    return f"<html><head><title>{_words(rnd, 4)}</title></head><body>{page}</body></html>", true


@lru_cache(1)
def labeller(pages: int = 2000, seed: int = 11) -> Labeller:
    """Fitted on made pages, each of which is given by the seed alone."""
    rnd, data = random.Random(seed), []
    for _ in range(pages):
        page, true = sample_page(rnd)
        own = set(true)
        blocks = leaves(page)
        data.append((vectors(blocks), np.array([t in own for _, t, _ in blocks], np.float32)))
    model = Labeller()
    model.fit(data)
    return model


def main_texts(pages: list[str], model: Labeller | None = None) -> list[str]:
    blocks = [leaves(p) for p in pages]
    keep = (model or labeller()).label([vectors(b) for b in blocks])
    return ["\n".join(t for (_, t, _), k in zip(b, ks) if k) for b, ks in zip(blocks, keep)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Character references are decoded, white space inside a block becomes one space,
    blocks are joined by a line feed. A null or empty page, or one without an
    article, has the empty text. Ids and urls stay as given, null or repeated. A page
    takes time and memory in proportion to its length, however its tags are nested.
    """
    model = labeller()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("text"))

    def run(batches):
        for batch in steps(batches):
            out = main_texts(batch.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, SCHEMA)


def query(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
