"""Main text of HTML pages by a recurrent block labeller.

A page is read as a sequence of leaf blocks: runs of text between block-level tags. Scripts,
styles, comments, form controls' values and other markup are no text. Each block becomes a vector
of its hashed tag path (names, classes, ids and roles), its hashed words, and its length, link
share and place. A bidirectional LSTM in numpy reads the whole sequence, so every block is judged
with the context of the whole document, and blocks labelled as main text are joined in page order.

The network is trained here with a fixed seed, on page layouts that are drawn from lists of
containers (article and content areas among menus, sidebars, adverts, notices, forms, comments,
headers and footers) and filled with drawn words, so it is the same for every table and no page
goes to the driver.

Rows: null html is an empty page, whose text is empty. Pages without a main block have empty text.
Repeated rows and ids give a row each, null ids and urls stay null. An empty table gives an empty
result. Other columns are ignored. Long pages are read whole; sequences are cut nowhere.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.runtime import bounded_batches, settled

PATH_DIM, WORD_DIM = 48, 16
DIM = PATH_DIM + WORD_DIM + 6
HIDDEN = 16
LAYOUTS, EPOCHS, GROUP, RATE = 1400, 18, 24, 8e-3
#: Blocks that are labelled together (padding counts), and steps whose inputs are made together.
CELLS, STEPS = 1 << 14, 1 << 10
CACHED = 50_000
# fixed values: tags of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("script style noscript template svg math iframe object textarea select".split())
RAW, HEAD = frozenset("script style".split()), frozenset("base basefont bgsound link meta title script style noscript template".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "td": frozenset("td th tr".split()), "th": frozenset("td th tr".split()), "tr": frozenset(["tr"]), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "option": frozenset(["option"])}
BOUNDS = frozenset("ul ol table div article section body".split())
#: Tags that tell nothing of a block's role.
NOTHING = INLINE | frozenset("html body".split())
CLOSES = {tag: [k for k, by in CLOSED_BY.items() if tag in by] for tag in frozenset().union(*CLOSED_BY.values())}
#: What can begin behind an angle bracket, and the plain part of a tag.
START, PLAIN, BARE = re.compile(r"<(?:!--|(/?)([A-Za-z][A-Za-z0-9:-]*)|[!?])"), re.compile(r"[^<>\"']*"), re.compile(r"[^<>]*")
MARK = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[^\W_]+")


@dataclass(slots=True)
class Block:
    place: _Place
    text: str
    linked: int


class _Place:
    """A chain of open elements by its last one: what its tags and marks add up to."""

    __slots__ = ("above", "tokens", "n", "total")

    def __init__(self, above: _Place | None, tokens: list[str]):
        self.above, self.tokens = above, tokens
        self.n = len(tokens) + (above.n if above else 0)
        self.total: np.ndarray | None = None

    def vector(self) -> np.ndarray:
        """The sum of the hashed vectors of all tokens, remembered in every element of the chain."""
        new, at = [], self
        while at is not None and at.total is None:
            new.append(at)
            at = at.above
        total = at.total if at is not None else np.zeros(PATH_DIM, np.float32)
        for place in reversed(new):
            total = place.total = total + _own_vector(tuple(place.tokens))
        return total


_ROOT = _Place(None, [])


@functools.lru_cache(CACHED)
def _own_vector(tokens: tuple[str, ...]) -> np.ndarray:
    return _PATHS.sum([x.split("=", 1)[-1] for x in tokens]) if tokens else np.zeros(PATH_DIM, np.float32)


class _Stack:
    """Open elements, with the places of each tag's, so that no tag walks the stack."""

    def __init__(self) -> None:
        self.open: list[tuple[str, _Place]] = []
        self.of: dict[str, list[int]] = {}
        self.bounds: list[int] = []

    def place(self) -> _Place:
        return self.open[-1][1] if self.open else _ROOT

    def push(self, tag: str, tokens: list[str]) -> None:
        self.of.setdefault(tag, []).append(len(self.open))
        if tag in BOUNDS:
            self.bounds.append(len(self.open))
        self.open.append((tag, _Place(self.place(), tokens) if tokens else self.place()))

    def cut(self, at: int) -> None:
        while len(self.open) > at:
            tag, _ = self.open.pop()
            self.of[tag].pop()
            if tag in BOUNDS:
                self.bounds.pop()

    def close(self, tag: str) -> None:
        if self.of.get(tag):
            self.cut(self.of[tag][-1])

    def make_room(self, tag: str) -> None:
        """Close the innermost element that the start tag ends, if no bound lies between."""
        last = max((self.of[k][-1] for k in CLOSES.get(tag, ()) if self.of.get(k)), default=-1)
        if last >= 0 and last > (self.bounds[-1] if self.bounds else -1):
            self.cut(last)


@dataclass(slots=True)
class _Token:
    """A comment, a declaration (both without a tag) or a start or end tag, and where it stands."""

    start: int
    end: int
    closing: str = ""
    tag: str = ""
    rest: str = ""


class _Page:
    """A page and what is known of its end, so that nothing is searched for twice in vain."""

    def __init__(self, text: str):
        self.text, self.last = text, {q: text.rfind(q) for q in "\"'>"}
        self.closed: dict[str, dict[int, int]] = {}
        self.open: set[str] = set()

    def tag_end(self, at: int) -> tuple[int, int] | None:
        """Ends of a tag's attributes and of the tag, from behind its name: quoted values are read to
        their closing quote, however long. A tag whose quotes don't match ends at the next angle
        bracket. The page's end ends a tag too; what meets another opening bracket first is none."""
        text, first = self.text, at
        while True:
            at = PLAIN.match(text, at).end()
            c = text[at : at + 1]
            if c == ">" or not c:
                return at, at + len(c)
            if c == "<" or at >= self.last[c]:
                at = BARE.match(text, first).end()
                return None if text.startswith("<", at) else (at, at + text.startswith(">", at))
            at = text.index(c, at + 1) + 1

    def token(self, at: int) -> _Token | None:
        """The first token from at on."""
        while m := START.search(self.text, at):
            at = m.end()
            if m.group(2):
                if ends := self.tag_end(at):
                    return _Token(m.start(), ends[1], m.group(1), m.group(2).lower(), self.text[at : ends[0]])
                continue
            comment = m.group() == "<!--"
            end = self.text.find("-->" if comment else ">", at) if at <= self.last[">"] else -1
            if end >= 0 or comment:
                return _Token(m.start(), end + (3 if comment else 1) if end >= 0 else len(self.text))
        return None

    def ends(self, tag: str) -> dict[int, int]:
        """{end of a start tag: end of its end tag}; elements that are never closed are left out."""
        if tag not in self.closed:
            out, opened = {}, []
            for m in re.finditer(rf"<(/?){tag}(?![\w:-])", self.text, re.I):
                if not (ends := self.tag_end(m.end())):
                    continue
                if not m.group(1):
                    if not self.text.endswith("/", m.end(), ends[0]):
                        opened.append(ends[1])
                elif opened:
                    out[opened.pop()] = ends[1]
            self.closed[tag] = out
        return self.closed[tag]

    def after(self, tag: str, at: int) -> int | None:
        """Behind the next end tag of an element in whose content no tags count."""
        if tag in self.open:
            return None
        end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(self.text, at)
        if not end:
            self.open.add(tag)
        return end.end() if end else None

    def after_head(self, at: int) -> int:
        """Where a head ends that starts before at: behind </head>, or before <body>, the first other
        element that is no metadata or the first text outside of elements."""
        while t := self.token(at):
            if self.text[at : t.start].strip():
                break
            if t.closing and t.tag == "head":
                return t.end
            if t.tag and not t.closing and t.tag not in HEAD:
                return t.start
            at = t.end
            if t.tag in HEAD and not t.closing and t.tag in ("title", "script", "style", "noscript", "template") and not t.rest.endswith("/"):
                at = self.after(t.tag, at) or (len(self.text) if t.tag in RAW else at)
        return at


def blocks(page: str) -> list[Block]:
    """The page's non-empty leaf blocks in order, white space inside turned into one space."""
    stack = _Stack()
    out: list[Block] = []
    parts: list[str] = []
    linked = at = 0
    place = _ROOT

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(place, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def text(raw: str) -> None:
        nonlocal linked, place
        if not raw:
            return
        raw = entities.unescape(raw)
        if not parts:
            place = stack.place()
        parts.append(raw)
        if stack.of.get("a"):
            linked += len(raw.strip())

    page = page or ""
    whole = _Page(page)
    while True:
        token = whole.token(at)
        text(page[at : token.start if token else len(page)])
        if not token:
            break
        at, closing, tag, rest = token.end, token.closing, token.tag, token.rest
        if not tag:
            continue
        if tag in SKIPPED:
            if not closing and not rest.endswith("/"):
                flush()
                if tag in RAW:
                    at = whole.after(tag, at) or len(page)
                else:  # without an end tag the element is a container like any other
                    at = whole.ends(tag).get(at, at)
            continue
        if tag == "head":
            if not closing:
                flush()
                at = whole.after_head(at)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            flush()
        if closing:
            stack.close(tag)
            continue
        stack.make_room(tag)
        if not rest.rstrip().endswith("/"):
            marks = [] if tag in NOTHING else [f"{a.lower()}={w.lower()}" for a, *v in MARK.findall(rest) for w in re.split(r"[\s_-]+", "".join(v)) if w]
            stack.push(tag, [] if tag in NOTHING else [tag, *marks])
    flush()
    return out


class Hashed:
    """Sums of hashed vectors: each token has two signed entries at places that a hash gives."""

    def __init__(self, dim: int):
        self.dim, self.place, self.table = dim, {}, np.zeros((CACHED, dim), np.float32)

    def sum(self, tokens: list[str]) -> np.ndarray:
        place = self.place
        new = set(tokens).difference(place)
        if len(place) + len(new) > len(self.table):
            place.clear()
            self.table = np.zeros((max(CACHED, len(set(tokens))), self.dim), np.float32)
            new = set(tokens)
        for t in new:
            row = self.table[len(place)]
            h = xxhash.xxh3_64_intdigest(t)
            for shift in (0, 20):
                row[(h >> shift) % self.dim] += 1.0 if (h >> (shift + 16)) & 1 else -1.0
            place[t] = len(place)
        return self.table[list(map(place.__getitem__, tokens))].sum(0)


_PATHS, _WORDS = Hashed(PATH_DIM), Hashed(WORD_DIM)


def vectors(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), DIM), np.float32)
    for i, b in enumerate(page):
        out[i, :PATH_DIM] = b.place.vector() / max(1, b.place.n) ** 0.5
        if words := WORD.findall(b.text.lower()):
            own = _WORDS.sum(words) * (0.1 / len(words) ** 0.5)
            out[i, PATH_DIM : PATH_DIM + WORD_DIM] = own / max(1.0, float(np.linalg.norm(own)) / 0.3)  # runs of one word add up
        out[i, -6:] = np.log1p(len(b.text)) / 20, b.linked / len(b.text), i / len(page), 1 / (1 + i), 1 / (len(page) - i), b.text[-1:] in ".!?"
    return out


class BiLSTM:
    """One layer in each direction and a logistic output for each step."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        k = (DIM + HIDDEN) ** -0.5
        self.p = [x.astype(np.float32) for x in (rng.normal(0, k, (DIM + HIDDEN, 4 * HIDDEN)), np.zeros(4 * HIDDEN), rng.normal(0, k, (DIM + HIDDEN, 4 * HIDDEN)), np.zeros(4 * HIDDEN), rng.normal(0, 0.3, 2 * HIDDEN), np.zeros(1))]
        for b in (self.p[1], self.p[3]):
            b[HIDDEN : 2 * HIDDEN] = 1.0

    @staticmethod
    def _run(x: np.ndarray, live: np.ndarray, w: np.ndarray, b: np.ndarray, keep: list | None) -> np.ndarray:
        n, t, _ = x.shape
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((n, t, HIDDEN), np.float32)
        for s in range(t):
            if s % STEPS == 0:
                given = x[:, s : s + STEPS] @ w[:DIM] + b
            z = given[:, s % STEPS] + h @ w[DIM:]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = live[:, s, None]
            before, previous = c, h
            c = m * (f * c + i * g) + (1 - m) * c
            h = m * (o * np.tanh(c)) + (1 - m) * h
            out[:, s] = h
            if keep is not None:
                keep.append((previous, before, c, i, f, o, g, m))
        return out

    @staticmethod
    def _back(x: np.ndarray, d_out: np.ndarray, w: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray]:
        dw, db = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32)
        dh = np.zeros_like(d_out[:, 0])
        dc = np.zeros_like(dh)
        for s in range(x.shape[1] - 1, -1, -1):
            previous, before, c, i, f, o, g, m = keep[s]
            dh = dh + d_out[:, s]
            tc = np.tanh(c)
            live_h, live_c = dh * m, (dc + dh * o * (1 - tc * tc)) * m
            dz = np.concatenate([live_c * g * i * (1 - i), live_c * before * f * (1 - f), live_h * tc * o * (1 - o), live_c * i * (1 - g * g)], axis=1)
            dw[:DIM] += x[:, s].T @ dz
            dw[DIM:] += previous.T @ dz
            db += dz.sum(0)
            dc = live_c * f + dc * (1 - m)
            dh = dz @ w[DIM:].T + dh * (1 - m)
        return dw, db

    @staticmethod
    def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        size = [len(p) for p in pages]
        x = np.zeros((len(pages), max(size), DIM), np.float32)
        live = np.zeros(x.shape[:2], np.float32)
        back = []
        for k, p in enumerate(pages):
            x[k, : len(p)], live[k, : len(p)] = p, 1
            back.append(np.concatenate([np.arange(len(p))[::-1], np.arange(len(p), x.shape[1])]))
        return x, live, back

    def _forward(self, pages: list[np.ndarray], keep: tuple | None = None) -> tuple:
        x, live, back = self._padded(pages)
        turned = np.stack([row[b] for row, b in zip(x, back)])
        one = self._run(x, live, self.p[0], self.p[1], keep[0] if keep else None)
        two = self._run(turned, live, self.p[2], self.p[3], keep[1] if keep else None)
        both = np.concatenate([one, np.stack([row[b] for row, b in zip(two, back)])], axis=2)
        logit = both @ self.p[4] + self.p[5][0]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), x, turned, live, back, both

    def labels(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text for each block of each page; pages of like length together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        part: list[int] = []
        for i in [*sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i])), None]:
            if part and (i is None or (len(part) + 1) * len(pages[i]) > CELLS):
                p = self._forward([pages[j] for j in part])[0]
                for row, j in enumerate(part):
                    out[j] = p[row, : len(pages[j])]
                part = []
            if i is not None:
                part.append(i)
        return out

    def train(self, pages: list[np.ndarray], truth: list[np.ndarray], seed: int = 13) -> None:
        rng = np.random.default_rng(seed)
        first, second, step = [p * 0 for p in self.p], [p * 0 for p in self.p], 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            # pages of like length together, so that little is padding
            mixed = np.array(sorted(rng.permutation(len(pages)), key=lambda i: len(pages[i]) // 8))
            starts = np.arange(0, len(mixed), GROUP)
            for k in rng.permutation(starts):
                part = mixed[k : k + GROUP]
                keep: tuple[list, list] = ([], [])
                p, x, turned, live, back, both = self._forward([pages[i] for i in part], keep)
                y = np.zeros_like(live)
                for row, i in enumerate(part):
                    y[row, : len(truth[i])] = truth[i]
                off = ((p - y) * live / live.sum()).astype(np.float32)
                d = off[:, :, None] * self.p[4]
                dw1, db1 = self._back(x, d[:, :, :HIDDEN], self.p[0], keep[0])
                dw2, db2 = self._back(turned, np.stack([row[b] for row, b in zip(d[:, :, HIDDEN:], back)]), self.p[2], keep[1])
                grads = [dw1, db1, dw2, db2, np.einsum("ntk,nt->k", both, off), np.array([off.sum()], np.float32)]
                norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads))))
                step += 1
                for w, g, m, v in zip(self.p, grads, first, second):
                    g = g / norm
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


# fixed values: containers of main text and of the rest, as layouts use them
MAIN = ["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="content" role="main">{}</div>', '<div class="post-content">{}</div>', '<section class="article-body">{}</section>', '<div class="entry-content">{}</div>', '<div id="main"><div class="story">{}</div></div>', '<div class="article"><div class="text">{}</div></div>', '<article class="post">{}</article>', "<div><article>{}</article></div>"]
RATHER_NOT = {
    "menu": ["<nav>{}</nav>", '<div class="menu">{}</div>', '<div id="nav">{}</div>', '<div class="navbar">{}</div>', '<div class="breadcrumb">{}</div>', '<div role="navigation">{}</div>'],
    "top": ["<header>{}</header>", '<div class="header">{}</div>', '<div id="masthead">{}</div>', '<div class="topbar">{}</div>'],
    "foot": ["<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer">{}</div>', '<div class="copyright">{}</div>', '<section class="footer legal">{}</section>'],
    "side": ["<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="side">{}</div>', '<aside class="related">{}</aside>', '<div class="widget">{}</div>', '<div class="tags">{}</div>', '<div class="share social">{}</div>'],
    "advert": ['<div class="ad">{}</div>', '<div class="ads banner">{}</div>', '<div class="advert">{}</div>', '<aside class="ad">{}</aside>', '<div class="sponsored">{}</div>', '<div id="promo">{}</div>', '<section class="advertisement">{}</section>', '<div class="ad-slot">{}</div>'],
    "notice": ['<div class="cookie-notice">{}</div>', '<div class="cookie">{}</div>', '<div id="consent">{}</div>', '<div class="notice">{}</div>', '<div class="banner notice" role="alert">{}</div>', '<div class="newsletter">{}</div>', '<div class="popup">{}</div>', '<div role="dialog">{}</div>'],
    "form": ["<form>{}</form>", '<form class="search">{}</form>', '<div class="form"><form>{}</form></div>', '<form id="subscribe">{}</form>'],
    "comment": ['<div class="comments">{}</div>', '<section id="comments">{}</section>', '<div class="comment">{}</div>', '<ol class="commentlist">{}</ol>', '<div class="comments"><div class="comment">{}</div></div>', '<section class="comments"><article class="comment">{}</article></section>', '<div class="discussion replies">{}</div>'],
}
_BEFORE, _AFTER, _WITHIN = ("top", "menu", "advert", "notice", "form", "side"), ("comment", "side", "foot", "form", "advert", "notice", "menu"), ("advert", "side", "notice", "form")


def layout(rng: random.Random, words: list[str]) -> tuple[str, str]:
    """A page, and the same page with its main blocks' texts marked by a leading character."""
    mark = "\x01"

    def said(lo: int, hi: int, end: str = "") -> str:
        return " ".join(rng.choice(words) for _ in range(rng.randint(lo, hi))).replace("<", "").replace("&", "") + end

    def prose(main: bool, lo: int = 1, hi: int = 60) -> str:
        hi = max(lo, rng.choice([3, hi // 3, hi, hi]))
        s = (mark if main else "") + said(lo, hi, rng.choice([".", ".", ".", "", "!"]))
        if (odd := rng.random()) < 0.06:  # runs of one word, and lists in a line
            s = (mark if main else "") + ((rng.choice(words) + " ") * rng.randint(2, 40) if odd < 0.03 else " | ".join(rng.choice(words) for _ in range(rng.randint(2, 40))))
        if rng.random() < 0.2:
            s += f' <a href="/x">{said(1, 3)}</a> {said(1, 8)}'
        return rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>", "<blockquote>{}</blockquote>", "<li>{}</li>", "<pre>{}</pre>"] if main else ["<p>{}</p>", "<div>{}</div>", "{}", "<p><b>{}</b></p>", "<li>{}</li>"]).format(s)

    def rather_not(kind: str) -> str:
        frame = rng.choice(RATHER_NOT[kind])
        if kind == "menu" or (kind in ("top", "side", "foot") and rng.random() < 0.5):
            ends = [f'<a href="/{i}">{said(1, 3)}</a>' for i in range(rng.randint(2, 9))]
            if rng.random() < 0.25:  # links in a line
                return rng.choice([frame, '<div id="top">{}</div>', "<div>{}</div>"]).format(rng.choice(["", " ", " | ", " &middot; "]).join(ends))
            return frame.format("<ul>" + "".join(f"<li>{x}</li>" for x in ends) + "</ul>")
        if kind == "form":
            return frame.format(f"<label>{said(1, 4)}</label><input name=q><button>{said(1, 2)}</button>")
        n = rng.randint(1, 6 if kind == "comment" else 2)
        return frame.format("".join(prose(False, 1, 40 if kind == "comment" else 25) for _ in range(n)))

    body = [f"<h1>{mark}{said(2, 10)}</h1>"] if rng.random() < 0.85 else []
    for _ in range(rng.randint(0 if body else 1, rng.choice([60, 60, 240]) if rng.random() < 0.06 else 14)):
        body.append(f"<h{rng.randint(2, 4)}>{mark}{said(1, 6)}</h3>" if rng.random() < 0.1 else prose(True))
        if rng.random() < 0.06:
            body.append(rather_not(rng.choice(_WITHIN)))
        if rng.random() < 0.15:
            kind = rng.choice(["ul", "ul", "ol"])
            body.append(f"<{kind}>" + "".join(f"<li>{mark}{said(1, 20, rng.choice(['', '.']))}</li>" for _ in range(rng.randint(2, 6))) + f"</{kind}>")
        if rng.random() < 0.05:
            body.append(f"<table><tr><td>{mark}{said(1, 4)}</td><td>{mark}{said(1, 4)}</td></tr></table>")
    main = rng.choice(MAIN).format("".join(body))
    before = "".join(rather_not(k) for k in _BEFORE if rng.random() < 0.4)
    after = "".join(rather_not(k) for k in _AFTER if rng.random() < 0.4)
    whole = before + main + after
    if rng.random() < 0.3:
        whole = rng.choice(['<div class="wrapper">{}</div>', '<div id="page">{}</div>', '<div class="container">{}</div>']).format(whole)
    return f"<html><head><title>{said(1, 6)}</title></head><body>{whole}</body></html>", mark


# fixed values: parts of the words that fill drawn layouts
SYLLABLES = "a al an ar be ca ch con de der do e ein el en er es et ge he i in ing ion is ke la le li lo ma me mi mo na ne ni no o of on or ou pa per po que ra re ri ro sa se sh si so st ta te th ti to tra u un ur ve ver vi wa we wi zu é ä ö ñ".split()


def drawn_words(rng: random.Random, n: int = 3000) -> list[str]:
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.choice([1, 1, 2, 2, 3, 4]))) for _ in range(n)]
    return [w.capitalize() if rng.random() < 0.1 else w + rng.choice(["", "", "", "", ",", "."]) for w in words]


def trained(seed: int = 5) -> BiLSTM:
    """The labeller, from drawn layouts."""
    rng = random.Random(seed)
    words = drawn_words(rng)
    pages, truth = [], []
    for _ in range(LAYOUTS):
        page, mark = layout(rng, words)
        cut = blocks(page)
        truth.append(np.array([b.text.startswith(mark) for b in cut], np.float32))
        for b in cut:
            b.text = b.text.lstrip(mark) or " "
        pages.append(vectors(cut))
    net = BiLSTM()
    net.train(pages, truth)
    return net


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: the id, the url, text (main blocks joined by a line feed), n_chars."""
    bounded_batches(pages.sparkSession)
    net = trained()

    @F.pandas_udf("string")
    def extracted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in parts:
            cut = [blocks(page) for page in batch]
            told = net.labels([vectors(page) for page in cut])
            yield pd.Series(["\n".join(b.text for b, p in zip(page, label) if p >= 0.5) for page, label in zip(cut, told)], dtype=object)
        settled()

    text = extracted(F.coalesce(F.col(html_col), F.lit("")))
    return pages.select(F.col(id_col), F.col(url_col), text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
