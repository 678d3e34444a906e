"""Main text of web pages: a bidirectional LSTM in numpy labels every leaf block of a page as article or not.

A page becomes the sequence of its leaf blocks (text between block-level tags). Each block has the hashed tokens of its tag path (tag names and
the words of class, id and role), those of its nearest elements, its hashed words and a few numbers (length, share of links, digits,
punctuation, place). Learned vectors of these feed one LSTM from the top of the page and one from its end, so each label depends on
the whole page.

No table labels blocks. The model learns from a bounded sample of pages: where a page marks its article or main element, its blocks
label themselves; their texts are also put into made-up layouts (other tags and class names, adverts and forms inside the article, comments
below it), so that labels do not hang on one site's markup. The labelling is one pass without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.common import set_aside, share

# ---- from a page to its leaf blocks ----

_ATTRIBUTES = r"""(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?+|=)*+"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>?|</[^>]*+>?|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<rest>{_ATTRIBUTES})>?", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HINT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose content is no text of the page.
_SKIPPED = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "noembed", "noframes", "xmp", "object", "canvas"}
_SKIP_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in _SKIPPED}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that do not end a block.
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source input".split())
_SPACE = {"br", "hr"}
#: Elements that an opening tag closes when they are open, and those that keep it from looking further out.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    path: tuple[str, ...]  # different tokens of all elements around it, outermost first
    near: tuple[str, ...]  # tokens of the innermost element, and of its parent if it has none but its name


def _tokens(name: str, rest: str) -> tuple[str, ...]:
    found = [name]
    if rest:
        for match in _NAMED.finditer(rest):
            found += ["." + w.lower() for w in _HINT.findall(match[2] or match[3] or match[4] or "")]
    return tuple(dict.fromkeys(found))


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of a page in order, without those that are blank. Character references are decoded, white space becomes one space."""
    blocks: list[Block] = []
    stack: list[tuple[str, tuple, tuple]] = []  # name, own tokens, tokens of the whole path
    parts: list[str] = []
    linked: list[str] = []
    link_depth = -1  # elements that were open where the current link began

    def flush():
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                own = stack[-1][1] if stack else ()
                near = own + stack[-2][1] if len(own) == 1 and len(stack) > 1 else own
                blocks.append(Block(text, len(" ".join("".join(linked).split())), stack[-1][2] if stack else (), near))
            linked.clear()

    def pop_to(depth: int):
        nonlocal link_depth
        del stack[depth:]
        if depth < link_depth:
            link_depth = -1

    def add(piece: str):
        if "&" in piece:
            piece = unescape(piece)
        parts.append(piece)
        if link_depth >= 0:
            linked.append(piece)

    at, end = 0, len(page)
    while at < end:
        match = _TOKEN.search(page, at)
        if match is None:
            add(page[at:])
            break
        if match.start() > at:
            add(page[at : match.start()])
        at = match.end()
        name = match["start"]
        if name:
            name = name.lower()
            if name in _SKIPPED:
                close = _SKIP_END[name].search(page, at)
                at = close.end() if close else end
                if close:
                    at = page.find(">", at) + 1 or end
                continue
            if name in _INLINE:
                if name == "a":
                    link_depth = len(stack)
                continue
            if name in _SPACE:
                add(" ")
                continue
            flush()
            if name in _VOID:
                continue
            for i in range(len(stack) - 1, -1, -1):  # an open paragraph ends at the next block
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] not in ("h1", "h2", "h3", "h4", "h5", "h6", "pre", "address"):
                    break
            closes, bounds = _CLOSES.get(name, ((), ()))
            for i in range(len(stack) - 1, -1, -1) if closes else ():
                if stack[i][0] in closes:
                    pop_to(i)
                    break
                if stack[i][0] in bounds:
                    break
            own = _tokens(name, match["rest"])
            above = stack[-1][2] if stack else ()
            new = tuple(t for t in own if t not in above)
            stack.append((name, own, above + new if new else above))
        elif match["end"]:
            name = match["end"].lower()
            if name == "a":
                link_depth = -1
            if name in _INLINE or name in _VOID:
                continue
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop_to(i)
                    break
                if i < len(stack) - 256:  # a stray end tag in a very deep tree
                    break
    flush()
    return blocks


# ---- features ----


@dataclass(frozen=True)
class Settings:
    #: Hash buckets of path tokens and of words, width of their vectors, and of the state of either direction.
    path_buckets: int = 1024
    word_buckets: int = 4096
    width: int = 12
    state: int = 24
    #: The bound on what training sees: pages, blocks of one of its layouts, and steps of so many layouts.
    pages: int = 256
    blocks: int = 40
    steps: int = 550
    batch: int = 16
    rate: float = 0.008
    seed: int = 5


NUMBERS = 9


class Features:
    """Bucket lists and numbers of blocks. Buckets of seen paths and words are kept in tables that are emptied when they grow large."""

    def __init__(self, settings: Settings):
        self.settings, self.words, self.paths = settings, {}, {}

    def _bucket(self, word: str) -> int:
        got = self.words.get(word)
        if got is None:
            if len(self.words) > 400_000:
                self.words.clear()
            got = self.words[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.settings.word_buckets
        return got

    def _path(self, tokens: tuple[str, ...]) -> np.ndarray:
        got = self.paths.get(tokens)
        if got is None:
            if len(self.paths) > 50_000:
                self.paths.clear()
            got = self.paths[tokens] = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % self.settings.path_buckets for t in tokens], np.int64)
        return got

    def of(self, blocks: list[Block]):
        """(three lists of bucket arrays, numbers) of one page's blocks."""
        n = len(blocks)
        numbers = np.zeros((n, NUMBERS), np.float32)
        paths, nears, words = [], [], []
        for i, b in enumerate(blocks):
            ws = b.text.lower().split(" ")
            paths.append(self._path(b.path))
            nears.append(self._path(b.near))
            words.append(np.fromiter(map(self._bucket, ws), np.int64, len(ws)))
            size = len(b.text)
            ends = b.text.count(".") + b.text.count(",") + b.text.count("!") + b.text.count("?")
            numbers[i, :6] = (np.log1p(len(ws)) / 4, b.linked / size, min(1.0, 8 * ends / size), len(ws) == 1, size / len(ws) / 10, b.text[-1] in ".!?:;,\"'")
        numbers[:, 6] = (np.arange(n) + 0.5) / max(n, 1)
        numbers[:, 7] = np.minimum(np.arange(n), 8) / 8
        numbers[:, 8] = np.minimum(np.arange(n)[::-1], 8) / 8
        return (paths, nears, words), numbers


def _flatten(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    return (np.concatenate(lists) if len(lists) else np.zeros(0, np.int64)), sizes


# ---- the network ----


def new_weights(settings: Settings) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(settings.seed)
    d, h = 3 * settings.width + NUMBERS, settings.state
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    bias = np.zeros((2, 1, 4 * h), np.float32)
    bias[:, :, h : 2 * h] = 1  # remember at first
    return {
        "path": normal(0.3, settings.path_buckets, settings.width), "near": normal(0.3, settings.path_buckets, settings.width), "word": normal(0.1, settings.word_buckets, settings.width),
        "w": normal(d**-0.5, 2, d, 4 * h), "u": normal(h**-0.5, 2, h, 4 * h), "b": bias, "out": normal(0.2, 2 * h), "c": np.zeros(1, np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _means(table: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sizes), table.shape[1]), np.float32)
    some = sizes > 0
    if some.any():
        heads = (np.cumsum(sizes) - sizes)[some]
        out[some] = np.add.reduceat(table[flat], heads) / sizes[some, None]
    return out


class Batch:
    """Pages side by side, padded to the longest; the second copy of each is turned round for the other direction."""

    def __init__(self, pages):
        self.sizes = np.array([len(numbers) for _, numbers in pages], np.int64)
        self.flat = [_flatten([x for lists, _ in pages for x in lists[k]]) for k in range(3)]
        self.numbers = np.concatenate([n for _, n in pages])
        self.row = np.repeat(np.arange(len(pages)), self.sizes)
        self.step = np.arange(len(self.row)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.back = self.sizes[self.row] - 1 - self.step
        self.longest = int(self.sizes.max())

    def inputs(self, p) -> np.ndarray:
        return np.concatenate([_means(p[name], *self.flat[k]) for k, name in enumerate(("path", "near", "word"))] + [self.numbers], axis=1)


def forward(p: dict[str, np.ndarray], batch: Batch, keep: bool = False):
    """Log-odds per block; with ``keep`` also what the backward pass needs."""
    x = batch.inputs(p)
    h = p["u"].shape[1]
    n, steps = len(batch.sizes), batch.longest
    gates = np.zeros((steps, 2, n, 4 * h), np.float32)
    projected = np.matmul(x[None], p["w"]) + p["b"]
    gates[batch.step, 0, batch.row] = projected[0]
    gates[batch.back, 1, batch.row] = projected[1]
    hidden, cell = np.zeros((steps + 1, 2, n, h), np.float32), np.zeros((steps + 1, 2, n, h), np.float32)
    for t in range(steps):
        g = gates[t]
        g += np.matmul(hidden[t], p["u"])
        g[..., : 3 * h] = _sigmoid(g[..., : 3 * h])
        g[..., 3 * h :] = np.tanh(g[..., 3 * h :])
        cell[t + 1] = g[..., h : 2 * h] * cell[t] + g[..., :h] * g[..., 3 * h :]
        hidden[t + 1] = g[..., 2 * h : 3 * h] * np.tanh(cell[t + 1])
    both = np.concatenate([hidden[batch.step + 1, 0, batch.row], hidden[batch.back + 1, 1, batch.row]], axis=1)
    odds = both @ p["out"] + p["c"]
    return (odds, (x, gates, hidden, cell, both)) if keep else odds


def gradients(p: dict[str, np.ndarray], batch: Batch, labels: np.ndarray) -> dict[str, np.ndarray]:
    odds, (x, gates, hidden, cell, both) = forward(p, batch, keep=True)
    h, steps = p["u"].shape[1], batch.longest
    d = ((_sigmoid(odds) - labels) / len(labels)).astype(np.float32)
    grad = {"out": both.T @ d, "c": np.array([d.sum()], np.float32)}
    d_both = d[:, None] * p["out"]
    d_hidden = np.zeros_like(hidden[1:])
    d_hidden[batch.step, 0, batch.row] = d_both[:, :h]
    d_hidden[batch.back, 1, batch.row] = d_both[:, h:]
    d_gates = np.zeros_like(gates)
    next_h, next_c = np.zeros_like(hidden[0]), np.zeros_like(cell[0])
    back_u = p["u"].transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        i, f, o, c = (gates[t, ..., k * h : (k + 1) * h] for k in range(4))
        bent = np.tanh(cell[t + 1])
        dh = d_hidden[t] + next_h
        dc = dh * o * (1 - bent * bent) + next_c
        g = d_gates[t]
        g[..., :h] = dc * c * i * (1 - i)
        g[..., h : 2 * h] = dc * cell[t] * f * (1 - f)
        g[..., 2 * h : 3 * h] = dh * bent * o * (1 - o)
        g[..., 3 * h :] = dc * i * (1 - c * c)
        next_h, next_c = np.matmul(g, back_u), dc * f
    per = np.stack([d_gates[batch.step, 0, batch.row], d_gates[batch.back, 1, batch.row]])
    grad["w"] = np.matmul(x.T[None], per)
    grad["b"] = per.sum(1, keepdims=True)
    grad["u"] = np.stack([np.tensordot(hidden[:-1, k], d_gates[:, k], ((0, 1), (0, 1))) for k in (0, 1)])
    d_x = per[0] @ p["w"][0].T + per[1] @ p["w"][1].T
    width = p["path"].shape[1]
    for k, name in enumerate(("path", "near", "word")):
        flat, sizes = batch.flat[k]
        row = np.repeat(np.arange(len(sizes)), sizes)
        part = d_x[:, k * width : (k + 1) * width] / np.maximum(sizes, 1)[:, None]
        grad[name] = np.stack([np.bincount(flat, part[row, j], len(p[name])) for j in range(width)], axis=1).astype(np.float32)
    return grad


def fit(layouts, settings: Settings) -> dict[str, np.ndarray]:
    """Adam over batches of (blocks, labels) that ``layouts`` yields."""
    p = new_weights(settings)
    features = Features(settings)
    mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, settings.steps + 1):
        chosen = [next(layouts) for _ in range(settings.batch)]
        labels = np.concatenate([y for _, y in chosen]).astype(np.float32)
        grad = gradients(p, Batch([features.of(blocks) for blocks, _ in chosen]), labels)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = settings.rate * (1 - step / settings.steps) + 1e-5
        for k, g in grad.items():
            g = g / max(1.0, norm)
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return p


# ---- layouts to learn from ----

_ASIDE_TAGS = {"nav", "aside", "footer", "form", "button", "select", "option", "dialog"}
_ASIDE_HINTS = set(
    "nav navbar menu navigation breadcrumb breadcrumbs header masthead topbar footer bottom copyright legal sidebar widget related recommended cookie cookies consent notice alert banner ad ads advert advertisement adsense "
    "sponsored sponsor promo promotion form search login signup newsletter subscribe comment comments reply replies respond discussion disqus share social pagination pager tags toolbar popup modal overlay".split()
)


def own_labels(blocks: list[Block]) -> np.ndarray | None:
    """1 for blocks inside an article or main element and in nothing that says it is no part of the text; None if the page marks no such element."""
    if not any("article" in b.path or "main" in b.path for b in blocks):
        return None
    one = "article" if any("article" in b.path for b in blocks) else "main"
    return np.array([one in b.path and not any(t in _ASIDE_TAGS or t[0] == "." and t[1:] in _ASIDE_HINTS for t in b.path[b.path.index(one) + 1 :]) for b in blocks])


_WORDS = "the of and a to in is that it was for on are with as this be at by from more about our your read home news page site time people year".split()
#: Per kind of side matter: elements, class words, and short phrases. Prose of the sample is mixed in by ``Layouts``.
_KINDS = {
    "menu": (["nav", "ul", "div", "menu"], ["nav", "menu", "navbar", "main menu", "navigation", "links", "top nav", "breadcrumb", "breadcrumbs", "toc"], ["Home", "About", "Contact", "News", "Sports", "Products", "Services", "Blog", "Shop", "Login", "FAQ", "Accueil", "Startseite", "Inicio", "Kontakt", "Next", "Previous"]),
    "header": (["header", "div"], ["header", "site header", "masthead", "topbar", "branding", "logo", "page header"], ["The Daily", "Welcome to our site", "My Blog", "Skip to content", "Menu", "Your trusted source"]),
    "footer": (["footer", "div"], ["footer", "site footer", "bottom", "copyright", "legal", "colophon", "page footer"], ["© 2024 All rights reserved.", "Privacy Policy", "Terms of Use", "Imprint", "Impressum", "Powered by", "Contact us", "© example.com · Legal notice"]),
    "sidebar": (["aside", "div", "section"], ["sidebar", "side bar", "widget", "related", "related posts", "recommended", "right column", "popular", "trending", "teaser", "secondary"], ["Related articles", "Most popular", "You may also like", "Recent posts", "Archives", "Categories", "Read more", "Tags"]),
    "notice": (["div", "section", "aside", "dialog"], ["cookie", "cookie banner", "consent", "notice", "alert", "banner", "gdpr", "popup", "modal", "overlay", "message", "warning"], ["We use cookies to improve your experience.", "Accept all", "Reject", "This site uses cookies.", "Please enable JavaScript.", "Wir verwenden Cookies.", "Nous utilisons des cookies."]),
    "advert": (["div", "aside", "section", "ins"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad slot", "google ad", "sponsor", "banner ad", "adsbygoogle", "promotion"], ["Advertisement", "Sponsored", "Buy now", "50% off today only!", "Anzeige", "Publicité", "Click here", "Limited offer"]),
    "form": (["form", "div"], ["form", "search", "search form", "newsletter", "subscribe", "signup", "login", "contact form", "login box"], ["Search", "Subscribe", "Your email", "Submit", "Sign up for our newsletter", "Password", "Log in", "Enter your name", "Send"]),
    "comments": (["section", "div", "ol", "ul"], ["comments", "comment", "comment list", "comment body", "replies", "reply", "responses", "discussion", "disqus thread", "user comments", "respond", "reader comments"], ["Reply", "3 comments", "Leave a comment", "Posted by anna at 12:30", "says:", "Report", "2 days ago", "Like", "Kommentare"]),
    "share": (["div", "ul", "section"], ["share", "social", "sharing", "share buttons", "tags", "meta", "pagination", "pager", "author box"], ["Share", "Tweet", "Facebook", "Email", "Print", "Tags:", "Page 1 of 3", "Follow us"]),
}
_PROSE = {"menu": 0.15, "header": 0.3, "footer": 0.5, "sidebar": 0.6, "notice": 0.6, "advert": 0.75, "form": 0.2, "comments": 0.8, "share": 0.1}
_HOLDERS = [("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".main", ".content"), ("div", ".article", ".body"), ("div", ".post"), ("div", ".entry", ".content"), ("section", ".story"), ("div", ".text"), ("div", ".article"), ("div", ".post", ".body"), ("div",), ("section",), ("td",), (), ("article", ".post"), ("div", ".page"), ("div", ".body", ".copy"), ("div", ".container")]


class Layouts:
    """Endless (blocks, labels): sampled pages as they are, and their texts in made-up layouts."""

    def __init__(self, pages: list[tuple[list[Block], np.ndarray | None]], settings: Settings):
        self.rng = np.random.default_rng(settings.seed + 1)
        self.limit = settings.blocks
        self.real = [(b, y) for b, y in pages if y is not None and len(b)]
        self.prose = [b.text.split(" ") for blocks, _ in pages for b in blocks if len(b.text) > 40][:20_000] or [_WORDS]

    def _pick(self, values):
        return values[int(self.rng.integers(len(values)))]

    def _words(self, low: int, high: int) -> str:
        source = self._pick(self.prose)
        n = int(self.rng.integers(low, high + 1))
        start = int(self.rng.integers(max(1, len(source) - n)))
        got = source[start : start + n]
        text = " ".join(got)
        return (text[:1].upper() + text[1:] + ("." if self.rng.random() < 0.7 and text[-1:] not in ".!?" else "")) or "x"

    def _noise(self) -> str:
        return "." + "".join(chr(97 + int(x)) for x in self.rng.integers(0, 26, int(self.rng.integers(2, 8))))

    def _side(self, around: tuple[str, ...]) -> list[Block]:
        kind = self._pick(list(_KINDS))
        tags, hints, phrases = _KINDS[kind]
        tag, hint = self._pick(tags), ["." + w for w in self._pick(hints).split()]
        telling = tag in ("nav", "header", "footer", "aside", "form")
        if telling and self.rng.random() < 0.5 or kind == "menu" and self.rng.random() < 0.3:
            hint = [self._noise()] if self.rng.random() < 0.4 else []
        if self.rng.random() < 0.2:
            hint.append(self._noise())
        own = (tag, *hint)
        path = around + own
        blocks = []
        for _ in range(int(self.rng.integers(1, 7 if kind in ("menu", "comments", "sidebar") else 4))):
            long = self.rng.random() < _PROSE[kind]
            text = self._words(3, 60) if long else self._pick(phrases) if self.rng.random() < 0.75 else self._words(1, 3)
            inner = self._pick([("p",), ("div",), ("span",), ()] if long else [("li",), ("ul", "li"), ("p",), ("div",), ("button",) if kind in ("form", "notice", "share") else (), ("h3",), ()])
            if kind == "comments" and self.rng.random() < 0.5:
                inner = (self._pick(["div", "li", "article"]), ".comment", *inner)
            inner = tuple(t for t in inner if t != "span")
            linked = len(text) if kind == "menu" and self.rng.random() < 0.9 or not long and self.rng.random() < 0.5 else 0
            near = inner if len(inner) > 1 else (*inner, *own) if inner else own
            blocks.append(Block(text, linked, tuple(dict.fromkeys(path + inner)), near))
        return blocks

    def _made(self):
        rng = self.rng
        outer = ("html", "body") + self._pick([(), (), ("div",), ("div", ".wrapper"), ("div", self._noise()), ("div", ".page"), ("main",)])
        holder = self._pick(_HOLDERS)
        if holder == ("article",) and rng.random() < 0.3:
            holder += (self._noise(),)
        path = outer + holder
        blocks: list[Block] = []
        labels: list[int] = []

        def side(around, chance):
            while rng.random() < chance:
                got = self._side(around)
                blocks.extend(got)
                labels.extend([0] * len(got))

        side(outer[: int(rng.integers(2, len(outer) + 1))], 0.7)
        n = int(rng.integers(1, 16))
        for i in range(n):
            inner = ("p",)
            if i == 0 and rng.random() < 0.7:
                inner = self._pick([("h1",), ("h1",), ("h2",), ("header", "h1")]) if "article" in holder else self._pick([("h1",), ("h2",)])
                text = self._words(1, 14)
            else:
                draw = rng.random()
                inner = ("p",) if draw < 0.75 else self._pick([("div",), ("li",), ("ul", "li"), ("blockquote",), ("blockquote", "p"), ("h2",), ("h3",), ("pre",), (), ("table", "tr", "td"), ("figure", "figcaption"), ("section", "p")])
                text = self._words(1, 6) if rng.random() < 0.15 else self._words(5, 140)
            near = inner if len(inner) > 1 else (*inner, *holder) if inner else holder
            for _ in range(int(rng.integers(1, 5)) if "li" in inner or "td" in inner else 1):
                linked = int(len(text) * rng.random() * 0.4) if rng.random() < 0.15 else 0
                blocks.append(Block(text, linked, tuple(dict.fromkeys(path + inner)), near))
                labels.append(1)
                text = self._words(1, 30)
            if rng.random() < 0.08:
                side(path, 0.6)
        side(path, 0.25)
        side(outer[: int(rng.integers(2, len(outer) + 1))], 0.7)
        return blocks, np.array(labels)

    def __iter__(self):
        return self

    def __next__(self):
        if self.real and self.rng.random() < 0.35:
            blocks, labels = self._pick(self.real)
        else:
            blocks, labels = self._made()
        if len(blocks) > self.limit:  # a training page is a bounded stretch that keeps both ends in view
            start = int(self.rng.integers(len(blocks) - self.limit + 1)) if self.rng.random() < 0.5 else self._pick([0, len(blocks) - self.limit])
            blocks, labels = blocks[start : start + self.limit], labels[start : start + self.limit]
        return blocks, labels


# ---- the jobs ----


def train(pages: DataFrame, settings: Settings | None = None, html_col: str = "html") -> dict[str, np.ndarray]:
    """Weights learned in one task from the ``settings.pages`` different pages whose content hashes lowest, and from layouts made of their texts.

    Null and blank pages teach nothing; without any page the made-up layouts alone do.
    """
    settings = settings or Settings()
    html = F.col(f"`{html_col}`").alias("html")
    source = pages.select(F.xxhash64(html).alias("k"), html).where("html is not null")
    keys = source.select("k").distinct().orderBy("k").limit(settings.pages)
    sample = source.join(F.broadcast(keys), "k").groupBy("k").agg(F.min("html").alias("html"))  # one page per key, combined before the shuffle

    def learn(batches):
        parsed = []
        for batch in batches:
            for page in batch.column("html").to_pylist():
                blocks = leaf_blocks(page)
                parsed.append((blocks, own_labels(blocks)))
        weights = fit(Layouts(parsed, settings), settings)
        names = list(weights)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([weights[n].tobytes() for n in names], pa.binary()), pa.array([list(weights[n].shape) for n in names], pa.list_(pa.int64()))], ["name", "data", "shape"])

    rows = sample.repartition(1).sortWithinPartitions("k").mapInArrow(learn, "name string, data binary, shape array<bigint>").collect()  # one row per weight table
    if not rows:
        return fit(Layouts([], settings), settings)
    return {r.name: np.frombuffer(r.data, np.float32).reshape(r.shape) for r in rows}


def label_pages(pages: list[list[Block]], weights: dict[str, np.ndarray], features: Features, budget: int = 1 << 15) -> list[np.ndarray]:
    """Per page, which blocks belong to the article. Pages of like length are labelled together, up to ``budget`` padded blocks."""
    out: list[np.ndarray] = [np.zeros(len(b), bool) for b in pages]
    order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if pages[i]]
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * len(pages[order[stop]]) <= budget:
            stop += 1
        batch = Batch([features.of(pages[i]) for i in order[at:stop]])
        found = np.split(forward(weights, batch) > 0, np.cumsum(batch.sizes)[:-1])
        for i, got in zip(order[at:stop], found):
            out[i] = got
        at = stop
    return out


def extract_text(pages: DataFrame, weights: dict[str, np.ndarray], settings: Settings | None = None, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Every row of ``pages`` with a last column ``text_col``: the article's blocks in page order, joined by one space.

    Character references are decoded; white space (as Unicode has it) inside a block becomes one space. Null, empty and blank pages, and those without
    article blocks, have an empty text. Rows, repeated ones included, and all other columns stay; a column already named ``text_col`` is
    replaced. Nothing is cut: pages of any length are parsed and labelled whole.
    """
    settings = settings or Settings()
    pages, restore = set_aside(pages if text_col == html_col else pages.drop(text_col))
    shared = share(pages.sparkSession, weights)  # fixed size, whatever the input
    kept = [f for f in pages.schema.fields if f.name != text_col]

    def run(batches):
        model, features = shared(), Features(settings)
        for batch in batches:
            texts: list[str] = []
            column = batch.column(html_col)
            for start in range(0, batch.num_rows, 512):
                parsed = [leaf_blocks(h or "") for h in column.slice(start, 512).to_pylist()]
                for blocks, chosen in zip(parsed, label_pages(parsed, model, features)):
                    texts.append(" ".join([b.text for b, c in zip(blocks, chosen.tolist()) if c]))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(texts, pa.string())], [*[f.name for f in kept], text_col])

    return restore(pages.mapInArrow(run, T.StructType([*kept, T.StructField(text_col, T.StringType())])))
