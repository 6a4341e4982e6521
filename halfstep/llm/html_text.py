"""Main text of HTML pages by a recurrent block labeller.

A page is cut into blocks, the runs of text between block-level tags. A block's features are its path of tags with
classes and ids, its words (both hashed), and a few figures such as its length and share of link text. A bidirectional
LSTM in numpy reads all blocks of a page in order and labels each as main text or not, so a label depends on the whole
page. It is trained here, by gradient descent on pages made by rules with made-up words, for which the labels are known:
articles in many kinds of markup among menus, notices, adverts, forms, comments and the like.

Whole pages are read, without caps; features of very long pages are made in lots of LOT blocks. A page that is null or has
no main text gives an empty text. Repeated pages are labelled alike, and an empty table gives an empty one. Tags may be
unclosed or misnested: an element that hides its content and is never closed hides what follows only if HTML says so (as
for script); of others only the start tag is passed over. Columns other than id, url and page may have any names.

The labeller is trained on the driver at the start of each session, by float32 products whose last bits may depend on the
machine's library; pages whose odds lie near one half could then be labelled otherwise. Within a session all workers use
the same weights.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .langid import chunks

PATHS, LEAVES, WORDS, FIGURES = 256, 64, 128, 8
WIDTH = PATHS + LEAVES + WORDS + FIGURES
HIDDEN, PAGES, EPOCHS, BATCH, RATE, LOT = 24, 900, 7, 20, 0.01, 20_000

#: Elements that begin and end a block (fixed values of HTML).
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav object ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul".split())
#: Elements whose content is text up to their own end tag, which is not shown (fixed values of HTML).
RAW = frozenset("script style title textarea iframe noframes noscript".split())
#: Elements whose content, with the elements in it, is not shown.
UNSHOWN = frozenset("template svg math object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag closes if it is open (the nearest one, up to the barrier).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
#: The end of one of them ends any other.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BARRIER = frozenset("ul ol menu dl table tbody thead tfoot select body article section div".split())
CLOSE_P = BLOCK - {"button", "label", "option", "optgroup", "body", "html", "head", "legend", "caption", "iframe", "object", "template"}

#: A tag's name, then its attributes: a name, and after = a value in quotes or up to white space or the tag's end.
TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|</(?=[^a-zA-Z])[^>]*>?|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[\s/]+|=?[^\s/>=]+(?:\s*=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*|(?=>)))?|=)*)>?", re.S)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PIECES = re.compile(r"[a-z]+")


class Node:
    """An open element. Nodes share their parents, and also the columns of path features where they add none."""

    __slots__ = ("parent", "names", "depth", "columns")

    def __init__(self, parent: Node | None, names: tuple[str, ...]):
        self.parent, self.names, self.depth = parent, names, parent.depth + 1 if parent else 1
        held = parent.columns if parent else frozenset()
        own = {bucket("n:" + x, PATHS) if j else bucket("t:" + x, PATHS) for j, x in enumerate(names)}
        self.columns = held if own <= held else held | own


class Block:
    __slots__ = ("node", "text", "links")

    def __init__(self, node: Node | None, text: str, links: int):
        self.node, self.text, self.links = node, text, links

    @property
    def path(self) -> tuple[tuple[str, ...], ...]:
        """Tag, classes and ids of each element from the outermost."""
        out, node = [], self.node
        while node:
            out.append(node.names)
            node = node.parent
        return tuple(reversed(out))


class Open:
    """Open elements from the outermost, and where those of each tag are, so that none is searched for."""

    def __init__(self):
        self.items: list = []
        self.places: dict[str, list[int]] = {}
        self.barriers: list[int] = []

    def push(self, tag: str, item) -> None:
        self.places.setdefault(tag, []).append(len(self.items))
        if tag in BARRIER:
            self.barriers.append(len(self.items))
        self.items.append((tag, item))

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost element of these tags, -1 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def cut(self, place: int) -> None:
        """Closes the element at this place and those in it."""
        while len(self.items) > place:
            tag, _ = self.items.pop()
            self.places[tag].pop()
            if tag in BARRIER:
                self.barriers.pop()

    def count(self, tag: str) -> int:
        return len(self.places.get(tag, ()))


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with white space made single and character references decoded."""
    out: list[Block] = []
    stack, unshown = Open(), Open()  # unshown: elements whose content isn't shown
    parts: list[str] = []
    links = in_link = at = 0

    def flush() -> None:
        nonlocal parts, links
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(stack.items[-1][1] if stack.items else None, text, links))
        parts, links = [], 0

    def said(text: str) -> None:
        nonlocal links
        if text and not unshown.items:
            parts.append(text)
            links += len(text) if in_link else 0

    to_come: dict[str, int] = {}  # how many end tags of an element that isn't shown are still to come
    never: set[str] = set()  # elements of text of which no end tag is left

    def closed_later(tag: str) -> bool:
        if tag not in to_come:
            to_come[tag] = len(re.findall(rf"</{tag}(?=[\s/>])", page[at:], re.I))
        return to_come[tag] > unshown.count(tag)

    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            said(html.unescape(page[at:]))
            break
        said(html.unescape(page[at : m.start()]))
        at = m.end()
        if m["cdata"] is not None and (unshown.count("svg") or unshown.count("math")):
            continue
        if m["cdata"] is not None:  # outside svg and math it is a comment, up to the first >
            at = page.find(">", m.start()) + 1 or len(page)
        if m["tag"] is None:
            continue
        tag, closing = m["tag"].lower(), bool(m["close"])
        if tag in UNSHOWN:
            foreign = tag in ("svg", "math") or unshown.count("svg") or unshown.count("math")
            if closing:
                to_come[tag] = to_come.get(tag, 1) - 1
                if unshown.count(tag):
                    unshown.cut(unshown.last((tag,)))
            elif not (m["rest"].rstrip().endswith("/") and foreign) and closed_later(tag):
                unshown.push(tag, None)
            continue
        if tag in RAW:
            if not closing:
                end = None if tag in never else re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                if end is None:
                    never.add(tag)
                at = end.end() if end else len(page) if tag in ("script", "style") else at
            continue
        if unshown.items:
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in BLOCK:
            continue
        flush()
        if closing:
            place = stack.last(HEADINGS if tag in HEADINGS else (tag,))
            if place >= 0:
                stack.cut(place)
            continue
        if tag == "hr":
            continue
        top = stack.items[-1][0] if stack.items else ""
        if (tag in CLOSE_P and top == "p") or (tag in HEADINGS and top in HEADINGS):
            stack.cut(len(stack.items) - 1)
        if tag in CLOSES:
            place = stack.last(CLOSES[tag])
            if place > (stack.barriers[-1] if stack.barriers else -1):
                stack.cut(place)
        if tag in VOID:
            continue
        names = {piece for _, *v in NAMES.findall(m["rest"]) for piece in PIECES.findall("".join(v).lower())} if m["rest"] else ()
        stack.push(tag, Node(stack.items[-1][1] if stack.items else None, (tag, *sorted(names))))
    flush()
    return out


@functools.lru_cache(200_000)
def bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode()) % size


def features(pages: list[list[Block]]) -> np.ndarray:
    """A row for each block of the pages, one page after another."""
    return np.concatenate([*feature_lots(pages), np.zeros((0, WIDTH), np.float32)])


def feature_lots(pages: list[list[Block]]) -> Iterator[np.ndarray]:
    """The rows of features(), LOT at a time."""
    flat = [(b, k, len(page)) for page in pages for k, b in enumerate(page)]
    for i in range(0, len(flat), LOT):
        yield _features(flat[i : i + LOT])


def _features(some: list[tuple[Block, int, int]]) -> np.ndarray:
    at, column, times, figures = [], [], [], np.zeros((len(some), FIGURES), np.float32)
    for row, (b, k, of) in enumerate(some):
        f = dict.fromkeys(b.node.columns, 1) if b.node else {}
        f[PATHS + bucket(b.node.names[0] if b.node else "", LEAVES)] = 1
        words = b.text.lower().split()
        for x in words:
            w = PATHS + LEAVES + bucket(x.strip(".,;:!?()\"'"), WORDS)
            f[w] = f.get(w, 0) + 1
        at.append(np.full(len(f), row))
        column.append(np.fromiter(f, np.int64, len(f)))
        times.append(np.fromiter(f.values(), np.float32, len(f)))
        n, letters = len(b.text), sum(map(str.isalpha, b.text))
        figures[row] = (np.log1p(n) / 5, np.log1p(len(words)) / 4, min(1, b.links / n), min(1, sum(map(b.text.count, ".,;!?")) / (1 + len(words))), letters / n, b.text[-1] in ".!?", k / of, (b.node.depth if b.node else 0) / 8)
    x = np.zeros((len(some), WIDTH), np.float32)
    x[np.concatenate(at), np.concatenate(column)] = np.concatenate(times)
    words = x[:, PATHS + LEAVES : PATHS + LEAVES + WORDS]
    words /= np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1)
    x[:, -FIGURES:] = figures
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM over rows of features, with a logistic output for each row."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)

        def start(*shape: int) -> np.ndarray:
            return r.normal(0, (2 / sum(shape)) ** 0.5, shape).astype(np.float32)

        self.w = {"out": start(2 * HIDDEN, 1), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            gates = np.zeros(4 * HIDDEN, np.float32)
            gates[HIDDEN : 2 * HIDDEN] = 1  # to remember at first
            self.w |= {d + "x": start(WIDTH, 4 * HIDDEN), d + "h": start(HIDDEN, 4 * HIDDEN), d + "b": gates}

    def run(self, x: np.ndarray | list[np.ndarray], lengths: np.ndarray, keep: bool = False):
        """The hidden rows of sequences that stand one after another in x, or in its lots; with keep also what gradient()
        needs."""
        lots = x if isinstance(x, list) else [x]
        rows = int(lengths.sum())
        order = np.argsort(-lengths, kind="stable")
        starts, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
        steps = int(sizes[0]) if len(sizes) else 0
        active = [int((sizes > t).sum()) for t in range(steps)] if steps < 64 else (len(sizes) - np.searchsorted(sizes[::-1], np.arange(steps), side="right")).tolist()
        out, kept = np.zeros((rows, 2 * HIDDEN), np.float32), {}
        for k, d in enumerate("fb"):
            given = np.concatenate([lot @ self.w[d + "x"] + self.w[d + "b"] for lot in lots]) if len(lots) > 1 else lots[0] @ self.w[d + "x"] + self.w[d + "b"]
            h, c = np.zeros((len(sizes), HIDDEN), np.float32), np.zeros((len(sizes), HIDDEN), np.float32)
            trace = []
            for t, n in enumerate(active):
                at = starts[:n] + (t if d == "f" else sizes[:n] - 1 - t)
                z = given[at] + h[:n] @ self.w[d + "h"]
                gates, new = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
                i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
                was_h, was_c = h[:n].copy() if keep else None, c[:n].copy() if keep else None
                c[:n] = f * c[:n] + i * new
                tc = np.tanh(c[:n])
                h[:n] = o * tc
                out[at, k * HIDDEN : (k + 1) * HIDDEN] = h[:n]
                if keep:
                    trace.append((at, i, f, o, new, tc, was_h, was_c))
            kept[d] = trace
        return (out, kept, len(sizes)) if keep else out

    def odds(self, x: np.ndarray | list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
        return _sigmoid(self.run(x, lengths) @ self.w["out"] + self.w["bias"])[:, 0]

    def gradient(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        hidden, kept, m = self.run(x, lengths, True)
        error = (_sigmoid(hidden @ self.w["out"] + self.w["bias"])[:, 0] - y)[:, None] / len(y)
        g = {"out": hidden.T @ error, "bias": error.sum(0)}
        back = error @ self.w["out"].T
        for k, d in enumerate("fb"):
            dz_all, gh = np.zeros((len(x), 4 * HIDDEN), np.float32), np.zeros_like(self.w[d + "h"])
            dh, dc = np.zeros((m, HIDDEN), np.float32), np.zeros((m, HIDDEN), np.float32)
            for at, i, f, o, new, tc, was_h, was_c in reversed(kept[d]):
                n = len(at)
                up = dh[:n] + back[at, k * HIDDEN : (k + 1) * HIDDEN]
                cell = dc[:n] + up * o * (1 - tc * tc)
                dz = np.concatenate([cell * new * i * (1 - i), cell * was_c * f * (1 - f), up * tc * o * (1 - o), cell * i * (1 - new * new)], 1)
                dc[:n], dh[:n] = cell * f, dz @ self.w[d + "h"].T
                gh += was_h.T @ dz
                dz_all[at] = dz
            g |= {d + "x": x.T @ dz_all, d + "h": gh, d + "b": dz_all.sum(0)}
        return g


class Maker:
    """Pages by rule, with the label of every block."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.parts = ["".join(p) for p in ((a, b) for a in "bcdfglmnprstvz" for b in ("a", "e", "i", "o", "u", "en", "er", "on", "é", "ü"))]
        self.out: list[str] = []
        self.labels: list[int] = []

    def word(self) -> str:
        return "".join(self.r.choice(self.parts) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def sentences(self, n: int) -> str:
        out = []
        while n > 0:
            k = min(n, self.r.randint(1, 18))
            s = self.words(k)
            out.append(s[0].upper() + s[1:] + self.r.choice((".", ".", ".", ".", "!", "?", "")))
            n -= k
        noise = self.r.random()
        text = " ".join(out)
        return " ".join(w + self.r.choice(("&amp;&amp;", "###", "%%%", "***", "!!")) for w in text.split()) if noise < 0.04 else text.upper() if noise < 0.06 else text

    def add(self, markup: str, label: int | None = None) -> None:
        self.out.append(markup)
        if label is not None:
            self.labels.append(label)

    def box(self, tags: list[str], names: list[str], fill, plain: float = 0.0) -> None:
        tag = self.r.choice(tags)
        name = self.r.choice(names)
        form = self.r.random()
        said = "" if tag not in ("div", "section", "ul", "p", "td") and form < 0.5 or form < plain else f' {self.r.choice(("class", "class", "id"))}="{name}"'
        self.add(f"<{tag}{said}>")
        fill()
        self.add(f"</{tag}>" if self.r.random() < 0.97 or tag in ("nav", "aside", "footer", "header") else "")

    def links(self, low: int = 2, high: int = 10) -> None:
        kind = self.r.randrange(3)
        self.add("<ul>" if kind < 2 else "")
        for _ in range(self.r.randint(low, high)):
            text = self.words(self.r.choice((1, 1, 1, 2, 3, 8)))
            link = f'<a href="/{self.word()}">{text}</a>'
            self.add(f"<li>{link}</li>" if kind < 2 else f"<div>{link}</div>", 0)
        self.add("</ul>" if kind < 2 else "")

    def note(self, phrases: str, tag: str = "p") -> None:
        text = self.r.choice(phrases.split("|")) if self.r.random() < 0.6 else ""
        text = f"{text} {self.sentences(self.r.choice((1, 3, 6, 12, 25)))}" if self.r.random() < 0.8 or not text else text
        self.add(f"<{tag}>{text}</{tag}>" if self.r.random() < 0.5 else f"<div>{text}</div>" if self.r.random() < 0.3 else text, 0)

    def paragraph(self) -> None:
        n = self.r.choice((1, 1, 2, 3, 8, 15, 30, 60, 120)) if self.r.random() < 0.98 else self.r.choice((500, 2000))
        kind = self.r.random()
        text = self.sentences(n) if n < 500 or self.r.random() < 0.5 else f"{self.words(1)} " * n
        if kind < 0.15:
            self.add(f"<p><b>{text}<br>" if self.r.random() < 0.7 else f"<p><b>{text}</b></p>", 1)
        elif kind < 0.25:
            self.add(f"<h{self.r.randint(2, 4)}>{self.sentences(4)}</h3>", 1)
        elif kind < 0.32:
            tag = self.r.choice(("ul", "ol"))
            self.add(f"<{tag}>")
            for _ in range(self.r.randint(2, 6)):
                self.add(f"<li>{self.sentences(self.r.randint(1, 15))}" + self.r.choice(("</li>", "")), 1)
            self.add(f"</{tag}>")
        elif kind < 0.36:
            self.add(f"<blockquote>{text}</blockquote>", 1)
        elif kind < 0.39:
            self.add(f"<pre>{text}</pre>", 1)
        elif kind < 0.42:
            self.add("<table>")
            for _ in range(self.r.randint(1, 3)):
                self.add("<tr>")
                for _ in range(2):
                    self.add(f"<td>{self.sentences(self.r.randint(1, 6))}</td>", 1)
                self.add("</tr>")
            self.add("</table>")
        elif kind < 0.45:
            self.add(f"<figure><img src=x><figcaption>{self.sentences(6)}</figcaption></figure>", 1)
        elif kind < 0.52:
            self.add(f'<p>{text} <a href="/{self.word()}">{self.words(3)}</a> {self.sentences(5)}</p>', 1)
        else:
            self.add(f"<p>{text}" + self.r.choice(("</p>", "</p>", "")), 1)

    def extra(self) -> None:
        """Something that isn't main text."""
        kind = self.r.randrange(9)
        if kind == 0:
            self.box(["div", "aside", "section"], ["ad", "ads", "advert", "banner", "promo", "sponsor", "ad-box", "sponsored", "advertisement"], lambda: self.note("Advertisement|Anzeige|Publicité|Publicidad|Sponsored|Buy now"))
        elif kind == 1:
            self.box(["div", "section", "aside"], ["cookie", "cookie-notice", "consent", "notice", "gdpr", "alert", "popup", "banner"], lambda: self.note("We use cookies.|Wir verwenden Cookies.|Nous utilisons des cookies.|Usamos cookies.|Accept all|Privacy settings"))
        elif kind == 2:
            def comments() -> None:
                self.add(f"<h3>{self.r.choice(('Comments', 'Kommentare', 'Commentaires', 'Comentarios', self.words(2)))}</h3>", 0)
                for _ in range(self.r.randint(1, 5)):
                    tag = self.r.choice(("p", "li", "div", "article"))
                    self.add(f'<{tag} class="{self.r.choice(("comment", "reply", "comment-body", "user"))}">{self.sentences(self.r.choice((2, 8, 20, 50)))}</{tag}>', 0)

            self.box(["div", "section", "ol"], ["comments", "comment-list", "commentlist", "responses", "discussion", "replies"], comments)
        elif kind == 3:
            def side() -> None:
                self.add(f"<h3>{self.words(2)}</h3>", 0)
                self.links() if self.r.random() < 0.6 else self.note("Popular|Beliebt|Populaires|Popular posts")

            self.box(["aside", "div"], ["sidebar", "widget", "side", "rail", "related", "recommended", "popular", "tags", "share", "social"], side)
        elif kind == 4:
            self.add("<form>" if self.r.random() < 0.6 else '<form class="newsletter">')
            for _ in range(self.r.randint(1, 4)):
                tag = self.r.choice(("label", "button", "option", "p", "legend", "div"))
                self.add(f"<{tag}>{self.r.choice(('Email', 'Name', 'Subscribe', 'Search', 'Submit', 'Login', self.words(2), self.sentences(9)))}</{tag}><input>", 0)
            self.add("</form>")
        elif kind == 5:
            self.box(["div", "p", "nav"], ["breadcrumb", "crumbs", "pagination", "pager", "meta", "share", "toolbar"], lambda: self.add(" &gt; ".join(f'<a href="#">{self.word()}</a>' for _ in range(3)), 0))
        elif kind == 6:
            self.box(["div", "section"], ["related", "more", "recommended", "trending", "newsletter", "subscribe", "signup"], lambda: self.links(1, 6) if self.r.random() < 0.5 else self.note("Subscribe to our newsletter.|Read more|Share this|Abonnieren|Suscríbete|Abonnez-vous"))
        elif kind == 7:
            self.box(["nav", "div", "ul"], ["nav", "menu", "navbar", "main-nav", "topnav"], self.links)
        else:
            self.add(self.r.choice((f"<script>var a='<p>{self.word()}</p>';</script>", "<style>p{margin:0}</style>", f"<!-- {self.words(3)} -->", f"<noscript>{self.words(4)}</noscript>")))

    def article(self) -> None:
        if self.r.random() < 0.85:
            self.add(f"<h1>{self.sentences(self.r.randint(1, 12))}</h1>", 1)
        inside = self.r.random() < 0.35
        for _ in range(self.r.choice((1, 2, 3, 5, 8, 12, 20))):
            self.paragraph()
            if inside and self.r.random() < 0.12:
                self.extra()

    def page(self) -> tuple[str, list[int]]:
        self.out, self.labels = [], []
        self.add(f"<!DOCTYPE html><html><head><title>{self.words(4)}</title><style>p{{margin:0}}</style></head><body>")
        top = self.r.random()
        if top < 0.55:
            self.box(["nav", "div"], ["nav", "menu", "navbar", "navigation", "topmenu"], self.links)
        elif top < 0.8:
            self.box(["header", "div"], ["header", "masthead", "top", "site-header", "head"], lambda: (self.note("Welcome|Home|Menu"), self.links()))
        for _ in range(self.r.choice((0, 1, 1, 2))):
            self.extra()
        body = self.r.random()
        if body < 0.05:
            self.add("<table><tr><td>")
            self.links()
            self.add("</td><td>")
            self.article()
            self.add("</td></tr></table>")
        elif body < 0.1:
            self.article()
        else:
            self.box(["article", "article", "main", "div", "section"], ["content", "article", "post", "entry", "main", "story", "article-body", "post-content", "text", "body"], self.article)
        for _ in range(self.r.choice((0, 0, 1, 2, 3))):
            self.extra()
        if self.r.random() < 0.85:
            self.box(["footer", "div"], ["footer", "foot", "bottom", "copyright", "site-footer"], lambda: (self.note("&copy; 2024|Copyright|Impressum|Mentions légales|Aviso legal|&copy; example.com &middot;|All rights reserved"), self.links(1, 4) if self.r.random() < 0.4 else None))
        self.add("</body></html>" if self.r.random() < 0.9 else "")
        return "".join(self.out), self.labels


def made_pages(count: int, seed: int) -> list[tuple[list[Block], list[int]]]:
    maker, out = Maker(seed), []
    while len(out) < count:
        page, labels = maker.page()
        found = blocks(page)
        if found and len(found) == len(labels):  # misnested markup may merge blocks; such a page has no sure labels
            out.append((found, labels))
    return out


@functools.lru_cache(1)
def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = 7) -> Labeller:
    """The labeller, trained by Adam on made pages; the same each time."""
    data, model, r = made_pages(pages, seed), Labeller(seed), np.random.default_rng(seed)
    ready = [(features([b]), np.array(y, np.float32)) for b, y in data]
    first, second, t = {k: np.zeros_like(v) for k, v in model.w.items()}, {k: np.zeros_like(v) for k, v in model.w.items()}, 0
    for _ in range(epochs):
        order = r.permutation(len(ready))
        for i in range(0, len(order), BATCH):
            some = [ready[k] for k in order[i : i + BATCH]]
            g = model.gradient(np.concatenate([x for x, _ in some]), np.array([len(x) for x, _ in some]), np.concatenate([y for _, y in some]))
            t += 1
            for k, v in g.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                model.w[k] -= (RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model


def main_texts(model: Labeller, pages: list[str | None]) -> list[str]:
    found = [blocks(p or "") for p in pages]
    lengths = np.array([len(f) for f in found], np.int64)
    odds = model.odds(list(feature_lots(found)), lengths) if lengths.sum() else np.zeros(0)
    ends = np.cumsum(lengths)
    return ["\n".join(b.text for b, p in zip(f, odds[e - len(f) : e], strict=True) if p >= 0.5) for f, e in zip(found, ends, strict=True)]


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """page_id, url, text of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [t for part in chunks(batch.column(2), 1_000_000) for t in main_texts(shared.value, part.to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema[page_id].dataType.simpleString()
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(body)).mapInArrow(text, f"page_id {kind}, url string, text string")


def op3_block_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
