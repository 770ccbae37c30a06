"""Main-text extraction from HTML: a linear-chain conditional random field over DOM leaf blocks.

A page is read once into leaf blocks: runs of text that no block-level tag interrupts, each with
its block's tag, its ancestors (tags, and hints in their class, id and role), the share of its
characters inside links, and its form.  A two-label chain CRF scores them and Viterbi decodes the
whole page.  The model is trained by gradient ascent on labelled pages: given ones, or by default
pages that this module writes from varied templates, whose blocks it knows to be main text or not.

A null page is an empty one; a page without blocks, or without main text, gives the empty text.
Markup is never text, however malformed: see `_tokens`.  Text in `noscript`, `object` and `math`
stands where it is and is judged as any other.  Nothing is capped; a null page_id or url passes through; repeated rows give equal rows; an empty
table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandweave.llm.common import read_table

#: HTML's own kinds of tags.  Fixed values.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input "
    # Formulas stand inside their sentence.
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover "
    "mmultiscripts mprescripts none mtable mtr mlabeledtr mtd maction semantics annotation annotation-xml".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't read.  Only scripts and styles without an end tag reach to the page's end.
RAW = ("script", "style", "textarea", "title", "template", "iframe", "svg", "select", "noframes", "xmp")
TO_END = frozenset(("script", "style"))
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSED_BY_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
#: What ends a tag, or opens a quoted value in it: a quote counts only after an equals sign.
STOP = re.compile(r">|=\s*[\"']")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
HINT = re.compile(r"""(?<![\w:.-])(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

#: What an ancestor's tag or hint says: one bit each.
TAGS = {t: i for i, t in enumerate("article main nav header footer aside form figure ul ol table blockquote section div body dialog address menu".split())}
HINTS = {
    "main": r"article|content|post(?!ed)|entry|story|\bbody|text|main|prose|blog(?!roll)",
    "advert": r"\bads?\b|\bad[-_]|[-_]ads?\b|advert|sponsor|promo|banner|commercial|outbrain|taboola",
    "comment": r"comment|repl(?:y|ies)|disqus|respond|discussion|feedback|reactions?\b|\breviews?\b",
    "menu": r"\bnav|navbar|menu|breadcrumb|crumbs|pagination|pager|\btabs?\b|toolbar|skip|toc\b",
    "side": r"sidebar|\bside\b|widget|related|recommend|popular|trending|more[-_]|share|social|follow|tags?\b|author[-_]?bio|rail\b",
    "notice": r"cookie|consent|notice|alert|gdpr|newsletter|subscri|popup|modal|overlay|paywall|signup|login|privacy|disclaimer",
    "foot": r"foot|copyright|legal|colophon|credits?\b",
    "head": r"head(?!line|ing)|masthead|\btop\b|logo|brand|hero",
    "meta": r"byline|meta\b|date|time(?!line)|author\b|posted|caption",
}
HINT_RES = [re.compile(p, re.I) for p in HINTS.values()]
N_TAGS, N_HINTS = len(TAGS), len(HINTS)
OWN = ("p", "h1", "h2", "h3", "li", "td", "pre", "blockquote", "div", "figcaption", "dd", "button", "footer", "body", "article", "other")
N_FORM = 17
N_FEATURES = 1 + N_TAGS + N_HINTS + len(OWN) + N_FORM + 2


#: Longer attributes are looked through each time and never kept, so that the cache is bounded in bytes.
KEPT_CHARACTERS = 512


def _mask(tag: str, attributes: str) -> int:
    return _seen_mask(tag, attributes) if len(attributes) <= KEPT_CHARACTERS else _hints(tag, attributes)


def _hints(tag: str, attributes: str) -> int:
    """Bits of a tag, and of what its class, id, role and itemprop hint at."""
    mask = 1 << TAGS[tag] if tag in TAGS else 0
    if attributes and "=" in attributes:
        for found in HINT.finditer(attributes):
            hint = found[1] or found[2] or found[3] or ""
            for i, pattern in enumerate(HINT_RES):
                if pattern.search(hint):
                    mask |= 1 << (N_TAGS + i)
    return mask


_seen_mask = lru_cache(maxsize=20_000)(_hints)


def _form(text: str, linked: int) -> int:
    """Bits of what the text looks like."""
    n = len(text)
    words = text.count(" ") + 1
    share = linked / n
    bits = 1 << (0 if words <= 2 else 1 if words <= 5 else 2 if words <= 12 else 3 if words <= 30 else 4)
    bits |= 1 << (5 if not linked else 6 if share < 0.3 else 7 if share < 0.8 else 8)
    bits |= (text[-1] in ".!?…”\"»") << 9 | ("©" in text) << 10 | text[0].isupper() << 11 | ("|" in text or "·" in text) << 12
    bits |= (n > 200) << 13 | (text.count(",") > 1) << 14 | (sum(map(text.count, "0123456789")) > 0.2 * n) << 15 | (text[0] in "#@") << 16
    return bits


Tag = tuple[bool, str, str]


def _tokens(page: str) -> Iterator[str | Tag]:
    """The page's text runs, and its tags as (closes, name, attributes), without the elements of RAW and what they hold.

    A tag ends at its first `>` outside quoted values; one whose quotes never close ends at its
    first `>`; what stands after a `<` of a tag without any `>` is dropped.  Time is linear in the page.
    """
    at, size = 0, len(page)
    last_end, last_quote = page.rfind(">"), {q: page.rfind(q) for q in "\"'"}
    unended: set[str] = set()
    hopeless: set[int] = set()  # places behind a closed quote from which no tag's end is reached
    while at < size:
        open_ = page.find("<", at)
        if open_ < 0:
            yield page[at:]
            return
        if open_ > at:
            yield page[at:open_]
        after = page[open_ + 1 : open_ + 2]
        if after in ("!", "?"):
            if page.startswith("<!--", open_):
                end = page.find("-->", open_ + 2)  # `<!-->` is a whole comment
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", open_)
                at = size if end < 0 else end + 1
            continue
        name = NAME.match(page, open_ + 1)
        if name is None:
            yield "<"
            at = open_ + 1
            continue
        if name.end() > last_end:
            return
        place, passed = name.end(), []
        while True:
            stop = STOP.search(page, place) if place <= last_end else None
            if stop is None:
                end = 0
            elif stop[0] == ">":
                end = stop.end()
            else:
                quote = page[stop.end() - 1]
                place = page.find(quote, stop.end()) + 1 if stop.end() <= last_quote[quote] else 0
                if place and place not in hopeless:
                    passed.append(place)
                    continue
                end = 0
            break
        if not end:
            hopeless.update(passed)
            end = page.find(">", name.end()) + 1
        at, attributes = end, page[name.end() : end - 1]
        closes = name[0][0] == "/"
        tag = name[0][closes:].lower()
        if closes or tag not in RAW:
            yield closes, tag, attributes
        elif not (tag == "svg" and attributes.endswith("/")):
            found = None if tag in unended else RAW_END[tag].search(page, end)
            if found:
                at = (page.find(">", found.end()) + 1) or size
            elif tag in TO_END:
                return
            else:
                unended.add(tag)  # no later one of this tag has an end either


class _Stack:
    """Open elements (tag, ancestors' mask), and where each tag is open."""

    def __init__(self):
        self.open: list[tuple[str, int]] = [("", 0)]
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, mask: int) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, self.open[-1][1] | mask))

    def deepest(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, depth: int) -> None:
        while len(self.open) > depth:
            self.places[self.open.pop()[0]].pop()


def blocks(page: str | None) -> list[tuple[str, int, int, int]]:
    """(text, ancestors' mask, own tag's number, form) of the leaf blocks in page order."""
    out: list[tuple[str, int, int, int]] = []
    stack = _Stack()
    parts: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                tag, mask = stack.open[-1]
                out.append((text, mask, OWN.index(tag) if tag in OWN else len(OWN) - 1, _form(text, min(linked, len(text)))))
            parts.clear()
        linked = 0

    for token in _tokens(page or ""):
        if isinstance(token, str):
            if "&" in token:
                token = entities.unescape(token)
            parts.append(token)
            if in_link:
                linked += len(token)
            continue
        closes, tag, attributes = token
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closes else 1
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        if closes:
            if depth := stack.deepest((tag,)):
                stack.cut(depth)
            in_link = 0
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P and stack.open[-1][0] == "p":
            stack.cut(len(stack.open) - 1)
        if tag in CLOSED_BY_SAME and (depth := stack.deepest(CLOSED_BY_SAME[tag])) and depth >= stack.deepest(FENCES[tag]):
            stack.cut(depth)
        if not attributes.endswith("/") or tag in TAGS or tag in OWN:
            stack.push(tag, _mask(tag, attributes.strip()))
    flush()
    return out


def vector(mask: int, own: int, form: int) -> np.ndarray:
    """The block's features as 0/1."""
    x = np.zeros(N_FEATURES)
    x[0] = 1
    for i in range(N_TAGS + N_HINTS):
        x[1 + i] = mask >> i & 1
    at = 1 + N_TAGS + N_HINTS
    x[at + own] = 1
    for i in range(N_FORM):
        x[at + len(OWN) + i] = form >> i & 1
    bad = sum(mask >> (N_TAGS + i) & 1 for i, k in enumerate(HINTS) if k not in ("main", "meta", "head"))
    inside = mask >> TAGS["article"] & 1 or mask >> TAGS["main"] & 1
    x[-2], x[-1] = bool(inside) and not bad, bool(bad)
    return x


class ChainCRF:
    """Two labels (0 other, 1 main): emissions linear in the features, transitions, first and last weights."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.weights, self.moves, self.first, self.last = weights, moves, first, last
        self.known: dict[tuple[int, int, int], tuple[float, float]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.known = {}

    def emission(self, key: tuple[int, int, int]) -> tuple[float, float]:
        if (found := self.known.get(key)) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            e = vector(*key) @ self.weights
            found = self.known[key] = (float(e[0]), float(e[1]))
        return found

    def decode(self, keys: list[tuple[int, int, int]]) -> list[int]:
        """The most probable labels (Viterbi)."""
        if not keys:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        e = self.emission(keys[0])
        s0, s1 = self.first[0] + e[0], self.first[1] + e[1]
        back: list[tuple[int, int]] = []
        for key in keys[1:]:
            e = self.emission(key)
            a0, a1, b0, b1 = s0 + m00, s1 + m10, s0 + m01, s1 + m11
            back.append((int(a1 > a0), int(b1 > b0)))
            s0, s1 = (a1 if a1 > a0 else a0) + e[0], (b1 if b1 > b0 else b0) + e[1]
        label = int(s1 + self.last[1] > s0 + self.last[0])
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]

    def extract(self, page: str | None) -> str:
        found = blocks(page)
        labels = self.decode([b[1:] for b in found])
        return "\n".join(b[0] for b, label in zip(found, labels) if label)


def train(pages: list[tuple[list[tuple[int, int, int]], list[int]]], steps: int = 120, rate: float = 0.15, l2: float = 1e-4) -> ChainCRF:
    """Maximises the labels' log likelihood by Adam; forward-backward runs over all pages side by side."""
    pages = [p for p in pages if p[0]]
    b, t = len(pages), max(len(p[0]) for p in pages)
    x, y, on = np.zeros((b, t, N_FEATURES)), np.zeros((b, t), np.int64), np.zeros((b, t), bool)
    for i, (keys, labels) in enumerate(pages):
        x[i, : len(keys)] = [vector(*k) for k in keys]
        y[i, : len(keys)], on[i, : len(keys)] = labels, True
    lengths = on.sum(axis=1)
    row, ends = np.arange(b), lengths - 1
    params = [np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2), np.zeros(2)]
    first_moment, second_moment = ([np.zeros_like(p) for p in params] for _ in range(2))
    truth = np.eye(2)[y] * on[..., None]
    logsum = lambda v, axis: (m := v.max(axis=axis)) + np.log(np.exp(v - np.expand_dims(m, axis)).sum(axis=axis))
    for step in range(1, steps + 1):
        w, moves, start, stop = params
        e = x @ w
        forward, backward = np.zeros((b, t, 2)), np.zeros((b, t, 2))
        forward[:, 0] = start + e[:, 0]
        for k in range(1, t):
            forward[:, k] = e[:, k] + logsum(forward[:, k - 1][:, :, None] + moves, 1)
        for k in range(t - 1, -1, -1):
            after = logsum(moves[None] + (e[:, k + 1] + backward[:, k + 1])[:, None, :], 2) if k + 1 < t else 0.0
            backward[:, k] = np.where((ends == k)[:, None], stop, after)
        z = logsum(forward[row, ends] + stop, 1)
        single = np.exp(np.minimum(forward + backward - z[:, None, None], 0)) * on[..., None]
        pair = forward[:, :-1, :, None] + moves + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]
        pair = np.exp(np.minimum(pair, 0)) * on[:, 1:, None, None]
        real = np.einsum("bti,btj->ij", truth[:, :-1], truth[:, 1:])
        grads = [
            np.einsum("btf,btc->fc", x, truth - single) / b - l2 * w,
            (real - pair.sum(axis=(0, 1))) / b,
            (truth[:, 0] - single[:, 0]).sum(axis=0) / b,
            (truth[row, ends] - single[row, ends]).sum(axis=0) / b,
        ]
        for p, g, m1, m2 in zip(params, grads, first_moment, second_moment):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return ChainCRF(*params)


class PageWriter:
    """Writes pages from varied templates, with each block's label."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, *options):
        return options[int(self.rng.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, low: int, high: int) -> str:
        made = []
        for _ in range(int(self.rng.integers(low, high + 1))):
            made.append("".join(self.pick("ka", "to", "ri", "men", "lo", "su", "ver", "an", "de", "o", "is") for _ in range(int(self.rng.integers(1, 5)))))
        text = " ".join(w + ("," if self.chance(0.06) else "") for w in made)
        return text[0].upper() + text[1:]

    def sentence(self, low: int = 6, high: int = 22) -> str:
        return self.words(low, high).rstrip(",") + self.pick(".", ".", ".", "!", "?")

    def paragraph(self) -> str:
        text = " ".join(self.sentence() for _ in range(int(self.pick(1, 1, 2, 3, 5))))
        if self.chance(0.1):
            text = self.words(1, 2).rstrip(",") + "."
        if self.chance(0.2):
            text += f' <a href="/x">{self.words(1, 3)}</a> ' + self.sentence()
        return text

    def links(self, low: int = 3, high: int = 8) -> str:
        shape = self.pick("ul", "div", "p")
        items = [f'<a href="/{i}">{self.words(1, 4)}</a>' for i in range(int(self.rng.integers(low, high)))]
        if shape == "ul":
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return f"<{shape}>" + self.pick(" ", " | ", " &middot; ").join(items) + f"</{shape}>"

    def body(self) -> list[str]:
        """HTML of main blocks, in order."""
        out = [f"<h1>{self.words(3, 10)}</h1>"] if self.chance(0.85) else []
        for _ in range(int(self.rng.integers(1, 9))):
            kind = self.rng.random()
            text = self.paragraph()
            if kind < 0.75:
                out.append(f"<p>{text}</p>" if self.chance(0.8) else f"<p><b>{text}<br>")
            elif kind < 0.82:
                out.append(f"<{(h := self.pick('h2', 'h3'))}>{self.words(2, 7)}</{h}>")
            elif kind < 0.9:
                out.append("<ul>" + "".join(f"<li>{self.sentence(3, 14)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.95:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            else:
                out.append(f"<table><tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr></table>")
        return out

    def noise(self, kind: str) -> str:
        """HTML of blocks that aren't main text."""
        text = lambda: f"<p>{self.paragraph()}</p>" if self.chance(0.7) else self.paragraph()
        if kind == "advert":
            return f'<div class="{self.pick("ad", "ads", "advert", "sponsored", "promo-box", "ad-slot", "banner")}">{text()}</div>'
        if kind == "comments":
            name = self.pick('class="comments"', 'id="comments"', 'class="comment-list"', 'id="disqus_thread"', 'class="replies"', 'class="reader-comments"')
            one = self.pick("div", "li", "article")
            inner = "".join(f'<{one} class="comment"><p>{self.paragraph()}</p></{one}>' for _ in range(int(self.rng.integers(1, 4))))
            return f"<{(t := self.pick('section', 'div'))} {name}><h3>{self.words(1, 3)}</h3>{inner}</{t}>"
        if kind == "aside":
            return f"<aside{self.pick('', ' class=sidebar', ' class=related')}>{self.pick(text(), self.links(), f'<h3>{self.words(1, 3)}</h3>' + self.links())}</aside>"
        if kind == "side":
            return f'<div class="{self.pick("sidebar", "widget", "related-posts", "share", "social", "recommended", "popular")}">{self.pick(text(), self.links())}</div>'
        if kind == "form":
            return f"<form>{self.pick('', '<p>' + self.sentence() + '</p>')}<label>{self.words(1, 2)}</label><input name=q><button>{self.words(1, 2)}</button></form>"
        if kind == "notice":
            return f'<div class="{self.pick("cookie-banner", "notice", "cookie-consent", "newsletter", "alert", "gdpr", "subscribe-box", "popup")}">{text()}</div>'
        if kind == "nav":
            return f"<nav>{self.links()}</nav>" if self.chance(0.7) else f'<div class="{self.pick("menu", "navbar", "breadcrumbs", "nav")}">{self.links()}</div>'
        if kind == "header":
            return f"<header>{self.pick('', f'<h1>{self.words(1, 4)}</h1>', f'<p>{self.sentence()}</p>', self.words(1, 4))}{self.links(2, 5)}</header>"
        foot = f"&copy; {self.words(1, 3)} &middot; {self.sentence(3, 10)}"
        return self.pick(f"<footer>{foot}</footer>", f"<footer><p>{self.sentence()}</p>{self.links(2, 5)}</footer>", f'<div id="footer">{foot}</div>')

    def page(self) -> tuple[str, list[tuple[str, bool]]]:
        """The page as pieces: (html, their blocks are main text)."""
        pieces: list[tuple[str, bool]] = [("<html><head><title>t</title><style>p{}</style></head><body>", False)]
        add = lambda kind, p: pieces.append((self.noise(kind), False)) if self.chance(p) else None
        for kind, p in (("notice", 0.25), ("header", 0.4), ("nav", 0.7), ("advert", 0.4), ("side", 0.15)):
            add(kind, p)
        open_, close = self.pick(
            ("<article>", "</article>"), ("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"),
            ('<div class="content">', "</div>"), ('<div id="main-content">', "</div>"), ('<div class="post-body">', "</div>"),
            ('<section class="entry-content">', "</section>"), ("<div>", "</div>"), ('<div class="story">', "</div>"),
        )
        pieces.append((open_, False))
        body = self.body()
        for i, block in enumerate(body):
            pieces.append((block, True))
            if i and self.chance(0.12):
                pieces.append((self.noise(self.pick("advert", "aside", "side", "notice", "form")), False))
        add("comments", 0.12)
        pieces.append((close, False))
        for kind, p in (("comments", 0.35), ("aside", 0.35), ("side", 0.3), ("form", 0.2), ("advert", 0.2), ("nav", 0.15), ("footer", 0.85)):
            add(kind, p)
        pieces.append(("</body></html>", False))
        return "".join(p[0] for p in pieces), pieces


MARK = ("⁅", "⁆")


def labelled_page(writer: PageWriter) -> tuple[list[tuple[int, int, int]], list[int], str, str]:
    """(block keys, labels, page, main text) of a written page; main blocks are told by marks around them."""
    page, pieces = writer.page()
    text = re.compile(r">([^<]*[^<\s][^<]*)<")
    marked = "".join(text.sub(lambda m: f">{MARK[0]}{m[1]}<", html) if main else html for html, main in pieces)
    labels = [int(MARK[0] in b[0]) for b in blocks(marked)]
    found = blocks(page)
    return [b[1:] for b in found], labels, page, "\n".join(b[0] for b, label in zip(found, labels) if label)


TRAIN_PAGES = 250
_MODELS: dict[int, ChainCRF] = {}


def default_model(pages: int = TRAIN_PAGES, seed: int = 11) -> ChainCRF:
    if pages not in _MODELS:
        writer = PageWriter(seed)
        _MODELS[pages] = train([labelled_page(writer)[:2] for _ in range(pages)])
    return _MODELS[pages]


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, model: ChainCRF | None = None) -> DataFrame:
    """EXTRACTED for columns page_id, url, html."""
    crf = model or default_model()

    def main(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [crf.extract(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(main, EXTRACTED)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the main text of all `pages`."""
    return extract(read_table(spark, sf_dir, "pages"))
