"""Main text of web pages: a linear-chain CRF labels the leaf blocks of a page content or boilerplate.

A leaf block is a run of text between the tags of block elements. Its features are
its ancestors (tags, words of their class, id and role, and what the innermost of
them that says so holds) and its text: length, share of links, punctuation, place,
and the same of its neighbours. Viterbi decoding labels all blocks of a page at
once; content blocks are joined.

No table has labelled pages, so the CRF is trained on ``SAMPLE`` made ones: page
layouts of many kinds around invented words, each block with its label. They are
the same in every run. Pages are worked on in one pass without a shuffle.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import escape, unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellmark.llm.quality import LineModel, fit, viterbi
from tellmark.llm.ragged import slices
from tellmark.session import table

#: Made pages that the model is trained on, and training pages that a word of a class must stand in to be a feature.
SAMPLE, COMMON = 600, 3
#: Elements whose text isn't read as markup and isn't shown, and elements without an end tag.
RAW = frozenset("script style title textarea iframe xmp noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose tags end a block.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head"
    " header hr html label legend li main menu nav noscript ol optgroup option p pre search section select summary svg table tbody td tfoot th thead tr ul".split()
)
#: Elements that say what they hold.
SECTIONS = frozenset("article aside dialog figure footer form header main menu nav noscript".split())
#: Elements that a start tag of the key closes if they are open within the nearest container.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "body": {"head"},
}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
_MARKUP = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|/(?=[^a-zA-Z\s>])[^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)(?:>|\Z))""", re.S
)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: Words of class and id attributes by what an element holds; a word is a feature, and so is each kind that has it.
NAMES = {
    "article": "article post entry story content main text body articleBody page single hentry prose post-content entry-content article-body story-body main-content",
    "menu": "nav menu navigation navbar topnav main-menu site-nav breadcrumb breadcrumbs pagination pager tabs skip links toolbar",
    "header": "header site-header masthead top banner branding logo topbar page-header",
    "footer": "footer site-footer bottom copyright colophon legal foot page-footer footer-links",
    "sidebar": "sidebar side aside widget widget-area secondary rail column-right related recommended popular trending more teaser teasers box",
    "ad": "ad ads advert advertisement adslot ad-slot ad-banner sponsor sponsored promo promotion banner-ad adsense commercial",
    "notice": "cookie cookies consent gdpr notice cookie-banner cookie-notice alert message overlay modal popup paywall newsletter subscribe signup disclaimer privacy",
    "comments": "comments comment comment-list commentlist disqus discussion replies reply respond user-comments comments-area responses",
    "share": "share social sharing share-buttons social-links follow tags tag-list meta",
    "form": "form search searchform login contact-form search-box signin register",
}
_KINDS = {w: [k for k, names in NAMES.items() if w in _WORD.findall(names)] for names in NAMES.values() for w in _WORD.findall(names)}


class Block(NamedTuple):
    """A leaf block: its text, what it stands in, and how many of its characters are links."""

    text: str
    within: frozenset
    linked: int


@lru_cache(maxsize=1 << 14)
def _marks(tag: str, attributes: str) -> frozenset:
    """The tag, the words of its names with a dot before them, and the kinds of these words with an equals sign."""
    words = {w.lower() for names in _NAMES.findall(attributes) for w in _WORD.findall(" ".join(names))} if "=" in attributes else set()
    return frozenset({tag, *("." + w for w in words), *("=" + k for w in words for k in _KINDS.get(w, ()))})


def leaf_blocks(html: str) -> list[Block]:
    """The blocks of a page in order, without empty ones; character references are decoded, white space is one space each.

    Elements nest as far as blocks need it: an end tag closes the nearest open
    element of its name, paragraphs end at the next block, list items and cells at
    the next one. Comments and what isn't shown are left out. What is no tag is text.
    """
    out: list[Block] = []
    parts: list[str] = []
    linked, link = 0, None  # link: how many elements were open when an a was
    # tag, marks of all up to it, those of the innermost that says what it holds, and what a block in it has
    stack: list[tuple[str, frozenset, frozenset, frozenset]] = []
    none: frozenset = frozenset()

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if link is not None:
                linked += len(text)

    def end() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split()) if parts else ""
        if text:
            out.append(Block(text, stack[-1][3] if stack else none, min(linked, len(text))))
        parts.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal link
        del stack[to:]
        if link is not None and link > to:
            link = None

    at, n = 0, len(html)
    while at < n:
        found = _MARKUP.search(html, at)
        if not found:
            break
        say(html[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if tag == "a":
            link = None if found[1] else len(stack)
        elif tag in RAW and not found[1]:
            over = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
            at = over.start() if over else n
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            end()
            if found[1]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                continue
            if stack and stack[-1][0] == "p":
                close(len(stack) - 1)
            shut, holds = CLOSES.get(tag), _HOLDS.get(tag, {"table"})
            if shut:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in holds:
                        break
                    if stack[k][0] in shut:
                        close(k)
            if tag not in VOID:
                own = _marks(tag, found[3])
                marks, says = (stack[-1][1] | own, stack[-1][2]) if stack else (own, none)
                says = frozenset("^" + m for m in own if m in SECTIONS or m[0] == "=") or says
                stack.append((tag, marks, says, marks | says | {">" + tag}))
    else:
        at = n
    say(html[at:])
    end()
    return out


#: Code points of a block whose share of capitals and digits is a feature.
STARTS = 60


def text_features(blocks: list[Block], owner: np.ndarray) -> np.ndarray:
    """What the text of every block says, and what its neighbours on the page say; owner names the page of a block."""
    n = len(blocks)
    own = np.zeros((n, 13), np.float32)
    for i, b in enumerate(blocks):
        t, size = b.text, len(b.text)
        words = t.count(" ") + 1
        begin = t[:STARTS]
        own[i] = (
            np.log1p(words) / 5, b.linked / size, words < 4, words > 15, t[-1] in ".!?…。:", min(t.count(","), 5) / 5, t[0].isupper(),
            min(sum(map(str.isupper, begin)) / len(begin), 0.5), sum(map(str.isdigit, begin)) / len(begin), "©" in t, any(c in t for c in "|·»›"), ".example" in t or "@" in t or "http" in t, size / words > 12,
        )
    first = np.concatenate([[True], owner[1:] != owner[:-1]]) if n else np.zeros(0, bool)
    last = np.concatenate([first[1:], [True]]) if n else first
    before, after = np.zeros((n, 4), np.float32), np.zeros((n, 4), np.float32)
    some = [0, 1, 2, 4]
    before[1:], after[:-1] = own[:-1, some], own[1:, some]
    before[first], after[last] = 0, 0
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    headed = np.array([">h1" in b.within for b in blocks], np.int64)
    seen = np.cumsum(headed)
    begun = (seen - (seen - headed)[start] > 0) if n else np.zeros(0, bool)
    again = np.zeros(n, bool)
    known: dict[tuple[int, str], int] = {}
    for i, b in enumerate(blocks):
        k = known.setdefault((int(owner[i]), b.text), i)
        if k != i:
            again[k] = again[i] = True
    extra = np.stack([np.ones(n), first, last, begun, again], 1) if n else np.zeros((0, 5))
    return np.concatenate([own, before, after, extra.astype(np.float32)], 1)


@dataclass(frozen=True)
class PageModel:
    """The chain, and the ancestors' marks in the order of its features; marks come before the features of the text."""

    marks: dict[str, int]
    chain: LineModel

    def features(self, blocks: list[Block], owner: np.ndarray) -> np.ndarray:
        text = text_features(blocks, owner)
        out = np.zeros((len(blocks), len(self.marks) + text.shape[1]), np.float32)
        out[:, len(self.marks) :] = text
        rows: dict[frozenset, np.ndarray] = {}
        for i, b in enumerate(blocks):
            at = rows.get(b.within)
            if at is None:
                at = rows[b.within] = np.array([self.marks[m] for m in b.within if m in self.marks], np.int64)
            out[i, at] = 1
        return out

    def content(self, pages: list[list[Block]]) -> list[list[str]]:
        """The texts of the content blocks of every page."""
        blocks = [b for p in pages for b in p]
        owner = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
        states = viterbi(self.chain, self.features(blocks, owner), owner)
        out: list[list[str]] = [[] for _ in pages]
        for i in np.flatnonzero(states == 1):
            out[owner[i]].append(blocks[i].text)
        return out


def train(pages: Iterable[tuple[list[Block], list[bool]]]) -> PageModel:
    """Fit the chain on pages of labelled blocks (true: content). The fit is the same in every run."""
    pages = [(b, y) for b, y in pages if b]
    seen: dict[str, int] = {}
    for blocks, _ in pages:
        for m in sorted({m for b in blocks for m in b.within}):
            seen[m] = seen.get(m, 0) + 1
    marks = {m: k for k, m in enumerate(sorted(m for m, c in seen.items() if c >= COMMON))}
    empty = PageModel(marks, LineModel(np.zeros((0, 2)), np.zeros(2), np.zeros((2, 2))))
    blocks = [b for p, _ in pages for b in p]
    owner = np.repeat(np.arange(len(pages)), [len(p) for p, _ in pages])
    labels = np.array([y for _, ys in pages for y in ys], np.int64)
    return PageModel(marks, fit(empty.features(blocks, owner), owner, labels, rounds=200, penalty=0.1))


# -- made pages ---------------------------------------------------------------

class _Page:
    """Builds one made page; every text that could become a block is noted with its label."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        sounds = self.r.sample("a e i o u ba be bi da de do fa ga ge ha he ka ko la le li ma me mi na ne no pa po ra re ri sa se si ta te ti va ve wa st er en on an é ü ß ñ ç".split(), 24)
        self.sounds, self.labels, self.out = sounds, [], []

    def some(self, *of):
        return self.r.choice(of)

    def word(self) -> str:
        return "".join(self.r.choices(self.sounds, k=self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        joint = self.some(" ", " ", " ", " | ", ", ") if self.r.random() < 0.1 else " "
        return joint.join(self.word() for _ in range(self.r.randint(low, high)))

    def prose(self, low: int = 1, high: int = 5) -> str:
        return " ".join(self.words(1, 20).capitalize() + self.some(".", ".", ".", "!", "?", "") for _ in range(self.r.randint(low, high)))

    def names(self, kind: str) -> str:
        every = NAMES[kind].split()
        if self.r.random() < 0.12:
            return ""
        return f' {self.some("class", "class", "id")}="{" ".join(self.r.sample(every, self.r.randint(1, 2)))}"'

    def say(self, text: str, good: bool) -> str:
        """The text as markup, noted with its label."""
        if text.strip():
            self.labels.append(good)
        return escape(text, quote=False)

    def link(self, text: str, good: bool) -> str:
        return f'<a href="/{self.word()}">{self.say(text, good)}</a>'

    def list_of(self, texts: list[str], links: bool, good: bool) -> str:
        shut = self.some("</li>", "</li>", "")
        of = self.some("ul", "ul", "ol")
        items = "".join(f"<li>{self.link(t, good) if links else self.say(t, good)}{shut}" for t in texts)
        return f"<{of}>{items}</{of}>"

    def around(self, kind: str, tags: tuple[str, ...], inner) -> str:
        tag = self.some(*tags)
        names = self.names(kind) or (f' class="{NAMES[kind].split()[0]}"' if tag in ("div", "section", "td") else "")
        return f"<{tag}{names}>{inner()}</{tag}>"

    # boilerplate
    def menu(self) -> str:
        texts = [self.words(1, 3) + self.some("", "", ".", ",") for _ in range(self.r.randint(2, 9))]
        row = lambda: self.some(" ", "").join(f"<div>{self.link(t, False)}</div>" for t in texts)
        return self.around("menu", ("nav", "nav", "div", "ul"), self.some(lambda: self.list_of(texts, True, False), row))

    def header(self) -> str:
        def inner() -> str:
            name = f"<div>{self.link(self.words(1, 3), False)}</div>"
            line = f"<p>{self.say(self.prose(1, 1), False)}</p>" if self.r.random() < 0.25 else ""
            return name + line + (self.menu() if self.r.random() < 0.5 else "")

        return self.around("header", ("header", "header", "div"), inner)

    def footer(self) -> str:
        def inner() -> str:
            line = f"{self.some('© ', '© ', '')}{self.word()}{self.some('.example.org', '', '.example.com')} {self.some('· ', '', '| ', '2024 ')}{self.prose(1, 3)}"
            return self.some(lambda: self.say(line, False), lambda: f"<p>{self.say(line, False)}</p>" + self.list_of([self.words(1, 3) for _ in range(3)], True, False))()

        return self.around("footer", ("footer", "footer", "div"), inner)

    def sidebar(self) -> str:
        def inner() -> str:
            out = f"<{(h := self.some('h2', 'h3', 'h4'))}>{self.say(self.words(1, 4), False)}</{h}>"
            texts = [self.words(3, 9) for _ in range(self.r.randint(2, 6))]
            return out + self.some(lambda: self.list_of(texts, True, False), lambda: "".join(f"<p>{self.say(self.prose(1, 2), False)}</p>" for _ in texts[:3]))()

        return self.around("sidebar", ("aside", "aside", "div", "section"), inner)

    def plain(self, kind: str) -> str:
        def inner() -> str:
            text = self.prose(1, 3)
            return self.some(lambda: self.say(text, False), lambda: f"<p>{self.say(text, False)}</p>", lambda: f"<p>{self.say(text, False)}</p><p>{self.link(self.words(1, 3), False)}</p>")()

        return self.around(kind, ("div", "div", "section", "aside"), inner)

    def noscript(self) -> str:
        return f"<noscript>{self.say(self.prose(1, 1), False)}</noscript>"

    def form(self) -> str:
        def inner() -> str:
            note = f"<p>{self.say(self.prose(1, 2), False)}</p>" if self.r.random() < 0.5 else ""
            fields = "".join(f"<label>{self.say(self.words(1, 3), False)}</label><input name=x>" for _ in range(self.r.randint(1, 3)))
            pick = "<select>" + "".join(f"<option>{self.say(self.word(), False)}" for _ in range(3)) + "</select>" if self.r.random() < 0.3 else ""
            return note + fields + pick + f"<button>{self.say(self.words(1, 2), False)}</button>"

        return f"<form{self.names('form')}>{inner()}</form>"

    def comments(self) -> str:
        def one() -> str:
            who = f"<{(t := self.some('div', 'span', 'h4', 'p'))}>{self.say(self.words(1, 2), False) if t != 'span' else ''}</{t}>"
            return who + "".join(f"<p>{self.say(self.prose(1, 4), False)}</p>" for _ in range(self.r.randint(1, 2)))

        def inner() -> str:
            head = f"<h3>{self.say(self.words(1, 3), False)}</h3>" if self.r.random() < 0.7 else ""
            item = self.some("li", "div", "article")
            names = self.some("", ' class="comment"', ' class="comment-body"') if item != "div" else ' class="comment"'
            body = "".join(f"<{item}{names}>{one()}</{item}>" for _ in range(self.r.randint(1, 5)))
            return head + (f"<ol>{body}</ol>" if item == "li" else body)

        return self.around("comments", ("section", "div", "div", "aside"), inner)

    # content
    def paragraph(self) -> str:
        kind = self.r.random()
        text = self.words(1, 3).capitalize() + "." if kind < 0.15 else self.prose(1, 9)
        mark = self.some("", "", "<b>", "<em>", "<span>")
        shut = {"<em>": "</em>", "<span>": "</span>", "<b>": self.some("", "</b>")}.get(mark, "")
        inner = self.say(text, True)
        if self.r.random() < 0.2:
            inner += f' <a href="/{self.word()}">{escape(self.words(1, 4))}</a>'
        return f"<p>{mark}{inner}{shut}{self.some('', '', '<br>')}{self.some('</p>', '</p>', '</p>', '')}"

    def piece(self) -> str:
        pick = self.r.random()
        if pick < 0.72:
            return self.paragraph()
        if pick < 0.8:
            return f"<{(h := self.some('h2', 'h3'))}>{self.say(self.words(1, 8), True)}</{h}>"
        if pick < 0.88:
            return self.list_of([self.prose(1, 2) if self.r.random() < 0.6 else self.words(1, 6) for _ in range(self.r.randint(2, 5))], False, True)
        if pick < 0.92:
            return f"<blockquote>{self.say(self.prose(1, 3), True)}</blockquote>"
        if pick < 0.95:
            return f"<pre>{self.say(self.words(5, 30), True)}</pre>"
        if pick < 0.98:
            return f"<figure><img src=x><figcaption>{self.say(self.prose(1, 1), True)}</figcaption></figure>"
        row = lambda: "<tr>" + "".join(f"<td>{self.say(self.words(1, 3), True)}</td>" for _ in range(3)) + "</tr>"
        return f"<table>{row()}{row()}</table>"

    def article(self) -> str:
        h = "h1" if self.r.random() < 0.95 else "h2"
        title = f"<{h}>{self.say(self.words(2, 14).capitalize() + self.some('', '', '.'), True)}</{h}>"
        out = [self.some(title, title, f"<header>{title}</header>")]
        inside = [lambda: self.plain("ad"), lambda: self.plain("share"), self.sidebar, lambda: self.plain("notice"), self.form]
        for _ in range(self.r.randint(1, 3) if self.r.random() < 0.3 else self.r.randint(3, 16)):
            out.append(self.piece())
            if self.r.random() < 0.12:
                out.append("</p>" + self.some(*inside)())
        if self.r.random() < 0.15:
            out.append(self.comments())
        body, kind = "".join(out), self.r.random()
        if kind < 0.5:
            return f"<article{self.some('', self.names('article'))}>{body}</article>"
        if kind < 0.6:
            return f"<main>{body}</main>"
        if kind < 0.7:
            return f"<main><article>{body}</article></main>"
        names = self.names("article") or ' class="content"'
        return f"<{(t := self.some('div', 'div', 'section'))}{names}>{body}</{t}>"

    def page(self) -> str:
        top = [self.menu, self.header, lambda: self.plain("ad"), lambda: self.plain("notice"), self.noscript, self.form]
        end = [self.sidebar, self.comments, self.footer, lambda: self.plain("ad"), lambda: self.plain("notice"), self.form, self.menu, lambda: self.plain("share")]
        parts = [f() for f in self.r.sample(top, self.r.randint(0, 4))]
        if self.r.random() < 0.97:
            parts.append(self.article())
        parts += [f() for f in self.r.sample(end, self.r.randint(0, 4))]
        if self.r.random() < 0.6:
            parts.append(self.footer())
        inner = "".join(f"{p}{self.some('', chr(10), '<!-- x -->')}" for p in parts)
        if self.r.random() < 0.3:
            inner = f'<div class="{self.some("wrapper", "container", "page", "site")}">{inner}</div>'
        return f"<!DOCTYPE html><html><head><title>{escape(self.words(2, 6))}</title><script>var t='</p>';</script></head><body>{inner}</body></html>"


def made_pages(n: int, first: int = 0) -> list[tuple[str, list[bool]]]:
    """n made pages as markup, each with the label of every leaf block; ``first`` is the seed of the first."""
    pages = [_Page(first + k) for k in range(n)]
    return [(p.page(), p.labels) for p in pages]


@lru_cache(maxsize=1)
def made_model() -> PageModel:
    """The model of ``SAMPLE`` made pages."""
    return train((leaf_blocks(html), labels) for html, labels in made_pages(SAMPLE))


# -- the operator -------------------------------------------------------------


def _extracted(model: PageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                pages = [leaf_blocks(h) if h else [] for h in part.column("html").to_pylist()]
                texts = ["\n".join(t) for t in model.content(pages)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"]
                )

    return run


def extract(pages: DataFrame, model: PageModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text and n_chars (code points).

    ``text`` holds the content blocks in page order, joined by line feeds. Null and
    empty pages, and pages without content, have an empty text. Broken markup is
    read as far as it goes, to the page's end. Repeated rows give equal rows; other
    columns are not carried. Empty in, empty out.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    found = slim.mapInArrow(_extracted(model or made_model()), f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return found.toDF(id_col, url_col, "text", "n_chars")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


#: The layout of the tables' pages in SQL: all of the article's headings and paragraphs, as far as the page goes.
ORACLES = {
    "op11_html_extraction": r"""
WITH a AS (SELECT page_id, url, regexp_extract(regexp_replace(coalesce(html, ''), '<!--.*?(-->|$)', '', 'gs'), '<article>(.*)', 1, 's') AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_extract(x, '^(.*?)(</article>|<footer>|$)', 1, 's'), '<[a-zA-Z/][^>]*$', '') AS x FROM a),
c AS (SELECT page_id, url, list_transform(regexp_split_to_array(x, '</?(h1|p)>'),
        lambda p: regexp_replace(regexp_replace(replace(p, '<br>', ' '), '<[a-zA-Z/][^>]*>', '', 'g'), '&quot(;|$)', '"', 'g')) AS ps FROM b),
d AS (SELECT page_id, url, list_transform(ps, lambda p:
        trim(regexp_replace(regexp_replace(p, '&amp(;|$)', '&', 'g'), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS ps FROM c),
t AS (SELECT page_id, url, array_to_string(list_filter(ps, lambda p: p <> ''), chr(10)) AS text FROM d)
SELECT page_id, url, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM t"""
}
QUERIES = {"op11_html_extraction": op11_html_extraction}
