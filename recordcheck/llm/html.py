"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks at block-level tags. Each block is described by its word count and link density, by those of
the blocks before and after it, and by the marks (tag names, class, id and role words) of the elements around it. A decision
tree, trained on a small table of labelled blocks, tells main text from the rest.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordcheck.llm.common import table

#: Comments, declarations, elements whose content is no markup (one that isn't closed ends with the page), and tags. Of such
#: elements only <xmp> holds text to read, as it stands.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:xmp)\b[^>]*>(?P<raw>.*?)(?:</xmp\s*>|\Z)|<(?P<dead>script|style|iframe|textarea|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>.*?(?:</(?P=dead)\s*>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<more>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Elements whose content is left out where it stands, up to their end or that of an element around them.
SKIPPED = frozenset("button select datalist svg canvas video audio object template annotation annotation-xml".split())
INLINE = frozenset("math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle mpadded mspace mtable mtr mtd semantics a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
REST_TAGS = frozenset("nav header footer aside form fieldset menu dialog noscript".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Words of class, id and role names. A name's last word says what an element is, words of place and form left aside.
REST_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs crumbs "
    "sidebar side widget widgets footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations teaser teasers comment comments reply replies respond disqus discussion pagination "
    "pager copyright legal disclaimer search form hidden skip tags taglist outbrain taboola complementary contentinfo navigation".split()
)
MAIN_WORDS = frozenset("article main content post entry story text body articlebody maincontent".split())
FORM_WORDS = frozenset(
    "list lists bar bars box boxes wrap wrapper inner outer container area slot slots item items block blocks section sections button buttons link links panel left right "
    "top bottom thread row col column grid group holder module unit region zone frame tab tabs primary secondary".split()
)
FEATURES = (
    "words", "words_before", "words_after", "links", "links_before", "links_after", "mark", "under_rest", "under_weak_rest", "under_main", "page_has_main", "heading", "paragraph", "item", "ends_sentence",
    "copyright", "capitalized", "around_share", "wider_share",
)


def name_mark(name: str) -> int:
    """What one class, id or role name says: -2 and 2 if its last telling word is one of rest or main text, -1 and 1 if an earlier one is."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
    while len(words) > 1 and words[-1] in FORM_WORDS:
        words.pop()
    for at, w in enumerate(reversed(words)):
        if w in REST_WORDS or w in MAIN_WORDS:
            return (1 if at else 2) * (1 if w in MAIN_WORDS else -1)
    return 0


def marks(tag: str, attributes: str) -> int:
    """From -2 for an element that holds something else than main text to 2 for one that holds main text. Names that say the
    opposite outweigh each other."""
    if tag in ("html", "body"):
        return 0
    said = 0
    for name, *values in NAMED.findall(attributes) if attributes else ():
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role"):
            said += sum(map(name_mark, set(value.split())))
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower())):
            return -2
    if tag in MAIN_TAGS:
        return 2
    return -2 if tag in REST_TAGS else max(-2, min(2, said))


class Around(NamedTuple):
    """What the open block elements around a block say together; one object for each open element, shared by its blocks."""

    tag: str = ""
    inner: int = 0  # the mark of the innermost element that has one
    rest: bool = False
    weak: bool = False
    main: bool = False
    item: bool = False
    skipped: bool = False
    span: list[int] = [0, 0]  # words without links on the page at the element's begin and end
    outer: list[int] = [0, 0]  # the same of the elements around it
    wider: list[int] = [0, 0]

    def inside(self, tag: str, mark: int, words: int) -> Around:
        return Around(
            tag, mark or self.inner, self.rest or mark == -2, self.weak or mark == -1, self.main or mark > 0, self.item or tag == "li", self.skipped or tag in SKIPPED, [words, words], self.span, self.outer,
        )


def blocks(page: str | None) -> list[tuple[str, int, int, Around]]:
    """(text, words, linked words, what stands around it) of each flat block with text, in page order.

    An end tag closes its element and those within that are still open; one without an open element is passed over.
    """
    page = page or ""
    out: list[tuple[str, int, int, Around]] = []
    stack: list[Around] = [Around(span=[0, 0], outer=[0, 0], wider=[0, 0])]
    plain = 0
    open_: Counter[str] = Counter()
    pieces: list[tuple[str, bool]] = []
    linked, at = False, 0

    def flush() -> None:
        nonlocal plain
        if pieces:
            text = " ".join(html.unescape("".join(p for p, _ in pieces)).split())
            if text:
                inside = sum(len(html.unescape(p).split()) for p, link in pieces if link)
                words = text.count(" ") + 1
                out.append((text, words, min(inside, words), stack[-1]))
                plain += words - min(inside, words)
            pieces.clear()

    def close(tag: str) -> None:
        while open_[tag] and len(stack) > 1:
            gone = stack.pop()
            gone.span[1] = plain
            last = gone.tag
            open_[last] -= 1
            if last == tag:
                break

    for m in TOKEN.finditer(page):
        if m.start() > at and not stack[-1].skipped:
            pieces.append((page[at : m.start()], linked))
        at = m.end()
        tag, ends = m["tag"], m["end"]
        if m["raw"] is not None and not stack[-1].skipped:
            flush()
            stack.append(stack[-1].inside("pre", 0, plain))
            pieces.append((html.escape(m["raw"]), linked))
            flush()
            stack.pop().span[1] = plain
        if tag is None:
            continue
        tag = tag.lower()
        if ends and tag in SKIPPED:
            close(tag)
        elif tag in SKIPPED:
            if not m["more"].endswith("/"):
                stack.append(stack[-1].inside(tag, 0, plain))
                open_[tag] += 1
        elif tag == "a":
            linked = not ends
        elif tag == "br":
            pieces.append((" ", linked))
        elif tag in VOID:
            if tag == "hr":
                flush()
        elif ends:
            if tag not in INLINE or open_[tag]:  # an inline element that was marked stands as a block
                flush()
                close(tag)
        else:
            mark = marks(tag, m["more"])
            if tag in ("header", "noscript") and stack[-1].main and mark < 0:
                mark = 0  # of the article, not of the page
            if tag not in INLINE or mark < 0:
                flush()
                while stack[-1].tag and stack[-1].tag in CLOSES.get(tag, {"p"}):
                    close(stack[-1].tag)
                linked = False
                if not m["more"].endswith("/"):
                    stack.append(stack[-1].inside(tag, mark, plain))
                    open_[tag] += 1
    if at < len(page) and not stack[-1].skipped:
        pieces.append((page[at:], linked))
    flush()
    for left in stack:
        left.span[1] = plain
    return out


def block_features(found: list[tuple[str, int, int, Around]]) -> np.ndarray:
    """A row of FEATURES for each block of a page."""
    words = np.array([b[1] for b in found], float)
    links = np.array([b[2] for b in found], float) / np.maximum(words, 1)
    shift = lambda v, k: np.r_[np.zeros(1), v[:-1]] if k < 0 else np.r_[v[1:], np.zeros(1)]
    around = [b[3] for b in found]
    of = lambda value: np.array([float(value(a)) for a in around])
    main = of(lambda a: a.main)
    whole = max(1.0, float(sum(b[1] - b[2] for b in found)))
    columns = [
        words, shift(words, -1), shift(words, 1), links, shift(links, -1), shift(links, 1), of(lambda a: a.inner), of(lambda a: a.rest), of(lambda a: a.weak), main,
        np.full(len(found), float(main.any())), of(lambda a: a.tag in HEADINGS), of(lambda a: a.tag in ("p", "blockquote", "pre")), of(lambda a: a.item), np.array([b[0][-1] in ".!?:\"'»”)" for b in found], float),
        np.array([b[0][0] in "©®" or "copyright" in b[0][:40].lower() or "all rights reserved" in b[0].lower() for b in found], float), np.array([b[0][:1].isupper() for b in found], float),
        of(lambda a: (a.outer[1] - a.outer[0]) / whole), of(lambda a: (a.wider[1] - a.wider[0]) / whole),
    ]
    return np.stack(columns, axis=1)


class Tree:
    """A binary decision tree by Gini impurity."""

    def __init__(self, depth: int = 9, least: int = 3):
        self.depth, self.least = depth, least
        self.nodes: list[list[float]] = []  # feature (-1: leaf), threshold, left, right, share of main text

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self._grow(x, y.astype(float), self.depth)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        at = len(self.nodes)
        self.nodes.append([-1, 0.0, 0, 0, float(y.mean())])
        best = (1e-9, -1, 0.0)
        n, total = len(y), y.sum()
        if depth and 0 < total < n:
            for f in range(x.shape[1]):
                order = np.argsort(x[:, f], kind="stable")
                v, s = x[order, f], np.cumsum(y[order])
                k = np.flatnonzero(v[1:] > v[:-1]) + 1
                k = k[(k >= self.least) & (k <= n - self.least)]
                if len(k):
                    a = s[k - 1]
                    gain = a * a / k + (k - a) ** 2 / k + (total - a) ** 2 / (n - k) + (n - k - total + a) ** 2 / (n - k) - (total * total + (n - total) ** 2) / n
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (float(gain[i]), f, float(v[k[i] - 1] + v[k[i]]) / 2)
        if best[1] >= 0:
            _, f, t = best
            low = x[:, f] <= t
            left, right = self._grow(x[low], y[low], depth - 1), self._grow(x[~low], y[~low], depth - 1)
            self.nodes[at][:4] = [f, t, left, right]
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for i, row in enumerate(x):
            k = 0
            while (node := self.nodes[k])[0] >= 0:
                k = node[2] if row[int(node[0])] <= node[1] else node[3]
            out[i] = node[4]
        return out


def labelled_pages(count: int = 900, seed: int = 7) -> list[tuple[str, list[bool]]]:
    """The small labelled table: pages of invented words in common layouts, with a label for each block (true: main text)."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("ba", "ko", "ri", "ten", "mu", "las", "el", "do")) for _ in range(r.randint(1, 4)))

    def say(low: int, high: int, end: str = ".") -> str:
        return " ".join(word() for _ in range(r.randint(low, high))).capitalize() + end

    def links(k: int) -> list[str]:
        return [f'<a href="/x">{say(1, 3, "")}</a>' for _ in range(k)]

    pages = []
    for _ in range(count):
        parts: list[tuple[str, list[bool]]] = []

        def rest(markup: str, blocks_: int) -> None:
            parts.append((markup, [False] * blocks_))

        def maybe(chance: float, make) -> None:
            if r.random() < chance:
                make()

        named = r.random() < 0.6  # whether main text stands in an element that says so
        style = r.random()  # how paragraphs are marked up: as such, as plain elements, or as one text with line breaks
        top = r.choice(("header", 'div class="header"', 'div id="masthead"', 'div class="site-header"'))
        maybe(0.5, lambda: rest(f"<{top}><div>{say(1, 4, '')}</div><p>{say(2, 9, r.choice(('', '.')))}</p></{top.split()[0]}>", 2))
        menu = r.choice(("nav", 'div class="menu"', 'ul class="navigation"', 'div id="nav"', "div", "div", "section"))
        k = r.randint(3, 9)
        between = r.choice((None, None, " ", " | ", "<br>"))  # links in a list, or in a line
        if between is None:
            maybe(0.9, lambda: rest(f"<{menu}><ul>" + "".join(f"<li>{x}</li>" for x in links(k)) + f"</ul></{menu.split()[0]}>", k))
        else:
            maybe(0.9, lambda: rest(f"<{r.choice(('div', 'p', 'td', menu))}>" + between.join(links(k)) + "</div></p></td></nav></ul></section>", 1))
        notice = r.choice(('div class="cookie-notice"', 'div id="consent"', 'div class="notice"', 'div role="alert"', 'div class="popup"'))
        maybe(0.4, lambda: rest(f"<{notice}><p>{say(6, 40)}</p></{notice.split()[0]}>", 1))
        ad = r.choice(('div class="ad"', 'div class="advert"', 'div id="sponsored"', 'aside class="promo"', 'div class="ad-banner"'))
        maybe(0.5, lambda: rest(f"<{ad}>{say(3, 60)}</{ad.split()[0]}>", 1))
        body, labels = "", []
        heading = r.choice(("h1", "h2"))
        body += f"<{heading}>{say(2, 12, r.choice(('', '.')))}</{heading}>"
        labels.append(True)
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.68:
                low, high = r.choice(((1, 3), (3, 12), (12, 45), (45, 160)))
                inner = say(low, high) + (f' <a href="/y">{say(1, 4, "")}</a> {say(3, 20)}' if r.random() < 0.2 else "")
                if named and r.random() < 0.06:  # what a footer says, said by an article
                    inner = r.choice(("All rights reserved.", "&copy; " + say(1, 5), f"Copyright {say(2, 9)}"))
                body += f"<p>{inner}</p>" if style < 0.7 else f"<div>{inner}</div>"
                labels.append(True)
            elif kind < 0.76:
                body += f"<h3>{say(1, 7, '')}</h3>"
                labels.append(True)
            elif kind < 0.84:
                n = r.randint(2, 5)
                body += "<ul>" + "".join(f"<li>{say(2, 20, r.choice(('', '.')))}</li>" for _ in range(n)) + "</ul>"
                labels += [True] * n
            elif kind < 0.88:
                body += f"<blockquote>{say(5, 60)}</blockquote>"
                labels.append(True)
            elif kind < 0.93 and named:
                inside = r.choice(('div class="ad"', 'aside', 'div class="related"', 'div class="share"', 'div class="newsletter"'))
                body += f"<{inside}><p>{say(3, 40)}</p></{inside.split()[0]}>"
                labels.append(False)
            else:
                body += f"<pre>{say(4, 30, '')}</pre>"
                labels.append(True)
        if style > 0.84:  # sentences and line breaks in one element, without any other mark-up
            body, labels = "<br><br>".join(say(4, 40) for _ in range(r.randint(3, 12))), [True]
        odd = f"{r.choice(sorted(REST_WORDS))}-{word()}{r.choice(('', '-' + word(), '-story'))}"  # a topic that sounds like something else
        holder = r.choice(("article", "main", 'div class="content"', 'div id="main-content"', 'div class="post"', 'section class="entry"', f'div class="content" id="{odd}"', f'article id="{odd}"')) if named else r.choice(("div", "section", 'div class="x1"', f'div id="{odd}"', f'div class="{odd}"'))
        parts.append((f"<{holder}>{body}</{holder.split()[0]}>", labels))
        side = r.choice(("aside", 'div class="sidebar"', 'div id="side"', 'div class="widget"', "div"))
        n = r.randint(1, 6)
        maybe(0.5, lambda: rest(f"<{side}><h3>{say(1, 3, '')}</h3><ul>" + "".join(f"<li>{x}</li>" for x in links(n)) + f"</ul><p>{say(4, 50)}</p></{side.split()[0]}>", n + 2))
        form = r.choice(("form", 'div class="search"', 'div class="login-form"'))
        maybe(0.3, lambda: rest(f"<{form}><p>{say(1, 12, '')}</p><div>{say(1, 3, '')}</div></{form.split()[0]}>", 2))
        note = r.choice(('section class="comments"', 'div id="comments"', 'ol class="comment-list"', 'div id="disqus"'))
        c = r.randint(1, 5)
        maybe(0.5, lambda: rest(f"<{note}>" + "".join(f'<div class="c"><p>{say(2, 60)}</p></div>' for _ in range(c)) + f"</{note.split()[0]}>", c))
        weak = f"{r.choice(('share', 'social', 'related', 'newsletter', 'search', 'promo'))}-{word()}"
        few = r.randint(1, 4)
        maybe(0.3, lambda: rest(f'<div class="{weak}">' + "".join(f"<p>{say(1, 12, r.choice(('', '.')))}</p>" for _ in range(few)) + "</div>", few))
        foot = r.choice(("footer", 'div class="footer"', 'div id="copyright"', "div"))
        maybe(0.9, lambda: rest(f"<{foot}>&copy; {say(1, 30, r.choice(('', '.')))}</{foot.split()[0]}>", 1))
        pages.append(("<html><body>" + "".join(p for p, _ in parts) + "</body></html>", [x for _, ls in parts for x in ls]))
    return pages


def train_tree(pages: list[tuple[str, list[bool]]] | None = None) -> Tree:
    rows = [(block_features(blocks(p)), labels) for p, labels in pages or labelled_pages()]
    return Tree().fit(np.concatenate([x for x, _ in rows]), np.concatenate([y for _, y in rows]))


def main_text(page: str | None, tree: Tree) -> str:
    """The main text's blocks, joined by one line feed; empty where there are none."""
    found = blocks(page)
    if not found:
        return ""
    keep = tree.predict(block_features(found)) >= 0.5
    return "\n".join(b[0] for b, k in zip(found, keep) if k)


def extract_text(pages: DataFrame, html_col: str = "html", tree: Tree | None = None) -> DataFrame:
    """Rows of pages without the html, with text and n_chars (code points), which replace columns of these names.

    Null and empty html give an empty text; every row gives one row, repeated ones too; an empty table gives an empty one.
    """
    tree = tree or train_tree()
    own = pages.select(*[c for c in pages.columns if c not in ("text", "n_chars", html_col)], pages[html_col].cast("string").alias("__html"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                texts = pa.array([main_text(t, tree) for t in part.column(part.num_columns - 1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], names=[*b.schema.names[:-1], "text"])

    return own.mapInArrow(run, f"{fields}text string").withColumn("n_chars", F.char_length("text").cast("bigint"))


def op5_html(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
