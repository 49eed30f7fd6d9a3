"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into blocks at block-level tags. Each block has a word count, a link density, those of its neighbours, its size
against the page's longest text, and what encloses it. A tree trained on the hand-labelled blocks of labelled_pages tells main
text from the rest. Its first levels split by counts and densities of the block and its neighbours; marks in the markup, where
there are any, refine what these have told apart.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tree
from .labelled_pages import PAGES

#: Elements whose content is raw text: they end at their own end tag only, or with the page.
RAW = frozenset(("script", "style"))
#: Elements whose content isn't shown, belongs to a form, or stands in for media. They end where their container ends, at the latest.
SKIPPED = frozenset("noscript template textarea title iframe canvas select option button datalist audio video head annotation desc".split())
#: Elements that end one block and begin another.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an element of the same kind ends.
ENDS_ITSELF = frozenset("p li dt dd tr td th option".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
FRAMES = frozenset("nav header footer aside form menu dialog fieldset".split())
MAIN = frozenset(("article", "main"))
#: These never frame, whatever their class says.
NEVER = frozenset(("html", "body", "main"))
#: Words in class, id or role that mark what frames a page.
FRAME_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion nav navbar navigation menu menubar
    footer sidebar aside complementary contentinfo widget widgets cookie cookies consent gdpr notice notices popup modal overlay dialog alert newsletter
    subscribe subscription signup login share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager comment comments
    commentlist disqus respond replies reply search searchform form toolbar topbar masthead skip copyright legal hidden outbrain taboola""".split()
)
#: These mark a frame only outside of the article.
HEADER_WORDS = frozenset(("header", "head"))
#: A class of a frame word and such words only is a mark, one with other words is a hint.
COMMON_WORDS = frozenset(
    """site page main global primary secondary top bottom left right upper lower inner outer wrapper wrap container content box block section area
    list item items bar row col column group panel region slot unit link links button buttons icon icons title post posts article articles story
    mobile desktop sticky fixed wp js id the and by for of more our email body text meta thread sdk""".split()
)
#: A class that begins so says what a page has or lacks.
SAYS = frozenset("no has with without hide show is".split())
#: Of these, articles inside are framed too.
REPLIES = frozenset("comment comments commentlist disqus respond replies reply related recommended recommendations".split())
#: Words and pairs of words that name the container of the main text.
CONTENT_NAMES = frozenset("content article post entry story articlebody postbody entrycontent postcontent articlecontent storybody maincontent".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_SIMPLE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Least labelled blocks of a leaf, and the part of main blocks from which a leaf counts as main: in doubt, no text is lost.
LEAST, DOUBT = 4, 0.5
#: The first features are counts and densities; so many levels of the tree split by these.
COUNTS, LEVELS = 6, 2

FEATURES = ("words", "link_density", "words_before", "links_before", "words_after", "links_after", "share_of_longest", "heading", "mark", "container", "page_has_main")
#: Levels of `mark` and `container`.
HINT, FRAMED = 1, 2
NAMED, MARKED = 1, 2


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    return found


def _hidden(name: str, attributes: dict[str, str]) -> bool:
    """Whether an element isn't shown, and so is no text at all."""
    return name not in NEVER and ("hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(_HIDING.search(attributes.get("style", ""))))


def _mark(name: str, attributes: dict[str, str], inside: bool) -> tuple[int, bool]:
    """How far an element frames what it holds (nothing, HINT, FRAMED), and whether articles inside are framed too."""
    if name in FRAMES and not (name == "header" and inside):
        return FRAMED, name != "form"
    if name in NEVER:
        return 0, False
    level = 0
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}".split():
        words = [w.lower() for w in _WORD.findall(token)]
        if not words or words[0] in SAYS:
            continue
        framing = FRAME_WORDS if inside else FRAME_WORDS | HEADER_WORDS
        marks = framing.intersection(words)
        if not marks:
            continue
        if name == "p" and inside:
            level = HINT  # a paragraph of an article may be about what its class says
        elif all(w in framing or w in COMMON_WORDS for w in words):
            if name != "article":
                return FRAMED, bool(marks & REPLIES)
            if marks & REPLIES:
                return FRAMED, True
        elif name != "article":
            level = HINT
    return level, False


def _container(name: str, attributes: dict[str, str]) -> int:
    if name in MAIN or attributes.get("role", "").lower() in MAIN:
        return MARKED
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w.lower() for w in _WORD.findall(token)]
        if "".join(words[-2:]) in CONTENT_NAMES or "".join(words) in CONTENT_NAMES:
            return NAMED
    return 0


def _tokens(page: str) -> Iterator[tuple[str, str, str, int, int]]:
    """(kind, name, attributes, start, end) of markup in order; kinds are open, close, cdata and other. Time is linear in the page.

    Quotes hide > in a tag. From a tag on whose quotes don't close before the page ends, quotes count as any other character.
    """
    position, last, quotes = 0, page.rfind(">"), True
    while (position := page.find("<", position)) >= 0:
        if page.startswith("<!--", position):
            end = page.find("-->", position + 2)
            end = len(page) if end < 0 else end + 3
            yield "other", "", "", position, end
        elif page.startswith("<![CDATA[", position):
            end = page.find("]]>", position)
            yield "cdata", "", page[position + 9 : end if end >= 0 else len(page)], position, end + 3 if end >= 0 else len(page)
            end = end + 3 if end >= 0 else len(page)
        elif position > last:
            return
        elif page[position + 1] in "!?":
            end = page.find(">", position) + 1
            yield "other", "", "", position, end
        else:
            m = _TAG.match(page, position) if quotes else _SIMPLE.match(page, position)
            if m is None and (page[position + 1].isalpha() or page[position + 1] == "/") and quotes and (m := _SIMPLE.match(page, position)):
                quotes = False
            if m is None:
                position += 1
                continue
            end, name = m.end(), m[2].lower()
            yield "close" if m[1] else "open", name, m[3], position, end
            if name in RAW and not m[1]:
                found = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, end)
                closing = page.find(">", found.end()) if found else -1
                end = closing + 1 if closing >= 0 else len(page)
                yield "raw", name, "", m.end(), end
        position = end


def blocks(page: str) -> tuple[list[str], np.ndarray]:
    """The text blocks of a page in order, and a row of features for each."""
    texts: list[str] = []
    rows: list[tuple[int, int, bool, int, int]] = []
    pieces: list[str] = []
    links: list[str] = []
    # Open elements that matter: name, skipped, heading, mark, whether the mark holds for articles inside, container.
    opened: list[tuple[str, bool, bool, int, bool, int]] = []
    depth: dict[str, int] = {}
    none = ("", False, False, 0, False, 0)
    in_link, at = False, 0

    def flush() -> None:
        nonlocal pieces, links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                _, _, heading, mark, _, inside = opened[-1] if opened else none
                texts.append(text)
                rows.append((text.count(" ") + 1, len("".join(links).split()), heading, mark, inside))
            pieces, links = [], []

    def read(text: str, decoded: bool = False) -> None:
        if text and not (opened and opened[-1][1]):
            text = text if decoded else html.unescape(text)
            pieces.append(text)
            if in_link:
                links.append(text + " ")

    def close(k: int) -> None:
        for x in opened[k:]:
            depth[x[0]] -= 1
        del opened[k:]

    for kind, name, attributes, start, end in _tokens(page):
        if kind != "raw":
            read(page[at:start])
        at = end
        if kind == "cdata":
            read(attributes, decoded=True)
        elif name == "a":
            in_link = kind == "open"
        elif name == "br":
            read(" ")
        elif name in VOID and name not in BLOCKS:
            continue
        elif name in SKIPPED or name in BLOCKS:
            block = name in BLOCKS
            if block:
                flush()
            if kind == "close":
                if depth.get(name, 0):
                    k = len(opened) - 1
                    while opened[k][0] != name:
                        k -= 1
                    close(k)
                elif name == "p":
                    flush()
            elif kind == "open" and name not in VOID and not (name in SKIPPED and attributes.endswith("/")):
                # A block inside of an unclosed control or caption belongs to what encloses that; raw media stand-ins keep theirs.
                if block and opened and opened[-1][0] in ("button", "option", "select", "textarea", "title", "head"):
                    k = len(opened) - 1
                    while k and opened[k - 1][1]:
                        k -= 1
                    close(k)
                if opened and (opened[-1][0] == name and name in ENDS_ITSELF or opened[-1][0] == "p" and block):
                    close(len(opened) - 1)
                _, skipped, _, mark, replies, inside = opened[-1] if opened else none
                hidden = False
                if block:
                    found = _attributes(attributes) if attributes else {}
                    hidden = _hidden(name, found)
                    own = _container(name, found)
                    level, holds = _mark(name, found, max(inside, own) == MARKED)
                    if own == MARKED and not replies and mark and level < FRAMED:
                        mark = 0  # the wrapper of an article doesn't frame it
                    mark, replies, inside = max(mark, level), replies or holds, max(inside, own)
                opened.append((name, skipped or hidden or not block, name in HEADINGS, mark, replies, inside))
                depth[name] = depth.get(name, 0) + 1
    read(page[at:])
    flush()
    if not rows:
        return [], np.zeros((0, len(FEATURES)))
    words, linked, heading, mark, inside = (np.array(x, dtype=float) for x in zip(*rows, strict=True))
    density = np.minimum(linked / words, 1)
    before = lambda x: np.concatenate([[0.0], x[:-1]])
    after = lambda x: np.concatenate([x[1:], [0.0]])
    has_main = np.full(len(words), float(((inside == MARKED) & (mark < FRAMED)).any()))
    longest = max(1.0, (words * (mark < FRAMED) * (density < 0.5)).max())
    return texts, np.stack([words, density, before(words), before(density), after(words), after(density), np.minimum(words / longest, 1), heading, mark, inside, has_main], axis=1)


def labelled() -> list[tuple[int, np.ndarray, bool]]:
    """The labelled blocks: page, features, whether the block is main text."""
    out = []
    for k, page in enumerate(PAGES):
        filled = re.sub(r"~(\d+)", lambda m: " ".join(["word"] * int(m[1])), page)
        texts, features = blocks(filled)
        labels = [[x for x in re.findall(r"(?<!\S)[+-](?=\S)", t)] for t in texts]
        # The sign is part of the first word, so it doesn't change the counts.
        out += [(k, f, "+" in signs) for f, signs in zip(features, labels, strict=True)]
    return out


def train(rows: list[tuple[int, np.ndarray, bool]] | None = None) -> tuple:
    rows = labelled() if rows is None else rows
    return tree.fit(np.array([f for _, f, _ in rows]), np.array([float(y) for _, _, y in rows]), depth=12, least=LEAST, leading=COUNTS, levels=LEVELS)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of each page: page_id, url, text (main blocks in order, joined by line ends).

    Character references are decoded once, white space inside a block (also non-breaking) becomes one space. Null and empty
    pages, and pages without main text, have an empty text. Markup that isn't closed ends where its container does or with the
    page (scripts and styles with the page); text that only looks like a tag stays. Repeated rows are treated alike. An empty
    table gives an empty result. Other columns aren't read. The time for a page grows with its length.
    """
    model = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = []
                for page in part.column(2).to_pylist():
                    found, features = blocks(page or "")
                    keep = tree.predict(model, features) >= DOUBT
                    texts.append("\n".join(t for t, k in zip(found, keep.tolist(), strict=True) if k))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, type=pa.string())], names=["page_id", "url", "text"])

    kind, url = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"page_id {kind}, url {url}, text string")
