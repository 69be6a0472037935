"""Main text of web pages by two passes over blocks.

Pass 1 labels each block by its length, its density of stop words and its density of links; what it stands in (a menu, a form,
an article) is one more feature. Blocks that this leaves open are short, linked or middling ones. Pass 2 gives them the
label of the nearest decided blocks.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselake.llm.common import small_batches

# Frequent function words of the languages served; a choice, not a fixed list.
STOP_WORDS = frozenset(
    "a about all also an and are as at be been but by can for from had has have he her his how i if in into is it its more"
    " no not of on one or our out she so that the their there they this to up was we were what when which who will with"
    " would you your"
    " au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne ou par pas pour qu que qui sa se ses son"
    " sur un une"
    " als am auch auf aus bei das dass dem den der die ein eine einem einer er es für ich im ist mit nach nicht oder sich sie"
    " sind um und von war wie wird zu zum zur"
    " al como con del el ella esta este fue ha las lo los más o para pero por se sin su sus también una y".split()
)

# Element names by the part they play.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td"
    " tfoot th thead tr ul button label".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FLAT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr thead tbody tfoot caption option hr html body head".split())
#: An element that opens ends these, where they are the innermost open ones.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"td", "th", "tr", "p"}, "option": {"option"}}
NOT_MAIN = frozenset("nav footer aside form button select menu dialog noscript template object svg math canvas audio video head".split())

# Names of classes, ids and roles for parts of a page.
PART_NOT_MAIN = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar sidebars menu nav navbar"
    " navigation breadcrumb breadcrumbs footer cookie cookies consent notice notices popup modal newsletter subscribe"
    " subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus"
    " reply replies respond widget toolbar pagination pager copyright disclaimer".split()
)
ROLE_NOT_MAIN = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: The second part of a name such as sidebar-left, and the first of one that doesn't name the element itself (has-sidebar).
PLACES = frozenset(
    "left right top bottom container wrapper wrap area list box bar block section slot unit banner panel menu item items links"
    " content inner outer main nav form thread header body text widget policy group region".split()
)
SAYS_OF = frozenset("has no with without is not show hide on".split())
PART_MAYBE = frozenset("header masthead banner".split())
PART_MAIN = frozenset("article main articlebody".split())

RAW = "script|style|textarea|title|iframe|noframes|xmp"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({RAW})\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/a-zA-Z][^>]*+(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Thresholds:
    """Densities are shares of the words (stop words) or of the characters (links); lengths are characters."""

    short: int = 70
    long: int = 200
    stop_low: float = 0.10
    stop_high: float = 0.25
    links: float = 0.33
    links_in_article: float = 0.66


@dataclass
class Block:
    container: int
    """Number of the article that it stands in; 0: none."""
    shut_out: bool
    """It stands in a menu, a form, an advert, ..."""
    parts: list = field(default_factory=list)
    link_chars: int = 0
    text: str = ""
    label: str = ""


def _names_not_main(name: str) -> bool:
    """A class or id that names a part other than the main text: itself, or with a word for its place (``sidebar-left``)."""
    if name in PART_NOT_MAIN:
        return True
    parts = [x for x in re.split(r"[-_]+", name) if x]
    if len(parts) != 2 or parts[0] in SAYS_OF:
        return False
    return parts[1] in PART_NOT_MAIN or parts[0] in PART_NOT_MAIN and (parts[1] in PLACES or parts[1].isdigit())


def _part(tag: str, attributes: str, in_article: bool) -> str:
    """What an element is by its name and attributes: ``main``, ``not`` (not main text) or nothing.

    Articles are shut out by a whole name only (``class="comment"``), blocks such as headings by their classes only.
    """
    if tag in ("html", "body"):
        return ""
    names: set[str] = set()
    role = ""
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            return "not"
        if name == "role":
            role = value.strip()
        elif name in ("class", "itemprop") or name == "id" and tag not in FLAT:
            names.update(value.split())
    if tag in ("article", "main"):
        return "not" if names & PART_NOT_MAIN else "main"
    if tag in NOT_MAIN or role in ROLE_NOT_MAIN or any(map(_names_not_main, names)):
        return "not"
    if tag == "header" or any(x.split("-")[-1] in PART_MAYBE for x in names):
        return "" if in_article else "not"
    return "main" if names & PART_MAIN or role in PART_MAIN else ""


def blocks_of(page: str) -> list[Block]:
    """Cut a page into blocks of text; scripts, styles, comments and markup don't make text.

    Elements of ``FLAT`` are put on the stack of open elements only where they are shut out; they end with their own end, with
    an element of ``ENDS``, or with the element around them.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # element; article and shut out as they were before it
    open_: Counter = Counter()  # elements on the stack by name
    article, shut_out, articles, in_link, breaks, at = 0, False, 0, False, 0, 0
    current: Block | None = None

    def text(chunk: str) -> None:
        nonlocal current, breaks
        if not chunk:
            return
        if not chunk.isspace():
            breaks = 0
        if current is None:
            current = Block(article, shut_out)
            blocks.append(current)
        chunk = html.unescape(chunk) if "&" in chunk else chunk
        current.parts.append(chunk)
        if in_link:
            current.link_chars += len("".join(chunk.split()))

    def close(i: int) -> None:
        nonlocal article, shut_out, current
        if stack[i][2] != shut_out:
            current = None
        _, article, shut_out = stack[i]
        open_.subtract(x[0] for x in stack[i:])
        del stack[i:]

    for m in TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        if not m[3]:
            continue
        tag, closing = m[3].lower(), bool(m[2])
        if tag == "br":
            breaks += 1
            if breaks > 1:
                current = None
            elif current is not None:
                current.parts.append(" ")
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag in BLOCKS:
            current, in_link, breaks = None, False, 0
            if not closing:
                while stack and stack[-1][0] in ENDS.get(tag, {"p"}):
                    close(len(stack) - 1)
        if closing:
            if open_[tag] > 0:
                i = len(stack) - 1
                while stack[i][0] != tag and not (tag in FLAT and stack[i][0] in BLOCKS):
                    i -= 1
                if stack[i][0] == tag:
                    close(i)
            continue
        if tag in VOID or m[4].endswith("/") or (tag in FLAT and not m[4]):
            continue
        part = _part(tag, m[4], article > 0)
        if tag in FLAT and part != "not" or tag not in BLOCKS and tag not in NOT_MAIN and part != "not":
            continue
        stack.append((tag, article, shut_out))
        open_[tag] += 1
        if part == "not":
            shut_out, current = True, None
        elif part == "main" and not shut_out and not article:
            articles += 1
            article = articles
    text(page[at:])
    for b in blocks:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in blocks if b.text]


def first_pass(b: Block, limits: Thresholds) -> str:
    """``good``, ``bad``, or open: ``near`` (middling), ``short``, ``linked`` (links in an article).

    Inside an article low densities leave a block open, as an article may hold lists, tables and references; outside they make
    it bad.
    """
    n, words = len(b.text), WORD.findall(b.text.lower())
    links = b.link_chars / max(1, len(b.text.replace(" ", "")))
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if b.shut_out or not b.container and links > limits.links:
        return "bad"
    if links > limits.links_in_article and stops < limits.stop_low:
        return "linked"
    if n < limits.short:
        return "short" if b.container or not b.link_chars else "bad"
    if stops >= limits.stop_high:
        return "good" if n > limits.long else "near"
    return "near" if stops >= limits.stop_low or b.container else "bad"


def _nearest(labels: list[str], counts: list[bool]) -> list[str]:
    """For each block, the label of the nearest one before that counts and is decided; nothing if there is none."""
    found, last = [], ""
    for label, count in zip(labels, counts, strict=True):
        found.append(last)
        if count and label in ("good", "bad"):
            last = label
    return found


def _closest(labels: list[str], counts: list[bool]) -> list[str]:
    """For each block, the label of the closest other one that counts and is decided (the earlier of two); nothing if none is."""
    places = [i for i, (label, count) in enumerate(zip(labels, counts, strict=True)) if count and label in ("good", "bad")]
    found, at = [], 0
    for i in range(len(labels)):
        while at < len(places) and places[at] <= i:
            at += 1
        before = next((p for p in places[max(0, at - 2) : at][::-1] if p != i), None)
        after = places[at] if at < len(places) else None
        near = before if after is None or before is not None and i - before <= after - i else after
        found.append("" if near is None else labels[near])
    return found


def second_pass(blocks: list[Block]) -> None:
    """Open blocks take the label of their decided neighbours; blocks that are shut out are nobody's neighbours.

    If an article has a good block, or nothing outside of articles is good, the articles are the text and what is around
    them is bad. Their open blocks, linked ones too, take the label of the closest decided block in articles; where none is
    decided, they are the text. Else (an article is a mere teaser beside the text) and on pages without articles, a middling
    block is good if a neighbour is, a short or linked one if all are that it has. A page without any good block has nothing but
    short or middling ones: they are the text.
    """
    inside = any(b.container and not b.shut_out for b in blocks)
    bounded = inside and (any(b.container and b.label == "good" for b in blocks) or all(b.container for b in blocks if b.label == "good"))
    if bounded:
        for b in blocks:
            if not b.container:
                b.label = "bad"
    counts = [not b.shut_out and (b.container > 0 or not bounded) for b in blocks]
    labels = [b.label for b in blocks]
    closest = _closest(labels, counts)
    before, after = _nearest(labels, counts), _nearest(labels[::-1], counts[::-1])[::-1]
    for i, b in enumerate(blocks):
        if b.label in ("good", "bad"):
            continue
        found = [s for s in (before[i], after[i]) if s]
        if bounded:
            good = closest[i] != "bad"
        elif "good" not in labels:
            good = b.label != "linked"
        elif b.label == "near":
            good = not found or "good" in found
        else:
            good = bool(found) and set(found) == {"good"}
        b.label = "good" if good else "bad"


def decide(blocks: list[Block], limits: Thresholds) -> list[Block]:
    """Both passes; returns the blocks of the main text."""
    for b in blocks:
        b.label = first_pass(b, limits)
    second_pass(blocks)
    return [b for b in blocks if b.label == "good"]


def main_text(page: str | None, limits: Thresholds = Thresholds()) -> str:
    """Main text of one page: its blocks in page order, joined by an empty line."""
    return "\n\n".join(b.text for b in decide(blocks_of(page), limits)) if page else ""


def extract(pages: DataFrame, html_column: str = "html", output: str = "text", limits: Thresholds = Thresholds()) -> DataFrame:
    """Add the main text of each page as ``output`` and its length in code points as ``n_chars``.

    Null or empty html gives an empty text. Columns of ``pages`` that have these names are replaced, all others are kept,
    rows are neither dropped nor merged, and an empty table gives an empty one. An unclosed element ends with its parent; a
    tag cut off by the end is dropped. One line break is white space, two end a block. Pages are worked on one at a time,
    whole, in time in proportion to their length.
    """
    small_batches(pages.sparkSession)

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        return pa.array((main_text(x, limits) for x in column.to_pylist()), pa.string())

    return pages.withColumn(output, texts(F.col(html_column))).withColumn("n_chars", F.length(output).cast("long"))
