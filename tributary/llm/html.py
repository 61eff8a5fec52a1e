"""Operator 7, HTML extraction: blocks, a context-free pass of density rules, a second pass for what stays open."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tributary.llm.common import table

#: Frequent function words of the four languages.
STOP_WORDS = frozenset(
    """the of and to in a is that it for on was with as be by are this at from or an not have but they you he she we his her
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er so dass wie bei oder aus
    de la le les des et en un une du que qui dans est pour par sur au pas plus avec ce il elle ne se son sa ou
    el los las y del que en un una por con para es se no lo su al como más o pero sus le ha""".split()
)
#: Elements whose whole content is no text of the page, and those that hold menus, notices, forms and the like.
RAW = frozenset("script style textarea title noscript iframe template svg xmp noembed noframes".split())
AWAY = frozenset("nav footer aside form menu button select head".split())
#: These go only outside the article, where they hold the site's name or a notice.
AWAY_OUTSIDE = frozenset("header dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub
    sup time tt u var wbr data ruby rb rt rp input link meta area param source track""".split()
)
MAIN = frozenset("article main".split())
#: A name in class, id or role marks an element as away if its head is one of these. The head is the last of its words but for PLAIN ones and sizes, as in
#: user-comments, cookie-law-info-bar and ad-728x90; a name with one of NOT_SO says the contrary: no-sidebar, page-with-header, has-ads. The head of
#: social-science and advertising-history is another word.
AWAY_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices
    sidebar aside menu nav navbar navigation footer masthead breadcrumb breadcrumbs comment comments reply replies respond
    disqus share sharing related recommended newsletter subscribe subscription signup login popup modal overlay
    pagination pager toolbar alert disclaimer gdpr paywall searchbox searchform complementary contentinfo""".split()
)
#: These mark outside the article only, where a name of an article's own part cannot be meant.
AWAY_NAMES_OUTSIDE = frozenset("header search form copyright social widget".split())
PLAIN = frozenset(
    """site page global top bottom left right main primary secondary box list item items container wrapper wrap inner outer holder bar block
    section area slot unit links link buttons button icons icon media posts articles stories content body text thread form policy
    desktop mobile sticky fixed google dfp widget widgets default info law panel row column col group module region zone rail""".split()
)
NOT_SO = frozenset("no not non has have with without".split())
#: Whole names of what holds text. Beside one of them a name that marks outside the article only does not count.
TEXT_NAMES = frozenset("content article post entry story main text body".split())
#: Marks of so many letters also count at the end of a longer word, as in usercomments.
LONG_MARK = 7
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.10, 0.20
LINKS_HIGH = 0.5

#: What may follow a tag's name, one at a time: its end, or an attribute. No part can match in two ways, so a page takes linear time.
ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)("?)|'([^']*+)('?)|([^\s>"'][^\s>]*+)|(?=>)))?)""")
TAG = re.compile(r"(/?)([A-Za-z][^\s/>]*+)")
NAME_WORD = re.compile(r"[a-z0-9]+")
HIDDEN = re.compile(r"display\s*+:\s*+none")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I) for tag in RAW}
WORD = re.compile(r"[^\W\d_]+")


class Block:
    """Text of one block, the characters of it inside links, whether the article holds it and whether it is an item of a list."""

    __slots__ = ("item", "linked", "main", "text")

    def __init__(self, text: str, linked: int, main: bool, item: bool):
        self.text, self.linked, self.main, self.item = text, linked, main, item


def attributes_from(page: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes that stand at `at`, after a tag's name, and where the tag ends; -1 if it has no end, when the rest of the page is in it."""
    out: dict[str, str] = {}
    while m := ATTRIBUTE.match(page, at):
        at = m.end()
        if m[1]:
            return out, at
        if m[3] is not None and not m[4] or m[5] is not None and not m[6]:
            return out, -1
        out.setdefault(m[2].lower(), m[3] or m[5] or m[7] or "")
    return out, -1


def _away(tag: str, attributes: dict[str, str], in_main: bool) -> bool:
    if tag in AWAY or tag in AWAY_OUTSIDE and not in_main:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or HIDDEN.search(attributes.get("style", "").lower()):
        return True
    if tag in ("html", "body") or tag in MAIN:
        return False
    names = [x for k in ("class", "id", "role") for x in attributes.get(k, "").lower().split()]
    if any(_marked(x, AWAY_NAMES) for x in names):
        return True
    return not in_main and not any(x in TEXT_NAMES for x in names) and any(_marked(x, AWAY_NAMES_OUTSIDE) for x in names)


def _marked(name: str, marks: frozenset[str]) -> bool:
    words = [w for w in NAME_WORD.findall(name) if w.isalpha()]
    if NOT_SO.intersection(words):
        return False
    while words and words[-1] in PLAIN and words[-1] not in marks:
        words.pop()
    if not words:
        return False
    head = words[-1]
    # words run together: a mark before a plain word, or a long mark at the end
    return head in marks or any(head[:i] in marks and head[i:] in PLAIN for i in range(2, len(head) - 1)) or any(head[-i:] in marks for i in range(LONG_MARK, len(head)))


def blocks(page: str) -> list[Block]:
    """The blocks outside removed elements, in page order; white space runs are one space, references decoded, empty ones gone.

    One pass over the page, in time linear in it: tags out of place close what they can, an unclosed element ends with the one around it, and
    a tag, comment or script without an end takes the rest of the page, as in a browser.
    """
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool]] = []  # open elements, and whether each begins a removed one
    opened: Counter[str] = Counter()
    away = mains = 0

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, min(linked, len(text)), mains > 0, opened["li"] > 0))
            parts.clear()
        linked = 0

    def text_to(end: int) -> None:
        nonlocal linked
        if end > at and not away:
            raw = page[at:end]
            parts.append(raw)
            if opened["a"]:
                linked += len(" ".join(entities.unescape(raw).split()))

    def pop() -> None:
        nonlocal away, mains
        tag, gone = stack.pop()
        opened[tag] -= 1
        away -= gone
        mains -= tag in MAIN

    at = look = 0  # text from `at` is not yet taken; the next tag is sought from `look`
    while (lt := page.find("<", look)) >= 0:
        if page.startswith(("<!", "<?"), lt):
            text_to(lt)
            end = page.find("-->", lt + 4) if page.startswith("<!--", lt) else page.find(">", lt)
            at = look = len(page) if end < 0 else end + (3 if page.startswith("<!--", lt) else 1)
            continue
        m = TAG.match(page, lt + 1)
        if not m:
            look = lt + 1
            continue
        text_to(lt)
        tag, closing = m[2].lower(), bool(m[1])
        attributes, end = attributes_from(page, m.end())
        at = look = len(page) if end < 0 else end
        if end < 0:
            break
        empty = page[end - 2] == "/"
        if tag in RAW:
            if not closing and not empty:
                close = RAW_END[tag].search(page, at)
                at = look = close.end() if close else len(page)
            continue
        if tag not in INLINE:
            close_block()
        if closing:
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
        elif tag not in VOID and not empty:
            if tag == "a" and any(t == "a" for t, _ in stack[-3:]):  # links do not nest
                while opened["a"] and any(t == "a" for t, _ in stack[-3:]):
                    pop()
            if tag in ("p", "li", "td", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
                pop()
            gone = _away(tag, attributes, mains > 0)
            stack.append((tag, gone))
            opened[tag] += 1
            away += gone
            mains += tag in MAIN
    text_to(len(page))
    close_block()
    return out


def first_pass(b: Block) -> str:
    """good, near, short or bad by the block alone."""
    n = len(b.text)
    if b.linked > LINKS_HIGH * n:
        # a paragraph of the article may be one link, a list of links is a menu
        return "near" if b.main and not b.item else "bad"
    if n < LENGTH_LOW:
        return "bad" if b.linked and not b.main else "short"
    found = WORD.findall(b.text.lower())
    density = sum(w in STOP_WORDS for w in found) / max(1, len(found))
    if density >= STOP_HIGH:
        return "good" if n > LENGTH_HIGH else "near"
    if density >= STOP_LOW:
        return "near"
    return "near" if b.main else "bad"


def classify(found: list[Block]) -> list[bool]:
    """Second pass: near and short blocks take the label of the nearest decided neighbours of their region.

    In the article an open block is kept unless both neighbours are bad; elsewhere a short one needs two good neighbours
    and a near one needs one. Where no block of the page is decided, near blocks and those of the article are kept.
    """
    first = [first_pass(b) for b in found]
    n = len(found)
    before: list[str] = [""] * n
    after: list[str] = [""] * n
    for side, places in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last = {True: "", False: ""}
        for i in places:
            side[i] = last[found[i].main]
            if first[i] in ("good", "bad"):
                last[found[i].main] = first[i]
    keep = []
    for i, b in enumerate(found):
        around = (before[i], after[i])
        if first[i] in ("good", "bad"):
            keep.append(first[i] == "good")
        elif b.main:
            keep.append(around != ("bad", "bad"))
        elif around == ("", ""):
            keep.append(first[i] == "near")
        else:
            keep.append("good" in around if first[i] == "near" else around.count("good") == 2)
    return keep


def extract(page: str | None) -> str:
    """The main text: kept blocks joined by one \\n; empty for null or a page without any. With an article, only its blocks count."""
    found = blocks(page or "")
    if any(b.main for b in found):
        found = [b for b in found if b.main]
    return "\n".join(b.text for b, good in zip(found, classify(found), strict=True) if good)


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text and n_chars of every row of pages; other columns are not read. Null key or url stay null, repeated rows repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(key, url, html)
    return rows.mapInArrow(run, f"page_id {rows.schema[key].dataType.simpleString()}, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page; see extracted()."""
    return extracted(table(spark, sf_dir, "pages"))
