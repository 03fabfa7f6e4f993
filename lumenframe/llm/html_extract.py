"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass looks at each
block alone: where it stands (navigation, adverts and the like, by tag or by the
words of class, id and role), its length, its share of stop words and of linked
text. It decides the clear cases and leaves short or wordless ones open. In the second
pass an open block takes the label of the nearest decided blocks of its region
(the article, or the rest of the page); where these differ it takes the one
nearer by, and between equals the text before it counts. A region with no decided block
keeps what is open.

A page with hardly any stop word is in a language that the list doesn't know. There
long blocks count as text that consist of letters mostly and have the marks of sentences.

Defined cases: a null or empty page has an empty text; unclosed tags, comments
and raw elements run to the end of the page as in browsers, and tags that may be left open
(paragraphs, list items, cells, options) end where the next one begins; a page without any
tag is one block; repeated rows stay apart. Whole pages are read whatever their
length.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import STOP_WORDS, slices

SHORT, LONG = 70, 200
STOPS_LOW, STOPS_HIGH, LINKS_HIGH = 0.12, 0.28, 0.5
#: Below this share of stop words in all its text a page's language is unknown; then prose has so many letters, and marks of sentences.
STOPS_UNKNOWN, LETTERS_LEAST, MARKS_LEAST = 0.03, 0.7, 0.004
#: Elements that stand inside a line. Fixed values.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
#: Elements whose content is read as characters up to their end tag, and isn't text of the page. Fixed values.
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
#: Other elements whose content isn't text of the page. Fixed values.
NO_TEXT = frozenset("object svg math canvas video audio select datalist option optgroup button".split())
#: Elements around a page's furniture. Fixed values.
FURNITURE = frozenset("nav header footer aside form menu dialog".split())
#: Words of class, id and role that name furniture. Fixed values.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments complementary "
    "consent contentinfo cookie cookies disqus feedback footer form gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice notices overlay pager pagination popup promo promotion recommended related reply replies respond search "
    "share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget widgets".split()
)
#: Marks that end or divide sentences. Fixed values.
MARKS = frozenset(".,;:!?\u3002\u3001\uff0c\uff01\uff1f\u060c\u061f\u06d4\u0964")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CELLS, _ROWS = frozenset(("td", "th")), frozenset(("thead", "tbody", "tfoot"))
#: What a start tag ends if it was left open, and in which elements it looks for that. Fixed values.
ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    **{n: (frozenset(("dt", "dd")), frozenset(("dl",))) for n in ("dt", "dd")},
    **{n: (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))) for n in ("option", "optgroup")},
    **{n: (_CELLS, frozenset(("tr", "table"))) for n in _CELLS},
    "tr": (_CELLS | {"tr"}, _ROWS | {"table"}),
    **{n: (_CELLS | _ROWS | {"tr"}, frozenset(("table",))) for n in _ROWS},
}
_TAG = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""")
_UNSHOWN = re.compile(r"""\bstyle\s*=\s*["'][^"']*display\s*:\s*none""", re.I)


class Block:
    __slots__ = ("article", "furniture", "label", "linked", "text")

    def __init__(self, text: str, linked: int, article: bool, furniture: bool):
        self.text, self.linked, self.article, self.furniture, self.label = text, linked, article, furniture, None


def _is_furniture(name: str, attrs: str, in_article: bool) -> bool:
    if name in NO_TEXT:
        return True
    if name in FURNITURE:
        return not (name == "header" and in_article)
    if not attrs or name in ("html", "body", "article", "main"):
        return False
    for m in _NAMES.finditer(attrs):
        words = {w.lower() for w in _WORDS.findall(m[1] or m[2] or m[3] or "")}
        if words & FURNITURE_WORDS and not (in_article and words & {"header"} and not words & (FURNITURE_WORDS - {"header"})):
            return True
    return bool(_UNSHOWN.search(attrs)) or ("hidden" in attrs and "hidden" in _QUOTED.sub("", attrs).lower().split())


def blocks(page: str) -> list[Block]:
    """The blocks of `page` that have text, in order."""
    out: list[Block] = []
    open_: list[tuple[str, bool, bool]] = []  # (name, in the article, in furniture)
    parts: list[str] = []
    linked: list[str] = []
    links = 0

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            size = len(" ".join(html.unescape("".join(linked)).split()))
            article, furniture = open_[-1][1:] if open_ else (False, False)
            out.append(Block(text, size, article, furniture))
        parts.clear()
        linked.clear()

    def add(text: str) -> None:
        parts.append(text)
        if links:
            linked.append(text)

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        ending, attrs = bool(m["end"] or m["end2"]), m["attrs"] or m["attrs2"] or ""
        if name in RAW:
            if not ending and not attrs.endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else n
            continue
        if name == "a":
            links = 0 if ending else 1
        if name in INLINE:
            continue
        close()
        links = 0
        if name in VOID:
            continue
        if ending:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    del open_[i:]
                    break
            continue
        if open_ and open_[-1][0] == "p":
            open_.pop()
        ends, within = ENDS.get(name, ((), ()))
        for i in range(len(open_) - 1 if ends else -1, -1, -1):
            if open_[i][0] in ends:
                del open_[i:]
            elif open_[i][0] in within:
                break
        if not attrs.endswith("/"):
            article, furniture = open_[-1][1:] if open_ else (False, False)
            open_.append((name, article or name in ("article", "main"), furniture or _is_furniture(name, attrs, article)))
    close()
    return out


def stop_share(words: list[str]) -> float:
    return sum(w.lower().strip(".,;:!?") in STOP_WORDS for w in words) / len(words)


def decide(b: Block, known: bool = True) -> bool | None:
    """First pass: True (text), False (furniture) or None (open); `known`: the stop words know the page's language."""
    if b.furniture:
        return False
    size = len(b.text)
    links = b.linked / size
    if links > LINKS_HIGH:
        return False
    if not b.article and size < LONG and ("\N{COPYRIGHT SIGN}" in b.text or "copyright" in b.text.lower()):
        return False
    if size < SHORT:
        return False if links > 0 and not b.article else None
    if b.article:
        return True
    if not known:
        letters, marks = sum(map(str.isalpha, b.text)), sum(c in MARKS for c in b.text)
        spaces = b.text.count(" ")
        if letters < LETTERS_LEAST * (size - spaces) or marks < MARKS_LEAST * size:
            return False
        return True if size > LONG else None
    stops = stop_share(b.text.split())
    if stops >= STOPS_HIGH or (stops >= STOPS_LOW and size > LONG):
        return True
    return None if stops >= STOPS_LOW else False


def label(found: list[Block]) -> list[Block]:
    """`found` with every label set."""
    words = [w for b in found if not b.furniture for w in b.text.split()]
    known = not words or stop_share(words) >= STOPS_UNKNOWN
    first = [decide(b, known) for b in found]
    nearest: list[tuple[list, list]] = [([], []) for _ in found]
    for direction, order in ((0, range(len(found))), (1, range(len(found) - 1, -1, -1))):
        seen: dict[bool, int] = {}
        for i in order:
            b = found[i]
            if b.article in seen:
                nearest[i][direction].append(seen[b.article])
            if first[i] is not None and not b.furniture:
                seen[b.article] = i
    for i, b in enumerate(found):
        b.label = first[i]
        if b.label is None:
            before, after = nearest[i]
            near = [(abs(i - j), j > i, first[j]) for j in before + after]
            b.label = min(near)[2] if near else True
    return found


def main_text(page: str | None) -> str:
    return " ".join(b.text for b in label(blocks(page)) if b.label) if page else ""


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of `pages`."""

    def run(batches):
        for batch in slices(batches):
            texts = [main_text(p.as_py()) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


def op2_query(pages: DataFrame) -> DataFrame:
    return extracted(pages)
