"""Main text of HTML pages by two-pass block rules.

Pass one splits a page into blocks at block-level tags and labels each by stop-word density, length and
link density; blocks inside menus, headers, footers, sidebars, notices, adverts, forms and reader comments
are boilerplate by their place. Pass two lets the ambiguous short blocks take the label that their nearest
decided neighbours agree on. Where a page marks its article (article, main, role=main), only blocks inside
it can be text, and a block there is dropped for its place or its links alone.

Defined edge cases: a null or empty page gives an empty text; markup that is never closed ends with the
page; repeated rows repeat their result; an empty table gives an empty result; columns other than page_id,
url and html are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import blocks, table

#: Frequent function words of the supported languages.
STOP_WORDS = frozenset(
    "the of and to in is was that for it on with as be by this are at from or an not but have has he she they you we his her their will would can "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er sie wird bei aus nach wie "
    "le la les de des du et en un une est que qui dans pour par sur au aux ne pas plus se ce il elle avec son sa ses ou "
    "el los las del y en una que por con para es se no su al lo como más pero sus o le ha".split()
)
LENGTH_LOW = 70
LENGTH_HIGH = 200
STOP_LOW = 0.10
STOP_LEAST = 0.03
STOP_HIGH = 0.20
MOST_LINKS = 0.33

_SKIP = frozenset("script style noscript template svg math iframe object canvas head title select option button textarea datalist map audio video".split())
_RAW = frozenset("script style textarea title noscript iframe".split())
_PLACE = frozenset("nav header footer aside form dialog menu".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OPEN_P = _BLOCK - {"html", "body"}
_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|gdpr|popup|modal|newsletter|subscribe|signup|sidebar|side|widget|menu|nav\w*|navbar|breadcrumb\w*|"
    r"header|masthead|topbar|footer|copyright|comments?|commentlist|respond|disqus|discussion|replies|reply|share|sharing|social|related|recommend\w*|pagination|pager|toolbar|login|search|hidden)(?:$|[\s_-])",
    re.I,
)
_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:-->|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
#: A slash that ends an attribute without quotes, as in <a href=/to/>.
_BARE_SLASH = re.compile(r"=[^\s\"'>]*/>\Z")
#: Parts of an article that are named like parts of a page.
_OWN = re.compile(r"(?:entry|post|article|story|content|section)[_-]+(?:header|heading|title|head)", re.I)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WHITE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")


class _Block:
    __slots__ = ("parts", "link_chars", "bad", "inside", "text", "head", "label")

    def __init__(self, bad: bool, inside: bool, head: bool) -> None:
        self.parts: list[str] = []
        self.link_chars = 0
        self.bad, self.inside, self.head = bad, inside, head
        self.text, self.label = "", ""


def _split(page: str) -> list[_Block]:
    found: list[_Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, bad place, inside the article, in a link
    block: _Block | None = None
    at = 0

    def state() -> tuple[bool, bool, bool]:
        return stack[-1][1:] if stack else (False, False, False)

    def add(piece: str) -> None:
        nonlocal block
        bad, inside, link = state()
        piece = html.unescape(piece) if "&" in piece else piece
        if block is None:
            if not piece.strip():
                return
            block = _Block(bad, inside, any(s[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for s in stack[-3:]))
            found.append(block)
        block.parts.append(piece)
        if link:
            block.link_chars += len(piece.strip())

    def close(tag: str) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                del stack[k:]
                return
            if tag != "body" and tag != "html" and stack[k][0] in ("article", "main", "body", "td") and tag in ("p", "b", "i", "a", "span", "em", "strong"):
                return

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        token = m.group(0)
        name = _NAME.match(token)
        if name is None:
            if token.startswith("<![CDATA["):
                add(token[9:-3] if token.endswith("]]>") else token[9:])
            continue
        tag = name.group(1).lower()
        if token[1] == "/":
            if tag in _BLOCK:
                block = None
            close(tag)
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag == "br":
            add(" ") if block is not None else None
            continue
        if tag in _OPEN_P:
            block = None
            if any(s[0] == "p" for s in stack[-6:]):
                close("p")
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                stack.pop()
        if tag in _VOID or (token.endswith("/>") and not _BARE_SLASH.search(token)):
            continue
        bad, inside, link = state()
        traits = {}
        if len(token) > len(tag) + 2:
            for a in _ATTR.finditer(token, len(tag) + 1):
                traits.setdefault(a.group(1).lower(), a.group(2) or a.group(3) or a.group(4) or "")
        role = traits.get("role", "").lower()
        named = tag not in ("html", "body", "article", "main") and _HINT.search(_OWN.sub("", traits.get("class", "") + " " + traits.get("id", "")))
        in_article = inside and tag == "header"
        unseen = "hidden" in traits or traits.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", traits.get("style", ""))
        bad = bad or tag in _SKIP or (tag in _PLACE and not in_article) or role in _ROLE or bool(named) or bool(unseen)
        inside = inside or ((tag in ("article", "main") or role == "main") and not bad)
        stack.append((tag, bad, inside, link or tag == "a"))
    return found


def extract(page: str | None) -> str:
    """The article's blocks, joined by a blank line."""
    if not page:
        return ""
    kept = []
    for b in _split(page):
        b.text = _WHITE.sub(" ", "".join(b.parts)).strip()
        if b.text:
            kept.append(b)
    marked = any(b.inside and not b.bad for b in kept)
    counts = []
    for b in kept:
        terms = _WORD.findall(b.text.lower())
        counts.append((sum(t in STOP_WORDS for t in terms), len(terms)))
    own = [c for b, c in zip(kept, counts) if not b.bad]
    # Where hardly any function word is known, the language is another one, and length decides alone.
    spoken = sum(c[0] for c in own) >= STOP_LEAST * sum(c[1] for c in own)
    for b, (hits, n) in zip(kept, counts):
        size = len(b.text)
        links = b.link_chars / size
        stops = hits / n if n else 0.0
        if b.bad or (marked and not b.inside):
            b.label = "bad"
        elif links > MOST_LINKS:
            b.label = "ambiguous" if marked and links < 0.8 else "bad"
        elif size < LENGTH_LOW or b.head:
            b.label = "ambiguous"
        elif stops >= STOP_HIGH:
            b.label = "good"
        elif stops >= STOP_LOW:
            b.label = "good" if size > LENGTH_HIGH or marked else "ambiguous"
        elif not spoken and size > LENGTH_HIGH:
            b.label = "good"
        else:
            b.label = "ambiguous"
    out = []
    last, near = None, [None] * len(kept)
    for i in range(len(kept) - 1, -1, -1):  # the next decided block, by text where the place decides nothing
        near[i] = last
        if kept[i].label != "ambiguous" and not (kept[i].bad or (marked and kept[i].label == "bad")):
            last = kept[i].label
    before = None
    for i, b in enumerate(kept):
        label = b.label
        if label == "ambiguous":
            after = near[i]
            if marked:
                label = "good" if before == "good" or after == "good" or (before is None and after is None) else "bad"
            elif b.head:
                label = "good" if after == "good" else "bad"
            else:
                label = "good" if "good" in (before, after) and "bad" not in (before, after) else "bad"
        elif not (b.bad or (marked and label == "bad")):
            before = label
        if label == "good":
            out.append(b.text)
    return "\n\n".join(out)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "html"):
            texts = [extract(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
