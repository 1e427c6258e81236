"""HTML extraction by two-pass block rules.

The page is cut into blocks at block-level tags. Pass one classifies every block: link-heavy
ones, and those that stand in menus, forms, adverts and the like, are out; long or middling
ones with enough stop words are main text; long ones without stop words are out unless they
stand in the article (tables, code); short ones and headings stay open, wherever they stand.
Where an article element holds main text, blocks outside it are out. Pass two gives an open
block the label of the nearest decided block, one of its own zone (article, menu, rest of the
page) before any other; of two equally near, the good one only if both are good, a heading
the one that follows. A zone without decided blocks keeps its open ones if it is the article.

Scripts, styles, comments and unseen elements are removed whole; character references are
decoded; white space inside a block becomes one space; blocks are joined by one newline.
Unclosed and crossing tags are tolerated, as are ``<`` and quotes that close nowhere; the scan
takes linear time whatever the page. Null or empty html: empty text. Repeated rows and null
ids are carried, ties need no order, an empty table gives an empty result; other columns are
ignored, whatever their names. Texts of any length are read whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .op3_quality import STOP_WORDS

SHORT = 70
LONG = 200
LINKS = 0.5
STOP_LOW, STOP_HIGH = 0.12, 0.25

# Element names by their role.
UNSEEN = "script style noscript template iframe svg math object canvas head select textarea button audio video".split()
BLOCKS = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul"
).split()
OUT = "nav footer aside form menu dialog fieldset".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
#: Words of class, id and role attributes that mark what is not the article.
OUT_WORDS = (
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal "
    "nav navbar navigation newsletter notice notification pagination pager popup promo promotion related replies reply respond share sharing sidebar social sponsor sponsored subscribe toolbar widget "
    "contentinfo complementary search alert disclaimer signup login"
).split()

#: Of these, the ones that count on an article element.
OUT_ARTICLES = "ad advert advertisement comment comments promo related replies reply sidebar sponsored".split()

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
#: Attributes up to the end of a tag; quotes count only behind an equals sign.
_ATTRIBUTES = re.compile(r"""(?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+""")
_CLOSE = {t: re.compile(rf"</{t}\s*+>", re.I) for t in UNSEEN}
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_BLOCKS, _OUT, _VOID, _UNSEEN = frozenset(BLOCKS), frozenset(OUT), frozenset(VOID), frozenset(UNSEEN)
_OUT_WORDS, _OUT_ARTICLES, _STOP = frozenset(OUT_WORDS), frozenset(OUT_ARTICLES), frozenset(STOP_WORDS)


def _marks_out(name: str, attributes: str, in_article: bool) -> bool:
    if name in _OUT or (name == "header" and not in_article):
        return True
    if not attributes:
        return False
    if _HIDDEN.search(attributes):
        return True
    if name in ("main", "body", "html"):
        return False
    words = _OUT_WORDS if name != "article" else _OUT_ARTICLES
    return any(p.lower() in words for m in _NAMES.findall(attributes) for p in _PART.findall(next((x for x in m if x), "")))


class _Block:
    __slots__ = ("article", "heading", "linked", "out", "text", "zone")

    def __init__(self, text: str, linked: int, out: bool, article: bool, heading: bool, zone: int):
        self.text, self.linked, self.out, self.article, self.heading, self.zone = text, linked, out, article, heading, zone


class _Scanner:
    """Tags of a page in order, in time linear in its length."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.last = page.rfind(">")  # no tag ends behind it
        self.quotes = True  # until a quote or tag closes nowhere: then tags end at the next >
        self.unclosed: set[str] = set()

    def next(self) -> tuple[str, str, str, str]:
        """(text before, "/" or "", name, attributes); the name is empty for comments, declarations and the page's end."""
        page, begin, look = self.page, self.at, self.at
        while True:
            lt = page.find("<", look)
            if lt < 0 or lt >= self.last:
                if lt >= 0 and page.startswith("<!--", lt):  # a comment without an end
                    self.at = len(page)
                    return page[begin:lt], "", "", ""
                self.at = len(page)
                return page[begin:], "", "", ""
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                self.at = len(page) if end < 0 else end + 3
                return page[begin:lt], "", "", ""
            if page[lt + 1] in "!?":
                self.at = page.find(">", lt) + 1
                return page[begin:lt], "", "", ""
            m = _NAME.match(page, lt + 1)
            if not m:
                look = lt + 1
                continue
            end = _ATTRIBUTES.match(page, m.end()).end() if self.quotes else -1
            if end < 0 or end == len(page) or page[end] != ">":
                self.quotes = False
                end = page.find(">", m.end())
            self.at = end + 1
            return page[begin:lt], m[1], m[2].lower(), page[m.end() : end]

    def skip(self, name: str) -> None:
        """Behind the end tag of an element that is not seen; one without an end takes the rest of the page (a head: nothing)."""
        c = None if name in self.unclosed else _CLOSE[name].search(self.page, self.at)
        if c:
            self.at = c.end()
            return
        self.unclosed.add(name)
        if name != "head":
            self.at = len(self.page)


def blocks(page: str) -> list[_Block]:
    """The non-empty blocks in page order."""
    found: list[_Block] = []
    parts: list[str] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether they are outside the main text
    marked: list[int] = []  # places in the stack of those that only their names mark as outside
    opened: Counter[str] = Counter()
    linked = out = article = zone = breaks = 0
    state = (False, False)
    link = -1  # elements open around the link that is open
    heading = False
    scan = _Scanner(page)

    def close_block() -> None:
        nonlocal parts, linked, breaks, zone, state
        text = " ".join("".join(parts).split())
        if text:
            if state != (now := (out > 0, article > 0)):
                zone, state = zone + 1, now
            found.append(_Block(text, linked, *now, heading, zone))
        parts, linked, breaks = [], 0, 0

    def pop() -> str:
        nonlocal out, article, link
        n, was_out = stack.pop()
        opened[n] -= 1
        out -= was_out
        article -= n in ("article", "main")
        if marked and marked[-1] == len(stack):
            marked.pop()
        if link > len(stack):
            link = -1
        return n

    while scan.at < len(page):
        raw, closing, name, attributes = scan.next()
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if text.strip():
                breaks = 0
                if link >= 0:
                    linked += len(" ".join(text.split()))
        if not name:
            continue
        if closing:
            if name in _BLOCKS:
                close_block()
            if name == "a":
                link = -1
            if name[0] == "h" and name[1:] in "123456":
                heading = False
            if opened[name]:
                while pop() != name:
                    pass
            continue
        if name in _UNSEEN:
            if not attributes.endswith("/"):
                scan.skip(name)
            parts.append(" ")
            continue
        if name == "br":
            breaks += 1
            parts.append(" ")
            if breaks > 1:
                close_block()
            continue
        if name in _BLOCKS:
            close_block()
            heading = name[0] == "h" and name[1:] in ("1", "2", "3", "4", "5", "6")
            if name in ("p", "li", "tr", "td", "th", "dd", "dt", "option") and stack and stack[-1][0] == name:  # end tags that may be left out
                pop()
        elif name == "a":
            link = len(stack)
        if name in _VOID or attributes.endswith("/"):
            continue
        if name in _BLOCKS or name in ("span", "ins"):
            if name in ("article", "main") and not article:
                for i in marked:  # an unclosed advert does not swallow the article
                    stack[i] = (stack[i][0], False)
                    out -= 1
                marked = []
            marks = _marks_out(name, attributes, article > 0)
            if marks and name not in _OUT:
                marked.append(len(stack))
            stack.append((name, marks))
            opened[name] += 1
            out += marks
            article += name in ("article", "main")
    close_block()
    return found


def density(text: str) -> float:
    """Share of stop words among the words."""
    words = _LETTERS.findall(text.lower())
    return sum(w in _STOP for w in words) / max(1, len(words))


def first_pass(b: _Block) -> bool | None:
    """Whether a block is main text by its own links, length and stop words and by where it stands; None if that does not say."""
    n = len(b.text)
    if b.out or b.linked > LINKS * n:
        return False
    if n < SHORT or b.heading:
        return False if b.text.startswith(("©", "Copyright")) else None
    stop = density(b.text)
    if stop >= STOP_HIGH or (stop >= STOP_LOW and n >= LONG):
        return True
    return None if stop >= STOP_LOW or b.article else False


def labels(found: list[_Block]) -> list[bool]:
    """Whether each block is main text."""
    first = [first_pass(b) for b in found]
    if any(x and b.article for x, b in zip(first, found, strict=True)):
        first = [x if b.article else False for x, b in zip(first, found, strict=True)]  # the page says where its article is
    decided = [i for i, x in enumerate(first) if x is not None]
    out: list[bool] = []
    k = 0
    for i, x in enumerate(first):
        if x is not None:
            out.append(x)
            continue
        while k < len(decided) and decided[k] < i:
            k += 1
        near = [j for j in ((decided[k - 1] if k else None), (decided[k] if k < len(decided) else None)) if j is not None]
        own = [j for j in near if found[j].zone == found[i].zone]
        if not own and found[i].article:
            out.append(True)
        elif not near:
            out.append(not found[i].heading or len(found) == 1)
        else:
            near = own or near
            least = min(abs(i - j) for j in near)
            near = [j for j in near if abs(i - j) == least]
            out.append(bool(first[near[-1]]) if found[i].heading else all(first[j] for j in near))
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, labels(found), strict=True) if keep)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and the main text of every page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    read = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("html"))
    return read.mapInArrow(work, "page_id long, url string, text string")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


# The article of pages that mark it and hold only paragraphs, headings, breaks and bold text, as the given ones do; the rules are not in it.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_PLAIN = "replace(replace(replace(replace(regexp_replace(s, '<[^>]*>', '', 'g'), '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&#39;', chr(39))"
SQL = f"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(replace(x, '<br>', ' '), '</?(p|h1)>', chr(1), 'g'), chr(1)) AS l FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(l, lambda s: trim(regexp_replace(regexp_replace({_PLAIN}, '&amp;?', '&', 'g'), '{_SPACE}', ' ', 'g'))), lambda s: s <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t"""
