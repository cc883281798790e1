"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from karst.llm.common import table

# Element names of the HTML standard, by what they mean here.
#: Their content is not text.
SILENT = frozenset("script style template noscript iframe object embed svg math canvas audio video head title".split())
#: Their content is no part of an article.
APART = frozenset("nav header footer aside menu dialog button select textarea fieldset".split())
#: They stand beside an article unless they hold it: some pages are one large form.
ASIDE = frozenset(["form"])
#: All that a head holds: any other element ends it, for its end tag may be left out.
OF_HEAD = frozenset("head base link meta title style script template noscript".split())
#: They have no end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: They neither begin nor end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
#: An open element of the first kind ends where one of the others begins.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}
#: Words of class, id and role that mark what stands beside an article.
BESIDE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|banner|cookie|cookies|consent|gdpr|notice|notices|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|"
    r"sidebar|side|aside|rail|widget|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|toc|pagination|pager|header|masthead|footer|foot|copyright|legal|related|recommended|recommendations|trending|"
    r"comment|comments|commentlist|respond|reply|replies|disqus|complementary|contentinfo|search)(?:$|[\s_-]|\d)",
    re.IGNORECASE,
)
#: Those of them that mark what readers added: longer than its article, and still beside it.
ADDED = re.compile(r"(?:^|[\s_-])(?:comment|comments|commentlist|respond|reply|replies|disqus)(?:$|[\s_-]|\d)", re.IGNORECASE)
MAIN = frozenset(["article", "main"])
CLOSES = {tag: [name for name, by in CLOSED_BY.items() if tag in by] for by in CLOSED_BY.values() for tag in by}
#: Lines on either side that smoothing looks at, and the standard deviation of its bell in lines.
RADIUS, SIGMA = 2, 1.0
#: Characters a tag, smoothed, below which lines without a word outside links are a menu, though they stand in an article.
MENU = 1.0

_WHITE = re.compile(r"\s+")
_CODE = re.compile(r"\s*([A-Za-z]{2,3})\b")
#: A letter after < begins no tag if another < comes before any > or attribute value.
_NO_TAG = re.compile("<(?=[A-Za-z][^<>\"'=]*<)")
#: Names of an article's own head, which holds its headline.
_OWN_HEAD = re.compile(r"(?:^|(?<=\s))(?:article|entry|post|story|page|content|single|headline)[-_]+(?:header|head|masthead)(?=$|\s)", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Lines(HTMLParser):
    """Parser events to lines: [text, tags, container, characters outside links]. A line ends at block tags and br; container is the number of
    the innermost article or main element, or 0; text of elements that are apart makes no line. Beside a line stand in
    `within` the numbers of its ancestors whose class, id or role says that they stand beside an article; of each,
    `marked` has whether readers added it, and `holds` the main and article elements inside."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, tuple[int, ...], bool]] = []  # name, silent or apart, container, marked ancestors, in a link
        self.open: dict[str, int] = defaultdict(int)  # names in the stack: it's searched only for what it holds
        self.within: list[tuple[int, ...]] = []
        self.marked: list[bool] = []
        self.holds: list[tuple[str, int, tuple[int, ...], int]] = []  # name, number, marked ancestors, container around
        self.lines: list[tuple[str, int, int, int]] = []
        self.plain = 0
        self.text: list[str] = []
        self.tags = 0
        self.containers = 0
        self.declared: str | None = None

    def _end_line(self) -> None:
        text = _WHITE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((text, self.tags, self.stack[-1][2] if self.stack else 0, self.plain))
            self.within.append(self.stack[-1][3] if self.stack else ())
            self.tags = 0
        self.text.clear()
        self.plain = 0

    def _pop_to(self, i: int) -> None:
        outside = self.stack[i - 1][3] if i else ()
        if any(name not in INLINE or within != outside for name, _, _, within, _ in self.stack[i:]):
            self._end_line()
        for x in self.stack[i:]:
            self.open[x[0]] -= 1
        del self.stack[i:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.open["head"] and tag not in OF_HEAD:
            self._pop_to(next(i for i, x in enumerate(self.stack) if x[0] == "head"))
        closes = CLOSES.get(tag)
        for i in range(len(self.stack) - 1, -1, -1) if closes and any(map(self.open.__getitem__, closes)) else ():
            name = self.stack[i][0]
            if tag in CLOSED_BY.get(name, ()):
                self._pop_to(i)
                break
            if name not in INLINE and name not in CLOSED_BY:
                break
        self.tags += 1
        if self.declared is None and tag in ("html", "meta"):
            self.declared = self._language(tag, attrs)
        if tag not in INLINE:
            self._end_line()
        if tag in VOID:
            return
        _, out, container, within, linked = self.stack[-1] if self.stack else ("", False, 0, (), False)
        if not out:
            out = tag in SILENT or tag in APART or (tag not in MAIN and tag not in ("html", "body") and any(k == "hidden" for k, _ in attrs))
            beside = not out and tag not in MAIN and tag not in ("html", "body") and (tag in ASIDE or self._beside(attrs))
            if out or beside:
                self._end_line()
            if beside:
                self.marked.append(any(ADDED.search(_CAMEL.sub("-", v)) for k, v in attrs if k in ("class", "id", "role") and v))
                within = (*within, len(self.marked) - 1)
        if tag in MAIN and not out:
            self.containers += 1
            self.holds.append((tag, self.containers, within, container))
            container = self.containers
        self.stack.append((tag, out, container, within, linked or tag == "a"))
        self.open[tag] += 1

    @staticmethod
    def _language(tag: str, attrs: list[tuple[str, str | None]]) -> str | None:
        if tag == "meta":
            of = dict(attrs)
            values = [of.get("content")] if (of.get("http-equiv") or "").strip().lower() == "content-language" else []
        else:
            values = [v for k, v in attrs if k in ("lang", "xml:lang")]
        found = [m for v in values if v and (m := _CODE.match(v))]
        return found[0][1].lower() if found else None

    @staticmethod
    def _beside(attrs: list[tuple[str, str | None]]) -> bool:
        return any(k in ("class", "id", "role") and v and BESIDE.search(_OWN_HEAD.sub("", _CAMEL.sub("-", v))) for k, v in attrs)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for i in range(len(self.stack) - 1, -1, -1) if self.open[tag] else ():
            if self.stack[i][0] == tag:
                self._pop_to(i)
                return
        if tag in ("p", "br"):
            self._end_line()

    def handle_data(self, data: str) -> None:
        if not (self.stack and self.stack[-1][1]):
            self.text.append(data)
            if not (self.stack and self.stack[-1][4]):
                self.plain += len(data.strip())

    def close(self) -> None:
        super().close()
        self._end_line()
        self.stack.clear()
        self.open.clear()


def smooth(values: list[float], radius: int = RADIUS, sigma: float = SIGMA) -> list[float]:
    """Gaussian means; at the ends the bell is cut and its weights still sum to one."""
    bell = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(radius + 1)]
    out = []
    for i in range(len(values)):
        near = range(max(0, i - radius), min(len(values), i + radius + 1))
        weights = [bell[abs(i - j)] for j in near]
        out.append(sum(w * values[j] for w, j in zip(weights, near)) / sum(weights))
    return out


def parsed(html: str | None) -> Lines:
    """The events of a page. declared is the language, in lower case, of the first html or content-language meta
    element that names one, wherever it is; comments, scripts and styles hold no elements."""
    html = html or ""
    tail = html.rfind("<")
    if tail >= 0 and ">" not in html[tail:] and re.match("[A-Za-z/!?]", html[tail + 1 : tail + 2]):
        html = html[:tail]  # a tag that the page's end cut off
    html = _NO_TAG.sub("&lt;", html)
    parser = Lines()
    parser.feed(html)
    parser.close()
    return parser


def main_text(html: str | None) -> str:
    return article(parsed(html))


def _dense(lines: list[tuple[str, int, int, int]]) -> list[int]:
    """Lines whose smoothed ratio of characters to tags reaches the lesser of the page's standard deviation and mean."""
    ratios = smooth([len(t) / max(1, tags) for t, tags, *_ in lines])
    mean = sum(ratios) / len(ratios)
    spread = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    threshold = min(mean, spread)
    return [i for i, r in enumerate(ratios) if r >= threshold]


def _without_menus(lines: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """Lines of an article without its menus: runs of lines that are nothing but links, where the smoothed ratio of
    characters outside links to tags falls below MENU somewhere in the run. A single link between paragraphs is
    carried by them."""
    ratios = smooth([plain / max(1, tags) for _, tags, _, plain in lines])
    out: list[tuple[str, int, int, int]] = []
    start = 0
    while start < len(lines):
        end = start + 1
        if not lines[start][3]:
            while end < len(lines) and not lines[end][3]:
                end += 1
        if lines[start][3] or min(ratios[start:end]) >= MENU:
            out += lines[start:end]
        start = end
    return out


def _left(page: Lines) -> list[tuple[str, int, int, int]]:
    """The page's lines without those of marked elements that stand beside the article. A mark doesn't count where
    the element holds a main element, or the page's only articles, or most of its text in dense lines - of what
    readers added, only if nothing else would be left. Tags of a line that goes count for the next one."""
    if not page.marked or not page.lines:
        return page.lines
    stays = {m for name, _, within, _ in page.holds if name == "main" for m in within}
    full = {c for _, _, c, _ in page.lines}
    outer = [(within, around) for name, number, within, around in page.holds if name == "article" and number in full]
    if not any(stays.issuperset(within) for within, _ in outer) and not any(name == "main" and number in full for name, number, *_ in page.holds):
        stays |= {m for within, around in outer if not around for m in within if not page.marked[m]}
    weight, total = [0] * len(page.marked), 0
    for i in _dense(page.lines):
        total += len(page.lines[i][0])
        for m in page.within[i]:
            weight[m] += len(page.lines[i][0])
    most = {m for m, w in enumerate(weight) if 2 * w > total}
    stays |= {m for m in most if not page.marked[m]}
    for kept in (stays, stays | most):
        lines, tags = [], 0
        for (text, n, container, plain), within in zip(page.lines, page.within):
            tags += n
            if kept.issuperset(within):
                lines.append((text, tags, container, plain))
                tags = 0
        if lines:
            break
    return lines


def article(page: Lines) -> str:
    """The article's blocks, joined by newlines.

    Lines whose smoothed ratio of characters to tags reaches the threshold - the lesser of the page's standard
    deviation and mean - form the content clusters. The container (innermost article or main element, or the rest
    of the page) with the most text in clusters holds the article, with containers inside it that have clusters.
    In a marked container all lines count but those of menus (see _without_menus): a short paragraph of an article is
    part of it. Outside of one, the lines from the first to the last of a cluster do. Which elements stand beside the article is judged by _left.
    """
    lines = _left(page)
    if not lines:
        return ""
    chosen = _dense(lines)
    weight: dict[int, int] = {}
    for i in chosen:
        weight[lines[i][2]] = weight.get(lines[i][2], 0) + len(lines[i][0])
    marked = {c: w for c, w in weight.items() if c}
    if marked:
        inside = [x for x in lines if x[2] in marked]
        return "\n".join(t for t, *_ in _without_menus(inside) or inside)
    return "\n".join(t for t, *_ in lines[chosen[0] : chosen[-1] + 1])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html, with text and n_chars (code points). One row a page, repeated rows too; null, empty and
    text-less pages have an empty text; pages of any length are read whole, in time that grows with the length; an empty table gives no row; a column text or n_chars of pages gives way."""
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                piece = batch.slice(lo, 512)
                texts = [main_text(h) for h in piece.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(kept)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*kept, "text", "n_chars"])

    schema = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in kept) + "text string, n_chars bigint"
    return pages.select(*[f"`{c}`" for c in kept], html_col).mapInArrow(run, schema)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
