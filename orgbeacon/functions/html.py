"""Text, title and links of html pages, each page parsed once, and what is chosen from them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from orgbeacon.functions.codes import CODE_LENGTHS, looks_parked, or_empty, published_inns

# Paths that often hold registry codes, and words of links to such pages.
COMMON_PATHS = ("/contacts", "/contact", "/kontakty", "/about", "/o-kompanii", "/o-nas")
LINK_WORDS = (
    "контакт", "contact", "о компании", "о нас", "about", "реквизит", "requisite", "оферт", "offer", "политик", "privacy",
    "юридическ", "info",
)
NO_LINK = ("#", "mailto:", "tel:", "javascript:")
MOST_HTML, MOST_TITLE, MOST_LINKS, MOST_PAGES, MOST_ERROR = 400_000, 200, 6, 5, 200


_CODE = StructType([StructField("code", StringType()), StructField("excerpt", StringType())])
_PAGE = StructType([StructField("text", StringType()), StructField("title", StringType()), StructField("links", ArrayType(StringType())), StructField("codes", ArrayType(_CODE)), StructField("parse_error", StringType())])
_ROWS = pa.struct([("text", pa.string()), ("title", pa.string()), ("links", pa.list_(pa.string())), ("codes", pa.list_(pa.struct([("code", pa.string()), ("excerpt", pa.string())]))), ("parse_error", pa.string())])
_RUN = re.compile(f"[0-9]{{{min(CODE_LENGTHS)},}}")
# Most tags are these, without attributes; they mean nothing to the handlers below.
_PLAIN = re.compile("</?(p|b|i|u|em|strong|small|span|div|br|hr|ul|ol|li|dl|dt|dd|table|tbody|thead|tr|td|th|h[1-6]|article|section|nav|header|footer|main|aside|blockquote)>")
#: Pages that a worker holds as Python objects at a time; the rest of a batch stays in Arrow buffers, which Spark bounds in bytes.
PAGES_AT_ONCE = 100


class _Page(HTMLParser):
    hidden = frozenset({"script", "style", "noscript", "svg"})

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.title: str | None = None
        self.links: list[tuple[str, str]] = []
        self.skip = 0
        self.in_title = False
        self.open_links: list[tuple[str, list[str]]] = []

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for line numbers

    def parse_starttag(self, i: int) -> int:
        plain = _PLAIN.match(self.rawdata, i)
        return super().parse_starttag(i) if plain is None else plain.end()

    def parse_endtag(self, i: int) -> int:
        plain = _PLAIN.match(self.rawdata, i) if self.cdata_elem is None else None
        return super().parse_endtag(i) if plain is None else plain.end()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.hidden:
            self.skip += 1
        elif tag == "title" and not self.skip:
            self.in_title, self.title_parts = True, []
        elif tag == "a":
            self._close_link()
            href = dict(attrs).get("href")
            if href is not None:
                self.open_links.append((href, []))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in self.hidden:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            self.skip = max(0, self.skip - 1)
        elif tag == "title" and self.in_title:
            self.in_title = False
            if self.title is None:
                self.title = "".join(self.title_parts)
        elif tag == "a":
            self._close_link()

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title_parts.append(data)
        elif not self.skip:
            if piece := data.strip():
                self.pieces.append(piece)
            for _, own in self.open_links:
                own.append(data.strip())

    def _close_link(self) -> None:
        if self.open_links:
            href, own = self.open_links.pop()
            self.links.append((href, "".join(own)))

    def done(self) -> None:
        self.close()
        self._close_link()
        if self.in_title and self.title is None:
            self.title = "".join(self.title_parts)


def ranked_links(links: list[tuple[str, str]], base: str | None, limit: int = MOST_LINKS) -> list[str]:
    """The links (href, text) likely to lead to registry codes: absolute, each once, the likeliest first, then in page order.

    A word in the text weighs 2, in the address alone 1; links without such a word are left out.
    """
    found: dict[str, int] = {}
    for href, text in links:
        text = text.lower()
        both = f"{text} {href.lower()}"
        weight = sum(2 if w in text else 1 for w in LINK_WORDS if w in both)
        if weight and not href.startswith(NO_LINK):
            try:
                found.setdefault(urljoin(base or "", href).split("#")[0], weight)
            except ValueError:
                continue
    return sorted(found, key=lambda url: -found[url])[:limit]


def codes_with_excerpts(text: str, width: int = 160) -> list[dict]:
    """The distinct maximal digit runs that have the length of a registry code, each with the text around its first place."""
    found: dict[str, str] = {}
    for run in _RUN.finditer(text):
        if len(run[0]) in CODE_LENGTHS and run[0] not in found:
            found[run[0]] = text[max(0, run.start() - width // 2) : run.end() + width // 2].strip()
    return [{"code": c, "excerpt": e} for c, e in found.items()]


def _parsed(html: str | None, base: str | None) -> dict:
    page, error = _Page(), None
    if html:
        try:
            page.feed(html)
            page.done()
        except Exception as failed:  # a page that can't be parsed must not end the job: it is reported beside the others
            page, error = _Page(), f"page: {type(failed).__name__}: {failed}"[:MOST_ERROR]
    text = " ".join(" ".join(page.pieces).split())
    return {"text": text, "title": (page.title or "").strip()[:MOST_TITLE], "links": ranked_links(page.links, base), "codes": codes_with_excerpts(text), "parse_error": error}


@F.arrow_udf(_PAGE)
def parse_page(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Text, title, interesting links and codes of each page, and why it can't be parsed, if it can't."""
    for html, base in batches:
        for at in range(0, len(html), PAGES_AT_ONCE):
            few = zip(html.slice(at, PAGES_AT_ONCE), base.slice(at, PAGES_AT_ONCE), strict=True)
            yield pa.array([_parsed(h.as_py(), b.as_py()) for h, b in few], _ROWS)


def crawl_targets(domain: Column, home_url: Column, final_url: Column, links: Column) -> Column:
    """Further pages to look at: interesting links, then common paths; not the home page; at most five."""
    paths = F.array(*(F.concat(F.lit("https://"), domain, F.lit(p)) for p in COMMON_PATHS))
    known = F.array(home_url, final_url)
    return F.slice(F.array_distinct(F.array_except(F.concat(links, paths), known)), 1, MOST_PAGES)


def page_text(pages: DataFrame) -> DataFrame:
    """``pages`` with text, title, links and codes in place of html; pages are independent, so this is a map."""
    return pages.withColumn("__p", parse_page("html", F.coalesce("final_url", "url"))).select(*(c for c in pages.columns if c != "html"), (F.length(or_empty("html")) > 0).alias("has_html"), "__p.*")


def page_facts(parsed: DataFrame) -> DataFrame:
    """What verification needs of parsed pages, short beside their text: url, final_url, status, has_html, title, links, codes, the two
    least numbers published (one of them is foreign to any organisation, if there is one), parked, how the text begins, and parse_error."""
    published = F.slice(F.array_sort(published_inns("text")), 1, 2)
    return parsed.select("url", F.coalesce("final_url", "url").alias("final_url"), "status", "has_html", "title", "links", "codes", published.alias("published"), looks_parked("text").alias("parked"), F.substring("text", 1, 200).alias("head"), "parse_error")


def page_view(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """From wanted (url) and parsed pages: what each page shows in short, or why it can't be read."""
    asked = wanted.select("url", F.when(F.contains("url", F.lit("://")), F.col("url")).otherwise(F.concat(F.lit("https://"), "url")).alias("page_url"))
    known = pages.select(F.col("url").alias("page_url"), "status", "title", "text", "has_html", "error")
    shown = F.format_string("title: %s\ntext: %s", "title", F.substring("text", 1, 1400))
    unread = F.format_string("page not readable (status=%s, error=%s)", F.coalesce(F.col("status").cast("string"), F.lit("None")), F.coalesce("error", F.lit("None")))
    return asked.join(known, "page_url", "left").select("url", F.when(F.col("has_html"), shown).otherwise(unread).alias("view"))
