"""Pages to links and texts. HTML is parsed by the standard library's event parser, in Arrow batches; everything else stays in expressions.

Defined results: a null page is an empty one, without links and with the empty text; what a page's parser or a reference
raises is reported in its row; a URL that is met repeatedly counts where it comes first; an empty table gives no rows;
columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import collapse, pstrip

#: Elements without an end tag, elements whose text is not content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset({"script", "style", "template"})
LINKS = "array<struct<pos:int,href:string,h3:string>>"
#: Shortest text that counts, and its error.
MIN_LENGTH, TOO_SHORT = 100, "EMPTY_OR_SHORT"


def _matches(tag: str, attrs: dict[str, str], selector: tuple[str, str | None, str | None]) -> bool:
    """selector: (tag, attribute, value); the value of `class` is one of its words."""
    name, attribute, value = selector
    if tag != name or attribute is None:
        return tag == name
    own = attrs.get(attribute)
    return own is not None and (value is None or (value in own.split() if attribute == "class" else own == value))


class _Texts(HTMLParser):
    """Text nodes of the elements that a selector matches, one list per element, line breaks as line ends."""

    def __init__(self, selector):
        super().__init__(convert_charrefs=True)
        self.selector, self.stack, self.open, self.found = selector, [], [], []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            for k in self.open:
                self.found[k].append("\n")
        if tag in VOID:
            return
        hit = _matches(tag, {k: v or "" for k, v in attrs}, self.selector)
        if hit:
            self.found.append([])
            self.open.append(len(self.found) - 1)
        self.stack.append((tag, hit))

    def handle_startendtag(self, tag, attrs):
        if tag == "br":
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.stack):
            while self.stack:
                t, hit = self.stack.pop()
                if hit:
                    self.open.pop()
                if t == tag:
                    break

    def handle_data(self, data):
        if not any(t in SILENT for t, _ in self.stack):
            for k in self.open:
                self.found[k].append(data)


class _Links(HTMLParser):
    """Anchors with their href and the text of a heading inside."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.heading = [], False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.found.append([dict(attrs).get("href"), None])
        elif tag == "h3" and self.found and self.found[-1][1] is None:
            self.heading, self.found[-1][1] = True, ""

    def handle_endtag(self, tag):
        if tag in ("h3", "a"):
            self.heading = False

    def handle_data(self, data):
        if self.heading:
            self.found[-1][1] += data.strip()


def element_texts(html: str, selector) -> list[str]:
    """Text of each matching element: its text nodes, stripped, one a line, empty ones left out."""
    parser = _Texts(selector)
    parser.feed(html)
    parser.close()
    return ["\n".join(s for s in (x.strip() for x in nodes) if s) for nodes in parser.found]


def page_text(html: str | None, selectors: list) -> str:
    """Texts of the first selector's elements, a blank line apart; of a later selector, only the first element counts."""
    for k, selector in enumerate(selectors):
        found = element_texts(html or "", selector)
        if found:
            return "\n\n".join(found) if k == 0 else found[0]
    return ""


def extract_text(pages: DataFrame, key: str = "page_id", html: str = "html", selectors: list | None = None) -> DataFrame:
    """key, text, error: what a page's parser raises is caught in its row."""
    chosen = selectors or [("div", "data-lyrics-container", "true"), ("div", "class", "lyrics")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, page in zip(f[key], f[html], strict=True):
                try:
                    rows.append((k, page_text(page, chosen), None))
                except Exception as why:  # noqa: BLE001  a page's error belongs to its row
                    rows.append((k, None, f"{type(why).__name__}: {why}"))
            yield pd.DataFrame(rows, columns=[key, "text", "error"])

    kind = pages.schema[key].dataType.simpleString()
    out = pages.select(key, html).mapInPandas(run, f"{key} {kind}, text string, error string")
    return out.withColumn("text", collapse(F.col("text")))


def length_gate(texts: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """texts with `status`: null where the text is long enough."""
    return texts.withColumn("status", F.when(F.length(F.coalesce("text", F.lit(""))) < least, TOO_SHORT))


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Anchors of well-formed href="..." attributes, by expression: key, pos, href."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("pos", "href"))


def parsed_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """All anchors, by parser: key, pos, href, h3, error. A page that cannot be parsed is one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, page in zip(f[key], f[html], strict=True):
                parser = _Links()
                try:
                    parser.feed(page or "")
                    rows += [(k, i, href, h3, None) for i, (href, h3) in enumerate(parser.found)]
                except Exception as why:  # noqa: BLE001  a page's error belongs to its row
                    rows.append((k, None, None, None, f"{type(why).__name__}: {why}"))
            yield pd.DataFrame(rows, columns=[key, "pos", "href", "h3", "error"]).astype({"pos": "Int32"})

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, pos int, href string, h3 string, error string")


def resolve(base: str, href: Column) -> Column:
    """Absolute URL of the common kinds of references: absolute, //host, /path, query, fragment and plain relative paths."""
    scheme, rest = base.split("://", 1)
    host, _, path = rest.partition("/")
    folder = f"{scheme}://{host}/" + (path.rsplit("/", 1)[0] + "/" if "/" in path else "")
    return (
        F.when(F.regexp_like(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), href)
        .when(href.startswith("//"), F.concat(F.lit(f"{scheme}:"), href))
        .when(href.startswith("/"), F.concat(F.lit(f"{scheme}://{host}"), href))
        .when(href == "", F.lit(base))
        .when(href.startswith("#") | href.startswith("?"), F.concat(F.lit(base.split("#")[0].split("?")[0]), href))
        .otherwise(F.concat(F.lit(folder), href))
    )


def resolve_any(base: str, href: Column) -> Column:
    """struct<url, error> of every reference of RFC 3986: by expression where it is a plain path or an absolute URL without
    brackets, by Python where dot segments, brackets or control characters are in it. A reference that raises has no url."""

    def one(h: str | None) -> tuple[str | None, str | None]:
        try:
            return (None, None) if h is None else (urljoin(base, h), None)
        except ValueError as why:
            return None, f"{type(why).__name__}: {why}"

    @F.pandas_udf("url string, error string")
    def join(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(h) for h in values], columns=["url", "error"])

    name = r"[A-Za-z0-9_~%-]+(\.[A-Za-z0-9_~%-]+)*"
    plain = F.regexp_like(href, F.lit(rf"^((https?://|//)[A-Za-z0-9.:-]+)?/?({name}(/{name})*)?/?$")) & (href != "")
    rest = join(F.when(~plain, href))
    return F.struct(F.when(plain, resolve(base, href)).otherwise(rest["url"]).alias("url"), F.when(~plain, rest["error"]).alias("error"))


def url_path(url: Column) -> Column:
    return F.ltrim(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))


def first_seen(found: DataFrame, url: str, *order: str) -> DataFrame:
    """The first row of each URL, in order of the given columns: a minimum, which is taken before the shuffle as well, so
    that copies of a popular link never meet in one task. Further ties follow the other columns."""
    others = [c for c in found.columns if c not in (url, *order)]
    first = found.groupBy(url).agg(F.min(F.struct(*order, *others)).alias("first of its url"))
    return first.select(*[F.col(url) if c == url else F.col(f"`first of its url`.`{c}`").alias(c) for c in found.columns])


def slug_title(path: Column, prefix: str, suffix: str = "-lyrics") -> Column:
    bare = F.replace(F.replace(path, F.lit(prefix), F.lit("")), F.lit(suffix), F.lit(""))
    return F.replace(bare, F.lit("-"), F.lit(" "))


def song_index(pages: DataFrame, base: str, contains: str, prefix: str) -> DataFrame:
    """Pages -> title, url of the songs they link to."""
    rows = parsed_links(pages).filter(F.col("href").contains(contains) & (F.col("href") != ""))
    rows = rows.withColumn("url", resolve_any(base, F.col("href"))["url"]).filter("url IS NOT NULL").withColumn("path", url_path(F.col("url"))).filter(F.col("path").startswith(prefix))
    return first_seen(rows, "url", "page_id", "pos").select(F.coalesce("h3", slug_title(F.col("path"), prefix)).alias("title"), "url")


def todo(index: DataFrame, done: DataFrame, artist: str) -> DataFrame:
    """Index entries still to be fetched: artist, title, url. Entries that repeat within the index stay."""
    wanted = index.select(F.lit(artist).alias("artist"), pstrip(F.coalesce("title", F.lit(""))).alias("title"), pstrip(F.coalesce("url", F.lit(""))).alias("url")).filter("url <> ''")
    return wanted.join(done.select("url").filter("url IS NOT NULL").distinct(), "url", "left_anti").select("artist", "title", "url")
