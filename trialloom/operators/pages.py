"""Fetched web pages: URLs, contents, links."""

from __future__ import annotations

import html as html_module
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialloom.functions.text import SPACE, col, strip

# Query keys that only track, and characters that are replaced in page texts.
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "source")
SPECIAL_CHARACTERS = {"【": "〖", "】": "〗", "◼": "◾", "​": ""}
# Marks around a link's number, text and domain in page texts, and what stands for the inner mark in texts.
LINK_OPEN, LINK_CLOSE, LINK_SEP, LINK_SEP_ALT = "【", "】", "†", "‡"

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def normalize_url(c: Column | str) -> Column:
    """A URL's form for history: https, lower host without www., no fragment, trailing slash or tracking keys.

    Text without a host is stripped only; null and "" give "". The query's keys and values are decoded and
    written anew, so that %20 and + are one; a % that begins no escape stands for itself."""
    url = strip(col(c))
    part = lambda i: F.regexp_extract(url, _URL, i)
    scheme = F.lower(part(1))
    scheme = F.when(scheme.isin("http", "https", ""), "https").otherwise(scheme)
    host = F.regexp_replace(F.lower(part(2)), r"^www\.", "")
    path = F.when(part(3) == "/", "/").otherwise(F.regexp_replace(part(3), "/+$", ""))
    plain = lambda x: F.url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))
    coded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pairs = F.transform(F.filter(F.split(part(4), "&"), lambda p: p != ""), lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("k"), plain(F.regexp_replace(p, "^[^=]*=?", "")).alias("v")))
    kept = F.filter(pairs, lambda p: ~F.lower(p.k).startswith("utm_") & ~F.lower(p.k).isin(*TRACKING_KEYS))
    query = F.array_join(F.transform(kept, lambda p: F.concat(coded(p.k), F.lit("="), coded(p.v))), "&")
    whole = F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.coalesce(F.when(part(2) != "", whole).otherwise(url), F.lit(""))


def filter_visited(results: DataFrame, history: DataFrame, by: str = "query_id", order: str = "pos", url: str = "url") -> DataFrame:
    """Results whose normalised URL is not in ``history`` (url), the first of each in order; with an empty history all of them as they are."""
    if history.isEmpty():
        return results
    seen = history.select(F.col("url").alias("_u")).distinct()
    out = results.where(F.coalesce(F.col(url) != "", F.lit(False))).withColumn("_u", normalize_url(url))
    first = out.withColumn("_n", F.row_number().over(Window.partitionBy(by, "_u").orderBy(order))).where("_n = 1").drop("_n")
    return first.join(seen, "_u", "left_anti").drop("_u")


def count_skipped(results: DataFrame, history: DataFrame, by: str = "query_id", url: str = "url") -> DataFrame:
    """How many different URLs of each query the history holds."""
    u = results.select(by, normalize_url(url).alias("_u")).distinct()
    return u.join(history.select(F.col("url").alias("_u")).distinct(), "_u", "left_semi").groupBy(by).agg(F.count("*").alias("skipped"))


def content_signature(c: Column | str) -> Column:
    """SHA-256 of the first 2000 characters of the text with white space collapsed."""
    compact = strip(F.regexp_replace(col(c), f"{SPACE}+", " "))
    return F.sha2(F.substring(compact, 1, 2000), 256)


def dedupe_content(pages: DataFrame, text: str, order: str) -> DataFrame:
    """The first page of each content signature, with the signature. ``order`` must tell pages apart.

    Only signatures and order are ranked, once; whole pages follow by a join with the survivors."""
    first = pages.groupBy(content_signature(F.coalesce(text, F.lit(""))).alias("signature")).agg(F.min(order).alias(order))
    return pages.join(first, order)


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html_module.unescape, na_action="ignore")


def html_to_text(c: Column | str) -> Column:
    """Text of a page: characters outside the basic plane go, tags become blanks, entities characters, white space one blank."""
    return strip(F.regexp_replace(_unescape(F.regexp_replace(_plain_characters(c), "<[^>]+>", " ")), f"{SPACE}+", " "))


def _plain_characters(c: Column | str) -> Column:
    t = F.regexp_replace(col(c), r"[\x{10000}-\x{1FFFF}]", "")
    for a, b in SPECIAL_CHARACTERS.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


class _Page(HTMLParser):
    """Writes a page as text with link and image marks, headings and lists."""

    HIDDEN = frozenset(("head", "script", "style", "math", "template"))
    BLOCKS = frozenset("address article aside blockquote body div dl dd dt figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table tr ul".split())

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.here = url, urlparse(url).netloc
        self.out: list[str] = []
        self.links: dict[str, int] = {}
        self.images, self.hidden, self.anchor = 0, 0, None

    def _write(self, text: str) -> None:
        (self.out if self.anchor is None else self.anchor[1]).append(text)

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in self.HIDDEN:
            self.hidden += 1
        elif self.hidden:
            pass
        elif tag == "a" and attrs.get("href") is not None:
            self._close_anchor()
            self.anchor = (attrs["href"], [])
        elif tag == "img":
            name = attrs.get("alt", attrs.get("title"))
            self._write(f"[Image {self.images}: {name}]" if name else f"[Image {self.images}]")
            self.images += 1
        elif tag == "br":
            self._write("\n")
        elif tag == "li":
            self._write("\n  * ")
        elif tag in self.BLOCKS:
            self._write("\n\n" + ("#" * int(tag[1]) + " " if tag in ("h1", "h2", "h3", "h4", "h5", "h6") else ""))

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "a":
            self._close_anchor()
        elif tag in self.BLOCKS and not self.hidden:
            self._write("\n\n")

    def handle_data(self, data):
        if not self.hidden:
            self._write(re.sub(r"\s+", " ", data))

    def _close_anchor(self) -> None:
        if self.anchor is None:
            return
        (link, parts), self.anchor = self.anchor, None
        text = re.sub(r"\s+", " ", "".join(parts)).replace(LINK_SEP, LINK_SEP_ALT)
        try:
            whole = urljoin(self.url, link)
            domain = urlparse(whole).netloc
        except ValueError:
            domain = ""
        if text and self.url and domain and not link.startswith(("mailto:", "javascript:", "#")):
            n = self.links.setdefault(whole.replace("arxiv.org", "ar5iv.org"), len(self.links))
            text = f"{LINK_OPEN}{n}{LINK_SEP}{text}{'' if domain == self.here else LINK_SEP + domain}{LINK_CLOSE}"
        self._write(text)

    def text(self, page: str) -> str:
        page = re.sub(r"<su([pb])(?: [^>]*)?>([\w\-]+)</su\1>", lambda m: ("^" if m[1] == "p" else "_") + "{" + m[2] + "}", page)
        self.feed(page)
        self.close()
        self._close_anchor()
        lines = "".join(self.out).split("\n")
        joined = "\n".join(x.rstrip() if x.startswith("  * ") else x.strip() for x in lines)
        return re.sub(r"\n(\s*\n)+", "\n\n", re.sub(r"(?m)^[^\S\n]+$", "", joined)).strip()


@F.pandas_udf(T.StringType())
def _page_text(page: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else _Page(u or "").text(p) for p, u in zip(page, url)], dtype=object)


def page_text(html: Column | str, url: Column | str) -> Column:
    """A page as text that keeps its structure, for reading by a model.

    Links become 【n†text】, with †domain for other hosts, n counting a page's distinct links; images become
    [Image n: name]; headings, list items and line breaks are written as in markdown; scripts, styles, formulas and
    the head go. Without a URL links are their texts. Null stays null."""
    return _page_text(_plain_characters(html), col(url))


_ANCHOR = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)')[^>]*>(.*?)</a>""", re.IGNORECASE | re.DOTALL)


def _links(url: str | None, page: str | None) -> list[dict]:
    out: dict[str, dict] = {}
    if not url or not page:
        return []
    here = urlparse(url).netloc
    for m in _ANCHOR.finditer(page):
        link = html_module.unescape(m[1] if m[1] is not None else m[2])
        text = " ".join(html_module.unescape(re.sub("<[^>]+>", " ", m[3])).split())
        if not text or link.startswith(("mailto:", "javascript:", "#")):
            continue
        try:
            link = urljoin(url, link)
            domain = urlparse(link).netloc
        except ValueError:
            continue
        if domain:
            link = link.replace("arxiv.org", "ar5iv.org")
            out.setdefault(link, {"id": len(out), "link": link, "domain": domain, "internal": domain == here})
    return list(out.values())


_LINK = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("link", T.StringType()), T.StructField("domain", T.StringType()), T.StructField("internal", T.BooleanType())])


@F.pandas_udf(T.ArrayType(_LINK))
def _extract(url: pd.Series, page: pd.Series) -> pd.Series:
    return pd.Series([_links(u, p) for u, p in zip(url, page)])


def extract_links(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Rows (key, id, link, domain, internal): a page's distinct absolute links in first order."""
    return pages.select(key, F.explode(_extract(url, html)).alias("l")).select(key, "l.*")


def top_pages(pages: DataFrame, by: str, order: str, text: str, signature: str, n: int = 4, chars: int = 4000) -> DataFrame:
    """Per query the first n non-empty pages of distinct content, in result order, cut to ``chars``."""
    full = pages.where(F.coalesce(F.col(text) != "", F.lit(False)))
    first = full.withColumn("_d", F.row_number().over(Window.partitionBy(by, signature).orderBy(order))).where("_d = 1")
    out = first.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("place") <= n)
    return out.withColumn(text, F.substring(text, 1, chars)).drop("_d")
