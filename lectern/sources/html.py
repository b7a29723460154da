"""Chapter pages: titles, paragraphs and links, as SQL expressions over the raw page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

CHROME = ["previous chapter", "next chapter", "author's note:"]  # fixed values: how short lines of site chrome begin
HIDDEN = r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->"
BODIES = [r"(?is)<div[^>]*entry-content[^>]*>(.*)</div>", r"(?is)<article[^>]*>(.*)</article>", r"(?is)<main[^>]*>(.*)</main>"]
TITLES = [r"(?is)<h1[^>]*entry-title[^>]*>(.*?)</h1>", r"(?is)<[a-z0-9]+[^>]*entry-title[^>]*>(.*?)</", r"(?is)<h1[^>]*>(.*?)</h1>", r"(?is)<title[^>]*>(.*?)</title>"]


def plain(html: Column) -> Column:
    """Text of a piece of HTML: tags go, the five common references are decoded, white space collapses."""
    out = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(value))
    return T.clean(out)


def _first(html: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in patterns])


def title(html: Column, url: Column, site: str | None = None) -> Column:
    """The page's title: the first of the known places with text, without a dash and the name ``site`` (a pattern) at its end, else the URL's last part."""
    shown = plain(F.coalesce(_first(F.regexp_replace(html, HIDDEN, ""), TITLES), F.lit("")))
    if site:
        shown = F.trim(F.regexp_replace(shown, rf"\s+[–—|-]\s+(?:{site})\s*$", ""))
    return F.coalesce(F.nullif(shown, F.lit("")), T.last_part(url))


def paragraphs(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Paragraphs (key, para, line) of the page's body: what stands between openings of p, up to its end if it has one.
    Empty ones and short lines of site chrome are left out."""
    body = _first(F.regexp_replace(html, HIDDEN, ""), BODIES)
    parts = F.slice(F.split(body, r"(?i)<p(?:\s[^>]*)?>"), 2, 1 << 30)
    texts = F.transform(parts, lambda x: plain(F.get(F.split(x, r"(?i)</p>|</article>|</div>|</main>"), F.lit(0))))
    chrome = lambda x: (F.length(x) < 60) & F.exists(F.array(*map(F.lit, CHROME)), lambda c: F.startswith(F.lower(x), c))
    return pages.select(key, F.posexplode(F.filter(texts, lambda x: (x != "") & ~chrome(x))).alias("para", "line")).withColumn("para", F.col("para").cast("long"))


def bodyless(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Keys of pages without any of the known bodies; ``paragraphs`` gives no rows for them."""
    return pages.where(_first(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, ""), BODIES).isNull()).select(key)


def require_bodies(pages: DataFrame, key: str = "page_id", html: str = "html") -> None:
    """Raise ValueError if a page has no body."""
    found = bodyless(pages, key, html).limit(5).collect()
    if found:
        raise ValueError("pages without a body: " + ", ".join(str(r[0]) for r in found))


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Headings and links in page order: (key, ord, kind, text, href)."""
    found = F.regexp_extract_all(F.regexp_replace(html, HIDDEN, ""), F.lit(r"(?is)(<h[1-4][^>]*>.*?</h[1-4]>|<a\s[^>]*>.*?</a>)"), 1)
    own = pages.select(key, F.posexplode(found).alias("ord", "_x"))
    link = F.lower(F.left("_x", F.lit(2))) == "<a"
    return own.select(key, F.col("ord").cast("long"), F.when(link, "link").otherwise("heading").alias("kind"), plain(F.col("_x")).alias("text"), F.when(link, F.nullif(F.regexp_extract("_x", r"(?i)href=[\"']([^\"']*)", 1), F.lit(""))).alias("href"))
