"""Facts of web pages: titles, routes, links, forms, assets, styles — regular text, so regular expressions suffice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_path

TITLE = r"(?is)<title[^>]*>(.*?)</title>"
HREF = r"(?i)<a\s[^>]*?href=[\"']([^\"']*)[\"']"
STYLE_BLOCK = r"(?is)<style[^>]*>(.*?)</style>"
SELECTOR = r"([^{}@/;]+)\{"
ASSET = r"(?i)<(?:img|script|link|source|video|audio|iframe)\s[^>]*?(?:src|href)=[\"']([^\"']+)[\"']"
FORM = r"(?is)<form\b([^>]*)>(.*?)</form>"
FIELD = r"(?i)<(?:input|select|textarea)\s[^>]*?name=[\"']([^\"']+)[\"']"


def attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    return F.when(value != "", value)


def page_facts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, route, title, language (a two-letter first segment of the route)."""
    title = F.trim(F.regexp_extract(html, TITLE, 1))
    route = normalize_path(F.col(url))
    lang = F.regexp_extract(route, r"^/([a-z]{2})(?:/|$)", 1)
    return pages.select(key, route.alias("route"), F.when(title != "", title).alias("title"), F.when(lang != "", lang).alias("language"))


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    return pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(HREF), F.lit(1))).alias("href"))


def selectors(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Selectors of the style blocks, one row each time one is used."""
    block = F.array_join(F.regexp_extract_all(html, F.lit(STYLE_BLOCK), F.lit(1)), "\n")
    names = pages.select(key, F.explode(F.regexp_extract_all(block, F.lit(SELECTOR), F.lit(1))).alias("s"))
    return names.select(key, F.trim(F.regexp_replace("s", r"\s+", " ")).alias("selector")).filter("selector <> ''")


def style_facts(files: DataFrame) -> DataFrame:
    """path, selectors, classes, ids, css_variables, imports, asset_urls of style sheets; distinct, in order."""
    def found(rx: str) -> Column:
        return F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(rx), F.lit(1)), F.trim))

    css = files.filter(F.col("role") == "style")
    return css.select(
        "path",
        found(SELECTOR).alias("selectors"),
        found(r"\.([A-Za-z_][\w-]*)\s*[,{:>\s]").alias("classes"),
        found(r"#([A-Za-z_][\w-]*)\s*[,{:>\s]").alias("ids"),
        found(r"(--[\w-]+)\s*:").alias("css_variables"),
        found(r"@import\s+(?:url\()?[\"']?([^\"')\s;]+)").alias("imports"),
        found(r"url\([\"']?([^\"')]+)[\"']?\)").alias("asset_urls"),
    )


def form_facts(files: DataFrame) -> DataFrame:
    """source, method, action, fields of every form of page files."""
    pages = files.filter(F.col("role").isin("frontend-page", "webapp"))
    both = F.arrays_zip(F.regexp_extract_all("content", F.lit(FORM), F.lit(1)).alias("tag"), F.regexp_extract_all("content", F.lit(FORM), F.lit(2)).alias("body"))
    forms = pages.select("path", F.posexplode(both).alias("form_no", "f"))
    return forms.select(F.col("path").alias("source"), "form_no", F.upper(attribute(F.col("f.tag"), "method")).alias("method"), attribute(F.col("f.tag"), "action").alias("action"), F.regexp_extract_all(F.col("f.body"), F.lit(FIELD), F.lit(1)).alias("fields"))


def asset_facts(files: DataFrame) -> DataFrame:
    """source, asset_path, asset_kind of what page files refer to."""
    pages = files.filter(F.col("role").isin("frontend-page", "webapp"))
    used = pages.select(F.col("path").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(ASSET), F.lit(1)))).alias("asset_path"))
    ends = F.lower(F.regexp_replace("asset_path", r"[?#].*$", ""))
    kind = F.when(ends.rlike(r"\.(png|jpe?g|gif|svg|webp|ico|avif)$"), "image").when(ends.rlike(r"\.[cm]?js$"), "script").when(ends.endswith(".css"), "style").when(ends.rlike(r"\.(woff2?|ttf|otf|eot)$"), "font").when(ends.rlike(r"\.(mp4|webm|mp3|ogg)$"), "media").otherwise("other")
    return used.withColumn("asset_kind", kind)
