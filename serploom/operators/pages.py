"""From fetched bodies to readable text, with native expressions."""

from __future__ import annotations

import codecs
from collections.abc import Sequence
from encodings.aliases import aliases

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serploom import dims
from serploom.functions import text, urls

THIN = 400
BODY_CAP = 10 * 1024 * 1024

# Class and id words of page furniture, and the elements that are audited.
FURNITURE = [
    "nav", "navbar", "navigation", "menu", "sidebar", "side-bar", "footer", "header",
    "masthead", "breadcrumb", "cookie", "consent", "gdpr", "banner", "advert", "ads",
    "sponsor", "promo", "social", "share", "comment", "disqus", "related", "recommend",
    "newsletter", "subscribe", "signup", "login", "modal", "popup", "overlay", "skip-link",
    "pagination", "pager", "toolbar", "widget", "meta-bar", "site-header", "site-footer",
]
FURNITURE_TAGS = [
    "aside", "div", "footer", "form", "header", "nav", "section", "ul",
]


# --- bodies -----------------------------------------------------------------------------------------
def mime_type(content_type: Column) -> Column:
    return F.lower(urls.trim_ws(F.substring_index(content_type, ";", 1)))


def charset_of(content_type: Column) -> Column:
    value = F.regexp_extract(content_type, r"(?i);\s*charset\s*=([^;]*)", 1)
    return F.nullif(F.lower(F.regexp_replace(value, "^[ \"']+|[ \"']+$", "")), F.lit(""))


def is_textual(mime: Column) -> Column:
    """Types that can be handed on as text; PDF is left out on purpose."""
    allowed = F.lit(False)
    for prefix in dims.TEXTUAL_PREFIXES:
        allowed = allowed | mime.startswith(prefix)
    return allowed


def has_markup(body: Column) -> Column:
    return body.rlike("<[A-Za-z/!]")


#: charsets of one byte a character, decoded by tables that the codecs give
SINGLE_BYTE = [
    *[f"cp{n}" for n in (437, 850, 852, 855, 857, 858, 862, 866, 874, *range(1250, 1259))],
    *[f"iso8859-{n}" for n in (*range(2, 12), *range(13, 17))], "koi8-r", "koi8-u", "mac-roman", "mac-cyrillic",
]
#: other charsets, by the names pages use for them
_BUILT_IN = {"UTF-8": ["utf-8", "utf8"], "ISO-8859-1": ["iso-8859-1", "latin1", "latin-1"], "US-ASCII": ["us-ascii", "ascii"]}
_HIGH = "".join(map(chr, range(128, 256)))


def _names(charset: str) -> list[str]:
    """What a codec is called in pages, lower-case."""
    name = codecs.lookup(charset).name
    known = {charset, name, *[alias for alias, codec in aliases.items() if codec == name.replace("-", "_")]}
    known |= {n.replace("_", "-") for n in known} | {n.replace("cp", "windows-") for n in known if n.startswith("cp12")}
    return sorted(known | {n.replace("iso8859", "iso-8859") for n in known})


def high_characters(charset: str) -> list[str | None]:
    """The characters of the bytes from 128 on, null where the charset has none."""

    def of(byte: int) -> str | None:
        try:
            return bytes([byte]).decode(charset)
        except UnicodeDecodeError:
            return None

    return [of(b) for b in range(128, 256)]


def _by_name(body: Column, latin: Column, name: Column) -> Column:
    """Text in the named charset; null if the name is not known or the bytes are not in it."""
    whole = F.col("_whole")
    found = F.when(name.isin(_BUILT_IN["UTF-8"]), F.when(whole, body.cast("string")))
    found = found.when(name.isin(_BUILT_IN["ISO-8859-1"]), latin)
    found = found.when(name.isin(_BUILT_IN["US-ASCII"]), F.when(~latin.rlike(r"[^\x00-\x7F]"), latin))
    for charset in SINGLE_BYTE:
        table = high_characters(charset)
        lost = "".join(chr(128 + i) for i, c in enumerate(table) if c is None)
        text = F.translate(latin, _HIGH, "".join(c or "?" for c in table))
        found = found.when(name.isin(_names(charset)), F.when(~latin.rlike(f"[{lost}]"), text) if lost else text)
    return found


def decode_body(pages: DataFrame, body: str = "body", content_type: str = "content_type") -> DataFrame:
    """Adds ``html``: declared charset, then UTF-8, then the charset the page names, then Latin-1.

    One projection: charsets of one byte are tables over the Latin-1 reading of the bytes. A charset of several
    bytes other than UTF-8 is not known (Spark's own decoding fails on broken bytes) and goes on to the next
    rule; ``multibyte_bodies`` are such pages.
    """
    raw = F.col(body)
    df = pages.withColumns({
        "_declared": charset_of(F.col(content_type)), "_latin": F.decode(raw, "ISO-8859-1"), "_whole": F.is_valid_utf8(raw.cast("string")),
    })
    df = df.withColumn("_meta", F.lower(F.regexp_extract(F.substring("_latin", 1, 4096), "(?i)charset[^=]*=[\"']?([\\w-]+)", 1)))
    html = F.coalesce(
        _by_name(raw, F.col("_latin"), F.col("_declared")), F.when(F.col("_whole"), raw.cast("string")),
        _by_name(raw, F.col("_latin"), F.col("_meta")), F.col("_latin"),
    )
    return df.withColumn("html", html).drop("_declared", "_latin", "_whole", "_meta")


def multibyte_bodies(pages: DataFrame, content_type: str = "content_type") -> DataFrame:
    """Pages that declare a charset ``decode_body`` has no rule for."""
    known = [n for names in _BUILT_IN.values() for n in names] + [n for c in SINGLE_BYTE for n in _names(c)]
    charset = charset_of(F.col(content_type))
    return pages.filter(charset.isNotNull() & ~charset.isin(known))


def admit_bodies(pages: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(pages worth decoding, refused pages with a reason): type allow-list and size cap."""
    mime = mime_type(F.col("content_type"))
    reason = F.when(
        ~F.coalesce(is_textual(mime), F.lit(True)), F.concat(F.lit("unsupported type "), mime)
    ).when(F.octet_length(body) > BODY_CAP, F.lit("body too large"))
    df = pages.withColumn("refused", reason)
    return df.filter("refused is null").drop("refused"), df.filter("refused is not null")


# --- readable text ----------------------------------------------------------------------------------
def page_title(html: Column) -> Column:
    """Cleaned text of the page's first title element."""
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.nullif(F.coalesce(text.clean_text(raw), raw), F.lit(""))


def is_furniture(identifier: Column) -> Column:
    """Native form of the class / id test, for audits over attribute tables."""
    words = F.split(F.lower(identifier), r"[^\p{L}\p{N}-]+")
    names = "|".join(FURNITURE)
    return F.exists(words, lambda w: w.rlike(f"^(?:{names})(?:-|$)|-(?:{names})$"))


def boilerplate_audit(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Class attributes of candidate elements per page, with the furniture verdict."""
    tags = "|".join(sorted(FURNITURE_TAGS))
    found = F.regexp_extract_all(
        "html", F.lit(rf'<(?:{tags})\s[^>]*?class="([^"]*)"'), F.lit(1)
    )
    attributes = pages.select(key, F.explode(found).alias("identifier"))
    return attributes.groupBy("identifier").agg(
        F.count("*").alias("elements"), F.countDistinct(key).alias("pages")
    ).withColumn("is_furniture", is_furniture(F.col("identifier")))


def finish_pages(extracted: DataFrame, max_characters: int = 12_000) -> DataFrame:
    """Clipped text with the thin flag; empty text is a failure."""
    clipped, truncated = text.clip_words(F.col("text"), max_characters)
    length = F.coalesce(F.length("text"), F.lit(0))
    return extracted.withColumns(
        {
            "truncated": F.coalesce(truncated, F.lit(False)),
            "verdict": F.when(length == 0, F.lit("failed"))
            .when(length < THIN, F.lit("thin"))
            .otherwise("useful"),
            "text": clipped,
        }
    )


def prefer_extraction(
    direct: DataFrame, reader: DataFrame | None = None, key: str = "page_id"
) -> DataFrame:
    """Best of two extractions per page: method, text, warning.

    Direct text of 400 characters wins; else the reader's; else direct text if there is any.
    """
    plain = direct.select(key, F.col("text").alias("_direct"))
    if reader is None:
        joined = plain.withColumn("_reader", F.lit(None).cast("string"))
        short = "Extracted text is short; the page may require JavaScript rendering."
    else:
        joined = plain.join(reader.select(key, F.col("text").alias("_reader")), key, "full_outer")
        short = "Jina Reader fallback was unavailable; returned native extraction."
    length = F.coalesce(F.length("_direct"), F.lit(0))
    use_direct = length >= THIN
    use_reader = ~use_direct & (F.coalesce("_reader", F.lit("")) != "")
    method = (
        F.when(use_direct, F.lit("direct"))
        .when(use_reader, F.lit("reader"))
        .when(length > 0, F.lit("direct"))
        .otherwise("failed")
    )
    warning = F.when(
        use_reader & F.col("_direct").isNotNull(),
        F.concat(
            F.lit("Native extraction produced only "), length.cast("string"),
            F.lit(" characters; used Jina Reader instead."),
        ),
    ).when(~use_direct & ~use_reader & (length > 0), F.lit(short))
    chosen = F.when(method == "direct", F.col("_direct")).when(method == "reader", F.col("_reader"))
    return joined.select(key, method.alias("method"), chosen.alias("text"), warning.alias("warning"))


# --- links ------------------------------------------------------------------------------------------
# Fixed values of a link worth following.
LINK_TEXT, LINKS_A_PAGE = (12, 300), 30

_UNSEEN = r"(?is)<!--.*?-->|<(script|style|template|textarea|title|xmp|iframe)\b.*?</\1\s*>"
# attributes, quoted or not; the text up to the end tag or to the next link
_ANCHOR = r"""(?is)<a\s((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>(.*?)(?=</a\s*>|<a[\s>]|\z)"""
_HREF = r"""(?is)(?:^|[\s"'])href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
# elements that part words; other tags leave nothing
_PARTING = (
    "address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|h[1-6]|header|hr|li|nav|ol|p|pre|section|table|td|th|tr|ul"
)


def link_text(inner: Column) -> Column:
    """The words inside a link on one line."""
    parted = F.regexp_replace(inner, rf"(?i)</?(?:{_PARTING})\b[^>]*>", " ")
    return text.collapse_ws(text.decode_entities(F.regexp_replace(parted, "<[^>]*>", "")))


def extract_outlinks(
    pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id", exclude: Sequence[str] = (), limit: int = LINKS_A_PAGE
) -> DataFrame:
    """Links of a page that read like titles: key, position, url, title, canonical_url, host.

    Every anchor with a target in page order; redirect targets are unwrapped, relative ones completed from the page's own
    address; hosts of ``exclude`` and below are left out. A link's words have 12 to 300 characters and a space. The
    first link to an address stays, the first ``limit`` links of a page do. Expressions and one shuffle by page.
    """
    seen = F.regexp_replace(html, _UNSEEN, " ")
    groups = F.arrays_zip(*[F.regexp_extract_all(F.col("_seen"), F.lit(_ANCHOR), F.lit(g)).alias(n) for g, n in ((1, "attributes"), (2, "inner"))])
    base = F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    found = pages.select(key, base.alias("_base"), seen.alias("_seen")).select(key, "_base", F.posexplode(groups).alias("_pos", "_a"))
    raw = F.regexp_replace(F.regexp_extract("_a.attributes", _HREF, 1), "^[\"']|[\"']$", "")
    links = found.select(key, "_pos", "_base", urls.trim_ws(text.decode_entities(raw)).alias("_href"), F.col("_a.inner").alias("_inner"))
    links = links.filter("_href <> ''").withColumn("url", urls.absolute_url(urls.unwrap_redirect(F.col("_href")), F.col("_base")))
    links = links.filter(urls.domain_filter(urls.url_host(F.col("url")), [], list(exclude)) & (urls.url_host(F.col("url")) != ""))
    links = links.select(key, "_pos", "url", link_text(F.col("_inner")).alias("title"))
    links = links.filter(F.length("title").between(*LINK_TEXT) & F.contains("title", F.lit(" ")))
    links = urls.with_canonical_url(links, "url", host_out="host")
    # both windows are met by one deal of the pages
    first = Window.partitionBy(key, "canonical_url").orderBy("_pos")
    in_page = Window.partitionBy(key).orderBy("_pos")
    kept = links.repartition(key).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    ranked = kept.withColumn("position", F.row_number().over(in_page)).filter(F.col("position") <= limit)
    return ranked.select(key, "position", "url", "title", "canonical_url", "host")


def challenge_pages(pages: DataFrame, link_rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages that carry an anti-bot marker and yielded no rows; a page with rows never counts."""
    marked = pages.filter(text.contains_any(F.lower("html"), dims.CHALLENGE_MARKERS))
    return marked.select(key).join(link_rows.select(key).distinct(), key, "left_anti")
