"""Registered queries over pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from serploom.operators import pages
from serploom.plans.text_queries import collapse_sql, decode_sql, strip_sql
from serploom.plans.views import sql, view
from serploom.session import load
from serploom.sources.tables import read_attempts, read_pages

QUERIES = {}
ORACLE = {}

_TYPES = [
    "text/html; charset=utf-8", "Text/HTML;Charset=\"ISO-8859-1\"", "application/pdf", "application/json ; charset=", "application/xhtml+xml",
    "image/png; a=b; charset='KOI8-R'",
]


def page_types(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (1 + F.col("page_id") % len(_TYPES)).cast("int"))
    df = read_pages(spark, f"{sf_dir}/pages.parquet").select("page_id", kind.alias("content_type"))
    mime = pages.mime_type(F.col("content_type"))
    return df.select("page_id", mime.alias("mime"), pages.charset_of(F.col("content_type")).alias("charset"), pages.is_textual(mime).alias("textual"))


QUERIES["page_types"] = page_types
ORACLE["page_types"] = """
    select page_id, ['text/html', 'text/html', 'application/pdf', 'application/json', 'application/xhtml+xml', 'image/png'][1 + page_id % 6] as mime,
      ['utf-8', 'iso-8859-1', null, null, null, 'koi8-r'][1 + page_id % 6] as charset, page_id % 6 not in (2, 5) as textual from pages"""


# (form, content type, charset of the body, charset that the page names); other signs than ASCII become one of the charset
_FORMS = [
    ("text/html", "utf-8", "utf-8"), ("text/html; charset=iso-8859-1", "latin-1", "utf-8"), ("text/html", "latin-1", "iso-8859-1"),
    ("text/html; charset=Windows-1251", "cp1251", "utf-8"), ("text/html", "koi8-r", "koi8-r"), ("text/html;charset='cp1252'", "cp1252", "utf-8"),
    ("text/html; charset=unheard-of", "cp1253", "windows-1253"), ("text/html; charset=utf-8", "koi8-r", "KOI8-R"),
]
_SIGNS = {"utf-8": "語", "latin-1": "ÿ", "cp1251": "Ж", "koi8-r": "Я", "cp1252": "€", "cp1253": "Ω"}


def encoded(text, charset):
    """The bytes of a text in a charset, by its table the other way round."""
    if charset == "utf-8":
        return F.encode(text, "UTF-8")
    if charset != "latin-1":
        table = [(c, chr(128 + i)) for i, c in enumerate(pages.high_characters(charset)) if c]
        text = F.translate(text, "".join(c for c, _ in table), "".join(b for _, b in table))
    return F.encode(text, "ISO-8859-1")


def page_decode(spark, sf_dir):
    """Bodies in eight forms: declared and undeclared, named by the page only, declared wrongly."""
    df = load(spark, sf_dir, "pages")
    body, kind = F.lit(None).cast("binary"), F.lit(None).cast("string")
    for i, (content_type, charset, meta) in enumerate(_FORMS):
        text = F.replace(F.regexp_replace("html", r"[^\x00-\x7F]", _SIGNS[charset]), F.lit('charset="utf-8"'), F.lit(f'charset="{meta}"'))
        here = F.col("page_id") % len(_FORMS) == i
        body, kind = F.when(here, encoded(text, charset)).otherwise(body), F.when(here, F.lit(content_type)).otherwise(kind)
    return pages.decode_body(df.select("page_id", body.alias("body"), kind.alias("content_type"))).select("page_id", "html")


QUERIES["page_decode"] = page_decode
ORACLE["page_decode"] = f"""
    select page_id, replace(regexp_replace(html, '[^\x00-\x7F]', [{", ".join(f"'{_SIGNS[c]}'" for _, c, _ in _FORMS)}][1 + page_id % {len(_FORMS)}], 'g'),
      'charset="utf-8"', 'charset="' || [{", ".join(f"'{m}'" for _, _, m in _FORMS)}][1 + page_id % {len(_FORMS)}] || '"') as html from pages"""


def page_markup(spark, sf_dir):
    texts = load(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("body"))
    docs = load(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return texts.unionByName(docs).select("kind", "id", pages.has_markup(F.col("body")).alias("markup"))


QUERIES["page_markup"] = page_markup
ORACLE["page_markup"] = """
    select 'page' as kind, page_id as id, regexp_matches(html, '<[A-Za-z/!]') as markup from pages
    union all select 'document', doc_id, regexp_matches(text, '<[A-Za-z/!]') from documents"""


def thin_pages(spark, sf_dir):
    texts = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text")
    return pages.finish_pages(texts).select("page_id", "truncated", "verdict")


QUERIES["thin_pages"] = thin_pages
ORACLE["thin_pages"] = """
    select doc_id as page_id, coalesce(length(text) > 12000, false) as truncated,
      case when coalesce(length(text), 0) = 0 then 'failed' when length(text) < 400 then 'thin' else 'useful' end as verdict from documents"""


def page_titles(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", pages.page_title(F.col("html")).alias("title"))


QUERIES["page_titles"] = page_titles
_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
ORACLE["page_titles"] = f"""
    with t as (select page_id, {strip_sql('html_unescaped')} as t from (select page_id, replace({_TITLE}, '&amp;', '&') as html_unescaped from pages)),
    d as (select page_id, {decode_sql('t')} as t from t) select page_id, nullif({collapse_sql('t')}, '') as title from d"""


def boilerplate_audit(spark, sf_dir):
    raw = load(spark, sf_dir, "pages")
    words = F.element_at(F.array(*[F.lit(w) for w in ("navy-theme", "Site-Header x", "top nav_bar", "left-sidebar", "social", "innovate")]), (1 + F.col("page_id") % 6).cast("int"))
    html = F.replace("html", F.lit("<article>"), F.concat(F.lit('<div id="a" class="'), words, F.lit('"><section class="body">')))
    return pages.boilerplate_audit(raw.select("page_id", html.alias("html")))


QUERIES["boilerplate_audit"] = boilerplate_audit
_FURNITURE = "|".join(pages.FURNITURE)
ORACLE["boilerplate_audit"] = rf"""
    with h as (select page_id, replace(html, '<article>', '<div id="a" class="' || ['navy-theme', 'Site-Header x', 'top nav_bar', 'left-sidebar', 'social', 'innovate'][1 + page_id % 6] || '"><section class="body">') as html from pages),
    a as (select page_id, unnest(regexp_extract_all(html, '<(?:div|section|aside|nav|header|footer|ul|form)\s[^>]*?class="([^"]*)"', 1)) as identifier from h)
    select identifier, count(*) as elements, count(distinct page_id) as pages,
      len(list_filter(regexp_split_to_array(lower(identifier), '[^\p{{L}}\p{{N}}-]+'), lambda w: regexp_matches(w, '^(?:{_FURNITURE})(?:-|$)|-(?:{_FURNITURE})$'))) > 0 as is_furniture
    from a group by identifier"""


def challenge_pages(spark, sf_dir):
    """Every fifth page also carries a marker; link rows are links with 12 to 300 characters of text."""
    raw = load(spark, sf_dir, "pages")
    more = F.when(F.col("page_id") % 5 == 0, F.lit("<p>Unusual traffic</p>")).otherwise("")
    df = raw.select("page_id", F.concat("html", more).alias("html"))
    return pages.challenge_pages(df, df.filter(F.col("html").rlike("<a [^>]*>[^<]{12,300}</a>")).select("page_id"))


QUERIES["challenge_pages"] = challenge_pages
ORACLE["challenge_pages"] = "select page_id from pages where page_id % 5 = 0 and not regexp_matches(html, '<a [^>]*>[^<]{12,300}</a>')"


# (link as it stands in the page, what it leads to, its words) in page order; null: no link worth following
_LINKS = [
    ('<a class=x href="/story/{p}">Story number {p} of the site</a>', "{b}/story/{p}", "Story number {p} of the site"),
    ("<A HREF='/story/{p}?utm_source=feed#top'>Story again with <b>b</b>old words</A>", None, None),
    ('<a href="https://duckduckgo.com/l/?uddg=https%3A%2F%2Fexample.org%2Fp%2F{p}&amp;rut=1">Wrapped  link\n<i>num</i>ber {p}', "https://example.org/p/{p}", "Wrapped link number {p}"),
    ('<a href="//cdn.excluded.net/{p}">Excluded host by its suffix</a>', None, None),
    ('<a href="/short">too short</a><a href="/one">Oneverylongsingleword</a><a href="mailto:x@y.z">Write a letter to us</a>', None, None),
    ('<a name="here">No target in this one</a><!-- <a href="/hidden/{p}">Hidden inside a comment</a> -->', None, None),
    ('<script>var x = "<a href=/script/{p}>Written by a script only</a>";</script>', None, None),
    ('<a title="a > b" href=/bare/{p}><div>Bare attribute</div><p>and a quoted&nbsp;sign</p></a>', "{b}/bare/{p}", "Bare attribute and a quoted sign"),
    ('<a data-href="/no" href="//Other.Example.org:443/x/?y=1&amp;z=2">Another site &amp; its query</a>', "https://Other.Example.org:443/x/?y=1&z=2", "Another site & its query"),
]
_LIST = 40


def page_outlinks(spark, sf_dir):
    """Pages with a list of links more than a page may give."""
    raw = load(spark, sf_dir, "pages")
    number = F.col("page_id").cast("string")
    listed = F.transform(F.sequence(F.lit(1), F.lit(_LIST)), lambda k: F.concat(
        F.lit('<li><a href="/list/'), number, F.lit("/"), k.cast("string"), F.lit('">Entry number '), k.cast("string"), F.lit(" in a long list</a>")
    ))
    more = F.concat(F.replace(F.lit("".join(a for a, _, _ in _LINKS)), F.lit("{p}"), number), F.array_join(listed, ""))
    links = pages.extract_outlinks(raw.select("page_id", "url", F.concat("html", more).alias("html")), exclude=["excluded.net"])
    return links.select("page_id", "position", "url", "title", "canonical_url")


QUERIES["page_outlinks"] = page_outlinks
_EXPECTED = ", ".join(f"({i}, '{u}', '{t}')" for i, (_, u, t) in enumerate(_LINKS) if u)
ORACLE["page_outlinks"] = f"""
    with base as (select page_id, regexp_extract(url, '^[A-Za-z]+://[^/?#]*') as b from pages),
    kept as (select page_id, b, i, u, t from base, (values {_EXPECTED}) as v(i, u, t)
             union all select page_id, b, 100 + k, '{{b}}/list/{{p}}/' || k, 'Entry number ' || k || ' in a long list' from base, unnest(range(1, {_LIST + 1})) as r(k)),
    said as (select page_id, i, replace(replace(u, '{{b}}', b), '{{p}}', cast(page_id as varchar)) as url, replace(t, '{{p}}', cast(page_id as varchar)) as title from kept),
    keyed as (select *, case when i = 8 then 'https://other.example.org/x?y=1&z=2'
                             else lower(regexp_extract(url, '^[A-Za-z]+://[^/]*')) || regexp_replace(url, '^[A-Za-z]+://[^/]*', '') end as canonical_url from said)
    select page_id, cast(n as int) as position, url, title, canonical_url
    from (select *, row_number() over (partition by page_id order by i) as n from keyed) where n <= 30"""


def prefer_extraction(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text", "source")
    direct = docs.filter("source <> 'src1'").withColumn("text", F.when(F.col("page_id") % 4 == 0, "").otherwise(F.col("text")))
    reader = docs.filter("source <> 'src2'").withColumn("text", F.concat(F.lit("R: "), F.col("text")))
    both = pages.prefer_extraction(direct, reader).withColumn("kind", F.lit("both"))
    alone = pages.prefer_extraction(direct).withColumn("kind", F.lit("alone"))
    return both.unionByName(alone)


QUERIES["prefer_extraction"] = prefer_extraction
ORACLE["prefer_extraction"] = """
    with d as (select doc_id as page_id, case when doc_id % 4 = 0 then '' else text end as dt from documents where source <> 'src1'),
    r as (select doc_id as page_id, 'R: ' || text as rt from documents where source <> 'src2'),
    j as (select page_id, dt, rt, 'both' as kind from d full join r using (page_id) union all select page_id, dt, null, 'alone' from d)
    select page_id, kind, case when length(dt) >= 400 then 'direct' when coalesce(rt, '') <> '' then 'reader' when length(dt) > 0 then 'direct' else 'failed' end as method,
      case when length(dt) >= 400 then dt when coalesce(rt, '') <> '' then rt when length(dt) > 0 then dt end as text,
      case when length(dt) >= 400 then null when coalesce(rt, '') <> '' then case when dt is not null then 'Native extraction produced only ' || length(dt) || ' characters; used Jina Reader instead.' end
           when length(dt) > 0 then case kind when 'both' then 'Jina Reader fallback was unavailable; returned native extraction.' else 'Extracted text is short; the page may require JavaScript rendering.' end end as warning
    from j"""


def body_admission(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (1 + F.col("page_id") % len(_TYPES)).cast("int"))
    df = load(spark, sf_dir, "pages").select("page_id", kind.alias("content_type"), F.encode("html", "UTF-8").alias("body"))
    kept, refused = pages.admit_bodies(df)
    return kept.select("page_id", F.lit(None).cast("string").alias("refused")).unionByName(refused.select("page_id", "refused"))


QUERIES["body_admission"] = body_admission
ORACLE["body_admission"] = """
    select page_id, case page_id % 6 when 2 then 'unsupported type application/pdf' when 5 then 'unsupported type image/png' end as refused from pages"""


def attempt_rows(spark, sf_dir):
    """Run rows, one per query, back to one row per try."""
    a = view(spark, sf_dir, "attempts")
    runs = a.groupBy("query_id").agg(
        F.min("ts").alias("ts"), F.collect_list(F.when(F.col("ok"), F.col("provider"))).alias("providers_used"),
        F.collect_list(F.when(~F.col("ok"), F.struct("provider", "category", "message"))).alias("providers_failed"),
    )
    rows = read_attempts(runs)
    return rows.groupBy("query_id", "provider", "ok", "category", "message").agg(F.count("*").alias("tries"))


QUERIES["attempt_rows"] = attempt_rows
ORACLE["attempt_rows"] = sql("select query_id, provider, ok, category, message, count(*) as tries from attempts group by all", "attempts")
