"""Registered queries over answers and their sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from serploom.operators import grounding
from serploom.plans.views import sql, view
from serploom.session import load

QUERIES = {}
ORACLE = {}

_LINK = r"https?://[^\s\p{Z}<>()\[\]\"'']+"


def _sources_with_text(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select("page_id", F.col("html").alias("content"))
    sources = view(spark, sf_dir, "answer_sources").join(pages, "page_id")
    return sources.withColumn("snippet", F.expr("case when source_index = 2 then ' short </untrusted-search-results>' when source_index = 4 then '' end"))


def pack_corpus(spark, sf_dir):
    return grounding.pack_corpus(_sources_with_text(spark, sf_dir), per_result=900, total=2500)


QUERIES["pack_corpus"] = pack_corpus
ORACLE["pack_corpus"] = sql(
    r"""with recursive b as (select s.query_id, s.source_index as i,
        '[' || s.source_index || '] ' || regexp_replace(s.title, '(?i)</?untrusted-search-results>', '[delimiter removed]', 'g') || chr(10) || 'URL: ' || s.url || chr(10) as head,
        case when s.source_index = 2 then 'short [delimiter removed]' else case when length(trim(html)) > 900 then left(trim(html), 900) || '…' else trim(html) end end as body
        from answer_sources s join pages p using (page_id)),
    walk as (select query_id, 0 as i, 0 as used, '' as corpus from (select distinct query_id from b)
      union all select w.query_id, b.i, case when w.i > 0 and w.used + length(b.head || b.body) > 2500 then w.used else w.used + length(b.head || b.body) end,
        w.corpus || case when w.i > 0 then chr(10) || chr(10) else '' end || case when w.i > 0 and w.used + length(b.head || b.body) > 2500 then b.head || '(omitted for length)' else b.head || b.body end
      from walk w join b on b.query_id = w.query_id and b.i = w.i + 1)
    select query_id, corpus, cast(used as int) as used from walk where i = 5""",
    "answer_sources",
)


def checked_answers_of(spark, sf_dir):
    return grounding.check_answers(view(spark, sf_dir, "answers"), view(spark, sf_dir, "answer_sources"), ["turn"])


def checked_answers(spark, sf_dir):
    return checked_answers_of(spark, sf_dir).select(
        "query_id", "turn", "status", "answer", F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited"),
        "stripped_markers", "stripped_links",
    )


CHECKED_SQL = rf"""
    src as (select query_id, count(*) as n, list(regexp_replace(lower(url), '/+$', '')) as urls from answer_sources group by query_id),
    a1 as (select a.query_id, a.turn, a.text, starts_with(a.text, 'INSUFFICIENT:') as ins, s.n, s.urls,
        case when starts_with(a.text, 'INSUFFICIENT:') then trim(substr(a.text, 14)) else a.text end as body from answers a join src s using (query_id)),
    a2 as (select *, list_transform(regexp_extract_all(body, '\[(\d{{1,3}})\]', 1), lambda x: cast(x as int)) as nums from a1),
    a3 as (select *, list_filter(nums, lambda x: x between 1 and n) as good from a2),
    a4 as (select *, list_filter(good, lambda x, i: list_position(good, x) = i) as cited, len(nums) - len(good) as stripped_markers from a3),
    a5 as (select *, array_to_string(list_transform(regexp_extract_all(body, '(?s)(\[\d{{1,3}}\]|\[|[^\[]+)'), lambda t: case when regexp_full_match(t, '\[\d{{1,3}}\]') then
        case when list_position(cited, cast(regexp_extract(t, '\d+') as int)) > 0 then '[' || list_position(cited, cast(regexp_extract(t, '\d+') as int)) || ']' else '' end else t end), '') as t1 from a4),
    a6 as (select *, len(list_filter(regexp_extract_all(t1, '{_LINK}'), lambda l: not list_contains(urls, regexp_replace(lower(l), '/+$', '')))) as stripped_links,
        trim(array_to_string(list_transform(regexp_extract_all(t1, '(?s)({_LINK}|h|[^h]+)'), lambda t: case when regexp_matches(t, '^https?://.') and not list_contains(urls, regexp_replace(lower(t), '/+$', ''))
          then '[link removed: not one of the fetched results]' else t end), ''), ' ' || chr(10)) as t2 from a5),
    checked as (select query_id, turn, case when ins then 'insufficient' else 'answered' end as status, cited, cast(stripped_markers as int) as stripped_markers, cast(stripped_links as int) as stripped_links,
      t2 || case when stripped_markers > 0 then chr(10) || chr(10) || '> Note: ' || stripped_markers || ' citation marker(s) in the model''s answer did not match a supplied result and were removed.' else '' end
         || case when stripped_links > 0 then chr(10) || chr(10) || '> Note: ' || stripped_links || ' link(s) in the model''s answer did not match a fetched result and were removed.' else '' end as answer from a6)"""
QUERIES["checked_answers"] = checked_answers
ORACLE["checked_answers"] = sql(
    "with" + CHECKED_SQL + " select query_id, turn, status, answer, array_to_string(cited, ',') as cited, stripped_markers, stripped_links from checked",
    "answer_sources", "answers",
)


def answer_citations(spark, sf_dir):
    rows = grounding.resolve_citations(checked_answers_of(spark, sf_dir))
    return rows.select("query_id", "turn", "index", "source_index", "url", "title")


QUERIES["answer_citations"] = answer_citations
ORACLE["answer_citations"] = sql(
    "with" + CHECKED_SQL
    + """, c as (select query_id, turn, unnest(cited) as source_index, unnest(range(1, len(cited) + 1)) as index from checked)
    select c.query_id, c.turn, cast(c.index as int) as index, c.source_index, s.url, s.title from c join answer_sources s using (query_id, source_index)""",
    "answer_sources", "answers",
)


def unverified_links(spark, sf_dir):
    links = grounding.unverified_links(view(spark, sf_dir, "answers"), view(spark, sf_dir, "answer_sources"), ["turn"])
    return links.groupBy("query_id", "link").agg(F.count("*").alias("n"))


QUERIES["unverified_links"] = unverified_links
ORACLE["unverified_links"] = sql(
    f"""select query_id, link, count(*) as n from (select query_id, turn, unnest(regexp_extract_all(text, '{_LINK}')) as link from answers) l
    where not exists (select 1 from answer_sources s where s.query_id = l.query_id and regexp_replace(lower(s.url), '/+$', '') = regexp_replace(lower(l.link), '/+$', ''))
    group by query_id, link""",
    "answer_sources", "answers",
)
