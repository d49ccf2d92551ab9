"""Registered queries over output documents and cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from serploom import dims
from serploom.operators import fusion
from serploom.plans.fusion_queries import _FLAT_RESPONSES, _TOP, family_sql, fusion_sql, ranked_lists
from serploom.plans.grounding_queries import CHECKED_SQL, checked_answers_of
from serploom.plans.health_queries import (
    _COUNTERS_SQL, _FACTS_SQL, _REUSE_LOGS_SQL, _SETTINGS_SQL, _STATUS_SQL, REUSE_STATS_SQL, provider_status_of, reuse_stats,
)
from serploom.plans.views import sql
from serploom.session import load
from serploom.sinks import outputs

QUERIES = {}
ORACLE = {}


def _searches(df, key):
    """Search rows for any key: every third has a failure, every fourth a warning."""
    k = F.col(key)
    failed = F.struct(F.lit("exa").alias("provider"), F.lit("timeout").alias("category"), F.lit("late").alias("message"))
    return df.select(
        k.alias("query_id"), F.concat(F.lit("query "), k.cast("string")).alias("query"), F.array(F.lit("tavily"), F.lit("brave")).alias("providers_used"),
        F.when(k % 3 == 0, F.array(failed)).otherwise(F.array().cast(outputs.FAILURE)).alias("providers_failed"),
        F.when(k % 4 == 0, F.array(F.lit("partial"), F.lit(""))).otherwise(F.array().cast("array<string>")).alias("warnings"),
        F.to_timestamp(F.lit("2024-02-01 10:00:00")).alias("retrieved_at"), (k * 3).cast("int").alias("elapsed_ms"), (k % 5 == 0).alias("served_from_cache"),
    )


_FAILED_JSON = """case when {k} % 3 = 0 then '[{{"provider":"exa","category":"timeout","message":"late"}}]' else '[]' end"""
_WARN_JSON = """case when {k} % 4 = 0 then '["partial",""]' else '[]' end"""
_TAIL_JSON = """',"providers_used":["tavily","brave"],"providers_failed":' || """ + _FAILED_JSON + """ || ',"warnings":' || """ + _WARN_JSON + """
    || ',"retrieved_at":"2024-02-01T10:00:00.000Z","elapsed_ms":' || {k} * 3 || ',"served_from_cache":' || case when {k} % 5 = 0 then 'true' else 'false' end || '}}'"""


def _fused(spark, sf_dir):
    return fusion.fuse(ranked_lists(spark, sf_dir), limit=8, per_host=2)


_TOP_COLUMNS = "query_id, rank, title, url, sources, snippet, strftime(published_at, '%Y-%m-%dT%H:%M:%S.%gZ') as published"
_FUSED_SQL = fusion_sql(
    _FLAT_RESPONSES, family_sql("v.upstream_engine"), "true",
    _TOP.format(cap=2, limit=8, columns=_TOP_COLUMNS).replace(f"select {_TOP_COLUMNS} from", f", top as (select {_TOP_COLUMNS} from") + ")",
)


def search_documents(spark, sf_dir):
    return outputs.search_documents(_searches(load(spark, sf_dir, "supplier"), "s_suppkey"), _fused(spark, sf_dir))


QUERIES["search_documents"] = search_documents
ORACLE["search_documents"] = sql(
    _FUSED_SQL
    + """ select s_suppkey as query_id, '{"query":"query ' || s_suppkey || '","results":' || coalesce(r.j, '[]') || """ + _TAIL_JSON.format(k="s_suppkey") + """ as document
    from supplier left join (select query_id, '[' || string_agg(cast(to_json(struct_pack(rank := rank, title := title, url := url, sources := string_split(sources, ','), snippet := snippet, published_at := published)) as varchar), ',' order by rank) || ']' as j
      from top group by query_id) r on r.query_id = s_suppkey""",
    "ranked_lists",
)


def search_cards(spark, sf_dir):
    return outputs.search_cards(_searches(load(spark, sf_dir, "supplier"), "s_suppkey"), _fused(spark, sf_dir), 20)


QUERIES["search_cards"] = search_cards
_CARD_TAIL = """case when {k} % 3 = 0 then chr(10) || 'Unavailable providers: exa (timeout)' else '' end || case when {k} % 4 = 0 then chr(10) || 'Note: partial' else '' end"""
ORACLE["search_cards"] = sql(
    _FUSED_SQL
    + """ select s_suppkey as query_id, rtrim(coalesce(r.j, 'No results.') || """ + _CARD_TAIL.format(k="s_suppkey") + """ || case when s_suppkey % 5 = 0 then chr(10) || 'Note: served from local cache.' else '' end, chr(10)) as card
    from supplier left join (select query_id, string_agg('[' || rank || '] ' || title || chr(10) || 'URL: ' || url || chr(10)
        || coalesce('Snippet: ' || case when length(snippet) > 20 then left(snippet, 20) || '…' else snippet end || chr(10), '') || 'Published: ' || published || chr(10) || 'Sources: ' || replace(sources, ',', ', ') || chr(10), chr(10) order by rank) as j
      from top group by query_id) r on r.query_id = s_suppkey""",
    "ranked_lists",
)


def _answer_inputs(spark, sf_dir):
    checked = checked_answers_of(spark, sf_dir).withColumn("model", F.lit("m1"))
    ids = load(spark, sf_dir, "conversations").select("conv_id").distinct()
    return checked, _searches(ids, "conv_id").withColumn("results_considered", F.lit(5))


def answer_documents(spark, sf_dir):
    return outputs.answer_documents(*_answer_inputs(spark, sf_dir), ["query_id", "turn"])


QUERIES["answer_documents"] = answer_documents
_CITED_SQL = """cited as (select query_id, turn, string_agg(cast(to_json(struct_pack(index := i, title := s.title, url := s.url)) as varchar), ',' order by i) as j,
        string_agg('[' || i || '] ' || s.title || chr(10) || '    ' || s.url, chr(10) order by i) as card
      from (select query_id, turn, unnest(cited) as source_index, unnest(range(1, len(cited) + 1)) as i from checked) c join answer_sources s using (query_id, source_index) group by query_id, turn)"""
ORACLE["answer_documents"] = sql(
    "with" + CHECKED_SQL + ", " + _CITED_SQL
    + """ select q.query_id, k.turn, '{"query":"query ' || q.query_id || '","status":"' || coalesce(k.status, 'results_only') || '","model":' || case when k.turn is null then 'null' else '"m1"' end
      || ',"citations":[' || coalesce(c.j, '') || '],"answer_characters":' || coalesce(length(k.answer), 0) || ',"results_considered":5' || """ + _TAIL_JSON.format(k="q.query_id") + """ as document
    from (select distinct conv_id as query_id from conversations) q left join checked k using (query_id) left join cited c on c.query_id = k.query_id and c.turn = k.turn""",
    "answer_sources", "answers",
)


def answer_cards(spark, sf_dir):
    return outputs.answer_cards(*_answer_inputs(spark, sf_dir), ["query_id", "turn"])


QUERIES["answer_cards"] = answer_cards
ORACLE["answer_cards"] = sql(
    "with" + CHECKED_SQL + ", " + _CITED_SQL
    + """ select k.query_id, k.turn, case when k.status = 'insufficient' then 'INSUFFICIENT — the search results do not answer this question.' || chr(10) || chr(10) else '' end
      || k.answer || chr(10) || chr(10) || coalesce('Sources:' || chr(10) || c.card, 'Sources: none cited.') || chr(10) || chr(10)
      || 'Answered by m1 from 5 search result(s); the model has no web access and saw only these.' || """ + _CARD_TAIL.format(k="k.query_id") + """
      || case when k.query_id % 5 = 0 then chr(10) || 'Note: search results served from local cache.' else '' end as card
    from checked k left join cited c on c.query_id = k.query_id and c.turn = k.turn""",
    "answer_sources", "answers",
)


def _fetched(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit("https://e.com/"), F.col("doc_id").cast("string")).alias("url"), F.lit("https://e.com/final").alias("final_url"),
        F.lit(200).alias("status"), F.expr("case doc_id % 3 when 0 then upper(split_part(text, chr(10), 1)) when 1 then lang end").alias("title"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("text/html")).alias("content_type"), F.lit("native_html").alias("method"), (F.col("doc_id") % 4 == 0).alias("truncated"),
        "text", F.expr("case when doc_id % 5 = 0 then array('short', '') else array() end").cast("array<string>").alias("warnings"),
    )


_FETCHED_SQL = """(select doc_id as page_id, 'https://e.com/' || doc_id as url, case doc_id % 3 when 0 then upper(split_part(text, chr(10), 1)) when 1 then lang end as title,
    case when doc_id % 2 = 0 then 'text/html' end as content_type, doc_id % 4 = 0 as truncated, text, doc_id % 5 = 0 as warned,
    doc_id % 3 = 0 or split_part(text, chr(10), 1) = lang as same from documents)"""


def page_documents(spark, sf_dir):
    return outputs.page_documents(_fetched(spark, sf_dir).withColumn("title", F.when(F.col("page_id") % 3 == 1, F.col("title"))))


QUERIES["page_documents"] = page_documents
ORACLE["page_documents"] = f"""
    select page_id, '{{"url":"' || url || '","final_url":"https://e.com/final","status":200,"title":' || case when page_id % 3 = 1 then '"' || title || '"' else 'null' end || ',"content_type":' || coalesce('"' || content_type || '"', 'null')
      || ',"extraction_method":"native_html","truncated":' || truncated || ',"text_characters":' || length(text) || ',"warnings":' || case when warned then '["short",""]' else '[]' end || '}}' as document from {_FETCHED_SQL}"""


def page_cards(spark, sf_dir):
    return outputs.page_cards(_fetched(spark, sf_dir))


QUERIES["page_cards"] = page_cards
ORACLE["page_cards"] = f"""
    select page_id, case when coalesce(title, '') <> '' and not (same and trim(split_part(text, chr(10), 1)) <> '') then '# ' || title || chr(10) else '' end || 'URL: https://e.com/final' || chr(10) || 'Status: 200 (native_html)'
      || case when truncated then chr(10) || 'Note: content was truncated.' else '' end || case when warned then chr(10) || 'Note: short' else '' end || chr(10) || chr(10) || text as card from {_FETCHED_SQL}"""


def _status(spark, sf_dir):
    return provider_status_of(spark, sf_dir).join(F.broadcast(dims.providers(spark)), "provider")


def status_documents(spark, sf_dir):
    return outputs.status_documents(_status(spark, sf_dir), reuse_stats(spark, sf_dir), 7200)


QUERIES["status_documents"] = status_documents
_STATUS_ROWS = f"status_rows as (select st.*, f.* exclude (provider), s.configured, c.* exclude (provider, requests, successes, failures) from status st join {_FACTS_SQL} using (provider) join {_SETTINGS_SQL} using (provider) left join counters c using (provider))"
_STATUS_FULL = f"with status as ({_STATUS_SQL}), counters as ({_COUNTERS_SQL}), " + _STATUS_ROWS
ORACLE["status_documents"] = sql(
    _STATUS_FULL + ", " + _REUSE_LOGS_SQL
    + f""" select '{{"providers":[' || string_agg('{{"provider_order":' || provider_order || ',"provider":"' || provider || '","status":"' || status || '","configured":' || configured || ',"is_aggregator":' || is_aggregator
      || ',"is_scraper":' || is_scraper || ',"family":"' || family || '","circuit_state":"' || circuit_state || '","requests":' || requests || ',"successes":' || successes || ',"failures":' || failures
      || ',"last_result_count":' || last_result_count || ',"average_latency_ms":' || average_latency_ms || ',"last_error":"' || last_error || '","last_error_category":"' || last_error_category || '","last_success_at":"' || last_success_at || '"}}', ',' order by provider_order)
      || '],"cache":{{"entries":' || any_value(r.entries) || ',"hits":' || any_value(r.hits) || ',"misses":' || any_value(r.misses) || ',"ttl_seconds":7200}}}}' as document
    from status_rows cross join ({REUSE_STATS_SQL}) r""",
    "attempts", "requests",
)


def status_cards(spark, sf_dir):
    return outputs.status_cards(_status(spark, sf_dir))


QUERIES["status_cards"] = status_cards
ORACLE["status_cards"] = sql(
    _STATUS_FULL
    + """ select provider, '- ' || provider || ': ' || status || ' [' || family || '] requests=' || requests || ' ok=' || successes || ' failed=' || failures
      || case when circuit_state <> 'closed' then ' circuit=' || circuit_state else '' end || chr(10) || '    last error: ' || last_error as card from status_rows""",
    "attempts",
)
