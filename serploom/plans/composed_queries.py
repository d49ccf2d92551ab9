"""Registered queries from landed payloads to fused results and documents."""

from __future__ import annotations

from serploom.operators import fusion
from serploom.operators.results import silver_results
from serploom.plans import payload_queries as built
from serploom.plans.fusion_queries import _TOP, family_sql, fusion_sql
from serploom.plans.output_queries import _TAIL_JSON, _TOP_COLUMNS, _searches
from serploom.session import load
from serploom.sinks import outputs
from serploom.sources.payloads import read_payloads, response_rows, result_rows

QUERIES = {}
ORACLE = {}

_LIMITED = "case when query_id % 7 = 0 then 429 else 200 end"


def fused_from_payloads(spark, sf_dir):
    """Three payloads per order: parsed, cleaned, deduplicated and fused with what their responses say.

    The payloads lie by query, and an order has a handful of URLs, nearly all of them shown.
    """
    landed = (
        built.payloads(spark, sf_dir, "tavily", built._tavily, _LIMITED)
        .unionByName(built.payloads(spark, sf_dir, "brave", built._brave))
        .unionByName(built.payloads(spark, sf_dir, "searxng", built._searxng))
    )
    parsed = read_payloads(landed)
    silver = silver_results(result_rows(parsed))
    answered = response_rows(parsed).filter("outcome = 'ok'").select("query_id", "provider", "upstream_engines")
    return fusion.fuse_by_query(silver, answered, limit=8, per_host=2)


# an item without engines is judged by the engines of its whole response
_ROWS_SQL = f"""i as {built.ITEMS_SQL},
    ranked_lists as (
      select query_id, provider_rank, title, url, cast(day as timestamp) as published_at, v.provider,
             case v.provider when 'tavily' then title || ' text'
                  when 'brave' then case when k > 0 then title else upper(title) end || ' one two' else day end as snippet,
             case when v.provider = 'searxng' then
               case k when 1 then 'brave' when 2 then 'bing' else 'said: ' || case when has_brave then 'brave' else '-' end end end as upstream_engine
      from (select *, bool_or(k = 1) over (partition by query_id) as has_brave from i)
      cross join unnest(['tavily', 'brave', 'searxng']) as v(provider)
      where v.provider <> 'tavily' or query_id % 7 <> 0),"""


def _fused_sql(columns: str) -> str:
    text = fusion_sql(
        "select distinct query_id, provider from lists", family_sql("v.upstream_engine"), "v.upstream_engine not like 'said:%'",
        _TOP.format(cap=2, limit=8, columns=columns),
    ).strip()
    return "with " + _ROWS_SQL + text.removeprefix("with")


def payload_fusion(spark, sf_dir):
    return fused_from_payloads(spark, sf_dir).select("query_id", "rank", "canonical_url", "score", "corroborated", "title", "snippet")


QUERIES["payload_fusion"] = payload_fusion
ORACLE["payload_fusion"] = _fused_sql("query_id, cast(rank as int) as rank, canonical_url, score, corroborated, title, snippet")


def payload_documents(spark, sf_dir):
    """The search document of every order, from its payloads."""
    return outputs.search_documents(_searches(load(spark, sf_dir, "orders"), "o_orderkey"), fused_from_payloads(spark, sf_dir))


QUERIES["payload_documents"] = payload_documents
ORACLE["payload_documents"] = (
    _fused_sql(_TOP_COLUMNS).replace(f"select {_TOP_COLUMNS} from", f", top as (select {_TOP_COLUMNS} from") + ")"
    + """ select o_orderkey as query_id, '{"query":"query ' || o_orderkey || '","results":' || coalesce(r.j, '[]') || """ + _TAIL_JSON.format(k="o_orderkey") + """ as document
    from orders left join (select query_id, '[' || string_agg(cast(to_json(struct_pack(rank := rank, title := title, url := url, sources := string_split(sources, ','), snippet := snippet, published_at := published)) as varchar), ',' order by rank) || ']' as j
      from top group by query_id) r on r.query_id = o_orderkey"""
)
