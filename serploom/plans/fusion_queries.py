"""Registered queries over ranked lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from serploom import dims
from serploom.functions import labels, urls
from serploom.operators import fusion
from serploom.operators.results import dedupe_in_response
from serploom.operators.results import silver_results as clean_silver
from serploom.plans.url_queries import canonical_sql
from serploom.plans.views import sql, view

QUERIES = {}
ORACLE = {}

_FACTS_SQL = "(values " + ", ".join(
    f"('{p[0]}', '{p[2]}', {str(p[3]).lower()}, {str(p[4]).lower()}, {p[5]}, "
    f"{str(p[2] in dims.INDEPENDENT_FAMILIES).lower()})"
    for p in dims.PROVIDERS
) + ") as f(provider, family, is_aggregator, is_scraper, provider_order, is_independent)"

_LISTS_SQL = canonical_sql(
    "ranked_lists",
    "url",
    "query_id, provider, provider_rank, title, url, upstream_engine, snippet, published_at",
)


def family_sql(engine: str) -> str:
    cases = " ".join(
        f"when contains(lower({engine}), '{needle}') then '{family}'"
        for needle, family in dims.ENGINE_FAMILIES
    )
    return f"case {cases} end"


def ranked_lists(spark, sf_dir):
    return with_keys(view(spark, sf_dir, "ranked_lists"))


def with_keys(lists):
    """Landed rows with their canonical URL, its host and the engines as a list."""
    lists = lists.withColumn(
        "upstream_engines",
        F.when(F.col("upstream_engine").isNotNull(), F.array("upstream_engine")),
    )
    return urls.with_canonical_url(lists, "url", host_out="host")


def fusion_sql(responses: str, resold: str, named: str, select: str) -> str:
    """SQL twin of the fusion: votes, contributions and clusters, then ``select``."""
    return f"""
    with lists as {_LISTS_SQL},
    votes as (select query_id, canonical_url, provider, min(greatest(provider_rank, 1)) as rank from lists group by all),
    full_votes as (select v.*, min(l.url) as url, min(struct_pack(u := l.url, t := l.title, s0 := coalesce(l.snippet, ''), s := l.snippet, p := l.published_at)) as x,
                   any_value(l.upstream_engine) as upstream_engine, any_value(l.host) as host
                   from votes v join lists l using (query_id, canonical_url, provider)
                   where greatest(l.provider_rank, 1) = v.rank group by all),
    responses as ({responses}),
    owned as (select distinct query_id, family from responses join {_FACTS_SQL} using (provider) where not is_aggregator),
    contributions as (
      select v.query_id, v.canonical_url, v.provider, v.rank, v.url, v.host, v.x.t as title, v.x.s as snippet, v.x.p as published_at,
             f.provider_order, case when o.family is not null and ({named}) then o.family else f.family end as vote_family,
             case when o.family is not null then 0.7 else 1.0 end / (60.0 + v.rank) as share
      from full_votes v join {_FACTS_SQL} on f.provider = v.provider
      left join owned o on o.query_id = v.query_id and f.is_aggregator and o.family in ('brave', 'mojeek', 'tavily') and o.family = ({resold})),
    clusters as (
      select query_id, canonical_url, round(sum(cast(share as double)), 12) as score, min(rank) as best_rank,
             array_to_string(list_sort(list_distinct(list(vote_family))), ',') as families,
             count(distinct vote_family) >= 2 and bool_or(vote_family in ('brave', 'mojeek', 'tavily')) as corroborated,
             array_to_string(list(provider order by rank, provider_order), ',') as sources,
             arg_min(title, rank * 100 + provider_order) as title, arg_min(url, rank * 100 + provider_order) as url, min(host) as host,
             arg_max(snippet, length(snippet) * 1000000 - rank * 100 - provider_order) as snippet, min(published_at) as published_at
      from contributions group by query_id, canonical_url)
    {select}"""


_FLAT_RESPONSES = "select distinct query_id, provider from lists"
_TOP = """, hosts as (select *, row_number() over (partition by query_id, host order by score desc, corroborated desc, best_rank, canonical_url) as in_host from clusters),
    ranked as (select *, row_number() over (partition by query_id order by score desc, corroborated desc, best_rank, canonical_url) as rank from hosts where in_host <= {cap})
    select {columns} from ranked where rank <= {limit}"""

_COLUMNS = [
    "query_id", "rank", "title", "url", "canonical_url", "host", "score", "corroborated", "best_rank", "snippet",
]


def fused_results(spark, sf_dir):
    fused = fusion.fuse(ranked_lists(spark, sf_dir), limit=8, per_host=2)
    return fused.select(
        *_COLUMNS,
        F.array_join("sources", ",").alias("sources"),
        F.date_format("published_at", "yyyy-MM-dd").alias("published"),
    )


QUERIES["fused_results"] = fused_results
ORACLE["fused_results"] = sql(
    fusion_sql(
        _FLAT_RESPONSES, family_sql("v.upstream_engine"), "true",
        _TOP.format(
            cap=2, limit=8,
            columns=", ".join(_COLUMNS).replace("rank,", "cast(rank as int) as rank,", 1)
            + ", sources, strftime(published_at, '%Y-%m-%d') as published",
        ),
    ),
    "ranked_lists",
)


def fused_uncapped(spark, sf_dir):
    lists = ranked_lists(spark, sf_dir).withColumn(
        "result_limit", (1 + F.col("query_id") % 20).cast("int")
    )
    fused = fusion.fuse(lists, per_host=0)
    return fused.select("query_id", "rank", "canonical_url", "score")


QUERIES["fused_uncapped"] = fused_uncapped
ORACLE["fused_uncapped"] = sql(
    fusion_sql(
        _FLAT_RESPONSES, family_sql("v.upstream_engine"), "true",
        _TOP.format(cap=10**9, limit="1 + query_id % 20",
                    columns="query_id, cast(rank as int) as rank, canonical_url, score"),
    ),
    "ranked_lists",
)


def fusion_diagnostics(spark, sf_dir):
    scored = fusion.fusion_diagnostics(ranked_lists(spark, sf_dir))
    return scored.select(
        "query_id", "canonical_url", "score", "corroborated", "best_rank",
        F.array_join("families", ",").alias("families"),
        F.array_join("sources", ",").alias("sources"),
    )


QUERIES["fusion_diagnostics"] = fusion_diagnostics
ORACLE["fusion_diagnostics"] = sql(
    fusion_sql(
        _FLAT_RESPONSES, family_sql("v.upstream_engine"), "true",
        "select query_id, canonical_url, score, corroborated, best_rank, families, sources from clusters",
    ),
    "ranked_lists",
)


def fusion_response_resale(spark, sf_dir):
    """Rows do not name their engines; the response does, and one more source answered with nothing."""
    lists = ranked_lists(spark, sf_dir).drop("upstream_engines")
    responses = lists.select("query_id", "provider").distinct().withColumn(
        "upstream_engines", F.when(F.col("provider") == "searxng", F.array(F.lit("bing"), F.lit("Mojeek API")))
    )
    empty = responses.filter("provider = 'brave' and query_id % 2 = 0").withColumn("provider", F.lit("mojeek"))
    scored = fusion.fusion_diagnostics(lists, responses.unionByName(empty))
    return scored.select("query_id", "canonical_url", "score", "corroborated", F.array_join("families", ",").alias("families"))


QUERIES["fusion_response_resale"] = fusion_response_resale
ORACLE["fusion_response_resale"] = sql(
    fusion_sql(
        _FLAT_RESPONSES + " union all select distinct query_id, 'mojeek' from lists where query_id % 2 = 0 and provider = 'brave'",
        "case when v.provider = 'searxng' then 'mojeek' end", "false",
        "select query_id, canonical_url, score, corroborated, families from clusters",
    ),
    "ranked_lists",
)


def owned_families(spark, sf_dir):
    attempts = view(spark, sf_dir, "attempts").filter("ok")
    return fusion.owned_families(attempts.select("query_id", "provider"))


QUERIES["owned_families"] = owned_families
ORACLE["owned_families"] = sql(
    f"select distinct query_id, family from attempts join {_FACTS_SQL} using (provider) where ok and not is_aggregator",
    "attempts",
)


def best_ranks(spark, sf_dir):
    votes = fusion.best_rank_votes(ranked_lists(spark, sf_dir), texts=False)
    return votes.select("query_id", "provider", "canonical_url", "rank")


QUERIES["best_ranks"] = best_ranks
ORACLE["best_ranks"] = sql(
    f"""select query_id, provider, canonical_url, min(greatest(provider_rank, 1)) as rank
    from {_LISTS_SQL} group by all""",
    "ranked_lists",
)


def deduped_results(spark, sf_dir):
    shown = ["query_id", "provider", "canonical_url", "provider_rank", "url"]
    return dedupe_in_response(ranked_lists(spark, sf_dir).select(*shown))


QUERIES["deduped_results"] = deduped_results
ORACLE["deduped_results"] = sql(
    f"""select query_id, provider, canonical_url, provider_rank, url from (
      select *, row_number() over (partition by query_id, provider, canonical_url order by provider_rank, url, title, snippet) as n
      from {_LISTS_SQL}) where n = 1""",
    "ranked_lists",
)


def silver_results(spark, sf_dir):
    """Raw rows with broken URLs, markup in titles and blank snippets, cleaned and deduplicated."""
    lists = view(spark, sf_dir, "ranked_lists")
    raw = lists.select(
        "query_id", "provider", "provider_rank", "published_at",
        F.expr(
            "case provider_rank % 5 when 0 then 'mailto:x@y' when 1 then substr(url, 9) when 2 then ' ' || substr(url, 7) else url end"
        ).alias("url"),
        F.expr("case when provider_rank % 4 = 0 then '<i></i>' else '<b>' || title || '</b> &amp;&nbsp;more' end").alias("title"),
        F.expr("coalesce(snippet, '  ') || '<br'").alias("snippet"),
    )
    silver = clean_silver(raw, ["example.com"], ["large-7.example.com", "WWW.standard-9.example.com"])
    return silver.select("query_id", "provider", "provider_rank", "canonical_url", "host", "title", "snippet")


QUERIES["silver_results"] = silver_results
ORACLE["silver_results"] = sql(
    f"""with fixed as (select *, 'https://' || substr(url, 9) as fixed_url from ranked_lists where provider_rank % 5 <> 0),
    c as {canonical_sql("fixed", "fixed_url", "query_id, provider, provider_rank, title, snippet, url")},
    t as (select *, case when provider_rank % 4 = 0 then host else title || ' & more' end as clean_title from c
          where host not in ('large-7.example.com', 'standard-9.example.com'))
    select query_id, provider, provider_rank, canonical_url, host, clean_title as title, nullif(trim(coalesce(snippet, '')), '') as snippet
    from (select *, row_number() over (partition by query_id, provider, canonical_url order by provider_rank, url, clean_title, snippet nulls first) as n from t)
    where n = 1""",
    "ranked_lists",
)


def engine_families(spark, sf_dir):
    named = view(spark, sf_dir, "ranked_lists").filter("upstream_engine is not null")
    named = named.select(F.concat(F.upper("upstream_engine"), F.lit(" "), F.col("title")).alias("engine"))
    family = labels.engine_family(F.col("engine"))
    return named.groupBy("engine").agg(F.count("*").alias("n")).select(
        "engine", "n", family.alias("family"),
        F.coalesce(labels.is_independent(family), F.lit(False)).alias("independent"),
    )


QUERIES["engine_families"] = engine_families
ORACLE["engine_families"] = sql(
    f"""select engine, n, {family_sql('engine')} as family, coalesce({family_sql('engine')} in ('brave', 'mojeek', 'tavily'), false) as independent
    from (select upper(upstream_engine) || ' ' || title as engine, count(*) as n from ranked_lists where upstream_engine is not null group by 1)""",
    "ranked_lists",
)


def provider_facts(spark, sf_dir):
    tries = fusion.attach_provider(view(spark, sf_dir, "attempts").select("event_id", "provider"))
    kind = labels.provider_kind(F.col("is_scraper"), F.col("is_aggregator"), F.col("is_independent"))
    return tries.groupBy("provider", "family", kind.alias("kind")).agg(F.count("*").alias("tries"))


QUERIES["provider_facts"] = provider_facts
ORACLE["provider_facts"] = sql(
    f"""select provider, family, case when is_scraper then 'scraper' when is_aggregator then 'aggregator'
      when is_independent then 'index' else 'search' end as kind, count(*) as tries
    from attempts join {_FACTS_SQL} using (provider) group by all""",
    "attempts",
)
