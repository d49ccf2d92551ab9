"""Input views derived from the given tables, written once for Spark SQL and DuckDB.

``@name`` marks a base table, ``#each(alias column values)`` one copy of a row per listed value. Each
view covers its whole base table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from serploom.session import load

VIEWS = {
    # every line is reported by three sources: one ranks by line, one by part, one resells the second
    "ranked_lists": """
        select l_suppkey as query_id, v.provider,
               cast(case v.provider when 'tavily' then l_linenumber
                    when 'brave' then 1 + (l_partkey * 7 + l_suppkey) % 20
                    else 1 + cast(l_quantity as bigint) % 20 end as int) as provider_rank,
               p_name as title,
               'https://' || lower(p_type) || '-' || cast(p_size as varchar(4)) || '.Example.com:443/p/'
                 || cast(l_partkey as varchar(20))
                 || case v.provider when 'brave' then '/?utm_source=x' when 'searxng' then '#top'
                    else '' end as url,
               case when v.provider = 'searxng' then
                 case when l_partkey % 2 = 0 then 'brave' else 'google' end end as upstream_engine,
               case when l_returnflag = 'N' then null
                    else p_name || ' ' || substr('quick brown foxes jump over lazy dogs', 1, l_linenumber * 5)
                    end as snippet,
               l_shipdate as published_at
        from @lineitem join @part on l_partkey = p_partkey
        #each(v provider 'tavily', 'brave', 'searxng')
    """,
    "attempts": """
        select event_id, cast(floor(event_id / 5) as bigint) as query_id, ts, provider, ok, category,
               latency_ms, case when ok then k % 20 else 0 end as result_count,
               coalesce(category, '') <> 'circuit_open' as reached_network,
               not (coalesce(category, '') = 'timeout' and k % 2 = 0) as charged,
               case when not ok then provider || ' failed with ' || category end as message,
               'n=' || cast(k as varchar(4)) as note
        from (
          select event_id, ts, k, event_type <> 'error' as ok, cast(floor(value * 100) as int) as latency_ms,
                 case user_id % 9 when 0 then 'tavily' when 1 then 'brave' when 2 then 'mojeek'
                   when 3 then 'exa' when 4 then 'searxng' when 5 then 'open_web_search'
                   when 6 then 'duckduckgo' when 7 then 'startpage' else 'parallel' end as provider,
                 case when event_type = 'error' then
                   case k % 7 when 0 then 'timeout' when 1 then 'network' when 2 then 'rate_limited'
                     when 3 then 'authentication' when 4 then 'malformed_response'
                     when 5 then 'circuit_open' else 'cancelled' end end as category
          from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from @events) e0
        ) e1
    """,
    "requests": """
        select event_id as request_id, ts,
               case when user_id % 11 = 0 then '   ' else event_type || '  Query ' || cast(user_id % 10 as varchar(4)) end as query,
               case user_id % 3 when 0 then 'fast' when 1 then 'balanced' else 'thorough' end as mode,
               cast(regexp_extract(props, '([0-9]+)', 1) as int) % 25 as max_results_raw,
               case event_type when 'click' then 'day' when 'view' then 'week' when 'signup' then 'month'
                 when 'purchase' then 'year' else 'any' end as recency,
               case user_id % 4 when 0 then 'en-us' when 1 then ' DE_de ' when 2 then 'fr' else 'pt-braz' end as locale,
               case when user_id % 13 = 0 then 'exa' end as requested_provider,
               event_type <> 'error' as useful
        from @events
    """,
    "node_probes": """
        select event_id, ts, 'node' || cast(user_id % 4 as varchar(4)) as node, user_id % 4 = 0 as is_local,
               case event_type when 'error' then 503 when 'signup' then 403 else 200 end as status_code,
               event_type = 'purchase' and k % 3 = 0 as unreachable,
               case when event_type in ('error', 'signup') then 'refused'
                    when k % 10 = 9 then '{"results": "none"}'
                    else '{"results": ['
                      || case k % 4 when 0 then '' when 1 then '{"engine": "brave"}'
                         when 2 then '{"engine": "google", "engines": ["bing", "google"]}'
                         else '{"engines": ["mojeek"]}, {"engine": "brave", "url": "https://a.example.com"}' end
                      || '], "unresponsive_engines": [["bing", "timeout"], ["wiki"]'
                      || case when user_id % 3 = 0 then ', ["brave", "captcha"]' else '' end || ']}' end as body,
               cast(floor(value * 100) as int) as latency_ms
        from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from @events) e
    """,
    # five numbered pages per conversation, drawn from all pages
    "answer_sources": """
        select c.query_id, c.source_index, p.page_id, p.url, regexp_extract(p.html, '<title>([^<]*)</title>', 1) as title
        from (select d.conv_id as query_id, cast(n.i as int) as source_index,
                     (d.conv_id * 7 + n.i * 3) % (select count(*) from @pages) as page
              from (select distinct conv_id from @conversations) d #each(n i 1, 2, 3, 4, 5)) c
        join @pages p on p.page_id = c.page
    """,
    "answers": """
        select a.conv_id as query_id, a.turn,
               case when turn % 4 = 3 then 'INSUFFICIENT: ' else '' end || text
                 || ' [' || cast(turn % 5 + 1 as varchar(4)) || '][2] and [99] ['
                 || cast(turn % 5 + 1 as varchar(4)) || '] see https://nowhere.example.org/x'
                 || case when turn % 2 = 1 then ' or ' || upper(p.url) || '/ ' else '' end as text
        from (select *, (conv_id * 7 + 3) % (select count(*) from @pages) as page from @conversations
              where role = 'assistant') a
        join @pages p on p.page_id = a.page
    """,
    "host_addresses": """
        select host, cast(p.i as int) as position,
               case (length(host) + p.i * 3) % 8 when 0 then '93.184.216.34' when 1 then '10.0.0.5'
                 when 2 then '169.254.169.254' when 3 then '100.64.1.1' when 4 then '192.0.2.1'
                 when 5 then '198.41.0.4' when 6 then '127.0.0.1' else '8.8.8.8' end as ip
        from (select distinct split_part(url, '/', 3) as host from @pages) h
        #each(p i 0, 1)
        where length(host) % 5 <> 4
    """,
    "url_variants": """
        select page_id, v.variant,
               case v.variant
                 when 0 then url
                 when 1 then scheme || '//' || upper(host) || '.:' || port || rest
                 when 2 then split_part(url, '#', 1) || case when strpos_(url) > 0 then '&' else '?' end
                        || 'utm_Source=a&id=%7e1&&fbclid=z&q=a+b%20c&%75tm_term=x#frag'
                 when 3 then 'http://user:pw@' || host || ':8080/a%7Eb/%e4%zz/%41%2f/' || cast(page_id as varchar(20)) || '/'
                 when 4 then 'ftp://' || host || '/x#y'
                 when 5 then '  //' || host || ':443'
                 when 6 then host || '/plain/'
                 else 'https://' || host || '/?gclid=1' end as url
        from (select page_id, url, split_part(url, '/', 3) as host, split_part(url, '/', 1) as scheme,
                     case when url like 'https%' then '443' else '80' end as port,
                     substr(url, length(split_part(url, '/', 1)) + length(split_part(url, '/', 3)) + 3) as rest
              from @pages) p
        #each(v variant 0, 1, 2, 3, 4, 5, 6, 7)
    """.replace("strpos_(url)", "position('?' in url)"),
}


_EACH = r"#each\((\w+) (\w+) ([^)]*)\)"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Spark side of a view."""
    text = VIEWS[name]
    for table in sorted(set(re.findall(r"@([a-z]+)", text))):
        load(spark, sf_dir, table).createOrReplaceTempView(f"serploom_{table}")
    text = re.sub(_EACH, r"lateral view explode(array(\3)) \1 as \2", text)
    return spark.sql(re.sub(r"@([a-z]+)", r"serploom_\1", text))


def _plain(text: str) -> str:
    text = re.sub(_EACH, r"cross join unnest([\3]) as \1(\2)", text)
    return re.sub(r"@([a-z]+)", r"\1", text)


def sql(body: str, *names: str) -> str:
    """The DuckDB side: ``body`` over the named views, given as common table expressions."""
    parts = [f"{n} as ({_plain(VIEWS[n])})" for n in names]
    text = body.strip()
    if not parts:
        return text
    if re.match(r"with recursive\b", text, re.I):
        return "with recursive " + ", ".join(parts) + ", " + text[len("with recursive") :]
    if re.match(r"with\b", text, re.I):
        return "with " + ", ".join(parts) + ", " + text[len("with") :]
    return "with " + ", ".join(parts) + " " + text
