"""Registered queries over attempt logs, probes, runs and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from serploom import dims
from serploom.operators import fusion, health, routing, runs, states
from serploom.plans.fusion_queries import _FACTS_SQL, fusion_sql, _FLAT_RESPONSES, _TOP, family_sql, ranked_lists
from serploom.plans.state_queries import OBSERVED_SQL
from serploom.plans.text_queries import DIGEST_SQL, digest_of
from serploom.plans.views import sql, view
from serploom.sources.probes import read_node_probes

QUERIES = {}
ORACLE = {}

REUSE_MS = 2 * 3600 * 1000

_SETTINGS = [
    ("tavily", True, True), ("brave", True, True), ("mojeek", False, True), ("exa", True, True), ("searxng", True, True),
    ("open_web_search", True, False), ("duckduckgo", True, True), ("startpage", True, True), ("parallel", True, True),
]
_SETTINGS_SQL = "(values " + ", ".join(f"('{p}', {str(c).lower()}, {str(e).lower()})" for p, c, e in _SETTINGS) + ") as s(provider, configured, enabled)"


def settings(spark):
    return spark.createDataFrame(_SETTINGS, "provider string, configured boolean, enabled boolean")


_FAILED_SQL = "not ok and reached_network and category not in ('circuit_open', 'cancelled')"
_COUNTERS_SQL = f"""select provider, count(*) filter (where reached_network) as requests, count(*) filter (where ok) as successes,
    count(*) filter (where {_FAILED_SQL}) as failures, cast(coalesce(sum(latency_ms) filter (where ok), 0) as bigint) as latency_total_ms,
    coalesce(cast(sum(latency_ms) filter (where ok) // nullif(count(*) filter (where ok), 0) as bigint), 0) as average_latency_ms,
    arg_max(latency_ms, ts) filter (where ok) as last_latency_ms, arg_max(result_count, ts) filter (where ok) as last_result_count,
    strftime(max(ts) filter (where ok), '%Y-%m-%dT%H:%M:%S.%gZ') as last_success_at, strftime(max(ts) filter (where {_FAILED_SQL}), '%Y-%m-%dT%H:%M:%S.%gZ') as last_failure_at,
    arg_max(message, ts) filter (where {_FAILED_SQL}) as last_error, arg_max(category, ts) filter (where {_FAILED_SQL}) as last_error_category,
    coalesce(string_agg(distinct category, ',' order by category), '') as categories
    from attempts group by provider"""
_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _stamped(df, *columns):
    return df.withColumns({c: F.date_format(c, _STAMP) for c in columns})


def provider_counters(spark, sf_dir):
    return _stamped(health.provider_counters(view(spark, sf_dir, "attempts")), "last_success_at", "last_failure_at")


QUERIES["provider_counters"] = provider_counters
ORACLE["provider_counters"] = sql(_COUNTERS_SQL, "attempts")


def provider_status_of(spark, sf_dir):
    attempts = view(spark, sf_dir, "attempts")
    return health.provider_status(health.provider_counters(attempts), states.observed_states(attempts), settings(spark))


def provider_status(spark, sf_dir):
    return provider_status_of(spark, sf_dir).select("provider", "status", "circuit_state", "requests", "successes", "failures")


QUERIES["provider_status"] = provider_status
_STATUS_SQL = f"""select s.provider, case when not configured then 'not_configured' when not enabled then 'disabled' when o.circuit_state = 'open' then 'circuit_open'
        when o.circuit_state = 'half_open' then 'probing' when o.rate_limited then 'rate_limited' else 'ready' end as status,
        coalesce(o.circuit_state, 'closed') as circuit_state, n.requests, n.successes, n.failures
    from {_SETTINGS_SQL} left join ({OBSERVED_SQL}) o using (provider) left join ({_COUNTERS_SQL}) n using (provider)"""
ORACLE["provider_status"] = sql(_STATUS_SQL, "attempts")


_PROBE_STATES = """select s.provider, case when healthy then 'OK' when not healthy then 'FAIL' when not enabled then 'OFF' when configured then 'IDLE' else 'NO KEY' end as state,
      case when f.is_scraper then 'scraper' when f.is_aggregator then 'aggregator' when f.is_independent then 'index' else 'search' end as kind,
      probes, successes, failures, average_latency_ms, last_result_count, last_error_category, categories, coalesce(round(successes / (successes + failures), 6), 0.0) as success_rate
    from {settings} join {facts} using (provider) left join (select provider, count(*) as probes, count(*) filter (where ok) as successes, count(*) filter (where not ok) as failures,
      cast(sum(latency_ms) filter (where ok) // count(*) filter (where ok) as bigint) as average_latency_ms, arg_max(ok, ts) as healthy,
      arg_max(result_count, ts) as last_result_count, arg_max_null(category, ts) as last_error_category,
      coalesce(string_agg(distinct category, ',' order by category), '') as categories from attempts group by provider) p using (provider)"""
_PROBE_SQL = _PROBE_STATES.format(settings=_SETTINGS_SQL, facts=_FACTS_SQL)


def _probes(spark, sf_dir):
    return health.probe_status(view(spark, sf_dir, "attempts"), settings(spark))


PROBE_COLUMNS = [
    "provider", "state", "kind", "probes", "successes", "failures", "average_latency_ms", "last_result_count",
    "last_error_category", "categories", "success_rate",
]


def probe_status(spark, sf_dir):
    return _probes(spark, sf_dir).select(*PROBE_COLUMNS)


QUERIES["probe_status"] = probe_status
ORACLE["probe_status"] = sql(_PROBE_SQL, "attempts")

_READ_PROBES_SQL = """select *, case when unreachable then 'down' when status_code <> 200 or decoded is null then 'degraded' when result_count = 0 then 'degraded' else 'up' end as state,
      case when unreachable then 'unreachable' when status_code = 403 then 'JSON disabled (add `json` to search.formats)' when status_code <> 200 then 'HTTP ' || status_code
           when decoded is null then 'JSON response was not a SearXNG payload' when result_count = 0 then 'no results returned' end as error,
      case when state = 'up' then case result_count when 2 then 'brave,mojeek' else case when contains(body, 'bing", "google') then 'bing,google' else 'brave' end end else '' end as engines,
      case when unreachable or status_code <> 200 or decoded is null then '' when contains(body, 'captcha') then 'bing: timeout,brave: captcha' else 'bing: timeout' end as unavailable_engines
    from (select * exclude (latency_ms), case when unreachable then null else latency_ms end as latency_ms,
        case when body like '{"results": [%' then 1 end as decoded, case when unreachable or status_code <> 200 then 0 when contains(body, 'mojeek') then 2 when contains(body, '"engine": ') then 1 else 0 end as result_count
      from node_probes)"""


def node_probe_states(spark, sf_dir):
    probes = read_node_probes(view(spark, sf_dir, "node_probes"))
    return probes.select(
        "event_id", "node", "state", "error", "latency_ms", "result_count",
        F.array_join("engines", ",").alias("engines"), F.array_join("unavailable_engines", ",").alias("unavailable_engines"),
    )


QUERIES["node_probe_states"] = node_probe_states
ORACLE["node_probe_states"] = sql(
    f"select event_id, node, state, error, latency_ms, result_count, engines, unavailable_engines from ({_READ_PROBES_SQL})", "node_probes"
)
_NODES_SQL = f"""select node, bool_or(is_local) as is_local, count(*) as checks, count(*) filter (where state <> 'up') as failures, arg_max(state, ts) as state, coalesce(string_agg(distinct state, ',' order by state), '') as states,
      arg_max_null(latency_ms, ts) as latency_ms, arg_max(result_count, ts) as result_count, arg_max(engines, ts) as engines, arg_max(unavailable_engines, ts) as unavailable_engines,
      arg_max_null(error, ts) as error, strftime(max(ts) filter (where state = 'up'), '%Y-%m-%dT%H:%M:%S.%gZ') as last_success_at,
      round((count(*) - count(*) filter (where state <> 'up')) / count(*), 6) as success_rate from ({_READ_PROBES_SQL}) group by node"""


def _nodes(spark, sf_dir):
    return health.node_status(read_node_probes(view(spark, sf_dir, "node_probes")))


def node_status(spark, sf_dir):
    nodes = _stamped(_nodes(spark, sf_dir), "last_success_at")
    return nodes.withColumns(
        {"engines": F.array_join("engines", ","), "unavailable_engines": F.array_join("unavailable_engines", ",")}
    )


QUERIES["node_status"] = node_status
ORACLE["node_status"] = sql(_NODES_SQL, "node_probes")

# per user nodes: a fleet large enough for every warning
_FLEET = "(select * replace ('node' || lpad(cast(uid as varchar), 3, '0') as node, uid = 0 as is_local) from (select n.*, e.user_id as uid from node_probes n join events e using (event_id)))"


def _fleet(spark, sf_dir):
    from serploom.session import load

    users = load(spark, sf_dir, "events").select("event_id", "user_id")
    probes = view(spark, sf_dir, "node_probes").join(users, "event_id")
    probes = probes.withColumns(
        {"node": F.concat(F.lit("node"), F.lpad(F.col("user_id").cast("string"), 3, "0")), "is_local": F.col("user_id") == 0}
    )
    return health.node_status(read_node_probes(probes.drop("user_id")))


def fleet_warnings(spark, sf_dir):
    return health.fleet_warnings(_fleet(spark, sf_dir), _probes(spark, sf_dir)).select("position", "weight", "warning")


_FLEET_NODES_SQL = _NODES_SQL.replace("from node_probes)", f"from {_FLEET})")
QUERIES["fleet_warnings"] = fleet_warnings
ORACLE["fleet_warnings"] = sql(
    f"""with nodes as ({_FLEET_NODES_SQL}), prov as ({_PROBE_SQL}), eng as (select trim(split_part(unnest(string_split(nullif(unavailable_engines, ''), ',')), ':', 1)) as engine from nodes)
    select 1 as position, cast(0 as bigint) as weight, 'this machine''s SearXNG (' || node || ') is down — the local server has no local provider' as warning from nodes where is_local and state = 'down'
    union all select 2, 0, count(*) || ' node(s) unreachable: ' || string_agg(node, ', ' order by node) from nodes where not is_local and state = 'down' having count(*) > 0
    union all select 3, count(*), 'engine ''' || engine || ''' unavailable on ' || count(*) || ' node(s)' from eng group by engine having count(*) >= greatest(2, (select count(*) from nodes) // 2)
    union all select 4, 0, count(*) || ' provider(s) have no credentials; press p to probe the rest' from prov where state = 'NO KEY' having count(*) > 0""",
    "node_probes", "attempts",
)


def fleet_verdict(spark, sf_dir):
    return health.fleet_verdict(_fleet(spark, sf_dir), _probes(spark, sf_dir))


QUERIES["fleet_verdict"] = fleet_verdict
ORACLE["fleet_verdict"] = sql(
    f"""with nodes as ({_FLEET_NODES_SQL}), prov as ({_PROBE_SQL}), n as (select count(*) as nodes, count(*) filter (where state = 'up') as nodes_up from nodes),
    p as (select count(*) filter (where state not in ('NO KEY', 'OFF')) as in_service, count(*) filter (where state = 'OK') as providers_ok from prov)
    select *, (nodes > 0 and nodes_up = 0) or (in_service > 0 and providers_ok = 0) as unhealthy from n cross join p""",
    "node_probes", "attempts",
)


def fleet_header(spark, sf_dir):
    return health.fleet_header(_fleet(spark, sf_dir), _probes(spark, sf_dir))


QUERIES["fleet_header"] = fleet_header
ORACLE["fleet_header"] = sql(
    f"""with nodes as ({_FLEET_NODES_SQL}), prov as ({_PROBE_SQL})
    select 'node' as kind, state, count(*) as n from nodes group by state union all select 'provider', state, count(*) from prov group by state""",
    "node_probes", "attempts",
)


def engine_contribution(spark, sf_dir):
    from serploom.sources.probes import PROBE_SCHEMA

    items = view(spark, sf_dir, "node_probes").select(F.explode(F.from_json("body", PROBE_SCHEMA)["results"]).alias("r"))
    return health.engine_contribution(items.select("r.engine", "r.engines"))


QUERIES["engine_contribution"] = engine_contribution
ORACLE["engine_contribution"] = sql(
    """select engine, count(*) as rows from (
      select unnest(case when contains(body, 'bing", "google') then ['bing', 'google'] when contains(body, 'mojeek') then ['mojeek', 'brave']
        when contains(body, '{"engine": "brave"}') then ['brave'] else [] end) as engine from node_probes where body like '{"results": [%') group by engine""",
    "node_probes",
)


def probe_queries(spark, sf_dir):
    probes = view(spark, sf_dir, "node_probes").select("event_id")
    return health.rotate_queries(probes, "event_id").groupBy("probe_query").agg(F.count("*").alias("probes"))


QUERIES["probe_queries"] = probe_queries
ORACLE["probe_queries"] = (
    "select [" + ", ".join(f"'{q}'" for q in dims.PROBE_QUERIES) + f"][1 + event_id % {len(dims.PROBE_QUERIES)}] as probe_query, count(*) as probes from events group by 1"
)


# --- runs -------------------------------------------------------------------------------------------
def search_summary(spark, sf_dir):
    s = runs.search_summary(view(spark, sf_dir, "attempts"))
    return s.select(
        "query_id", F.array_join("providers_used", ",").alias("providers_used"), "attempted", "failed", "results", "outcome", "warning"
    )


QUERIES["search_summary"] = search_summary
ORACLE["search_summary"] = sql(
    """with e as (select query_id, provider, ok, category, min(ts) as ts, count(*) as n, count(*) filter (where reached_network) as reached, sum(result_count) as results from attempts group by all),
    u as (select query_id, provider, min(ts) as ts from e where ok group by all),
    s as (select query_id, cast(sum(reached) as bigint) as attempted, cast(sum(case when ok then 0 else n end) as bigint) as failed, cast(sum(results) as bigint) as results,
          count(*) filter (where not ok) || ' provider(s) failed: ' || string_agg(provider || ' (' || category || ')', ', ' order by ts) filter (where not ok) || '.' as warning from e group by query_id)
    select s.query_id, coalesce(u.providers_used, '') as providers_used, attempted, failed, results, warning,
      case when results > 0 then 'ok' when attempted = 0 and failed > 0 then 'temporarily_unavailable' else 'providers_failed' end as outcome
    from s left join (select query_id, string_agg(provider, ',' order by ts) as providers_used from u group by query_id) u using (query_id)""",
    "attempts",
)


def answer_warnings(spark, sf_dir):
    from serploom.session import load

    docs = load(spark, sf_dir, "documents").select(
        "doc_id", F.expr("element_at(array('tavily', 'brave', 'searxng'), cast(1 + doc_id % 3 as int))").alias("provider"),
        F.expr("case when n_chars % 5 = 0 then '' else text end").alias("answer"),
        F.expr("case when lang = 'en' then array('slow', 'partial') end").alias("warnings"),
    )
    return runs.answer_warnings(docs).select("doc_id", F.array_join("all_warnings", "|").alias("warnings"))


QUERIES["answer_warnings"] = answer_warnings
ORACLE["answer_warnings"] = """
    select doc_id, concat_ws('|', case when n_chars % 5 <> 0 and text <> '' then ['Tavily', 'Brave Search', 'SearXNG'][1 + doc_id % 3] || ' supplied answer (untrusted, not fetched): '
      || case when length(text) > 300 then left(text, 300) || '…' else text end end, case when lang = 'en' then 'slow|partial' end) as warnings from documents"""


def run_latency(spark, sf_dir):
    per_query = view(spark, sf_dir, "attempts").groupBy("query_id").agg(F.sum("latency_ms").alias("latency_ms"))
    return runs.run_latency(per_query)


QUERIES["run_latency"] = run_latency
ORACLE["run_latency"] = sql(
    """with q as (select query_id, cast(sum(latency_ms) as bigint) as ms from attempts group by query_id)
    select count(*) as queries, min(ms) as min_ms, list_sort(list(ms))[cast(count(*) // 2 + 1 as int)] as median_ms, max(ms) as max_ms, round(avg(ms), 3) as wall_per_query_ms from q""",
    "attempts",
)


def run_participation(spark, sf_dir):
    return runs.run_participation(view(spark, sf_dir, "attempts"))


QUERIES["run_participation"] = run_participation
ORACLE["run_participation"] = sql(
    f"""select f.provider, count(distinct query_id) as queries from {_FACTS_SQL} left join
    (select * from attempts where ok) a on a.provider = f.provider group by f.provider""",
    "attempts",
)


def run_failures(spark, sf_dir):
    return runs.run_failures(view(spark, sf_dir, "attempts"))


QUERIES["run_failures"] = run_failures
ORACLE["run_failures"] = sql(
    "select provider, category, count(*) as failures from attempts where not ok group by grouping sets ((provider), (category), (provider, category))",
    "attempts",
)


def run_verdict(spark, sf_dir):
    attempts = view(spark, sf_dir, "attempts")
    return runs.run_verdict(attempts, settings(spark).filter("configured"))


QUERIES["run_verdict"] = run_verdict
ORACLE["run_verdict"] = sql(
    f"""with q as (select query_id, bool_or(ok) as any_ok from attempts group by query_id),
    silent as (select provider from {_SETTINGS_SQL} where configured except select provider from attempts where ok)
    select count(*) as queries, count(*) filter (where not any_ok) as errors, case when bool_and(not any_ok) then 'every query errored'
      when (select count(*) from silent) > 0 then 'requested provider(s) contributed to no query: ' || (select string_agg(provider, ', ' order by provider) from silent) end as failure from q""",
    "attempts",
)


def silent_providers(spark, sf_dir):
    attempts = view(spark, sf_dir, "attempts")
    return runs.silent_providers(attempts, settings(spark))


QUERIES["silent_providers"] = silent_providers
ORACLE["silent_providers"] = sql(
    f"""select provider from {_SETTINGS_SQL} except select provider from attempts where ok""",
    "attempts",
)


def retried_outcomes(spark, sf_dir):
    """Failures of even queries are retried; half of the retries succeed. The passes are unioned."""
    attempts = view(spark, sf_dir, "attempts").select("event_id", "query_id", "provider", "ok", "category")
    retried = attempts.filter("not ok and query_id % 2 = 0").withColumns(
        {"ok": F.col("event_id") % 2 == 0, "category": F.when(F.col("event_id") % 2 == 1, F.lit("timeout")), "pass": F.lit("retry")}
    )
    return runs.replace_failures(attempts, retried).select("event_id", "query_id", "provider", "ok", "category", "pass")


QUERIES["retried_outcomes"] = retried_outcomes
ORACLE["retried_outcomes"] = sql(
    """select event_id, query_id, provider, ok or event_id % 2 = 0 and query_id % 2 = 0 as ok,
      case when not ok and query_id % 2 = 0 then case when event_id % 2 = 1 then 'timeout' end else category end as category,
      case when not ok and query_id % 2 = 0 then 'retry' end as pass from attempts""",
    "attempts",
)


def thin_queries(spark, sf_dir):
    from serploom.session import load

    fused = fusion.fuse(ranked_lists(spark, sf_dir), limit=8, per_host=2)
    requests = load(spark, sf_dir, "supplier").select(
        (2 * F.col("s_suppkey")).alias("query_id"), F.lit("thorough").alias("mode"), (F.col("s_suppkey") % 8 + 1).cast("int").alias("result_limit")
    )  # every other supplier, and as many queries that found nothing
    return runs.thin_queries(requests, fused).select("query_id", "result_limit", "fused_rows")


QUERIES["thin_queries"] = thin_queries
ORACLE["thin_queries"] = sql(
    fusion_sql(
        _FLAT_RESPONSES, family_sql("v.upstream_engine"), "true",
        _TOP.format(cap=2, limit=8, columns="query_id, score").replace("select query_id, score from", ", fusedrows as (select query_id, score from")
        + """), n as (select query_id, count(*) as n from fusedrows group by query_id)
        select 2 * s_suppkey as query_id, cast(s_suppkey % 8 + 1 as int) as result_limit, coalesce(n.n, 0) as fused_rows from supplier left join n on n.query_id = 2 * s_suppkey
        where coalesce(n.n, 0) < least(s_suppkey % 8 + 1, 3)""",
    ),
    "ranked_lists",
)


# --- routing ----------------------------------------------------------------------------------------
_PLACES_SQL = f"""(select provider, is_aggregator, row_number() over (order by case when is_scraper then 3 when is_aggregator then 2 when is_independent then 0 else 1 end, provider_order) as place
    from {_FACTS_SQL} join {_SETTINGS_SQL} using (provider) where configured and enabled)"""
_ASSIGN_SQL = f"""select request_id, p.provider, cast(case when requested_provider is not null then 1 else place end as int) as place from requests r join {_PLACES_SQL} p
    on case when requested_provider is not null then p.provider = requested_provider else p.place <= case mode when 'fast' then 1 when 'balanced' then 2 else 3 end end"""


def assign_sources(spark, sf_dir):
    assigned = routing.assign_sources(view(spark, sf_dir, "requests"), settings(spark))
    return assigned.select("request_id", "provider", "place")


QUERIES["assign_sources"] = assign_sources
ORACLE["assign_sources"] = sql(_ASSIGN_SQL, "requests")


def remaining_providers(spark, sf_dir):
    attempts = view(spark, sf_dir, "attempts")
    needs = attempts.groupBy("query_id").agg(F.count_if(~F.col("reached_network")).cast("int").alias("slots"))
    left = routing.remaining_providers(needs.withColumn("slots", F.col("slots") + 1), attempts, settings(spark))
    extra = routing.remaining_providers(needs.withColumn("slots", F.lit(9)), attempts, settings(spark), True)
    return left.withColumn("pool", F.lit("all")).unionByName(extra.withColumn("pool", F.lit("aggregators"))).select("query_id", "provider", "place", "pool")


QUERIES["remaining_providers"] = remaining_providers
ORACLE["remaining_providers"] = sql(
    f"""with n as (select query_id, count(*) filter (where not reached_network) + 1 as slots from attempts group by query_id),
    c as (select n.query_id, n.slots, p.provider, p.is_aggregator, p.place as pref from n cross join {_PLACES_SQL} p
          where not exists (select 1 from attempts a where a.query_id = n.query_id and a.provider = p.provider)),
    r as (select *, cast(row_number() over (partition by query_id order by pref) as int) as place, cast(row_number() over (partition by query_id, is_aggregator order by pref) as int) as aplace from c)
    select query_id, provider, place, 'all' as pool from r where place <= slots union all select query_id, provider, aplace, 'aggregators' from r where is_aggregator""",
    "attempts",
)


def missing_answers(spark, sf_dir):
    assigned = routing.assign_sources(view(spark, sf_dir, "requests"), settings(spark)).withColumnRenamed("request_id", "query_id")
    outcomes = view(spark, sf_dir, "attempts").select(F.col("event_id").alias("query_id"), "provider")
    return routing.missing_answers(assigned, outcomes).select("query_id", "provider", "category", "message")


QUERIES["missing_answers"] = missing_answers
_NAMES_SQL = "(values " + ", ".join(f"('{p[0]}', '{p[1]}')" for p in dims.PROVIDERS) + ") as d(provider, display_name)"
ORACLE["missing_answers"] = sql(
    f"""select m.query_id, m.provider, 'timeout' as category, display_name || ' exceeded the search time budget.' as message
    from (select request_id as query_id, provider from ({_ASSIGN_SQL}) except select event_id, provider from attempts) m join {_NAMES_SQL} using (provider)""",
    "requests", "attempts",
)


def fan_in_of(spark, sf_dir):
    assigned = routing.assign_sources(view(spark, sf_dir, "requests"), settings(spark)).select(
        F.col("request_id").alias("query_id"), "provider", "mode", F.col("ts").cast("timestamp").alias("started_at")
    )
    a = view(spark, sf_dir, "attempts")
    arrived = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("latency_ms").cast("bigint") * 3000)
    responses = a.select(F.col("event_id").alias("query_id"), "provider", arrived.alias("arrived_at"), "ok")
    brave = a.select(F.col("event_id").alias("query_id"), F.lit("brave").alias("provider"), arrived.alias("arrived_at"), F.lit(True).alias("ok"))
    return assigned, responses.unionByName(brave)


def deadline_fan_in(spark, sf_dir):
    fan_in = routing.deadline_fan_in(*fan_in_of(spark, sf_dir))
    return fan_in.select("query_id", "provider", "outcome", "late", F.unix_micros("settled_at").alias("settled_us"))


_FAN_IN_SQL = f"""select query_id, provider, case when f is null then 'timeout' when f.ok then 'answered' else 'failed' end as outcome, f is null and any_response as late,
      coalesce(f.us, deadline) as settled_us
    from (select s.query_id, s.provider, s.deadline, min(struct_pack(us := r.us, ok := r.ok)) filter (where r.us <= s.deadline) as f, count(r.us) > 0 as any_response
      from (select q.request_id as query_id, a.provider, epoch_us(q.ts) + case q.mode when 'fast' then 12000000 when 'balanced' then 15000000 else 20000000 end as deadline
            from ({_ASSIGN_SQL}) a join requests q using (request_id)) s
      left join (select event_id, provider, epoch_us(ts) + latency_ms * 3000 as us, ok from attempts union all select event_id, 'brave', epoch_us(ts) + latency_ms * 3000, true from attempts) r
        on r.event_id = s.query_id and r.provider = s.provider group by all)"""
QUERIES["deadline_fan_in"] = deadline_fan_in
ORACLE["deadline_fan_in"] = sql(_FAN_IN_SQL, "requests", "attempts")


def query_completion(spark, sf_dir):
    done = routing.query_completion(routing.deadline_fan_in(*fan_in_of(spark, sf_dir)))
    return done.select("query_id", F.unix_micros("completed_at").alias("completed_us"), "answered", "timeouts", "late")


QUERIES["query_completion"] = query_completion
ORACLE["query_completion"] = sql(
    f"""select query_id, max(settled_us) as completed_us, count(*) filter (where outcome = 'answered') as answered,
      count(*) filter (where outcome = 'timeout') as timeouts, count(*) filter (where late) as late from ({_FAN_IN_SQL}) group by query_id""",
    "requests", "attempts",
)


def _reuse_logs(spark, sf_dir):
    """Requests with their digest, and the useful ones as stored answers."""
    reqs = view(spark, sf_dir, "requests").withColumn("max_results_raw", F.lit(5))
    reqs = reqs.select("request_id", "ts", "useful", digest_of(reqs).alias("digest"))
    stored = reqs.filter("useful").select("digest", F.col("request_id").alias("answer_id"), F.expr("ts + interval 1 second").alias("stored_at"))
    return reqs, stored


def reuse_lookup(spark, sf_dir):
    return routing.reuse_lookup(*_reuse_logs(spark, sf_dir), REUSE_MS)


_REUSE_LOGS_SQL = f"""r as (select request_id, ts, useful, {DIGEST_SQL} as digest from (select * replace (5 as max_results_raw) from requests)),
    s as (select digest, request_id as answer_id, ts + interval 1 second as stored_at from r where useful),
    looked_up as (select r.request_id, r.digest, case when r.ts < s.stored_at + interval 2 hour then s.answer_id end as answer_id
      from r asof left join s on r.digest = s.digest and r.ts >= s.stored_at)"""
QUERIES["reuse_lookup"] = reuse_lookup
ORACLE["reuse_lookup"] = sql(f"with {_REUSE_LOGS_SQL} select * from looked_up", "requests")

_NOW_US = 1_706_000_000_000_000


def reuse_stats(spark, sf_dir):
    reqs, stored = _reuse_logs(spark, sf_dir)
    return routing.reuse_stats(routing.reuse_lookup(reqs, stored, REUSE_MS), stored, _NOW_US, REUSE_MS)


REUSE_STATS_SQL = f"""select (select count(distinct digest) from s where epoch_us(stored_at) <= {_NOW_US} and epoch_us(stored_at) > {_NOW_US} - {REUSE_MS}000) as entries,
    (select count(answer_id) from looked_up) as hits, (select count(*) - count(answer_id) from looked_up) as misses"""
QUERIES["reuse_stats"] = reuse_stats
ORACLE["reuse_stats"] = sql(f"with {_REUSE_LOGS_SQL} {REUSE_STATS_SQL}", "requests")
