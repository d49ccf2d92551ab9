"""Registered queries over provider payloads built from the lines of every order."""

from __future__ import annotations

from pyspark.sql import functions as F

from serploom.session import load
from serploom.sources.payloads import read_payloads, response_rows, result_rows

QUERIES = {}
ORACLE = {}


def order_items(spark, sf_dir):
    """One row per order with its lines as a sorted array (an order has a handful of lines)."""
    lines = load(spark, sf_dir, "lineitem").join(
        load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey")
    )
    line = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.col("p_name").alias("title"),
        F.concat(F.lit("https://"), F.lower("p_type"), F.lit(".example.com/p/"), F.col("l_partkey").cast("string")).alias("url"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("epoch"),
        F.col("l_quantity").alias("score"), (F.col("l_partkey") % 3).cast("int").alias("k"),
    )
    return lines.groupBy(F.col("l_orderkey").alias("query_id")).agg(F.array_sort(F.collect_list(line)).alias("lines"))


ITEMS_SQL = """(select l_orderkey as query_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int) as provider_rank,
    p_name as title, 'https://' || lower(p_type) || '.example.com/p/' || l_partkey as url, strftime(l_shipdate, '%Y-%m-%d') as day, l_quantity as score, l_partkey % 3 as k
    from lineitem join part on l_partkey = p_partkey)"""


def payloads(spark, sf_dir, provider, build, status="200"):
    orders = order_items(spark, sf_dir)
    return orders.select(
        "query_id", F.lit(provider).alias("provider"), F.expr(status).cast("int").alias("status_code"), build(orders).alias("body")
    )


def _json(**fields):
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _tavily(df):
    return _json(
        answer=F.when(F.col("query_id") % 2 == 0, F.lit("42")).otherwise(""),
        results=F.transform("lines", lambda x: F.struct(
            x["title"].alias("title"), x["url"].alias("url"), F.concat(x["title"], F.lit(" text")).alias("content"),
            x["score"].alias("score"), x["day"].alias("published_date"))),
    )


def _brave(df):
    return _json(
        query=F.struct(F.lit("a").alias("original"), F.when(F.col("query_id") % 2 == 0, F.lit("b")).alias("altered")),
        web=F.struct(F.transform("lines", lambda x: F.struct(
            x["title"].alias("title"), x["url"].alias("url"), F.when(x["k"] > 0, x["title"]).alias("description"), x["day"].alias("page_age"),
            F.array(F.lit(""), F.upper(x["title"]), F.lit("one"), F.lit("ONE"), F.lit("two"), F.lit("three")).alias("extra_snippets"))).alias("results")),
    )


def _mojeek(df):
    status = F.expr("case query_id % 5 when 0 then 'Invalid key' when 1 then 'Daily limit' when 2 then 'Broken' else 'OK' end")
    return _json(response=F.struct(
        status.alias("status"), F.struct((F.col("query_id") + 100).alias("results")).alias("head"),
        F.transform("lines", lambda x: F.struct(
            x["title"].alias("title"), x["url"].alias("url"), x["day"].alias("desc"), x["score"].alias("score"), x["epoch"].alias("timestamp"))).alias("results")))


def _exa(df):
    return F.when(F.col("query_id") % 4 == 0, F.lit('{"oops": 1}')).otherwise(_json(results=F.transform("lines", lambda x: F.struct(
        x["title"].alias("title"), x["url"].alias("url"), F.concat(x["day"], F.lit("T00:00:00.000Z")).alias("publishedDate"),
        F.array(F.lit(""), F.concat(F.lit("h "), x["title"])).alias("highlights")))))


def _engines(x):
    return F.when(x["k"] == 1, F.array(F.lit("google"), F.lit("brave"))).when(x["k"] == 2, F.array(F.lit("bing")))


def _searxng(df):
    body = _json(
        results=F.transform("lines", lambda x: F.struct(
            x["title"].alias("title"), x["url"].alias("url"), x["day"].alias("content"), x["day"].alias("publishedDate"),
            F.when(x["k"] == 1, F.lit("brave")).alias("engine"), _engines(x).alias("engines"), x["score"].alias("score"))),
        unresponsive_engines=F.array(F.array(F.lit("wiki"), F.lit("timeout")), F.array(F.lit("lone"))),
    )
    answers = F.expr("case query_id % 3 when 0 then ', \"answers\": [{\"answer\": \"obj\"}]}' when 1 then ', \"answers\": [\"\", {\"x\": 1}, \"txt\"]}' else '}' end")
    return F.concat(F.regexp_replace(body, r"\}$", ""), answers)


def _open_web_search(df):
    items = F.transform("lines", lambda x: F.struct(
        x["title"].alias("title"), F.when(x["k"] > 0, x["url"]).alias("url"), x["url"].alias("link"), F.when(x["k"] == 1, x["day"]).alias("snippet"),
        F.when(x["k"] == 2, x["title"]).alias("description"), F.lit("c").alias("content"), F.when(x["k"] == 2, F.lit(77)).alias("rank"),
        F.when(F.col("query_id") % 2 == 0, _engines(x)).alias("engines"), x["day"].alias("published")))
    return (
        F.when(F.col("query_id") % 4 == 0, F.to_json(items))
        .when(F.col("query_id") % 4 == 1, _json(data=items))
        .when(F.col("query_id") % 4 == 2, _json(items=items, success=F.lit(True)))
        .otherwise(F.lit('{"status": "failed"}'))
    )


def _parallel(df):
    items = F.transform("lines", lambda x: F.struct(
        x["title"].alias("title"), F.when(x["k"] > 0, x["url"]).alias("url"), F.when(x["k"] == 1, x["day"]).alias("snippet"),
        F.array(F.lit(""), x["title"], F.lit("tail")).alias("excerpts"), x["day"].alias("publish_date")))
    structured = _json(result=F.struct(F.struct(items.alias("results")).alias("structuredContent")))
    text = _json(result=F.struct(F.array(F.struct(F.lit("not json").alias("text")), F.struct(F.to_json(items).alias("text"))).alias("content")))
    return (
        F.when(F.col("query_id") % 3 == 0, structured)
        .when(F.col("query_id") % 3 == 1, F.concat(F.lit("event: message\ndata: {}\ndata: "), text, F.lit("\n\n")))
        .otherwise(F.lit("data: [DONE]"))
    )


_ROWS = ["query_id", "provider_rank", "title", "url", "snippet"]


def _rows(df, *extra):
    return result_rows(read_payloads(df)).select(
        *_ROWS, *[F.expr(x) for x in extra], F.date_format("published_at", "yyyy-MM-dd").alias("published")
    )


def _responses(df):
    return response_rows(read_payloads(df)).select(
        "query_id", "outcome", "answer", "total_estimated", F.array_join("upstream_engines", ",").alias("engines"), F.array_join("warnings", "|").alias("warnings")
    )


def _register(name, provider, build, rows_sql, responses_sql, extra=(), status="200"):
    QUERIES[f"read_{name}"] = lambda spark, sf_dir: _rows(payloads(spark, sf_dir, provider, build, status), *extra)
    QUERIES[f"responses_{name}"] = lambda spark, sf_dir: _responses(payloads(spark, sf_dir, provider, build, status))
    ORACLE[f"read_{name}"] = f"with i as {ITEMS_SQL} {rows_sql}"
    ORACLE[f"responses_{name}"] = f"with q as (select distinct l_orderkey as query_id from lineitem), i as {ITEMS_SQL} {responses_sql}"


_PLAIN = "cast(null as varchar) as answer, cast(null as bigint) as total_estimated, '' as engines, '' as warnings"
_register(
    "tavily", "tavily", _tavily,
    "select query_id, provider_rank, title, url, title || ' text' as snippet, score as provider_score, day as published from i where query_id % 7 <> 0",
    """select query_id, case when query_id % 7 = 0 then 'rate_limited' else 'ok' end as outcome, case when query_id % 2 = 0 and query_id % 7 <> 0 then '42' end as answer,
    cast(null as bigint) as total_estimated, case when query_id % 7 <> 0 then '' end as engines, case when query_id % 7 <> 0 then '' end as warnings from q""",
    ("provider_score",), "case when query_id % 7 = 0 then 429 else 200 end",
)
_register(
    "brave", "brave", _brave,
    """select query_id, provider_rank, title, url, case when k > 0 then title || ' one two' else upper(title) || ' one two' end as snippet, day as published from i""",
    """select query_id, 'ok' as outcome, cast(null as varchar) as answer, cast(null as bigint) as total_estimated, '' as engines,
    case when query_id % 2 = 0 then 'Brave interpreted the query as "b".' else '' end as warnings from q""",
)
_register(
    "mojeek", "mojeek", _mojeek,
    "select query_id, provider_rank, title, url, day as snippet, score as provider_score, day as published from i where query_id % 5 > 2",
    """select query_id, case query_id % 5 when 0 then 'authentication' when 1 then 'rate_limited' when 2 then 'server_error' else 'ok' end as outcome, cast(null as varchar) as answer,
    query_id + 100 as total_estimated, '' as engines, '' as warnings from q""",
    ("provider_score",),
)
_register(
    "exa", "exa", _exa,
    "select query_id, provider_rank, title, url, 'h ' || title as snippet, day as published from i where query_id % 4 <> 0",
    f"select query_id, case when query_id % 4 = 0 then 'malformed_response' else 'ok' end as outcome, {_PLAIN} from q",
)
_register(
    "searxng", "searxng", _searxng,
    """select query_id, provider_rank, title, url, day as snippet, score as provider_score, case k when 1 then 'brave,google' when 2 then 'bing' end as engines, day as published from i""",
    """select q.query_id, 'ok' as outcome, case q.query_id % 3 when 0 then 'obj' when 1 then 'txt' end as answer, cast(null as bigint) as total_estimated,
    concat_ws(',', case when bool_or(k = 2) then 'bing' end, case when bool_or(k = 1) then 'brave,google' end) as engines, 'SearXNG engine wiki was unresponsive: timeout.' as warnings
    from q join i using (query_id) group by q.query_id""",
    ("provider_score", "array_join(upstream_engines, ',') as engines"),
)
_register(
    "open_web_search", "open_web_search", _open_web_search,
    """select query_id, cast(case when k = 2 then 77 else provider_rank end as int) as provider_rank, title, url, case k when 1 then day when 2 then title else 'c' end as snippet,
    case when query_id % 2 = 0 then case k when 1 then 'brave,google' when 2 then 'bing' end end as engines, day as published from i where query_id % 4 <> 3""",
    """select query_id, case when query_id % 4 = 3 then 'malformed_response' else 'ok' end as outcome, cast(null as varchar) as answer, cast(null as bigint) as total_estimated, engines,
    case when engines = '' then 'Open Web Search did not report its upstream engines, so its results cannot be attributed to independent sources.' else '' end as warnings
    from (select query_id, case when query_id % 2 = 0 then concat_ws(',', case when bool_or(k = 2) then 'bing' end, case when bool_or(k = 1) then 'brave,google' end) else '' end as engines
          from i group by query_id)""",
    ("array_join(upstream_engines, ',') as engines",),
)
_register(
    "parallel", "parallel", _parallel,
    """select query_id, cast(row_number() over (partition by query_id order by provider_rank) as int) as provider_rank, title, url, case when k = 1 then day else title end as snippet,
    chr(10) || chr(10) || title || chr(10) || chr(10) || 'tail' as content, day as published from i where query_id % 3 <> 2 and k > 0""",
    f"select query_id, case when query_id % 3 = 2 then 'malformed_response' else 'ok' end as outcome, {_PLAIN.replace(chr(39) * 2 + ' as engines', chr(39) + 'parallel' + chr(39) + ' as engines')} from q",
    ("content",),
)
