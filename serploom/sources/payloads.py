"""Landed provider payloads as result rows and response rows.

Every provider has one reader: a column expression that turns a JSON body into the common response
struct below. ``read_payloads`` picks the reader by provider inside one projection, so a table that
mixes providers is scanned and parsed once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serploom.functions.labels import parse_date, with_status_category
from serploom.functions.text import sse_last_json
from serploom.functions.urls import bind

ITEM = (
    "struct<rank:int,title:string,url:string,snippet:string,content:string,published:string,"
    "score:double,engines:array<string>>"
)
RESPONSE = (
    f"struct<outcome:string,answer:string,total_estimated:bigint,engines:array<string>,"
    f"warnings:array<string>,items:array<{ITEM}>>"
)


def _strings(*values: Column) -> Column:
    return F.array(*values).cast("array<string>")


def _item(i: Column, title, url, snippet, content=None, published=None, score=None, engines=None) -> Column:
    null = F.lit(None)
    return F.struct(
        (i + 1).cast("int").alias("rank"),
        title.alias("title"),
        url.alias("url"),
        snippet.alias("snippet"),
        (null.cast("string") if content is None else content).alias("content"),
        (null.cast("string") if published is None else published).alias("published"),
        (null.cast("double") if score is None else score.cast("double")).alias("score"),
        (null.cast("array<string>") if engines is None else engines).alias("engines"),
    )


def _response(ok: Column, items: Column, answer=None, total=None, engines=None, warnings=None, outcome=None) -> Column:
    verdict = F.when(ok, F.lit("ok")).otherwise("malformed_response") if outcome is None else outcome
    # a verdict may look at the whole body, so it is reached once
    return bind(verdict, lambda said: F.struct(
        said.alias("outcome"),
        (F.lit(None).cast("string") if answer is None else answer).alias("answer"),
        (F.lit(None).cast("bigint") if total is None else total.cast("bigint")).alias("total_estimated"),
        (_strings() if engines is None else engines).alias("engines"),
        (_strings() if warnings is None else F.coalesce(warnings, _strings())).alias("warnings"),
        F.when(said == "ok", F.coalesce(items, F.array().cast(f"array<{ITEM}>"))).alias("items"),
    ))


def _non_empty(text: Column) -> Column:
    return F.when(text != "", text)


def read_tavily(body: Column) -> Column:
    return bind(
        F.from_json(
            body,
            "answer string, results array<struct<title:string,url:string,content:string,score:double,"
            "published_date:string>>",
        ),
        lambda p: _tavily_response(p),
    )


def _tavily_response(p: Column) -> Column:
    items = F.transform(
        p["results"],
        lambda r, i: _item(i, r["title"], r["url"], r["content"], None, r["published_date"], r["score"]),
    )
    return _response(p["results"].isNotNull(), items, answer=_non_empty(p["answer"]))


def _brave_snippet(r: Column) -> Column:
    first = F.when(F.coalesce(r["description"], F.lit("")) != "", _strings(r["description"])).otherwise(_strings())
    extras = F.filter(F.coalesce(r["extra_snippets"], _strings()), lambda e: e != "")

    def add(parts: Column, extra: Column) -> Column:
        said = F.exists(parts, lambda p: F.lower(p).contains(F.lower(extra)))
        return F.when((F.size(parts) >= 3) | said, parts).otherwise(F.concat(parts, F.array(extra)))

    return _non_empty(F.array_join(F.aggregate(extras, first, add), " "))


def read_brave(body: Column) -> Column:
    return bind(
        F.from_json(
            body,
            "query struct<original:string,altered:string>, web struct<results:array<struct<title:string,"
            "url:string,description:string,page_age:string,extra_snippets:array<string>>>>",
        ),
        lambda p: _brave_response(body, p),
    )


def _object_with(body: Column, field: str, read: Column) -> Column:
    """The body is a JSON object whose field, if present, is an object too."""
    valid = body.rlike(r"^\s*\{") & F.try_parse_json(body).isNotNull()
    # a valid body has each name once, so a field that was read as an object is one
    held = read.isNotNull() | bind(F.get_json_object(body, f"$.{field}"), lambda h: h.isNull() | h.startswith("{"))
    return F.coalesce(valid, F.lit(False)) & held


def _brave_response(body: Column, p: Column) -> Column:
    items = F.transform(
        p["web"]["results"],
        lambda r, i: _item(i, r["title"], r["url"], _brave_snippet(r), None, r["page_age"]),
    )
    altered = p["query"]["altered"]
    warning = F.when(
        altered.isNotNull() & ~altered.eqNullSafe(p["query"]["original"]),
        _strings(F.concat(F.lit('Brave interpreted the query as "'), altered, F.lit('".'))),
    )
    return _response(_object_with(body, "web", p["web"]) & p.isNotNull(), items, warnings=warning)


def read_mojeek(body: Column) -> Column:
    """A success status may still carry an error in the body."""
    return bind(
        F.from_json(
            body,
            "response struct<status:string,head:struct<results:bigint>,results:array<struct<title:string,"
            "url:string,desc:string,score:double,timestamp:bigint>>>",
        )["response"],
        lambda p: _mojeek_response(body, p),
    )


def _mojeek_response(body: Column, p: Column) -> Column:
    status = F.lower(F.coalesce(p["status"], F.lit("")))
    outcome = (
        F.when(~_object_with(body, "response", p), F.lit("malformed_response"))
        .when(status.rlike("access denied|invalid key|password|permission"), F.lit("authentication"))
        .when(status.rlike("limit|quota|exceed"), F.lit("rate_limited"))
        .when(~status.startswith("ok"), F.lit("server_error"))
        .otherwise("ok")
    )
    items = F.transform(
        p["results"],
        lambda r, i: _item(
            i, r["title"], r["url"], r["desc"], None, r["timestamp"].cast("string"), r["score"]
        ),
    )
    return _response(F.lit(True), items, total=p["head"]["results"], outcome=outcome)


def read_exa(body: Column) -> Column:
    return bind(
        F.from_json(
            body,
            "results array<struct<title:string,url:string,publishedDate:string,highlights:array<string>>>",
        ),
        lambda p: _exa_response(p),
    )


def _exa_response(p: Column) -> Column:
    items = F.transform(
        p["results"],
        lambda r, i: _item(
            i, r["title"], r["url"],
            F.try_element_at(F.filter(r["highlights"], lambda h: h != ""), F.lit(1)),
            None, r["publishedDate"],
        ),
    )
    return _response(p["results"].isNotNull(), items)


def _named_engines(r: Column) -> Column:
    names = F.array_compact(F.concat(F.array(r["engine"]), F.coalesce(r["engines"], _strings())))
    return F.array_sort(F.array_distinct(names))


def _engines_or_null(r: Column) -> Column:
    return bind(_named_engines(r), lambda names: F.when(F.size(names) > 0, names))


def _all_engines(items: Column) -> Column:
    """Engines of all finished items, those of items that are dropped later too."""
    named = F.flatten(F.transform(items, lambda i: F.coalesce(i["engines"], _strings())))
    return F.coalesce(F.array_sort(F.array_distinct(named)), _strings())


def read_searxng(body: Column) -> Column:
    return bind(
        F.from_json(
            body,
            "results array<struct<url:string,title:string,content:string,publishedDate:string,engine:string,"
            "engines:array<string>,score:double>>, answers array<string>, "
            "unresponsive_engines array<array<string>>",
        ),
        lambda p: _searxng_response(p),
    )


def _searxng_response(p: Column) -> Column:
    items = F.transform(
        p["results"],
        lambda r, i: _item(
            i, r["title"], r["url"], r["content"], None, r["publishedDate"], r["score"], _engines_or_null(r)
        ),
    )
    texts = F.transform(
        p["answers"],
        lambda a: F.when(a.startswith("{"), F.get_json_object(a, "$.answer")).otherwise(a),
    )
    warnings = F.transform(
        F.filter(p["unresponsive_engines"], lambda e: F.size(e) >= 2),
        lambda e: F.concat(
            F.lit("SearXNG engine "), e[0], F.lit(" was unresponsive: "), e[1], F.lit(".")
        ),
    )
    answer = F.try_element_at(F.filter(texts, lambda t: F.coalesce(t, F.lit("")) != ""), F.lit(1))
    # the items are built once, and the response's engines come from them
    return bind(items, lambda done: _response(p["results"].isNotNull(), done, answer=answer, engines=_all_engines(done), warnings=warnings))


def read_open_web_search(body: Column) -> Column:
    row = (
        "array<struct<title:string,url:string,link:string,snippet:string,description:string,"
        "content:string,score:double,rank:int,engine:string,engines:array<string>,publishedAt:string,"
        "published:string>>"
    )
    wrapped = F.when(
        F.ltrim(body).startswith("["), F.concat(F.lit('{"bare":'), body, F.lit("}"))
    ).otherwise(body)
    return bind(
        F.from_json(
            wrapped,
            f"results {row}, data {row}, items {row}, bare {row}, success boolean, status string",
        ),
        lambda p: _open_web_search_response(p),
    )


def _open_web_search_response(p: Column) -> Column:
    found = F.coalesce(p["results"], p["data"], p["items"], p["bare"])
    items = F.transform(
        found,
        lambda r, i: _item(
            F.coalesce(r["rank"] - 1, i), r["title"], F.coalesce(r["url"], r["link"]),
            F.coalesce(r["snippet"], r["description"], r["content"]), None,
            F.coalesce(r["publishedAt"], r["published"]), r["score"], _engines_or_null(r),
        ),
    )
    ok = (
        found.isNotNull()
        | F.coalesce(p["success"], F.lit(False))
        | F.coalesce(F.lower(p["status"]) == "ok", F.lit(False))
    )
    unattributed = _strings(
        F.lit(
            "Open Web Search did not report its upstream engines, so its results cannot be "
            "attributed to independent sources."
        )
    )

    def response(done: Column, engines: Column) -> Column:
        return _response(ok, done, engines=engines, warnings=F.when(F.size(engines) == 0, unattributed))

    return bind(items, lambda done: bind(_all_engines(done), lambda engines: response(done, engines)))


def read_parallel(body: Column) -> Column:
    """Result list inside a tool answer: structured content first, else a text block that parses."""
    row = (
        "array<struct<title:string,url:string,link:string,snippet:string,description:string,"
        "excerpts:array<string>,excerpt:string,content:string,text:string,publish_date:string,"
        "published_at:string,publishedDate:string>>"
    )
    lists = f"results {row}, data {row}, items {row}, searchResults {row}"
    compact = lists.replace(" array<", ":array<").replace(", ", ",")
    return bind(
        F.from_json(
            sse_last_json(body),
            f"result struct<structuredContent:struct<{compact}>,content:array<struct<text:string>>>",
        )["result"],
        lambda p: _parallel_response(p, lists),
    )


def _parallel_response(p: Column, lists: str) -> Column:

    def listed(o: Column) -> Column:
        return F.coalesce(o["results"], o["data"], o["items"], o["searchResults"])

    def from_text(text: Column) -> Column:
        wrapped = F.when(
            F.ltrim(text).startswith("["), F.concat(F.lit('{"results":'), text, F.lit("}"))
        ).otherwise(text)
        return bind(F.from_json(wrapped, lists), listed)

    texts = F.filter(F.transform(p["content"], lambda c: from_text(c["text"])), lambda x: x.isNotNull())
    return bind(F.coalesce(listed(p["structuredContent"]), F.try_element_at(texts, F.lit(1))), _parallel_found)


def _parallel_found(found: Column) -> Column:
    usable = F.filter(found, lambda r: F.coalesce(r["url"], r["link"], F.lit("")) != "")
    items = F.transform(
        usable,
        lambda r, i: _item(
            i, r["title"], F.coalesce(r["url"], r["link"]),
            F.coalesce(
                r["snippet"], r["description"],
                F.try_element_at(F.filter(r["excerpts"], lambda e: e != ""), F.lit(1)), r["excerpt"],
            ),
            F.coalesce(
                r["content"], r["text"],
                F.when(F.size(r["excerpts"]) > 0, F.array_join(r["excerpts"], "\n\n")),
            ),
            F.coalesce(r["publish_date"], r["published_at"], r["publishedDate"]),
        ),
    )
    return _response(found.isNotNull(), items, engines=_strings(F.lit("parallel")))


READERS: dict[str, Callable[[Column], Column]] = {
    "tavily": read_tavily,
    "brave": read_brave,
    "mojeek": read_mojeek,
    "exa": read_exa,
    "searxng": read_searxng,
    "open_web_search": read_open_web_search,
    "parallel": read_parallel,
}


def register_reader(provider: str, reader: Callable[[Column], Column]) -> None:
    """Adds a source: ``reader`` maps a body column to a struct of type ``RESPONSE``."""
    READERS[provider] = reader


def read_payloads(payloads: DataFrame) -> DataFrame:
    """``payloads(query_id, provider, status_code, body)`` with the parsed ``response`` struct.

    A status outside 2xx decides the outcome before the body does.
    """
    df = with_status_category(payloads, body="body")
    parsed = F.lit(None).cast(RESPONSE)
    for provider, reader in READERS.items():
        response = reader(F.col("body")).cast(RESPONSE)
        parsed = F.when(F.col("provider") == provider, response).otherwise(parsed)
    return df.withColumn("response", F.when(F.col("status_category") == "ok", parsed))


def response_rows(parsed: DataFrame) -> DataFrame:
    """One row per payload: outcome, answer, engines and warnings."""
    # behind a generator the optimizer copies no parse into a filter on the outcome
    parsed = parsed.select("query_id", "provider", "status_category", F.explode(F.array("response")).alias("response"))
    outcome = F.coalesce(
        F.when(F.col("status_category") != "ok", F.col("status_category")), F.col("response.outcome")
    )
    return parsed.select(
        "query_id", "provider", outcome.alias("outcome"), F.col("response.answer").alias("answer"),
        F.col("response.total_estimated").alias("total_estimated"),
        F.col("response.engines").alias("upstream_engines"),
        F.col("response.warnings").alias("warnings"),
    )


def result_rows(parsed: DataFrame) -> DataFrame:
    """One row per result, ranked by its position in the payload, before anything is dropped."""
    # on a bare column the optimizer infers a filter by its size, which would parse every body again
    items = F.coalesce("response.items", F.array().cast(f"array<{ITEM}>"))
    rows = parsed.select("query_id", "provider", F.explode(items).alias("r"))
    return rows.select(
        "query_id", "provider", F.col("r.rank").alias("provider_rank"), "r.title", "r.url", "r.snippet",
        "r.content", parse_date(F.col("r.published")).alias("published_at"),
        F.col("r.score").alias("provider_score"), F.col("r.engines").alias("upstream_engines"),
    )
