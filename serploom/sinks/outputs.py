"""Output tables: one closed JSON document or one text card per query, page or status report.

A query has at most twenty results, so the lists gathered here are small. Documents always spell out
nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serploom.functions.labels import iso_utc
from serploom.functions.text import opens_with_title
from serploom.functions.urls import trim_ws

_KEEP_NULLS = {"ignoreNullFields": "false"}
FAILURE = "array<struct<provider:string,category:string,message:string>>"


def _document(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), _KEEP_NULLS)


def _results_by_query(fused: DataFrame) -> DataFrame:
    entry = F.struct(
        "rank", "title", "url", "sources", "snippet", iso_utc(F.col("published_at")).alias("published_at")
    )
    return fused.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("results"))


def _with_results(searches: DataFrame, fused: DataFrame) -> DataFrame:
    joined = searches.join(_results_by_query(fused), "query_id", "left")
    empty = F.array().cast(joined.schema["results"].dataType)
    return joined.withColumn("results", F.coalesce("results", empty))


def search_documents(searches: DataFrame, fused: DataFrame) -> DataFrame:
    """``searches(query_id, query, providers_used, providers_failed, warnings, retrieved_at, elapsed_ms,
    served_from_cache)`` and the fused results of each."""
    df = _with_results(searches, fused)
    return df.select(
        "query_id",
        _document(
            F.col("query"), F.col("results"), F.col("providers_used"), F.col("providers_failed"),
            F.col("warnings"), iso_utc(F.col("retrieved_at")).alias("retrieved_at"),
            F.col("elapsed_ms"), F.col("served_from_cache"),
        ).alias("document"),
    )


def _lines(*parts: Column) -> Column:
    """Non-null parts, one per line."""
    return F.array_join(F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])), "\n")


def _line(text: Column) -> Column:
    return F.when(text.isNotNull(), F.array(text))


def _failed_line(failures: Column) -> Column:
    names = F.transform(failures, lambda f: F.concat(f["provider"], F.lit(" ("), f["category"], F.lit(")")))
    return F.when(
        F.size(failures) > 0,
        F.array(F.concat(F.lit("Unavailable providers: "), F.array_join(names, ", "))),
    )


def _notes(warnings: Column) -> Column:
    return F.transform(F.filter(warnings, lambda w: w != ""), lambda w: F.concat(F.lit("Note: "), w))


def _cards(results: Column, max_snippet: int) -> Column:
    def card(r: Column) -> Column:
        snippet = F.when(
            F.length(r["snippet"]) > max_snippet,
            F.concat(F.substring(r["snippet"], 1, max_snippet), F.lit("…")),
        ).otherwise(F.when(r["snippet"] != "", r["snippet"]))
        return F.concat_ws(
            "\n",
            F.concat(F.lit("["), r["rank"].cast("string"), F.lit("] "), r["title"]),
            F.concat(F.lit("URL: "), r["url"]),
            F.concat(F.lit("Snippet: "), snippet),
            F.concat(F.lit("Published: "), r["published_at"]),
            F.concat(F.lit("Sources: "), F.array_join(r["sources"], ", ")),
            F.lit(""),
        )

    return F.when(F.size(results) == 0, F.array(F.lit("No results."))).otherwise(F.transform(results, card))


def search_cards(searches: DataFrame, fused: DataFrame, max_snippet: int = 400) -> DataFrame:
    df = _with_results(searches, fused)
    card = _lines(
        _cards(F.col("results"), max_snippet),
        _failed_line(F.col("providers_failed")),
        _notes(F.col("warnings")),
        F.when(F.col("served_from_cache"), F.array(F.lit("Note: served from local cache."))),
    )
    return df.select("query_id", trim_ws(card).alias("card"))


def answer_documents(checked: DataFrame, searches: DataFrame, keys: list[str]) -> DataFrame:
    """``checked`` from ``check_answers`` plus ``model``; ``searches`` as above plus results_considered.

    A search without an answer is reported as results_only.
    """
    answered = checked.select(*keys, "model", "status", "answer", "citations")
    df = searches.join(answered, "query_id", "left")
    cited = F.transform(
        "citations",
        lambda c: F.struct(c["index"].alias("index"), c["source"]["title"].alias("title"), c["source"]["url"].alias("url")),
    )
    none = F.array().cast("array<struct<index:int,title:string,url:string>>")
    return df.select(
        *keys,
        _document(
            F.col("query"), F.coalesce("status", F.lit("results_only")).alias("status"), F.col("model"),
            F.coalesce(cited, none).alias("citations"),
            F.coalesce(F.length("answer"), F.lit(0)).alias("answer_characters"),
            F.col("results_considered"), F.col("providers_used"), F.col("providers_failed"), F.col("warnings"),
            iso_utc(F.col("retrieved_at")).alias("retrieved_at"), F.col("elapsed_ms"), F.col("served_from_cache"),
        ).alias("document"),
    )


def answer_cards(checked: DataFrame, searches: DataFrame, keys: list[str]) -> DataFrame:
    df = checked.join(searches, "query_id")
    sources = F.when(F.size("citations") == 0, F.array(F.lit("Sources: none cited."))).otherwise(
        F.concat(
            F.array(F.lit("Sources:")),
            F.transform(
                "citations",
                lambda c: F.concat(
                    F.lit("["), c["index"].cast("string"), F.lit("] "), c["source"]["title"],
                    F.lit("\n    "), c["source"]["url"],
                ),
            ),
        )
    )
    card = _lines(
        F.when(
            F.col("status") == "insufficient",
            F.array(F.lit("INSUFFICIENT — the search results do not answer this question."), F.lit("")),
        ),
        F.array(F.col("answer"), F.lit("")),
        sources,
        F.array(
            F.lit(""),
            F.format_string(
                "Answered by %s from %d search result(s); the model has no web access and saw only these.",
                "model", "results_considered",
            ),
        ),
        _failed_line(F.col("providers_failed")),
        _notes(F.col("warnings")),
        F.when(F.col("served_from_cache"), F.array(F.lit("Note: search results served from local cache."))),
    )
    return df.select(*keys, trim_ws(card).alias("card"))


def page_documents(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, final_url, status, title, content_type, method, truncated, text, warnings)``."""
    return pages.select(
        "page_id",
        _document(
            F.col("url"), F.col("final_url"), F.col("status"), F.col("title"), F.col("content_type"),
            F.col("method").alias("extraction_method"), F.col("truncated"),
            F.length("text").alias("text_characters"), F.col("warnings"),
        ).alias("document"),
    )


def page_cards(pages: DataFrame) -> DataFrame:
    heading = F.when(
        (F.coalesce("title", F.lit("")) != "") & ~opens_with_title(F.col("title"), F.col("text")),
        F.array(F.concat(F.lit("# "), "title")),
    )
    card = _lines(
        heading,
        F.array(
            F.concat(F.lit("URL: "), "final_url"),
            F.concat(F.lit("Status: "), F.col("status").cast("string"), F.lit(" ("), "method", F.lit(")")),
        ),
        F.when(F.col("truncated"), F.array(F.lit("Note: content was truncated."))),
        _notes(F.col("warnings")),
    )
    return pages.select("page_id", F.concat(card, F.lit("\n\n"), "text").alias("card"))


def status_documents(status: DataFrame, reuse: DataFrame, ttl_seconds: int) -> DataFrame:
    """One document for the whole report: nine providers and the reuse totals."""
    entry = F.struct(
        "provider_order", "provider", "status", "configured", "is_aggregator", "is_scraper", "family",
        "circuit_state", "requests", "successes", "failures", "last_result_count", "average_latency_ms",
        "last_error", "last_error_category", iso_utc(F.col("last_success_at")).alias("last_success_at"),
    )
    rows = status.agg(F.array_sort(F.collect_list(entry)).alias("providers"))
    totals = reuse.select(
        F.struct("entries", "hits", "misses", F.lit(ttl_seconds).alias("ttl_seconds")).alias("cache")
    )
    # two single-row tables
    return rows.join(F.broadcast(totals), F.lit(True)).select(
        _document(F.col("providers"), F.col("cache")).alias("document")
    )


def status_cards(status: DataFrame) -> DataFrame:
    """One line group per provider."""
    counters = F.when(
        F.col("requests") > 0,
        F.format_string(" requests=%d ok=%d failed=%d", "requests", "successes", "failures"),
    ).otherwise("")
    circuit = F.when(
        F.col("circuit_state") != "closed", F.concat(F.lit(" circuit="), "circuit_state")
    ).otherwise("")
    head = F.concat(
        F.lit("- "), "provider", F.lit(": "), "status", F.lit(" ["), "family", F.lit("]"), counters, circuit
    )
    card = _lines(F.array(head), _line(F.concat(F.lit("    last error: "), "last_error")))
    return status.select("provider", card.alias("card"))


def write_documents(documents: DataFrame, path: str, files: int | None = None) -> None:
    """Writes documents or cards as parquet, replacing what was there; ``files`` sets how many files there are.

    The documents are dealt out anew for that, so that building them keeps its parallelism.
    """
    if files:
        documents = documents.repartition(files)
    documents.write.mode("overwrite").parquet(path)
