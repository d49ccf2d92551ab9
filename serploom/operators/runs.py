"""Per-query summaries and reports over whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serploom import dims


def search_summary(attempts: DataFrame, fused_counts: DataFrame | None = None) -> DataFrame:
    """One row per query: providers used in first-use order, failures, warning text and outcome.

    ``attempts(query_id, ts, event_id, provider, ok, category, reached_network)``. A query's attempts
    are first reduced to one entry per (provider, outcome), at most a few dozen, so the ordered lists
    stay small however often a query was retried.
    """
    at = F.struct("ts", "event_id")
    entries = attempts.groupBy("query_id", "provider", "ok", "category").agg(
        F.min(at).alias("at"),
        F.count("*").alias("n"),
        F.count_if("reached_network").alias("reached"),
        F.sum("result_count").alias("results"),
    )
    used = F.when(F.col("ok"), F.struct("at", "provider"))
    failed = F.when(
        ~F.col("ok"),
        F.struct("at", F.format_string("%s (%s)", "provider", "category").alias("text")),
    )
    summary = entries.groupBy("query_id").agg(
        F.array_distinct(
            F.transform(F.array_sort(F.collect_list(used)), lambda x: x["provider"])
        ).alias("providers_used"),
        F.transform(F.array_sort(F.collect_list(failed)), lambda x: x["text"]).alias("failures"),
        F.sum("reached").alias("attempted"),
        F.sum(F.when(~F.col("ok"), F.col("n")).otherwise(0)).alias("failed"),
        F.sum("results").cast("bigint").alias("results"),
    )
    if fused_counts is not None:
        summary = summary.drop("results").join(fused_counts, "query_id", "left")
    results = F.coalesce("results", F.lit(0))
    outcome = (
        F.when(results > 0, F.lit("ok"))
        .when((F.col("attempted") == 0) & (F.col("failed") > 0), F.lit("temporarily_unavailable"))
        .otherwise(F.lit("providers_failed"))
    )
    warning = F.when(
        F.size("failures") > 0,
        F.concat(
            F.size("failures").cast("string"), F.lit(" provider(s) failed: "),
            F.array_join("failures", ", "), F.lit("."),
        ),
    )
    return summary.withColumns({"results": results, "outcome": outcome, "warning": warning})


def answer_warnings(responses: DataFrame) -> DataFrame:
    """Warnings of a response: a supplied answer (300 characters at most), then its own."""
    names = dims.providers(responses.sparkSession).select("provider", "display_name")
    clipped = F.when(
        F.length("answer") > 300, F.concat(F.substring("answer", 1, 300), F.lit("…"))
    ).otherwise(F.col("answer"))
    supplied = F.when(
        F.coalesce("answer", F.lit("")) != "",
        F.array(
            F.concat("display_name", F.lit(" supplied answer (untrusted, not fetched): "), clipped)
        ),
    ).otherwise(F.array().cast("array<string>"))
    own = F.coalesce("warnings", F.array().cast("array<string>"))
    return responses.join(F.broadcast(names), "provider").withColumn(
        "all_warnings", F.concat(supplied, own)
    ).drop("display_name")


def run_latency(latencies: DataFrame) -> DataFrame:
    """Minimum, upper median, maximum and mean of ``latency_ms`` over a run.

    The upper median is the value at position n // 2 of the sorted list, which is the lower one from the
    other end. Map tasks count equal values, so what travels and what is held grows with the distinct
    milliseconds, not with the run.
    """
    median = F.expr("percentile_disc(0.5) within group (order by latency_ms desc)")
    return latencies.agg(
        F.count("*").alias("queries"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"),
        F.round(F.avg("latency_ms"), 3).alias("wall_per_query_ms"),
        median.cast(latencies.schema["latency_ms"].dataType).alias("median_ms"),
    )


def run_participation(attempts: DataFrame) -> DataFrame:
    """Queries each provider contributed to, providers with none included."""
    used = attempts.filter("ok").select("query_id", "provider").distinct()
    counts = used.groupBy("provider").agg(F.count("*").alias("queries"))
    return (
        dims.providers(attempts.sparkSession)
        .select("provider")
        .join(counts, "provider", "left")
        .fillna(0, ["queries"])
    )


def run_failures(attempts: DataFrame) -> DataFrame:
    """Failures per provider, per category and per pair, in one pass."""
    return (
        attempts.filter(~F.col("ok"))
        .groupingSets([["provider"], ["category"], ["provider", "category"]], "provider", "category")
        .agg(F.count("*").alias("failures"))
    )


def silent_providers(attempts: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested providers that contributed to no query."""
    return requested.select("provider").distinct().join(
        attempts.filter("ok").select("provider").distinct(), "provider", "left_anti"
    )


def run_verdict(attempts: DataFrame, requested: DataFrame) -> DataFrame:
    """One row with the reason a run has to be reported as failed, or NULL."""
    per_query = attempts.groupBy("query_id").agg(F.max("ok").alias("any_ok"))
    totals = per_query.agg(F.count("*").alias("queries"), F.count_if(~F.col("any_ok")).alias("errors"))
    silent = silent_providers(attempts, requested).agg(
        F.sort_array(F.collect_list("provider")).alias("silent")
    )
    reason = F.when(
        (F.col("queries") > 0) & (F.col("errors") == F.col("queries")), F.lit("every query errored")
    ).when(
        F.size("silent") > 0,
        F.concat(
            F.lit("requested provider(s) contributed to no query: "), F.array_join("silent", ", ")
        ),
    )
    return totals.join(F.broadcast(silent), F.lit(True)).select("queries", "errors", reason.alias("failure"))


def thin_queries(requests: DataFrame, fused: DataFrame) -> DataFrame:
    """Thorough requests left with fewer than min(limit, 3) fused rows."""
    counts = fused.groupBy("query_id").agg(F.count("*").alias("fused_rows"))
    thorough = requests.filter("mode = 'thorough'")
    if "requested_provider" in requests.columns:  # one provider was asked for, so few rows are no lack
        thorough = thorough.filter("requested_provider is null")
    return (
        thorough.join(counts, "query_id", "left")
        .fillna(0, ["fused_rows"])
        .filter(F.col("fused_rows") < F.least("result_limit", F.lit(3)))
    )


def union_responses(*passes: DataFrame) -> DataFrame:
    """Primary, refill, coverage and retry passes as one table."""
    result = passes[0]
    for other in passes[1:]:
        result = result.unionByName(other, allowMissingColumns=True)
    return result


def replace_failures(first: DataFrame, retried: DataFrame) -> DataFrame:
    """Retried outcomes replace the earlier failures of the same (query, provider)."""
    keys = ["query_id", "provider"]
    retried_keys = retried.select(*keys).distinct()
    replaced = first.filter(~F.col("ok")).join(retried_keys, keys, "left_anti")
    return union_responses(first.filter("ok"), replaced, retried)
