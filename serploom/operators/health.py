"""Provider health, node health and fleet reports from attempt and probe logs.

All of these are plain aggregations with partial aggregation before the shuffle: a provider that owns
most of the log is reduced to one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serploom import dims
from serploom.functions.labels import provider_kind
from serploom.operators import folds
from serploom.operators.folds import Fold

# Numbers of skipped attempts and cancellations never reach the counters.
_UNCOUNTED = ("circuit_open", "cancelled")


def _listed(name: str) -> Column:
    """A set of a closed list of values, in order.

    With a set among them, Spark keeps all aggregates of a group as objects in memory; without one it
    would sort the whole log to take the newest row of a few groups. (A caller that drops this column loses
    that: the optimizer prunes the set.)
    """
    return F.array_join(F.sort_array(name), ",")


def counter_folds() -> list[Fold]:
    """States of ``provider_counters`` per provider."""
    at = F.struct("ts", "event_id")
    failed = ~F.col("ok") & F.col("reached_network") & ~F.coalesce(F.col("category").isin(*_UNCOUNTED), F.lit(False))
    return [
        folds.count("requests", F.col("reached_network")),
        folds.count("successes", F.col("ok")),
        folds.count("failures", failed),
        Fold("latency_total_ms", "sum", F.col("latency_ms").cast("bigint"), F.col("ok")),
        Fold("last_latency_ms", "newest", F.col("latency_ms"), F.col("ok"), at),
        Fold("last_result_count", "newest", F.col("result_count"), F.col("ok"), at),
        Fold("last_success_at", "max", F.col("ts"), F.col("ok")),
        Fold("last_failure_at", "max", F.col("ts"), failed),
        Fold("last_error", "newest", F.col("message"), failed, at),
        Fold("last_error_category", "newest", F.col("category"), failed, at),
        Fold("categories", "seen", F.col("category")),
    ]


def counters_of(states: DataFrame) -> DataFrame:
    """Provider counters from one state per provider."""
    total = F.coalesce("latency_total_ms", F.lit(0).cast("bigint"))
    return states.select(
        "provider", "requests", "successes", "failures", total.alias("latency_total_ms"),
        F.coalesce(F.call_function("try_divide", total, F.col("successes")), F.lit(0)).cast("bigint").alias("average_latency_ms"),
        *[F.col(c)["value"].alias(c) for c in ("last_latency_ms", "last_result_count")],
        "last_success_at", "last_failure_at",
        *[F.col(c)["value"].alias(c) for c in ("last_error", "last_error_category")],
        _listed("categories").alias("categories"),
    )


def provider_counters(attempts: DataFrame) -> DataFrame:
    """Requests, outcomes, latency and last-seen values per provider.

    ``attempts(provider, ts, event_id, ok, category, message, latency_ms, result_count,
    reached_network)``. The average is an integer division over successes.
    """
    return counters_of(folds.parts(attempts, ["provider"], counter_folds()))


def provider_status(counters: DataFrame, observed: DataFrame, settings: DataFrame) -> DataFrame:
    """One status per provider: not_configured, disabled, circuit_open, probing, rate_limited, ready.

    ``observed`` is what ``states.observed_states`` returns; ``settings(provider, configured, enabled)``
    lists every provider to report.
    """
    df = (
        settings.join(counters, "provider", "left")
        .join(observed, "provider", "left")
        .withColumn("circuit_state", F.coalesce("circuit_state", F.lit("closed")))
    )
    status = (
        F.when(~F.col("configured"), F.lit("not_configured"))
        .when(~F.col("enabled"), F.lit("disabled"))
        .when(F.col("circuit_state") == "open", F.lit("circuit_open"))
        .when(F.col("circuit_state") == "half_open", F.lit("probing"))
        .when(F.coalesce("rate_limited", F.lit(False)), F.lit("rate_limited"))
        .otherwise(F.lit("ready"))
    )
    return df.withColumn("status", status).drop("rate_limited")


def probe_folds() -> list[Fold]:
    """States of ``probe_status`` per provider."""
    at = F.struct("ts", "event_id")
    return [
        folds.count("probes"),
        folds.count("successes", F.col("ok")),
        folds.count("failures", ~F.col("ok")),
        Fold("latency_total_ms", "sum", F.col("latency_ms").cast("bigint"), F.col("ok")),
        Fold("newest", "newest", F.struct("ok", "result_count", "category"), None, at),
        Fold("last_success_at", "max", F.col("ts"), F.col("ok")),
        Fold("categories", "seen", F.col("category")),
    ]


def probe_status(probes: DataFrame, settings: DataFrame) -> DataFrame:
    """Probe counters per provider with state OK, FAIL, IDLE, NO KEY or OFF.

    ``probes(provider, ts, event_id, ok, latency_ms, result_count, category)``.
    """
    return probe_status_of(folds.parts(probes, ["provider"], probe_folds()), settings)


def probe_status_of(states: DataFrame, settings: DataFrame) -> DataFrame:
    """Probe status from one state per provider."""
    folded = states.select(
        "provider", "probes", "successes", "failures",
        F.call_function("try_divide", F.col("latency_total_ms"), F.col("successes")).cast("bigint").alias("average_latency_ms"),
        F.col("newest.value.ok").alias("_healthy"),
        F.col("newest.value.result_count").alias("last_result_count"),
        F.col("newest.value.category").alias("last_error_category"),
        "last_success_at", _listed("categories").alias("categories"),
    )
    facts = dims.providers(states.sparkSession).select(
        "provider",
        provider_kind(F.col("is_scraper"), F.col("is_aggregator"), F.col("is_independent")).alias("kind"),
    )
    df = settings.join(F.broadcast(facts), "provider").join(folded, "provider", "left")
    attempted = F.col("successes") + F.col("failures")
    return df.withColumns(
        {
            "state": F.when(F.col("_healthy"), F.lit("OK"))
            .when(~F.col("_healthy"), F.lit("FAIL"))
            .when(~F.col("enabled"), F.lit("OFF"))
            .when(F.col("configured"), F.lit("IDLE"))
            .otherwise(F.lit("NO KEY")),
            "success_rate": F.coalesce(F.round(F.col("successes") / attempted, 6), F.lit(0.0)),
        }
    ).drop("_healthy")


def node_folds() -> list[Fold]:
    """States of ``node_status`` per node."""
    at, up = F.struct("ts", "event_id"), F.col("state") == "up"
    newest = F.struct("state", "latency_ms", "result_count", "engines", "unavailable_engines", "error")
    return [
        Fold("is_local", "max", F.col("is_local")),
        folds.count("checks"),
        folds.count("failures", ~up),
        Fold("last_success_at", "max", F.col("ts"), up),
        Fold("newest", "newest", newest, None, at),
        Fold("states", "seen", F.col("state")),
    ]


def node_status(probes: DataFrame) -> DataFrame:
    """Check counters and the newest probe of every node.

    ``probes`` is what ``read_node_probes`` returns: node, ts, event_id, is_local, state, latency_ms,
    result_count, engines, unavailable_engines, error. Everything but "up" counts as a failure.
    """
    return node_status_of(folds.parts(probes, ["node"], node_folds()))


def node_status_of(states: DataFrame) -> DataFrame:
    """Node status from one state per node."""
    rate = F.round((F.col("checks") - F.col("failures")) / F.col("checks"), 6)
    return states.select(
        "node", "is_local", "checks", "failures", "last_success_at", _listed("states").alias("states"), "newest.value.*", rate.alias("success_rate")
    )


def fleet_warnings(nodes: DataFrame, providers: DataFrame) -> DataFrame:
    """What an operator should act on, most urgent first: position, warning.

    ``nodes`` from ``node_status``, ``providers`` from ``probe_status``: one row per node or provider.
    """
    down = F.col("state") == "down"
    local = nodes.filter(down & F.col("is_local")).agg(F.min("node").alias("node")).filter("node is not null").select(
        F.lit(1).alias("position"), F.lit(0).cast("bigint").alias("weight"),
        F.concat(
            F.lit("this machine's SearXNG ("), "node",
            F.lit(") is down — the local server has no local provider"),
        ).alias("warning"),
    )
    remote = nodes.filter(down & ~F.col("is_local")).agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list("node")).alias("names")
    ).filter("n > 0").select(
        F.lit(2).alias("position"), F.lit(0).cast("bigint").alias("weight"),
        F.concat(F.col("n").cast("string"), F.lit(" node(s) unreachable: "), F.array_join("names", ", ")).alias("warning"),
    )
    engines = nodes.select(F.explode("unavailable_engines").alias("entry")).select(
        F.trim(F.substring_index("entry", ":", 1)).alias("engine")
    )
    total = nodes.agg(F.count("*").alias("nodes"))
    failing = (
        engines.groupBy("engine").agg(F.count("*").alias("weight"))
        .join(F.broadcast(total), F.col("weight") >= F.greatest(F.lit(2), F.floor(F.col("nodes") / 2)))
        .select(
            F.lit(3).alias("position"), "weight",
            F.concat(
                F.lit("engine '"), "engine", F.lit("' unavailable on "),
                F.col("weight").cast("string"), F.lit(" node(s)"),
            ).alias("warning"),
        )
    )
    keyless = providers.filter("state = 'NO KEY'").agg(F.count("*").alias("n")).filter("n > 0").select(
        F.lit(4).alias("position"), F.lit(0).cast("bigint").alias("weight"),
        F.concat(
            F.col("n").cast("string"),
            F.lit(" provider(s) have no credentials; press p to probe the rest"),
        ).alias("warning"),
    )
    return local.unionByName(remote).unionByName(failing).unionByName(keyless)


def fleet_verdict(nodes: DataFrame, providers: DataFrame) -> DataFrame:
    """One row: unhealthy when nodes exist and none is up, or providers are in service and none is OK."""
    n = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("state") == "up").alias("nodes_up"))
    in_service = ~F.col("state").isin("NO KEY", "OFF")
    p = providers.agg(
        F.count_if(in_service).alias("in_service"),
        F.count_if(F.col("state") == "OK").alias("providers_ok"),
    )
    # both sides are single-row aggregates
    both = n.join(F.broadcast(p), F.lit(True))
    return both.withColumn(
        "unhealthy",
        ((F.col("nodes") > 0) & (F.col("nodes_up") == 0))
        | ((F.col("in_service") > 0) & (F.col("providers_ok") == 0)),
    )


def fleet_header(nodes: DataFrame, providers: DataFrame) -> DataFrame:
    """Counts per state of nodes and providers."""
    return (
        nodes.select(F.lit("node").alias("kind"), "state")
        .unionByName(providers.select(F.lit("provider").alias("kind"), "state"))
        .groupBy("kind", "state")
        .agg(F.count("*").alias("n"))
    )


def engine_contribution(results: DataFrame) -> DataFrame:
    """Rows each upstream engine contributed to; a row without a list counts for its one engine."""
    single = F.when(F.col("engine").isNotNull(), F.array("engine")).otherwise(F.array().cast("array<string>"))
    listed = F.when(F.size(F.coalesce("engines", F.array().cast("array<string>"))) > 0, F.col("engines"))
    named = results.select(F.explode(F.coalesce(listed, single)).alias("engine"))
    return named.filter(F.coalesce(F.col("engine"), F.lit("")) != "").groupBy("engine").agg(F.count("*").alias("rows"))


def rotate_queries(probes: DataFrame, number: str = "probe_no") -> DataFrame:
    """The probe query each numbered probe sends."""
    queries = F.array(*[F.lit(q) for q in dims.PROBE_QUERIES])
    return probes.withColumn(
        "probe_query", F.element_at(queries, (F.col(number) % len(dims.PROBE_QUERIES) + 1).cast("int"))
    )
