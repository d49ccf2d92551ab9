"""Which providers serve a request, which are left, and who missed the deadline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from serploom import dims


def preference(settings: DataFrame) -> DataFrame:
    """Eligible providers with their place in the preference order (a nine-row table).

    ``settings(provider, configured, enabled)``. Independent indexes first, then other direct ones,
    aggregators, scrapers; the configured order holds inside each tier.
    """
    facts = dims.providers(settings.sparkSession)
    tier = (
        F.when(F.col("is_scraper"), 3)
        .when(F.col("is_aggregator"), 2)
        .when(F.col("is_independent"), 0)
        .otherwise(1)
    )
    eligible = F.broadcast(settings).join(facts, "provider").filter("configured and enabled")
    return eligible.select(
        "provider", "is_aggregator",
        F.row_number().over(Window.orderBy(tier, "provider_order")).alias("place"),
    )


def assign_sources(requests: DataFrame, settings: DataFrame) -> DataFrame:
    """(request, provider, place) rows: 1, 2 or 3 preferred providers by mode, or the one asked for.

    A requested provider that is not eligible yields no row. The join is against the ranked nine-row
    table, so requests are never shuffled.
    """
    ranked = F.broadcast(preference(settings))
    with_mode = requests.join(F.broadcast(dims.modes(requests.sparkSession)), "mode")
    asked = F.col("requested_provider")
    condition = F.when(asked.isNotNull(), asked == F.col("provider")).otherwise(
        F.col("place") <= F.col("mode_limit")
    )
    joined = with_mode.join(ranked, condition)
    return joined.withColumn("place", F.when(asked.isNotNull(), F.lit(1)).otherwise(F.col("place"))).drop(
        "is_aggregator"
    )


def remaining_providers(
    needs: DataFrame, tried: DataFrame, settings: DataFrame, aggregators_only: bool = False
) -> DataFrame:
    """Per query the first ``slots`` eligible providers it has not tried.

    ``needs(query_id, slots)``, ``tried(query_id, provider)``. What was tried is a set of at most nine
    names per query, so one aggregate and one equi join decide everything.
    """
    tried_sets = tried.groupBy("query_id").agg(F.collect_set("provider").alias("_tried"))
    pool = preference(settings)
    if aggregators_only:
        pool = pool.filter("is_aggregator")
    ordered = pool.agg(F.array_sort(F.collect_list(F.struct("place", "provider"))).alias("_pool"))
    joined = needs.join(tried_sets, "query_id", "left").join(F.broadcast(ordered), F.lit(True))
    untried = F.filter(
        "_pool",
        lambda p: ~F.array_contains(
            F.coalesce("_tried", F.array().cast("array<string>")), p["provider"]
        ),
    )
    picked = joined.select("query_id", "slots", F.posexplode(untried).alias("_pos", "_p"))
    return picked.filter(F.col("_pos") < F.col("slots")).select(
        "query_id", F.col("_p.provider").alias("provider"), (F.col("_pos") + 1).alias("place")
    )


def missing_answers(assigned: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Timeout rows for assigned providers that neither answered nor failed."""
    names = dims.providers(assigned.sparkSession).select("provider", "display_name")
    silent = unanswered(assigned, outcomes)
    return silent.join(F.broadcast(names), "provider").select(
        "query_id", "provider", F.lit("timeout").alias("category"),
        F.concat("display_name", F.lit(" exceeded the search time budget.")).alias("message"),
        F.lit(False).alias("charged"),
    )


def unanswered(assigned: DataFrame, outcomes: DataFrame) -> DataFrame:
    keys = ["query_id", "provider"]
    return assigned.select(*keys).distinct().join(outcomes.select(*keys).distinct(), keys, "left_anti")


def deadline_fan_in(assigned: DataFrame, responses: DataFrame) -> DataFrame:
    """Each assigned provider of a query with what came of it before the deadline.

    ``assigned(query_id, provider, mode, started_at)``, ``responses(query_id, provider, arrived_at,
    ok)``. The first response in time counts; ``outcome`` is answered, failed or timeout, ``late``
    tells a timeout whose response arrived afterwards.
    """
    keys = ["query_id", "provider"]
    modes = dims.modes(assigned.sparkSession).select("mode", "budget_ms")
    started = assigned.join(F.broadcast(modes), "mode").withColumn(
        "deadline", F.timestamp_micros(F.unix_micros("started_at") + F.col("budget_ms") * 1000)
    )
    # the earliest response decides, so repeats collapse before they travel
    earliest = responses.groupBy(*keys).agg(F.min(F.struct("arrived_at", "ok")).alias("_first"))
    joined = started.join(earliest, keys, "left")
    in_time = F.coalesce(F.col("_first.arrived_at") <= F.col("deadline"), F.lit(False))
    return joined.select(
        *keys,
        F.when(~in_time, F.lit("timeout"))
        .when(F.col("_first.ok"), F.lit("answered"))
        .otherwise(F.lit("failed"))
        .alias("outcome"),
        (~in_time & F.col("_first").isNotNull()).alias("late"),
        F.when(in_time, F.col("_first.arrived_at")).otherwise(F.col("deadline")).alias("settled_at"),
    )


def query_completion(fan_in: DataFrame) -> DataFrame:
    """When each query was complete: the last answer, or the deadline if someone stayed silent."""
    return fan_in.groupBy("query_id").agg(
        F.max("settled_at").alias("completed_at"),
        F.count_if(F.col("outcome") == "answered").alias("answered"),
        F.count_if(F.col("outcome") == "timeout").alias("timeouts"),
        F.count_if("late").alias("late"),
    )


def reuse_lookup(requests: DataFrame, stored: DataFrame, ttl_ms: int = dims.REUSE_TTL_MS) -> DataFrame:
    """As-of join: for each request the newest stored answer of its digest that is still valid.

    ``requests(digest, request_id, ts)``, ``stored(digest, answer_id, stored_at)``; valid while
    stored_at <= ts < stored_at + TTL. A valid answer is from the request's own stretch of TTL length or
    from the one before, so answers go to both and the newest is carried forward inside (digest, stretch):
    no pair of rows is formed, and a busy digest is spread over its stretches.
    """
    ttl = ttl_ms * 1000
    asked = requests.select(
        "digest", "request_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"),
        F.lit(1).alias("_side"), F.col("request_id").alias("_id"),
        F.lit(None).cast("struct<at:bigint,answer_id:bigint>").alias("_answer"),
    ).withColumn("_stretch", F.floor(F.col("_us") / ttl))
    at = F.unix_micros(F.col("stored_at").cast("timestamp"))
    answers = stored.select(
        "digest", F.lit(None).cast("bigint").alias("request_id"), at.alias("_us"),
        F.lit(0).alias("_side"), F.col("answer_id").alias("_id"),
        F.struct(at.alias("at"), F.col("answer_id")).alias("_answer"),
        F.explode(F.array(F.floor(at / ttl), F.floor(at / ttl) + 1)).alias("_stretch"),
    )
    so_far = (
        Window.partitionBy("digest", "_stretch").orderBy("_us", "_side", "_id")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    carried = asked.unionByName(answers).withColumn("_newest", F.last("_answer", ignorenulls=True).over(so_far))
    # no digest, no stored answer
    valid = F.col("digest").isNotNull() & (F.col("_us") < F.col("_newest.at") + ttl)
    return carried.filter("_side = 1").select(
        "request_id", "digest", F.when(valid, F.col("_newest.answer_id")).alias("answer_id")
    )


def reuse_stats(looked_up: DataFrame, stored: DataFrame, now_us: int, ttl_ms: int = dims.REUSE_TTL_MS) -> DataFrame:
    """One row: digests with an answer that is valid at ``now_us``, and how many lookups had one or had none.

    ``looked_up`` is what ``reuse_lookup`` returns, ``stored`` its stored answers.
    """
    at = F.unix_micros(F.col("stored_at").cast("timestamp"))
    live = stored.filter((at <= now_us) & (at > now_us - ttl_ms * 1000)).select("digest").distinct()
    entries = live.agg(F.count("digest").alias("entries"))
    counted = looked_up.agg(F.count("answer_id").alias("hits"), F.count_if(F.col("answer_id").isNull()).alias("misses"))
    # two single-row aggregates
    return entries.join(F.broadcast(counted), F.lit(True))
