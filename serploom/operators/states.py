"""What attempt logs say about outcomes over time: failure streaks and the state a provider was last seen in.

Times are event times in microseconds.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serploom.functions.labels import is_transient

NO_OUTCOME, SUCCESS, TRANSIENT, OTHER_FAILURE = range(4)
HOUR_US = 3_600_000_000


def outcome_code() -> Column:
    """What an attempt means for its provider; skips, cancellations and deadline losses mean nothing."""
    none = (
        ~F.col("reached_network")
        | ~F.col("charged")
        | F.coalesce(F.col("category").isin("cancelled", "circuit_open"), F.lit(False))
    )
    return (
        F.when(F.col("ok"), F.lit(SUCCESS))
        .when(none, F.lit(NO_OUTCOME))
        .when(is_transient(F.col("category")), F.lit(TRANSIENT))
        .otherwise(F.lit(OTHER_FAILURE))
    )


def failure_streaks(attempts: DataFrame, key: str = "provider", bucket_us: int = HOUR_US) -> DataFrame:
    """Runs of transient failures between successes; other failures neither extend nor break one.

    A key's log is cut into time buckets, so a key that owns most of the log is spread over tasks: the
    successes before a bucket come from one counted row per key and bucket, those inside from a window.
    """
    rows = attempts.select(
        key, "event_id", F.coalesce("ok", F.lit(False)).alias("ok"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"),
        outcome_code().alias("_code"),
    ).withColumn("_bucket", F.floor(F.col("_us") / bucket_us))
    in_order = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(key, "_bucket").orderBy("_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    before = (
        rows.groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_of")).agg(F.count_if("ok").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(in_order), F.lit(0)))
    )
    numbered = rows.withColumn("_inside", F.sum(F.col("ok").cast("bigint")).over(inside))
    joined = numbered.filter(F.col("_code") == TRANSIENT).join(
        before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_of"))
    )
    return (
        joined.withColumn("island", F.col("_before") + F.col("_inside"))
        .groupBy(key, "island")
        .agg(
            F.count("*").alias("failures"),
            F.min("event_id").alias("first_event"),
            F.min("_us").alias("started_us"),
            F.max("_us").alias("ended_us"),
        )
    )


def moment(ts: str = "ts", event_id: str = "event_id") -> Column:
    """Time and event number as one decimal, which a hash aggregation can compare (a struct it can't)."""
    us = F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(18,0)")
    return (us * F.lit(Decimal(10**19)) + F.col(event_id).cast("decimal(19,0)")).cast("decimal(38,0)")


def observed_states(attempts: DataFrame, key: str = "provider") -> DataFrame:
    """Circuit and rate limit as the log shows them, one row per key.

    ``circuit_state`` is open when the newest attempt was skipped with ``circuit_open``, half_open when
    attempts were made since but none has succeeded, else closed. ``rate_limited`` tells that the newest
    attempt that was not skipped was refused for its rate.
    """
    at, skipped = moment(), F.coalesce(F.col("category") == "circuit_open", F.lit(False))
    refused = F.coalesce(F.col("category") == "rate_limited", F.lit(False))
    seen = attempts.groupBy(key).agg(
        F.max(F.when(skipped, at)).alias("_skipped"),
        F.max(F.when(~skipped, at)).alias("_tried"),
        F.max(F.when(F.col("ok"), at)).alias("_succeeded"),
        F.max(F.when(refused, at)).alias("_refused"),
    )
    never = F.lit(-1).cast("decimal(38,0)")
    after = lambda x, y: F.coalesce(x, never) > F.coalesce(y, never)
    state = (
        F.when(after(F.col("_skipped"), F.col("_tried")), F.lit("open"))
        .when(after(F.col("_skipped"), F.col("_succeeded")), F.lit("half_open"))
        .otherwise(F.lit("closed"))
    )
    limited = F.coalesce(F.col("_refused") == F.col("_tried"), F.lit(False))
    return seen.select(key, state.alias("circuit_state"), limited.alias("rate_limited"))
