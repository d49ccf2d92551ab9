"""Live counters, live fusion and the deadline join."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from serploom import dims
from serploom.operators import folds, fusion, health, routing
from serploom.operators.folds import Fold
from serploom.session import ensure_checkpoint_dir, landed
from serploom.streaming.store import KeyedStore


def new_folder(df: DataFrame, name: str) -> str:
    """A fresh place for one stream's output and progress, in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _trigger(every: str | None) -> dict:
    return {"processingTime": every} if every else {"availableNow": True}


def append_to(stream: DataFrame, path: str, progress: str, every: str | None = None) -> StreamingQuery:
    """Appends results to a parquet table; ``every`` sets the refresh interval, else run once through."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", progress)
        .outputMode("append")
        .trigger(**_trigger(every))
        .start()
    )


def run_through(stream: DataFrame, name: str) -> DataFrame:
    """Drives a stream over all that is available and returns what it wrote."""
    folder = new_folder(stream, name)
    append_to(stream, f"{folder}/data", f"{folder}/progress").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/data")


def until_idle(query: StreamingQuery) -> None:
    """Lets a refreshing query go through all that has arrived, then stops it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, a join one store a partition instead of four.

    The default store holds every version's rows in the executors' memory. A session that names another store keeps it,
    and a stream that is started again keeps the one that its progress names.
    """
    default = next(iter(_STATE))
    if not spark.conf.get(default).endswith(".HDFSBackedStateStoreProvider"):
        yield
        return
    before = {name: spark.conf.get(name, None) for name in _STATE}
    try:
        for name, value in _STATE.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


# --- running tables


def state_store(spark: SparkSession, path: str, states: StructType, keys: list[str], of: list[Fold], **layout) -> KeyedStore:
    """Where the states of ``folds.parts`` are kept, merged on reading."""
    return KeyedStore(spark, path, keys, states, lambda rows: folds.merge(rows, keys, of), **layout)


def upsert_states(
    rows: DataFrame, path: str, progress: str, keys: list[str], of: list[Fold], every: str | None = None, **layout
) -> tuple[StreamingQuery, KeyedStore]:
    """Keeps one state per key current: every micro-batch adds its own part, none reads or rewrites the table.

    The stream holds no state of its own, so it needs no watermark and rows may come in any order. ``every`` sets
    the refresh interval, else the query runs once through. Read the table with ``store.current()``.
    """
    store = state_store(rows.sparkSession, path, folds.parts(rows, keys, of).schema, keys, of, **layout)

    def write(batch: DataFrame, number: int) -> None:
        store.add(folds.parts(batch, keys, of), number)

    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(**_trigger(every)).start()
    return query, store


def live_counters(attempts: DataFrame, path: str, progress: str, every: str | None = None, **layout) -> tuple[StreamingQuery, KeyedStore]:
    """Provider counters; ``health.counters_of(store.current())`` is the table."""
    return upsert_states(attempts, path, progress, ["provider"], health.counter_folds(), every, **layout)


def live_probes(probes: DataFrame, path: str, progress: str, every: str | None = None, **layout) -> tuple[StreamingQuery, KeyedStore]:
    """Provider probes; ``health.probe_status_of(store.current(), settings)`` is the table."""
    return upsert_states(probes, path, progress, ["provider"], health.probe_folds(), every, **layout)


def live_nodes(probes: DataFrame, path: str, progress: str, every: str | None = None, **layout) -> tuple[StreamingQuery, KeyedStore]:
    """Node probes; ``health.node_status_of(store.current())`` is the table."""
    return upsert_states(probes, path, progress, ["node"], health.node_folds(), every, **layout)


# --- live fusion


def votes_of(rows: DataFrame) -> DataFrame:
    """Result rows reduced to one vote per (query, URL, provider), as result rows again."""
    return fusion.best_rank_votes(rows).withColumnRenamed("rank", "provider_rank")


def _newest(lists: DataFrame) -> DataFrame:
    """The lists of each query's newest round."""
    of = Window.partitionBy("query_id")
    return lists.withColumn("_newest", F.max("round").over(of)).filter("round = _newest").drop("_newest")


def fuse_batches(
    results: DataFrame, path: str, progress: str, every: str | None = None,
    fuse: Callable[[DataFrame], DataFrame] = fusion.fuse, **layout,
) -> StreamingQuery:
    """Fuses the queries that a micro-batch adds rows to, over all their votes so far.

    Votes are kept under ``path/votes`` and fused lists under ``path/fused``, both by bucket of the query, so a batch
    reads the buckets it touches; a source that reports a URL again adds nothing to them. Rows of one query that
    arrive in several batches meet, and end as the batch form would have them. ``fused_so_far`` reads the lists.
    """
    spark = results.sparkSession
    votes = KeyedStore(spark, f"{path}/votes", ["query_id"], votes_of(results).schema, votes_of, within=["canonical_url"], **layout)
    fused = fuse(spark.createDataFrame([], votes.schema)).schema
    lists = fused_store(spark, path, StructType([*fused.fields, StructField("round", LongType())]), **layout)

    def write(batch: DataFrame, number: int) -> None:
        votes.add(votes_of(batch), number)
        slices = votes.slices_of(number)
        parts = []
        for n in range(slices):
            part = fuse(votes.rows(number, touched=votes.batch(number), part=(n, slices)))
            # the lists are few rows; landed, so the shuffles of one part are gone when the next begins
            parts.append(landed(part, "lists") if slices > 1 else part)
        lists.add(reduce(DataFrame.unionByName, parts).withColumn("round", F.lit(number).cast("bigint")), number)

    return (
        results.writeStream.foreachBatch(write)
        .option("checkpointLocation", progress)
        .trigger(**_trigger(every))
        .start()
    )


def fused_store(spark: SparkSession, path: str, schema: StructType | None = None, **layout) -> KeyedStore:
    """The lists that ``fuse_batches`` writes, with the number of their batch as ``round``."""
    return KeyedStore(spark, f"{path}/fused", ["query_id"], schema, _newest, **layout)


def fused_so_far(spark: SparkSession, path: str, **layout) -> DataFrame:
    """The newest fused list of every query that ``fuse_batches`` wrote."""
    return fused_store(spark, path, **layout).current().drop("round")


# --- deadlines


def stream_fan_in(
    assigned: DataFrame, responses: DataFrame, delay: str = "1 minute", late_for: str = "60 seconds"
) -> DataFrame:
    """What came of assigned providers as a stream: an interval left outer join under two watermarks.

    ``assigned(query_id, provider, mode, started_at[, asked])``, ``responses(query_id, provider, arrived_at, ok)``. The
    join waits ``late_for`` longer than the longest budget: a response in time settles its row, a later one makes it
    a timeout with ``late`` set, and only a row that nothing came for is a plain timeout, once the watermark has
    passed it. A provider that responds again gives another row; ``first_outcomes`` keeps the earliest.
    """
    modes = dims.modes(assigned.sparkSession).select("mode", "budget_ms")
    asked = ["asked"] if "asked" in assigned.columns else []
    left = (
        assigned.join(F.broadcast(modes), "mode")
        .select("query_id", "provider", "started_at", "budget_ms", *asked)
        .withWatermark("started_at", delay)
        .alias("a")
    )
    right = responses.select("query_id", "provider", "arrived_at", "ok").withWatermark("arrived_at", delay).alias("r")
    longest = max(m[2] for m in dims.MODES) // 1000
    joined = left.join(
        right,
        (F.col("a.query_id") == F.col("r.query_id"))
        & (F.col("a.provider") == F.col("r.provider"))
        & (F.col("arrived_at") >= F.col("started_at"))
        & (F.col("arrived_at") <= F.col("started_at") + F.expr(f"interval {longest} seconds + interval {late_for}")),
        "left_outer",
    )
    deadline = F.timestamp_micros(F.unix_micros("started_at") + F.col("budget_ms") * 1000)
    in_time = F.coalesce(F.col("arrived_at") <= deadline, F.lit(False))
    outcome = F.when(~in_time, F.lit("timeout")).when(F.col("ok"), F.lit("answered")).otherwise("failed")
    return joined.select(
        "a.query_id", "a.provider", "started_at", *asked, "arrived_at", "ok", outcome.alias("outcome"),
        (~in_time & F.col("arrived_at").isNotNull()).alias("late"),
        F.when(in_time, F.col("arrived_at")).otherwise(deadline).alias("settled_at"),
    )


def first_outcomes(rows: DataFrame) -> DataFrame:
    """One row of ``stream_fan_in`` per (query, provider): that of the earliest response, of equal ones the failed."""
    others = [c for c in rows.columns if c not in ("query_id", "provider")]
    place = F.struct(F.col("arrived_at").isNull().alias("none"), "arrived_at", "ok")
    return rows.groupBy("query_id", "provider").agg(F.min_by(F.struct(*others), place).alias("_row")).select("query_id", "provider", "_row.*")


def outcome_store(spark: SparkSession, path: str, schema: StructType | None = None, **layout) -> KeyedStore:
    """Outcomes by query. Late responses are its rows with ``late``, each once."""
    return KeyedStore(spark, f"{path}/outcomes", ["query_id"], schema, first_outcomes, **layout)


def closed_store(spark: SparkSession, path: str, schema: StructType | None = None, **layout) -> KeyedStore:
    """Closed queries, as ``routing.query_completion`` has them and with the batch that closed or last changed them as ``round``."""
    return KeyedStore(spark, f"{path}/closed", ["query_id"], schema, _newest, **layout)


def close_queries(
    outcomes: DataFrame, path: str, progress: str, every: str | None = None,
    on_closed: Callable[[DataFrame, int], None] | None = None, **layout,
) -> StreamingQuery:
    """Settles queries as the outcomes of their providers come in.

    ``outcomes`` is what ``stream_fan_in`` returns with ``asked``, the number of providers that a query asked. A micro-batch
    looks again at the queries it brings outcomes of; those that all providers are settled for are closed.
    ``on_closed`` gets the closed queries of the batch and its number, for instance to fuse them.
    """
    spark = outcomes.sparkSession
    kept = outcome_store(spark, path, outcomes.schema, **layout)
    empty = spark.createDataFrame([], outcomes.schema)
    closed = closed_store(spark, path, StructType([*_closed(empty).schema.fields, StructField("round", LongType())]), **layout)

    def write(batch: DataFrame, number: int) -> None:
        kept.add(batch, number)
        done = _closed(kept.rows(number, touched=kept.batch(number)))
        closed.add(done.withColumn("round", F.lit(number).cast("bigint")), number)
        if on_closed:
            on_closed(closed.batch(number), number)

    with state_on_disk(spark):
        return outcomes.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(**_trigger(every)).start()


def _closed(outcomes: DataFrame) -> DataFrame:
    settled = outcomes.groupBy("query_id").agg(F.count("*").alias("settled"), F.max("asked").alias("asked"))
    return routing.query_completion(outcomes).join(settled.filter("settled >= asked").select("query_id"), "query_id", "left_semi")
