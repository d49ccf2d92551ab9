"""Keyed stores under micro-batches: pruning, compaction, replays; running tables, fusion and deadlines as streams."""

import random
import re

import pytest
from pyspark.sql import functions as F

from serploom.functions.urls import with_canonical_url
from serploom.operators import folds, fusion, health, routing
from serploom.operators.folds import Fold
from serploom.streaming import live
from serploom.streaming.store import KeyedStore

@pytest.fixture
def of(spark):
    return [
        folds.count("n"), Fold("total", "sum", F.col("v")), Fold("top", "max", F.col("v"), F.col("v") < 90), Fold("last", "newest", F.col("name"), None, F.col("at")),
        Fold("names", "seen", F.col("name")),
    ]



def _rows(spark, seed, n=40, keys=30):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(keys), rnd.randrange(100), seed * 1000 + i, rnd.choice("abc")) for i in range(n)]
    return spark.createDataFrame(rows, "k bigint, v bigint, at bigint, name string")


def _shown(states):
    return sorted((r.k, r.n, r.total, r.top, r["last"].value, sorted(r.names)) for r in states.collect())


def test_parts_merge_to_the_whole(spark, of):
    batches = [_rows(spark, s) for s in range(4)]
    whole = batches[0]
    for b in batches[1:]:
        whole = whole.unionByName(b)
    parts = folds.parts(batches[3], ["k"], of)
    for b in batches[:3]:
        parts = parts.unionByName(folds.parts(b, ["k"], of))
    merged = folds.merge(parts, ["k"], of)
    want = folds.parts(whole, ["k"], of)
    assert _shown(merged) == _shown(want) == _shown(folds.merge(merged, ["k"], of))


def test_store_over_many_batches(spark, of, tmp_path):
    path, store, seen = str(tmp_path / "s"), None, None
    for number in range(11):
        batch = _rows(spark, number)
        seen = batch if seen is None else seen.unionByName(batch)
        state = folds.parts(batch, ["k"], of)
        store = store or live.state_store(spark, path, state.schema, ["k"], of, buckets=8, compact=3)
        store.add(state, number)
        if number in (2, 5, 7, 10):
            store.add(state, number)  # replayed
            assert _shown(store.rows(number)) == _shown(store.current()) == _shown(folds.parts(seen, ["k"], of))
    assert store.last() == 10
    names = sorted(p.name for p in (tmp_path / "s").iterdir())
    assert len([n for n in names if n[6:].isdigit()]) <= 2 * 3 and len([n for n in names if n.endswith("-merged")]) <= 2
    # a base that was not finished: the one before and its batches are enough
    (tmp_path / "s" / "batch=8-merged" / "_SUCCESS").unlink()
    assert _shown(live.state_store(spark, path, store.schema, ["k"], of, buckets=8, compact=3).current()) == _shown(folds.parts(seen, ["k"], of))
    kinds = lambda s: [(f.name, f.dataType.simpleString()) for f in s]
    assert kinds(KeyedStore(spark, path, ["k"], compact=3).schema) == kinds(store.schema)
    assert KeyedStore(spark, str(tmp_path / "new"), ["k"], store.schema).current().collect() == []


def test_a_batch_reads_the_buckets_it_touches(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id as k", "id as v")
    store = KeyedStore(spark, str(tmp_path / "s"), ["k"], rows.schema, buckets=64, compact=100)
    read = []
    for number in range(8):
        batch = rows.filter(f"k between {number * 500} and {number * 500 + 3}")
        store.add(rows.filter(f"k between {number * 500} and {number * 500 + 499}"), number)
        found = store.rows(number, touched=batch)
        assert {r.k for r in found.collect()} == set(range(number * 500, number * 500 + 4))
        plan = found._jdf.queryExecution().executedPlan().toString()
        buckets = re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (?:IN|INSET) \(?([\d, ]+)", plan)
        read.append(len(buckets[1].split(",")))
    assert max(read) <= 4


def _lists(spark, seed, queries, urls=12):
    rnd = random.Random(seed)
    rows = [(q, p, rnd.randrange(1, 20), f"T{u}", f"https://h{u % 5}.com/{u}") for q in queries for p in ("tavily", "brave", "searxng") for u in rnd.sample(range(urls), 5)]
    return with_canonical_url(spark.createDataFrame(rows, "query_id bigint, provider string, provider_rank int, title string, url string"), "url", host_out="host")


def test_live_fusion_over_many_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    parts = [(1, range(0, 6)), (2, range(4, 10)), (3, range(10, 16)), (4, [0, 15]), (5, range(16, 20))]
    for seed, queries in parts:
        _lists(spark, seed, queries).coalesce(1).write.mode("append").parquet(source)
    every = spark.read.parquet(source)
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(source)
    path = str(tmp_path / "out")
    live.fuse_batches(stream, path, str(tmp_path / "progress"), buckets=16, compact=2).awaitTermination()
    shown = lambda df: sorted((r.query_id, r.rank, r.canonical_url, r.score, r.corroborated, r.title) for r in df.collect())
    assert shown(live.fused_so_far(spark, path, buckets=16, compact=2)) == shown(fusion.fuse(every))
    lists = live.fused_store(spark, path, buckets=16, compact=2)
    # the last batch brought four new queries and fused no other
    assert {r.query_id for r in lists.batch(4).select("query_id").distinct().collect()} == set(range(16, 20))
    votes = KeyedStore(spark, f"{path}/votes", ["query_id"], merge=live.votes_of, buckets=16, compact=2)
    # a URL reported again is one vote: the store holds no more rows than there are votes
    assert votes.current().count() == fusion.best_rank_votes(every).count()


def _probe_log(spark, seed, n=60):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["tavily", "brave", "exa"]), rnd.choice(["n1", "n2"]), seed * 1000 + i, seed * 1000 + i, rnd.random() < 0.7, rnd.randrange(900), rnd.randrange(9), rnd.choice([None, "timeout"]),
             rnd.choice(["up", "down", "degraded"])) for i in range(n)]
    df = spark.createDataFrame(rows, "provider string, node string, event_id bigint, t bigint, ok boolean, latency_ms int, result_count int, category string, state string")
    return df.selectExpr("*", "timestamp_seconds(1700000000 + t) as ts", "node = 'n1' as is_local", "array('e') as engines", "array(node) as unavailable_engines", "category as error")


@pytest.mark.parametrize("every", [None, "500 milliseconds"])
def test_running_tables(spark, tmp_path, every):
    for s in (3, 1, 2, 4):
        _probe_log(spark, s).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    whole = spark.read.parquet(str(tmp_path / "in"))
    settings = spark.createDataFrame([("tavily", True, True), ("mojeek", False, True)], "provider string, configured boolean, enabled boolean")

    def run(start, name):
        stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query, store = start(stream, str(tmp_path / name), str(tmp_path / f"{name}-progress"), every, compact=3)
        live.until_idle(query) if every else query.awaitTermination()
        assert not query.isActive and store.last() == 3
        return store

    shown = lambda df: sorted(map(str, df.collect()))
    probes, nodes = run(live.live_probes, "probes"), run(live.live_nodes, "nodes")
    assert shown(health.probe_status_of(probes.current(), settings)) == shown(health.probe_status(whole, settings))
    assert shown(health.node_status_of(nodes.current())) == shown(health.node_status(whole))
    # a batch that is replayed changes nothing
    nodes.add(nodes.batch(3), 3)
    assert shown(health.node_status_of(nodes.current())) == shown(health.node_status(whole))


def test_queries_close_and_late_responses_count_once(spark, tmp_path):
    rnd = random.Random(6)
    asked, came = [], []
    for q in range(40):
        providers = rnd.sample(["tavily", "brave", "exa"], rnd.randrange(1, 4))
        for p in providers:
            asked.append((q, p, rnd.choice(["fast"]), q * 10, len(providers)))
            if rnd.random() < 0.8:
                came.append((q, p, q * 10 + rnd.choice([1, 5, 11, 13, 40]), rnd.random() < 0.7))
            if rnd.random() < 0.2:  # answers again
                came.append((q, p, q * 10 + rnd.choice([2, 30]), True))
    a = spark.createDataFrame(asked, "query_id bigint, provider string, mode string, t bigint, asked bigint").selectExpr("query_id", "provider", "mode", "timestamp_seconds(1700000000 + t) as started_at", "asked")
    r = spark.createDataFrame(came, "query_id bigint, provider string, t bigint, ok boolean").selectExpr("query_id", "provider", "timestamp_seconds(1700000000 + t) as arrived_at", "ok")
    batch = routing.deadline_fan_in(a, r)
    end = spark.sql("select -1L as query_id, '-' as provider, 'fast' as mode, timestamp'2100-01-01 00:00:00' as started_at, 1L as asked")
    last = spark.sql("select -2L as query_id, '-' as provider, timestamp'2100-01-01 00:00:00' as arrived_at, true as ok")
    for df, name, tail in ((a, "a", end), (r, "r", last)):
        df.orderBy(F.rand(3)).repartition(3).write.parquet(str(tmp_path / name))
        tail.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda df, name: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    closed_in = {}
    path = str(tmp_path / "out")

    def closed(done, number):
        for row in done.collect():
            closed_in.setdefault(row.query_id, []).append(number)

    joined = live.stream_fan_in(read(a, "a"), read(r, "r"), delay="1 day")
    live.close_queries(joined, path, str(tmp_path / "progress"), on_closed=closed, compact=3).awaitTermination()
    keyed = lambda df: sorted((x.query_id, x.provider, x.outcome, x.late, x.settled_at) for x in df.collect())
    outcomes = live.outcome_store(spark, path, compact=3).current()
    assert keyed(outcomes) == keyed(batch)
    assert outcomes.filter("late").count() == batch.filter("late").count() > 0
    done = live.closed_store(spark, path, compact=3).current()
    shown = lambda df: sorted((x.query_id, x.completed_at, x.answered, x.timeouts, x.late) for x in df.collect())
    assert shown(done) == shown(routing.query_completion(batch)) and set(closed_in) == set(range(40))


def test_without_adaptive_execution_a_bucket_is_one_file(spark, tmp_path):
    """The micro-batches of a stateful stream have none: there every task wrote a file for every bucket."""
    plain = spark.newSession()
    plain.conf.set("spark.sql.adaptive.enabled", "false")
    rows = plain.range(4000).selectExpr("id as k", "id as v").repartition(8)
    store = KeyedStore(spark, str(tmp_path / "s"), ["k"], rows.schema, buckets=16)
    store.add(rows, 0)
    files = {b.name: len(list(b.glob("*.parquet"))) for b in (tmp_path / "s" / "batch=0").glob("bucket=*")}
    assert len(files) == 16 and set(files.values()) == {1}
    assert sorted(tuple(r) for r in store.current().collect()) == [(k, k) for k in range(4000)]


def test_the_deadline_join_keeps_its_state_on_disk(spark, tmp_path):
    before = {name: spark.conf.get(name, None) for name in live._STATE}
    spark.sql("select 1L as query_id, 'exa' as provider, 'fast' as mode, timestamp'2024-01-01 00:00:00' as started_at, 1L as asked").write.parquet(str(tmp_path / "a"))
    spark.sql("select 1L as query_id, 'exa' as provider, timestamp'2024-01-01 00:00:01' as arrived_at, true as ok").write.parquet(str(tmp_path / "r"))
    a, r = (spark.readStream.schema(spark.read.parquet(str(tmp_path / n)).schema).parquet(str(tmp_path / n)) for n in "ar")
    seen = []
    live.close_queries(live.stream_fan_in(a, r), str(tmp_path / "out"), str(tmp_path / "progress"), on_closed=lambda done, number: seen.extend(done.collect())).awaitTermination()
    kinds = {p.suffix for p in (tmp_path / "progress" / "state").rglob("[0-9]*.*")}
    assert kinds & {".changelog", ".zip"} and ".delta" not in kinds
    assert [(x.query_id, x.answered) for x in seen] == [(1, 1)]
    assert {name: spark.conf.get(name, None) for name in live._STATE} == before
