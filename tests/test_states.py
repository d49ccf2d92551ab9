import itertools
import random

import pytest

from serploom.operators import routing, states
from serploom.streaming import live

CATEGORIES = [None, "timeout", "network", "authentication", "cancelled", "circuit_open"]


def attempt_log(seed, n, hot):
    rng, t, rows = random.Random(seed), 0.0, []
    for i in range(n):
        t += rng.choice([0.2, 1, 1, 3, 12])
        category = rng.choice(CATEGORIES + ["timeout", "timeout", "rate_limited"])
        provider = "tavily" if rng.random() < hot else rng.choice(["brave", "exa"])
        rows.append((i, provider, t, category is None, category, category != "circuit_open", rng.random() < 0.9))
    return rows


def as_table(spark, rows):
    df = spark.createDataFrame(rows, "event_id bigint, provider string, t double, ok boolean, category string, reached_network boolean, charged boolean")
    return df.selectExpr("*", "timestamp_micros(1700000000000000 + bigint(t * 1000000)) as ts")


@pytest.mark.parametrize("seed", [1, 2])
def test_observed_states(spark, seed):
    rows = attempt_log(seed, 300, 0.8)
    got = {r.provider: (r.circuit_state, r.rate_limited) for r in states.observed_states(as_table(spark, rows).repartition(5)).collect()}
    want = {}
    for provider in {r[1] for r in rows}:
        newest_first = [r for r in reversed(rows) if r[1] == provider]
        since_success = [r[4] for r in itertools.takewhile(lambda r: not r[3], newest_first)]
        tried = [r[4] for r in newest_first if r[4] != "circuit_open"]
        state = "open" if newest_first[0][4] == "circuit_open" else "half_open" if "circuit_open" in since_success else "closed"
        want[provider] = (state, bool(tried) and tried[0] == "rate_limited")
    assert got == want


@pytest.mark.parametrize("bucket_us", [1_000_000, 60_000_000, states.HOUR_US])
def test_streaks(spark, bucket_us):
    rows = attempt_log(9, 400, 0.7)
    got = {(r.provider, r.first_event): r.failures for r in states.failure_streaks(as_table(spark, rows), bucket_us=bucket_us).collect()}
    want, run = {}, {}
    for i, p, _, ok, category, reached, charged in rows:
        if ok:
            run.pop(p, None)
        elif category in ("timeout", "network", "rate_limited") and reached and charged:
            first = run.setdefault(p, i)
            want[(p, first)] = want.get((p, first), 0) + 1
    assert got == want


@pytest.mark.parametrize("ttl", [3, 10, 1000])
def test_reuse_lookup_as_of(spark, ttl):
    rng = random.Random(3)
    asked = [(f"d{rng.randint(0, 1)}", i, rng.randint(0, 300)) for i in range(200)]
    kept = [(f"d{rng.randint(0, 1)}", 1000 + i, rng.randint(0, 300)) for i in range(60)]
    requests = spark.createDataFrame(asked, "digest string, request_id bigint, t bigint").selectExpr("digest", "request_id", "timestamp_seconds(t) as ts")
    stored = spark.createDataFrame(kept, "digest string, answer_id bigint, t bigint").selectExpr("digest", "answer_id", "timestamp_seconds(t) as stored_at")
    got = {r.request_id: r.answer_id for r in routing.reuse_lookup(requests, stored, ttl * 1000).collect()}
    for digest, i, t in asked:
        valid = [(s, a) for d, a, s in kept if d == digest and s <= t < s + ttl]
        assert got[i] == (max(valid)[1] if valid else None)


def test_fan_in_stream_settles_what_the_watermark_passed(spark, tmp_path):
    assigned = spark.createDataFrame(
        [(1, "tavily", "fast", 0), (1, "brave", "fast", 0), (2, "tavily", "fast", 5), (3, "tavily", "fast", 4000)], "query_id bigint, provider string, mode string, t bigint"
    ).selectExpr("query_id", "provider", "mode", "timestamp_seconds(1700000000 + t) as started_at")
    responses = spark.createDataFrame([(1, "tavily", 3, True), (2, "tavily", 30, True), (3, "tavily", 4001, False), (9, "exa", 4000, True)], "query_id bigint, provider string, t bigint, ok boolean").selectExpr(
        "query_id", "provider", "timestamp_seconds(1700000000 + t) as arrived_at", "ok"
    )
    batch = {(r.query_id, r.provider): r.outcome for r in routing.deadline_fan_in(assigned, responses).collect()}
    assert batch == {(1, "tavily"): "answered", (1, "brave"): "timeout", (2, "tavily"): "timeout", (3, "tavily"): "failed"}
    assigned.coalesce(1).write.parquet(str(tmp_path / "a"))
    responses.coalesce(1).write.parquet(str(tmp_path / "r"))
    joined = live.stream_fan_in(
        spark.readStream.schema(assigned.schema).parquet(str(tmp_path / "a")), spark.readStream.schema(responses.schema).parquet(str(tmp_path / "r"))
    )
    got = {(r.query_id, r.provider): r.outcome for r in live.run_through(joined, "fan-in").collect()}
    assert got == batch


def test_live_fusion_joins_what_arrives_in_several_batches(spark, tmp_path):
    from serploom.functions.urls import with_canonical_url
    from serploom.operators import fusion

    parts = [
        [(1, "tavily", 1, "A", "https://a.com/"), (2, "tavily", 1, "C", "https://c.com/")],
        [(1, "brave", 1, "A", "https://a.com"), (1, "brave", 2, "B", "https://b.com")],
        [(3, "exa", 1, "D", "https://d.com")],
    ]
    schema = "query_id bigint, provider string, provider_rank int, title string, url string"
    for part in parts:
        rows = with_canonical_url(spark.createDataFrame(part, schema), "url", host_out="host")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    every = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.fuse_batches(stream, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    assert len(list((tmp_path / "out" / "fused").glob("batch=*"))) == 3
    shown = lambda df: sorted((r.query_id, r.rank, r.canonical_url, r.score, r.corroborated) for r in df.collect())
    assert shown(live.fused_so_far(spark, str(tmp_path / "out"))) == shown(fusion.fuse(every))
