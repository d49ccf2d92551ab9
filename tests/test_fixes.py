"""Cases that the registered queries' tables do not reach."""

import hashlib
import hmac

from pyspark.sql import functions as F

from serploom.functions.requests import clamp_requests, query_pseudonym
from serploom.functions.text import leading_title
from serploom.functions.urls import credential_in_url
from serploom.operators import fusion, health, runs
from serploom.plans import health_queries
from serploom.sources.payloads import read_brave, read_mojeek, read_payloads, result_rows


def test_own_limit_has_no_ceiling(spark):
    rows = [(1, "tavily", i, f"t{i}", f"http://h{i}.example/", f"http://h{i}.example/", f"h{i}.example", 30) for i in range(1, 31)]
    schema = "query_id int, provider string, provider_rank int, title string, url string, canonical_url string, host string, result_limit int"
    assert fusion.fuse(spark.createDataFrame(rows, schema)).count() == 30


def test_broken_payloads(one):
    for body, brave, mojeek in [("{bad", "malformed_response", "malformed_response"), ('{"web": 5}', "malformed_response", "server_error"),
                                ('{"response": 5}', "ok", "malformed_response"), ('{"web": {"results": []}}', "ok", "server_error")]:
        assert one(lambda b: read_brave(b)["outcome"], body) == brave
        assert one(lambda b: read_mojeek(b)["outcome"], body) == mojeek


def test_defaults_and_keys(spark, one):
    row = spark.createDataFrame([("q", 5, None)], "query string, max_results int, max_characters int")
    assert clamp_requests(row, max_characters="max_characters").first().character_limit == 12_000
    key = b"k" * 100
    want = "q" + hmac.new(key, b"swift", hashlib.sha256).hexdigest()[:16].lstrip("0")
    assert one(lambda q: query_pseudonym(q, key), "swift") == want
    assert one(leading_title, "Title: " + "x" * 1_200_000) == "x" * 1_200_000


def test_encoded_credential_names(one):
    assert one(credential_in_url, "https://a.example/?%74oken=1") is not None
    assert one(credential_in_url, "https://a.example/?q=1") is None


def test_failures_without_category(spark):
    schema = "provider string, ts timestamp, event_id bigint, ok boolean, category string, message string, latency_ms int, result_count int, reached_network boolean"
    rows = spark.createDataFrame([("exa", None, 1, False, None, "m", 5, 0, True)], schema)
    assert health.provider_counters(rows).first().failures == 1


def test_single_provider_requests_are_not_thin(spark):
    requests = spark.createDataFrame([(1, "thorough", 5, None), (2, "thorough", 5, "exa")], "query_id int, mode string, result_limit int, requested_provider string")
    fused = spark.range(0).select(F.col("id").alias("query_id"))
    assert [r.query_id for r in runs.thin_queries(requests, fused).collect()] == [1]


def test_silent_providers_reads_every_attempt(spark):
    plan = health_queries.silent_providers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "latency_ms" not in plan and "latency_ms" not in health_queries.ORACLE["silent_providers"].rsplit("except", 1)[1]


def test_payloads_are_parsed_in_one_place(spark):
    rows = spark.createDataFrame([(1, "brave", 200, '{"web": {"results": [{"title": "t", "url": "u", "page_age": "2024-01-02"}]}}')], "query_id int, provider string, status_code int, body string")
    plan = result_rows(read_payloads(rows))
    filters = [line for line in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter (" in line]
    assert not any("from_json" in line or "size(" in line for line in filters)
    assert [(r.provider_rank, str(r.published_at)) for r in plan.collect()] == [(1, "2024-01-02 00:00:00")]
