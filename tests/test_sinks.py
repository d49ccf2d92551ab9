"""Writers: partitions, repeated runs, markers, pruned reading. Pages from files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from serploom.operators import pages
from serploom.sinks import outputs, tables
from serploom.sources.tables import page_files, read_pages

NOW = dt.datetime(2024, 3, 10, 12, tzinfo=dt.timezone.utc)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _searches(spark, n, day="2024-02-01"):
    return spark.range(n).selectExpr(
        "id as query_id", "concat('q', id) as query", "array('tavily') as providers_used", "array('w') as warnings",
        f"cast('{day} 10:00:00' as timestamp) + make_interval(0, 0, 0, cast(id % 3 as int)) as retrieved_at", "cast(id as int) as elapsed_ms", "false as served_from_cache",
        "cast(2 as int) as results_considered",
    ).withColumn("providers_failed", F.array().cast(outputs.FAILURE))


def _fused(spark, n):
    return spark.range(n).selectExpr(
        "id as query_id", "cast(1 as int) as rank", "concat('t', id) as title", "'https://a.com/' as url", "array('tavily') as sources", "'s' as snippet",
        "cast(null as timestamp) as published_at",
    )


def _results(spark):
    return spark.range(400).selectExpr(
        "id as query_id", "element_at(array('tavily', 'brave', 'exa', 'mojeek'), cast(1 + id % 4 as int)) as provider", "concat('https://a.com/', id) as url",
        "timestamp_seconds(1710072000 - id * 43200) as published_at",
    )


def test_results_are_read_by_day_and_provider(spark, tmp_path):
    path = str(tmp_path / "results")
    results = _results(spark)
    tables.write_results(results, path, "r1")
    assert sorted(p.name for p in next((tmp_path / "results").glob("day=2024-03-10")).iterdir()) == ["provider=brave", "provider=tavily"]
    recent = tables.read_recent(spark, path, "week", NOW, ["brave", "exa"])
    want = results.filter("provider in ('brave', 'exa') and published_at >= timestamp'2024-03-03 12:00:00'")
    assert sorted(r.query_id for r in recent.collect()) == sorted(r.query_id for r in want.collect())
    plan = _plan(recent)
    assert "PartitionFilters" in plan and "day" in plan.split("PartitionFilters:")[1].split("]")[0] and "provider" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert tables.read_recent(spark, path, "any", NOW).count() == 400
    # a small table of days and providers prunes at run time
    wanted = spark.createDataFrame([(dt.date(2024, 3, 9), "exa")], "day date, provider string").filter("provider <> ''")
    joined = spark.read.parquet(path).join(wanted, ["day", "provider"])
    assert "dynamicpruning" in _plan(joined) and {r.query_id for r in joined.collect()} == {r.query_id for r in results.filter("provider = 'exa' and date(published_at) = '2024-03-09'").collect()}


def test_a_repeated_run_replaces_itself_only(spark, tmp_path):
    path = str(tmp_path / "results")
    tables.write_results(_results(spark), path, "r1")
    tables.write_results(_results(spark).filter("query_id < 10").withColumn("url", F.lit("new")), path, "r2")
    tables.write_results(_results(spark), path, "r1")
    assert tables.read_runs(spark, path).count() == 410
    # the second attempt of r2 has fewer days; those of the first are no longer listed
    tables.write_results(_results(spark).filter("query_id < 2").withColumn("url", F.lit("newer")), path, "r2")
    now = tables.read_runs(spark, path)
    assert now.count() == 402 and sorted(r.url for r in now.filter("run = 'r2'").collect()) == ["newer", "newer"]
    assert "dynamicpruning" in _plan(now)
    assert {r.run for r in tables.committed(spark, path).collect()} == {"r1", "r2"}


def test_a_run_without_marker_is_not_read(spark, tmp_path):
    path = str(tmp_path / "results")
    tables.write_results(_results(spark), path, "r1")
    half = _results(spark).withColumns({"day": F.to_date("published_at"), "run": F.lit("r2")})
    half.write.mode("append").partitionBy("day", "provider", "run").parquet(path)
    assert spark.read.parquet(path).count() == 800 and tables.read_runs(spark, path).count() == 400


def test_search_and_answer_documents_are_written(spark, tmp_path):
    searches, fused = _searches(spark, 9), _fused(spark, 7)
    for _ in range(2):
        tables.write_search(searches, fused, str(tmp_path / "s"), "a")
    want = {r.query_id: r.document for r in outputs.search_documents(searches, fused).collect()}
    got = tables.read_runs(spark, str(tmp_path / "s"))
    assert {r.query_id: r.document for r in got.collect()} == want and got.count() == 9 and got.select("day").distinct().count() == 3
    cited = "array<struct<index:int,source:struct<source_index:int,url:string,title:string,sources:array<string>>>>"
    checked = spark.range(5).selectExpr("id as query_id", "'m' as model", "'answered' as status", "'text' as answer").withColumn("citations", F.array().cast(cited))
    for _ in range(2):
        tables.write_answers(checked, searches, ["query_id"], str(tmp_path / "a"), "a")
    want = {r.query_id: r.document for r in outputs.answer_documents(checked, searches, ["query_id"]).collect()}
    got = tables.read_runs(spark, str(tmp_path / "a"))
    assert {r.query_id: r.document for r in got.collect()} == want and got.count() == 9


def test_page_and_status_documents_are_written(spark, tmp_path):
    rows = spark.range(6).selectExpr(
        "id as page_id", "'https://a.com/' as url", "'https://a.com/' as final_url", "cast(200 as int) as status", "'t' as title", "'text/html' as content_type", "'direct' as method",
        "false as truncated", "'body' as text", "array('w') as warnings", "timestamp'2024-02-01 23:59:59' + make_interval(0, 0, 0, 0, 0, 0, id) as fetched_at",
    )
    for _ in range(2):
        tables.write_pages(rows, str(tmp_path / "p"), "x")
    got = tables.read_runs(spark, str(tmp_path / "p"))
    assert {r.page_id: r.document for r in got.collect()} == {r.page_id: r.document for r in outputs.page_documents(rows).collect()}
    assert sorted(str(r.day) for r in got.select("day").distinct().collect()) == ["2024-02-01", "2024-02-02"]
    status = spark.createDataFrame([(0, "tavily", "ready")], "provider_order int, provider string, status string").selectExpr(
        "*", "true as configured", "false as is_aggregator", "false as is_scraper", "'tavily' as family", "'closed' as circuit_state", "1L as requests", "1L as successes", "0L as failures",
        "3 as last_result_count", "10L as average_latency_ms", "cast(null as string) as last_error", "cast(null as string) as last_error_category", "cast(null as timestamp) as last_success_at",
    )
    reuse = spark.createDataFrame([(1, 2, 3)], "entries bigint, hits bigint, misses bigint")
    for run in ("monday", "monday", "tuesday"):
        tables.write_status(status, reuse, 120, dt.date(2024, 2, 1), str(tmp_path / "st"), run)
    rows = tables.read_runs(spark, str(tmp_path / "st")).collect()
    assert sorted(r.run for r in rows) == ["monday", "tuesday"] and {r.document for r in rows} == {outputs.status_documents(status, reuse, 120).first().document}


BODIES = {
    "a.html": "<html>Grüße</html>".encode(), "b.htm": "<html>naïve</html>".encode("latin-1"), "c.pdf": b"%PDF-1.7", "d": b"<p>plain",
    "e.html": '<meta charset="windows-1251"><p>Привет'.encode("cp1251"), "f.txt": b"x" * 5000, "g.json": b"{}",
}
TEXTS = {"a.html": "<html>Grüße</html>", "b.htm": "<html>naïve</html>", "d": "<p>plain", "e.html": '<meta charset="windows-1251"><p>Привет', "g.json": "{}"}


@pytest.fixture
def folder(tmp_path):
    for name, body in BODIES.items():
        (tmp_path / "files").mkdir(exist_ok=True)
        (tmp_path / "files" / name).write_bytes(body)
    return str(tmp_path / "files")


def _decoded(rows):
    kept, _ = pages.admit_bodies(rows)
    return pages.decode_body(kept.filter("length < 4000")).select(F.substring_index("url", "/", -1).alias("name"), "html")


def test_pages_from_files(spark, folder):
    rows = read_pages(spark, folder, kind="binaryFile")
    assert {r.name: r.html for r in _decoded(rows).collect()} == TEXTS
    refused = pages.admit_bodies(rows)[1].collect()
    assert [(r.url.rsplit("/", 1)[1], r.refused) for r in refused] == [("c.pdf", "unsupported type application/pdf")]
    # sizes and times are compared before a file is opened
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = _plan(page_files(spark.read.format("binaryFile").load(folder), largest=4000, since=dt.datetime(2020, 1, 1)))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PushedFilters" in plan and "LessThanOrEqual(length,4000)" in plan and "GreaterThanOrEqual(modificationTime" in plan
    assert page_files(spark.read.format("binaryFile").load(folder), since=dt.datetime(2100, 1, 1)).count() == 0


def test_pages_from_a_stream_of_files(spark, folder, tmp_path):
    from serploom.streaming import live

    rows = read_pages(spark, folder, kind="binaryFile", stream=True, maxFilesPerTrigger=2)
    written = live.run_through(_decoded(rows), "pages")
    assert {r.name: r.html for r in written.collect()} == TEXTS


def test_pages_from_a_table_stream(spark, tmp_path):
    from serploom.streaming import live

    table = spark.createDataFrame([(i, f"https://a.com/{i}", "<p>x") for i in range(5)], "page_id bigint, url string, html string")
    table.repartition(3).write.parquet(str(tmp_path / "pages"))
    got = live.run_through(read_pages(spark, str(tmp_path / "pages"), stream=True, maxFilesPerTrigger=1), "table")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in table.collect())
