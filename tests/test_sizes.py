"""What travels and what stays on disk, on rows made here."""

from pyspark.sql import functions as F

from serploom.functions.urls import with_canonical_url
from serploom.operators import fusion


def _rows(spark, urls, queries=2):
    """Every URL of every query, reported by two sources; the second repeats it at a worse rank."""
    rows = spark.range(urls * queries).selectExpr(
        f"id % {queries} as query_id", "explode(array('tavily', 'brave')) as provider", f"cast(id div {queries} + 1 as int) as rank", "concat('https://h', id, '.com/', id) as url"
    )
    rows = rows.selectExpr("*", "explode(array(0, 1)) as again").selectExpr(
        "query_id", "provider", "rank + 5000 * again as provider_rank", "concat(provider, rank, '-', again) as title", "url",
        "if(again = 1, repeat('long ', 5), 'short') as snippet", "timestamp '2024-01-01 00:00:00' as published_at",
    )
    return with_canonical_url(rows, "url", host_out="host")


def _travelled(df):
    """Rows written to each shuffle of a plan that has run."""

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        found = [node.metrics().apply("shuffleRecordsWritten").value()] if kind == "ShuffleExchangeExec" else []
        children = node.children()
        return found + [x for i in range(children.size()) for x in walk(children.apply(i))]

    return walk(df._jdf.queryExecution().executedPlan())


def test_texts_of_urls_that_are_not_ranked_do_not_travel(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")  # as if the ranked rows were many
    try:
        fused = fusion.fuse(_rows(spark, 3000), limit=3)
        got = sorted((r.query_id, r["rank"], r.title, r.snippet) for r in fused.collect())
        assert got == [(q, n, f"tavily{n}-0", "short") for q in (0, 1) for n in (1, 2, 3)]
        assert max(_travelled(fused)) < 2000  # of 24 000 rows
    finally:
        spark.conf.set(name, before)


def test_marks_keep_every_wanted_row(spark):
    rows = spark.range(20000).select(F.xxhash64("id").alias("_number"), "id")
    wanted = rows.filter("id % 10 = 0").select("_number")
    kept = {r.id for r in fusion._marked(rows, wanted).collect()}
    assert kept >= set(range(0, 20000, 10)) and len(kept) < 3000


def test_a_host_that_its_url_does_not_spell_stays(spark):
    rows = spark.createDataFrame(
        [(1, "tavily", 1, "a", "u1", "https://a.com/1", "b.org"), (1, "tavily", 2, "b", "u2", "http://a.com/2", "a.com"),
         (1, "brave", 1, "c", "u3", "mailto:x", None), (1, "brave", 2, "d", "u4", "https://c.com/4", "c.com")],
        "query_id bigint, provider string, provider_rank int, title string, url string, canonical_url string, host string",
    )
    got = {r.canonical_url: r.host for r in fusion.scored_clusters(rows).collect()}
    assert got == {"https://a.com/1": "b.org", "http://a.com/2": "a.com", "mailto:x": None, "https://c.com/4": "c.com"}


def test_one_pass_fuses_as_two_do(spark):
    rows = _rows(spark, 40).withColumn("upstream_engines", F.when(F.col("provider") == "searxng", F.array(F.lit("brave"))))
    again = rows.filter("provider = 'tavily'").withColumns({"provider": F.lit("searxng"), "upstream_engines": F.array(F.lit("google")), "snippet": F.lit(None).cast("string")})
    rows = rows.unionByName(again).unionByName(rows.limit(1).withColumn("canonical_url", F.lit(None).cast("string")))
    one, two = fusion.fuse_by_query(rows, limit=5), fusion.fuse(rows, limit=5)
    assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def _tables(spark, folder, lines, parts, suppliers):
    """Small lineitem, part and supplier tables; every third line belongs to the next order."""
    spark.range(lines).selectExpr(
        "id div 3 as l_orderkey", f"id % {parts} as l_partkey", f"id % {suppliers} as l_suppkey", "cast(id % 3 as int) as l_linenumber",
        "id * 1.5d as l_extendedprice", "id * 1d as l_quantity", "'N' as l_returnflag", "timestamp '2024-01-01 00:00:00' as l_shipdate",
    ).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(parts).selectExpr("id as p_partkey", "concat('part ', id) as p_name", "'BIG' as p_type", "cast(id % 50 as int) as p_size").write.parquet(f"{folder}/part.parquet")
    spark.range(suppliers).selectExpr("id as s_suppkey").write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def test_payloads_that_lie_by_query_are_fused_where_they_are(spark, tmp_path):
    from serploom.plans.composed_queries import payload_fusion

    fused = payload_fusion(spark, _tables(spark, tmp_path, 60, 7, 5))
    assert len(fused.collect()) > 20 and max(_travelled(fused)) <= 60


def test_a_parse_is_not_copied_into_a_filter(spark):
    from serploom.sources.payloads import read_payloads, response_rows

    rows = spark.createDataFrame([(1, "exa", 200, '{"results": []}'), (2, "exa", 200, "[]"), (3, "exa", 500, "")], "query_id bigint, provider string, status_code int, body string")
    answered = response_rows(read_payloads(rows)).filter("outcome = 'ok'").select("query_id", "upstream_engines")
    assert [r.query_id for r in answered.collect()] == [1]
    plan = answered._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in "".join(x for x in plan.split("\n") if "Filter" in x)


def test_a_base_is_made_some_buckets_at_a_time(spark, tmp_path, monkeypatch):
    from serploom.streaming import store as module

    monkeypatch.setattr(module, "SLICE", 4000)
    merged = []

    def merge(rows):
        merged.append(rows)
        return rows.groupBy("k").agg(F.max("v").alias("v"))

    rows = spark.range(800).selectExpr("id as k", "id as v")
    store = module.KeyedStore(spark, str(tmp_path / "s"), ["k"], rows.schema, merge, buckets=8, compact=2)
    store.add(rows, 0)
    store.add(rows.selectExpr("k", "v + 1 as v"), 1)
    assert len(merged) > 1 and store._committed("batch=1-merged")
    want = [(k, k + 1) for k in range(800)]
    assert sorted(map(tuple, store._read(["batch=1-merged"]).select("k", "v").collect())) == want == sorted(map(tuple, store.current().collect()))
    store._merge(1)  # replayed: the base is made anew
    assert store._read(["batch=1-merged"]).count() == 800
    parts = [store.rows(1, touched=rows.filter("k < 30"), compacted=-1, part=(n, 3)) for n in range(3)]
    assert sorted(tuple(r) for p in parts for r in p.collect()) == want[:30] and all(p.count() < 30 for p in parts)


def _outputs_travel_little(spark, folder, query):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        # 4000 URLs in two queries make 12 000 rows; lineitem meets part by its key
        out = query(spark, _tables(spark, folder, 4000, 4000, 2))
        assert out.count() == 2
        out.collect()
        assert max(_travelled(out)) <= 4000
    finally:
        spark.conf.set(name, before)


def test_search_cards_do_not_move_every_text(spark, tmp_path):
    from serploom.plans.output_queries import search_cards

    _outputs_travel_little(spark, tmp_path, search_cards)


def test_search_documents_do_not_move_every_text(spark, tmp_path):
    from serploom.plans.output_queries import search_documents

    _outputs_travel_little(spark, tmp_path, search_documents)


def test_live_fusion_by_slices_is_the_batch_form(spark, tmp_path, monkeypatch):
    from serploom.streaming import live
    from serploom.streaming import store as module

    monkeypatch.setattr(module, "SLICE", 8000)
    every = _rows(spark, 20, queries=6)
    folder = str(tmp_path / "in")
    for again in (0, 1):
        every.filter(f"provider_rank {'>' if again else '<'} 5000").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    live.fuse_batches(stream, str(tmp_path / "out"), str(tmp_path / "progress"), buckets=4, compact=8).awaitTermination()
    assert module.KeyedStore(spark, f"{tmp_path}/out/votes", ["query_id"], buckets=4, compact=8).slices_of(1) > 1
    shown = lambda df: sorted((r.query_id, r["rank"], r.canonical_url, r.title, r.snippet) for r in df.collect())
    assert shown(live.fused_so_far(spark, str(tmp_path / "out"), buckets=4, compact=8)) == shown(fusion.fuse(every))
