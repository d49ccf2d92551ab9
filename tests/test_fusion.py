import random

import pytest
from pyspark.sql import functions as F

from serploom import dims
from serploom.functions.urls import with_canonical_url
from serploom.operators import fusion
from serploom.operators.results import dedupe_in_response, drop_invalid, filter_domains_at_scale
from serploom.plans import fusion_queries

SCHEMA = "query_id bigint, provider string, provider_rank int, title string, url string, snippet string, upstream_engines array<string>"


def lists(spark, rows, partitions=None):
    df = spark.createDataFrame([(1, *r, *[None] * (6 - len(r))) for r in rows], SCHEMA)
    if partitions:
        df = df.repartition(partitions)
    return with_canonical_url(df, "url", host_out="host")


def fused(df, **kw):
    return fusion.fuse(df, **kw).orderBy("query_id", "rank").collect()


def test_merges_sources_and_ranks(spark):
    rows = fused(lists(spark, [
        ("tavily", 1, "A", "https://a.com/1"), ("tavily", 2, "B", "https://b.com/1"), ("brave", 1, "B longer", "https://B.com/1/"),
    ]))
    assert [(r.canonical_url, r.sources, r.best_rank, r.title) for r in rows] == [
        ("https://b.com/1", ["brave", "tavily"], 1, "B longer"), ("https://a.com/1", ["tavily"], 1, "A")
    ]
    assert rows[0].corroborated and not rows[1].corroborated
    assert rows[0].score == pytest.approx(1 / 61 + 1 / 62)


def test_resold_index_is_no_corroboration(spark):
    rows = fused(lists(spark, [
        ("brave", 1, "A", "https://a.com/"), ("searxng", 1, "A", "https://a.com/", None, ["brave"]), ("searxng", 2, "C", "https://c.com/", None, ["google"]),
    ]))
    by_url = {r.canonical_url: r for r in rows}
    assert not by_url["https://a.com/"].corroborated
    assert by_url["https://a.com/"].score == pytest.approx(1 / 61 + 0.7 / 61)
    assert by_url["https://c.com/"].score == pytest.approx(1 / 62)


def test_empty_engine_list_is_not_missing(spark):
    responses = spark.createDataFrame([(1, "brave", None), (1, "searxng", ["brave"])], "query_id bigint, provider string, upstream_engines array<string>")
    base = [("brave", 1, "A", "https://a.com/")]
    silent = fusion.fuse(lists(spark, base + [("searxng", 1, "A", "https://a.com/", None, None)]), responses).first()
    named = fusion.fuse(lists(spark, base + [("searxng", 1, "A", "https://a.com/", None, [])]), responses).first()
    assert silent.score == pytest.approx(1.7 / 61) and named.score == pytest.approx(2 / 61)
    assert silent.corroborated and named.corroborated


def test_host_cap_and_backfill_free(spark):
    rows = [("tavily", i, f"t{i}", f"https://same.com/{i}") for i in range(1, 6)] + [("tavily", 6, "x", "https://other.com/x")]
    assert [r.host for r in fused(lists(spark, rows), limit=8, per_host=2)] == ["same.com", "same.com", "other.com"]
    assert len(fused(lists(spark, rows), limit=4, per_host=0)) == 4


def test_richest_snippet_and_one_vote(spark):
    rows = fused(lists(spark, [
        ("tavily", 1, "", "https://a.com/", "short"), ("brave", 2, "Title", "https://a.com/", "a longer snippet"),
        ("tavily", 3, "again", "https://a.com/?utm_source=1", "the longest snippet of all, but a worse repeat"),
    ]))
    assert len(rows) == 1 and rows[0].snippet == "a longer snippet" and rows[0].title == "Title" and rows[0].sources == ["tavily", "brave"]


def reference_fuse(rows, limit, cap):
    """Plain restatement for one query: best rank per (provider, url), reciprocal ranks, greedy host cap."""
    best = {}
    for provider, rank, _, url in rows:
        key = (provider, url)
        best[key] = min(best.get(key, 10**9), rank)
    score, first, families = {}, {}, {}
    for (provider, url), rank in best.items():
        score[url] = score.get(url, 0) + 1 / (60 + rank)
        first[url] = min(first.get(url, 10**9), rank)
        families.setdefault(url, set()).add(provider)
    order = sorted(score, key=lambda u: (-round(score[u], 12), not len(families[u]) >= 2, first[u], u))
    taken, used = [], {}
    for u in order:
        host = u.split("/")[2]
        if used.get(host, 0) < cap and len(taken) < limit:
            used[host] = used.get(host, 0) + 1
            taken.append(u)
    return taken


@pytest.mark.parametrize("seed", [1, 2])
def test_random_lists_hot_query_any_partitioning(spark, seed):
    rng = random.Random(seed)
    rows = [(p, rng.randint(1, 20), "t", f"https://h{rng.randint(0, 6)}.com/{rng.randint(0, 30)}") for p in ("tavily", "brave", "mojeek") for _ in range(400)]
    want = reference_fuse(rows, 8, 2)
    for partitions in (1, 7):
        got = fused(lists(spark, rows, partitions), limit=8, per_host=2)
        assert [r.canonical_url for r in got] == want


def test_silver_rows(spark):
    raw = spark.createDataFrame(
        [(1, "tavily", 1, "", "//a.com/x?utm_id=1", "<b>s</b>"), (1, "tavily", 2, "dup", "https://A.com/x", None), (1, "tavily", 3, "t", "mailto:x", None)],
        "query_id bigint, provider string, provider_rank int, title string, url string, snippet string",
    )
    rows = dedupe_in_response(drop_invalid(raw)).collect()
    assert [(r.provider_rank, r.title, r.canonical_url, r.snippet) for r in rows] == [(1, "a.com", "https://a.com/x", "s")]


def test_domain_join_equals_row_rule(spark):
    from serploom.functions.urls import domain_filter

    hosts_ = spark.createDataFrame([(q, h) for q in range(3) for h in ("a.com", "x.a.com", "nota.com", "b.org", "c.b.org")], "query_id int, host string")
    rules = spark.createDataFrame([(0, "include", "*.a.com"), (1, "exclude", "b.org"), (1, "include", "a.com"), (1, "include", "b.org")], "query_id int, kind string, domain string")
    got = {tuple(r) for r in filter_domains_at_scale(hosts_, rules).collect()}
    sets = {0: (["*.a.com"], []), 1: (["a.com", "b.org"], ["b.org"]), 2: ([], [])}
    want = set()
    for q, (inc, exc) in sets.items():
        arrays = [F.array(*[F.lit(d) for d in ds]).cast("array<string>") for ds in (inc, exc)]
        want |= {tuple(r) for r in hosts_.filter(F.col("query_id") == q).filter(domain_filter(F.col("host"), *arrays)).collect()}
    assert got == want


def test_window_limits_reach_below_the_shuffle(spark):
    df = lists(spark, [("tavily", 1, "A", "https://a.com/1")])
    plan = fusion.rank_clusters(fusion.scored_clusters(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4 and "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


def test_ranking_moves_numbers_only(spark):
    """No text is reduced, sorted or shuffled before the ranked URLs are known."""
    df = lists(spark, [("tavily", 1, "A", "https://a.com/1", "long text", ["brave"]), ("searxng", 1, "A", "https://a.com/1", "long text", ["brave"])])
    plan = fusion.rank_clusters(fusion.scored_clusters(df))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert "snippet" not in plan.split("Scan")[0] and "title" not in plan.split("Scan")[0]


def test_families_in_an_offer(spark):
    """The first of an aggregator's engines whose own index answered decides, by row, else by response."""
    responses = spark.createDataFrame([(1, "mojeek", None), (1, "tavily", None), (1, "searxng", ["x", "Brave", "mojeek.com"])], "query_id bigint, provider string, upstream_engines array<string>")
    rows = [
        ("searxng", 1, "A", "https://a.com/", None, ["bing", "brave", "Tavily API", "mojeek"]), ("searxng", 2, "B", "https://b.com/", None, ["brave", "google"]),
        ("searxng", 3, "C", "https://c.com/", None, None), ("searxng", 4, "D", "https://d.com/", None, []),
    ]
    got = {r.canonical_url: (r.families, r.score) for r in fusion.fusion_diagnostics(lists(spark, rows), responses).collect()}
    assert got == {
        "https://a.com/": (["tavily"], round(0.7 / 61, 12)), "https://b.com/": (["meta"], round(1 / 62, 12)),
        "https://c.com/": (["meta"], round(0.7 / 63, 12)), "https://d.com/": (["meta"], round(1 / 64, 12)),
    }


def test_ranks_alone_travel_as_numbers(spark):
    """Best ranks need no text: one row of numbers per (query, URL), the same votes as with texts."""
    rows = [
        (1, "brave", 3, "https://a.com/"), (1, "brave", -2, "https://a.com/"), (1, "tavily", None, "https://a.com/"), (1, "other", 4, "https://a.com/"),
        (1, "other", 2, "https://a.com/"), (1, "more", 9, "https://a.com/"), (1, None, 5, "https://a.com/"), (None, "exa", 7, None), (2, "exa", 7, "https://b.com/"),
        (2, "exa", 7, "https://b.com/"),
    ]
    df = spark.createDataFrame(rows, "query_id bigint, provider string, provider_rank int, canonical_url string")
    df = df.withColumns({"url": F.col("canonical_url"), "title": F.lit("T"), "snippet": F.lit("long text"), "host": F.lit("h"), "result_limit": F.col("provider_rank") + 1})
    columns = ["query_id", "canonical_url", "provider", "rank", "result_limit"]
    bare = fusion.best_rank_votes(df, texts=False)
    want, got = fusion.best_rank_votes(df).select(*columns), bare.select(*columns)
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.count() == 7
    plan = bare._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Sort [" not in plan and "_text" not in plan


def _few_lines(spark, folder):
    lines = [(1, 7, 1, 3.0, "N", "2024-01-02"), (1, 7, 2, 5.0, "R", "2024-01-03"), (2, 8, 1, 3.0, "R", "2024-01-02")]
    spark.createDataFrame(lines, "l_suppkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate string").withColumn(
        "l_shipdate", F.to_timestamp("l_shipdate")
    ).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(7, "blue tin", "SMALL TIN", 4), (8, "red box", "LARGE BOX", 9)], "p_partkey bigint, p_name string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_best_ranks_shuffles_no_texts(spark, tmp_path):
    votes = fusion_queries.best_ranks(spark, _few_lines(spark, tmp_path))
    plan = votes._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "l_returnflag" not in plan and "p_name" not in plan
    got = {(r.query_id, r.provider): r["rank"] for r in votes.collect()}
    assert got == {(1, "tavily"): 1, (1, "brave"): 11, (1, "searxng"): 4, (2, "tavily"): 1, (2, "brave"): 19, (2, "searxng"): 4}


def test_first_rows_without_texts(spark, tmp_path):
    """Whoever shows no texts may leave them out: the same first rows, and none of the texts is shuffled."""
    rows = [(1, "brave", 2, "u2", "c", "B", None), (1, "brave", 2, "u1", "c", "Z", "s"), (1, "brave", 2, "u1", "c", None, "t"), (1, "exa", 9, "u9", "c", "T", "s"),
            (None, "exa", None, None, "c", "T", "s"), (None, "exa", 1, "u", "c", "T", "s")]
    df = spark.createDataFrame(rows, "query_id bigint, provider string, provider_rank int, url string, canonical_url string, title string, snippet string")
    shown = ["query_id", "provider", "canonical_url", "provider_rank", "url"]
    want = dedupe_in_response(df).select(*shown).collect()
    assert sorted(map(str, dedupe_in_response(df.select(*shown)).collect())) == sorted(map(str, want)) and len(want) == 3
    plan = fusion_queries.deduped_results(spark, _few_lines(spark, tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "p_name" not in plan and "l_returnflag" not in plan


def test_rules_for_other_hosts_are_not_grouped(spark):
    """Rules meet the suffixes of a query's hosts before they are grouped; repeated, blank and foreign ones change nothing."""
    hosts_ = spark.createDataFrame([(0, "a.com"), (0, "x.a.com"), (0, "b.org"), (1, "a.com"), (2, "b.org"), (None, "a.com")], "query_id int, host string")
    rules = [(0, "exclude", "X.a.com."), (0, "exclude", "x.a.com"), (0, "exclude", ""), (0, "exclude", None), (1, "include", "nowhere.net"), (None, "exclude", "a.com")]
    rules += [(q, "exclude", f"*.part-{i}.example") for q in range(3) for i in range(50)]
    kept = filter_domains_at_scale(hosts_, spark.createDataFrame(rules, "query_id int, kind string, domain string"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, [r for r in hosts_.collect() if (r.query_id, r.host) not in ((0, "x.a.com"), (1, "a.com"))]))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    grouped = plan[plan.index("Aggregate [query_id"):]
    assert "LeftSemi" in grouped and "max((kind" in grouped.split("LeftSemi")[0]


def _spelled(spark, n=40):
    """Raw rows with the canonical form as an expression over them, some of them without a URL or a query."""
    rows = [(q if q else None, p, 1 + (i * 7 + q) % 9, f"T{i}", f"https://H{i % 5}.com:443/p/{i}?utm_source=x" if i % 11 else None, "s", ["brave"])
            for q in range(3) for i in range(n) for p in ("tavily", "brave", "searxng")]
    df = spark.createDataFrame(rows, "query_id long, provider string, provider_rank int, title string, url string, snippet string, upstream_engines array<string>")
    return with_canonical_url(df, "url", host_out="host")


def test_no_filter_spells_the_canonical_form_again(spark):
    rows = _spelled(spark)
    fused = fusion.fuse(rows)
    plan = fused._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.split("\n") if "Filter" in line]
    assert filters and not any("regexp_replace" in line or "substring_index" in line for line in filters)
    # a row without a URL or a query meets nothing, and the columns keep their order
    assert fused.filter("query_id is null or canonical_url is null").isEmpty()
    assert fused.columns[:3] == ["query_id", "canonical_url", "host"]
    ranked = fusion.rank_clusters(fusion.scored_clusters(rows)).filter("query_id is not null and canonical_url is not null")
    shown = lambda df: sorted(map(tuple, df.select("query_id", "rank", "canonical_url").collect()))
    assert shown(fused) == shown(ranked) and fused.count() > 0


def test_the_scored_stage_is_small_enough_to_be_compiled(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = fusion.rank_clusters(fusion.scored_clusters(_spelled(spark)))._jdf.queryExecution().executedPlan()
        debug = getattr(getattr(spark._jvm, "org.apache.spark.sql.execution.debug.package$"), "MODULE$")
        stages = debug.codegenStringSeq(plan)
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.length())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(sizes) < 8000  # the JVM interprets larger methods


def test_resold_lookup_is_the_first_owned_family_of_an_offer(spark):
    bits = [1 << fusion._FAMILIES.index(f) for f in dims.INDEPENDENT_FAMILIES]
    cases = [(o, w) for o in [*range(64), 255, None] for w in range(1 << len(fusion._FAMILIES))]
    df = spark.createDataFrame(cases, "offer int, owned int")
    got = df.select("offer", "owned", F.coalesce(fusion._resold(F.col("offer"), fusion._independent(F.col("owned"))), F.lit(0)).alias("x")).collect()
    for r in got:
        named = [] if r.offer in (None, 255) else [d for d in (r.offer & 3, r.offer >> 2 & 3, r.offer >> 4) if d]
        assert r.x == next((bits[d - 1] for d in named if bits[d - 1] & r.owned), 0)


def test_the_host_of_a_silver_row_is_not_shuffled(spark):
    from serploom.functions.urls import canonical_host
    from serploom.operators.results import silver_results

    odd = ["https://User:pw@A.example.com:8443/x?y=1", "HTTP://b.com.:80?q=1", "https://[::1]:443/p", "https://c.com:", "//d.com/a/?utm_source=x#f", "e.com/%7e/?", "https://A.example.com", "ftp://f.com/x"]
    raw = spark.createDataFrame([(i % 3, "brave", i, u, "t", "s") for i, u in enumerate(odd)], "query_id long, provider string, provider_rank int, url string, title string, snippet string")
    silver = silver_results(raw)
    plan = silver._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange", 1)[1]
    assert "AS host#" in plan and "AS host#" not in below
    spelled = with_canonical_url(raw, "url", host_out="host").filter("host is not null")
    assert spelled.filter(~canonical_host(F.col("canonical_url")).eqNullSafe(F.col("host"))).isEmpty() and spelled.count() >= 4
    hosts_ = {r.host for r in silver.collect()}
    assert {"a.example.com", "b.com", "[::1]", "c.com", "d.com", "e.com"} >= hosts_ and len(hosts_) >= 5
