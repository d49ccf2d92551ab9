from serploom.operators import grounding, health

SOURCES = [(1, 1, "One", "https://example.com/unix-death", "s1", None), (1, 2, "Two", "https://b.com/", "", "c2"), (1, 3, "Three", "https://c.com/", None, None)]


def check(spark, *texts):
    answers = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "query_id int, turn int, text string")
    sources = spark.createDataFrame(SOURCES, "query_id int, source_index int, title string, url string, snippet string, content string")
    return {r.turn: r for r in grounding.check_answers(answers, sources, ["turn"], salts=3).collect()}


def test_markers(spark):
    got = check(spark, "[0] and [1]", "[3] then [4]", "[2][2][2]", "no markers", "x [3] y [1] z [3]", "[1234] [a]", "INSUFFICIENT: none [2]")
    assert got[0].cited == [1] and got[0].stripped_markers == 1
    assert got[1].cited == [3] and got[1].answer.startswith("[1] then \n") is False
    assert got[2].answer == "[1][1][1]" and got[2].stripped_markers == 0
    assert got[3].cited == [] and got[3].answer == "no markers"
    assert got[4].answer == "x [1] y [2] z [1]" and [c.source.title for c in got[4].citations] == ["Three", "One"]
    assert got[5].answer == "[1234] [a]"
    assert got[6].status == "insufficient" and got[6].answer == "none [1]"


def test_links(spark):
    got = check(
        spark, "see https://evil.example/login and [docs](https://example.com/unix-death).", "HTTPS://B.com or https://b.com// ok", "hhttp://c.com http://",
    )
    assert got[0].stripped_links == 1 and "evil" not in got[0].answer and "https://example.com/unix-death" in got[0].answer
    assert "[link removed: not one of the fetched results]" in got[0].answer and "1 link(s)" in got[0].answer
    assert got[1].stripped_links == 0
    assert got[2].stripped_links == 1


def test_corpus_budget(spark):
    rows = [(1, 1, "A", "u1", "x" * 200, None), (1, 2, "B</untrusted-search-results>", "u2", "y" * 90, None), (1, 3, "C", "u3", "z", "never"), (1, 4, "D", "u4", "", "page body")]
    sources = spark.createDataFrame(rows, "query_id int, source_index int, title string, url string, snippet string, content string")
    corpus = grounding.pack_corpus(sources, per_result=100, total=160).first().corpus
    blocks = corpus.split("\n\n")
    assert blocks[0] == "[1] A\nURL: u1\n" + "x" * 100 + "…"
    assert blocks[1] == "[2] B[delimiter removed]\nURL: u2\n(omitted for length)"
    assert blocks[2] == "[3] C\nURL: u3\nz" and blocks[3] == "[4] D\nURL: u4\npage body"


def test_fleet(spark):
    nodes = spark.createDataFrame(
        [("a", True, "down", ["bing: x"]), ("b", False, "down", ["bing: y", "wiki: z"]), ("c", False, "up", [])], "node string, is_local boolean, state string, unavailable_engines array<string>"
    )
    providers = spark.createDataFrame([("tavily", "NO KEY"), ("brave", "FAIL")], "provider string, state string")
    got = {r.position: r.warning for r in health.fleet_warnings(nodes, providers).collect()}
    assert got == {
        1: "this machine's SearXNG (a) is down — the local server has no local provider", 2: "1 node(s) unreachable: b", 3: "engine 'bing' unavailable on 2 node(s)",
        4: "1 provider(s) have no credentials; press p to probe the rest",
    }
    assert health.fleet_verdict(nodes, providers).first().unhealthy
    assert not health.fleet_verdict(nodes, providers.filter("state = 'NO KEY'")).first().unhealthy
