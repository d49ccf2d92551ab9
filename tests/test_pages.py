from serploom.operators import pages


def test_furniture_words(many):
    cases = {"nav": True, "navy": False, "site-header x": True, "top_nav": True, "left-sidebar": True, "innovate": False, "sharep": False, "my-ads": True, "": False}
    assert many(pages.is_furniture, list(cases)) == list(cases.values())


def test_decode(spark):
    rows = [
        (1, "Привет".encode("windows-1251"), "text/html; charset=windows-1251"), (2, "é".encode(), None), (3, "é".encode("latin-1"), "text/html"),
        (4, b'<meta charset="windows-1251">' + "мир".encode("windows-1251"), "text/html"), (5, b"\xff\xfe", "text/html; charset=nonsense"), (6, b"caf\xe9", "text/html; charset=ISO-8859-1"),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, body binary, content_type string")
    got = {r.page_id: r.html for r in pages.decode_body(df).collect()}
    assert got == {1: "Привет", 2: "é", 3: "é", 4: '<meta charset="windows-1251">мир', 5: "ÿþ", 6: "café"}


def test_thin_and_clipped(spark):
    df = spark.createDataFrame([(1, ""), (2, "short"), (3, "word " * 200)], "page_id bigint, text string")
    got = {r.page_id: (r.verdict, r.truncated) for r in pages.finish_pages(df, 600).collect()}
    assert got == {1: ("failed", False), 2: ("thin", False), 3: ("useful", True)}


def test_titles(many):
    cases = {"<head><title lang=x>Tea &amp; milk</title>": "Tea & milk", "<p>none": None, "<title></title>": None, None: None}
    assert many(pages.page_title, list(cases)) == list(cases.values())


def test_challenges_need_empty_link_rows(spark):
    rows = spark.createDataFrame([(1, "<p>Unusual traffic</p>"), (2, "captcha"), (3, "tea")], "page_id bigint, html string")
    links = spark.createDataFrame([(2,)], "page_id bigint")
    assert [r.page_id for r in pages.challenge_pages(rows, links).collect()] == [1]
