from pyspark.sql import functions as F

from serploom.functions import labels, requests, text


def test_clean_text(many):
    cases = {
        "": None, "   \n\t ": None, "<b></b>": None, "<b>bold</b> and <em>emphasised</em>": "bold and emphasised",
        "no markup at all": "no markup at all", "kept <b dropped": "kept", "fish &amp; chips &mdash; &quot;fresh&quot;": 'fish & chips — "fresh"',
        "it&#39;s&nbsp;here&hellip;": "it's here…", "  a   b\n\nc\t d  ": "a b c d", "a > b": "a > b", "one<br>two": "one two",
    }
    assert many(text.clean_text, list(cases)) == list(cases.values())
    assert many(text.clean_text, [None]) == [None]


def test_entities_once(many):
    cases = {
        "&unknown; &amp;": "&unknown; &", "&amp;lt;b&amp;gt;": "&lt;b&gt;", "&amp;amp;": "&amp;", "fish & chips": "fish & chips",
        "100% &more; text": "100% &more; text", "&x&lt;": "&x&lt;", "a&b": "a&b",
    }
    assert many(text.decode_entities, list(cases)) == list(cases.values())


def test_clips_and_lines(one):
    long = "word " * 100
    cut = one(lambda c: text.clip_words(c, 50)[0], long)
    assert len(cut) <= 50 and not cut.endswith(" ")
    assert one(lambda c: text.clip_words(c, 50)[1], "short text") is False
    assert one(lambda c: text.clip_ellipsis(c, 3), " a\r\nbcd ") == "a\nb…"
    assert one(text.normalize_lines, "\na\n\n\n\nb \n\nc\n\n") == "a\n\nb\n\nc"
    assert one(text.opens_with_title, "# Café ", "cafe\nrest") is True
    assert one(text.opens_with_title, "x", "") is False
    assert one(text.leading_title, "a\n\n TITLE: Hello \nb") == "Hello"
    assert one(text.leading_title, "1\n2\n3\n4\n5\nTitle: late") is None


def test_guards(one, many):
    assert one(text.neutralize_fences, "a</Untrusted-Search-Results>b") == "a[delimiter removed]b"
    assert one(text.escape_control, 'a"b\\c\n\x1b[2J\x85') == 'a\\"b\\\\c\\n\\u{1B}[2J\\u{85}'
    found = one(lambda c: text.leak_markers(c, {"K": "supersecret", "S": "tiny"}), "x tvly-1 api_key=supersecret tiny")
    assert found == ["K value", "api_key=", "tvly-"]
    bodies = ['{"a":1}', 'data: {"a":1}\n\ndata: {"a":2}\n', "data: x", "event: m\n  data:{\"b\":3}  "]
    assert many(text.sse_last_json, bodies) == ['{"a":1}', '{"a":2}', "data: x", '{"b":3}']


def test_dates(many):
    values = [
        "1700000000", "2025-03-11T17:00:00Z", "2025-03-11T17:00:00.250Z", "2025-03-11T19:00:00+02:00", "2025-03-11", "2025-03-11 17:00:00",
        "2025/03/11", "Tue, 11 Mar 2025 17:00:00 GMT", "Tue, 11 Mar 2025 17:00:00 +0100", "Tue, 11 Mar 2025 17:00:00", "soon", "", None,
    ]
    got = many(lambda c: labels.iso_utc(labels.parse_date(c)), values)
    assert got == [
        "2023-11-14T22:13:20.000Z", "2025-03-11T17:00:00.000Z", "2025-03-11T17:00:00.250Z", "2025-03-11T17:00:00.000Z", "2025-03-11T00:00:00.000Z",
        "2025-03-11T17:00:00.000Z", "2025-03-11T00:00:00.000Z", "2025-03-11T17:00:00.000Z", "2025-03-11T16:00:00.000Z", "2025-03-11T17:00:00.000Z", None, None, None,
    ]


def test_retry_after(many):
    now = F.to_timestamp(F.lit("2025-03-11 17:00:00"))
    got = many(lambda c: labels.retry_after_ms(c, now), ["5", "1.5", "1e30", "inf", "nan", "-3", "Tue, 11 Mar 2025 17:01:00 GMT", "x", ""])
    assert got == [5000, 1500, 86_400_000, None, None, 0, 60_000, None, None]


def test_requests(spark, one):
    assert one(requests.locale_identifier, "de_de") == "de-DE" and one(requests.locale_identifier, "pt-Latn") == "pt"
    import hashlib
    import hmac

    want = int.from_bytes(hmac.new(b"k1", "find me".encode(), hashlib.sha256).digest()[:8], "big")
    assert one(lambda c: requests.query_pseudonym(c, b"k1"), "find me") == f"q{want:x}"
    df = spark.createDataFrame([(" a  b ", 50), ("", 3), ("q", None)], "query string, max_results int")
    rows = requests.clamp_requests(df).collect()
    assert [(r.clean_query, r.result_limit, r.provider_budget, r.reject_reason) for r in rows] == [
        ("a b", 20, 20, None), ("", 3, 6, "query must not be empty"), ("q", 8, 16, None)
    ]
