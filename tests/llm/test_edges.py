"""Nulls, empty tables, very long texts, repeated rows and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from serploom.llm import chat, decontam, licenses, lm_scores, mixing, neardup, quality, queries, secret_scan, token_counts, wrappers

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, quality string, `row` int, size int, words int, id int"
LONG = "the of and lorem ipsum " * 30_000


def _rows():
    texts = [None, "", " \n\t", "###", "one two", LONG, "the cat sat on the mat", "the cat sat on the mat", None, "İK ſtraße ‑ ▁▁ 💥 \x00 end"]
    rows = [(k, t, "en", "s", 1, "q", 1, 2, 3, 4) for k, t in enumerate(texts)]
    return [*rows, rows[6], (None, "no id here", None, None, None, None, None, None, None, None), (None,) * 10, (None,) * 10]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "the cat sat"), (2, None), (None, "one two"), (3, "")], "item_id bigint, text string")


def _vocabulary():
    return [("<unk>", 0.0), ("▁the", -1.0), ("▁", -2.0), ("t", -3.0), ("h", -3.0), ("e", -3.0), ("a", -3.0)]


def _operators(bench):
    return {
        "licenses": lambda d: licenses.with_licenses(d),
        "mix": lambda d: mixing.mix(d),
        "mixed_documents": lambda d: mixing.mixed_documents(d),
        "secrets": lambda d: d.withColumn("s", secret_scan.secret_spans(F.col("text"))),
        "mask": lambda d: secret_scan.mask_secrets(d),
        "lm": lambda d: lm_scores.with_lm_scores(d, d.select("doc_id").filter("doc_id < 5")),
        "contamination": lambda d: decontam.with_contamination(d, bench),
        "quality": lambda d: quality.with_quality(d, out="verdict"),
        "tokens": lambda d: token_counts.with_token_counts(d, _vocabulary()),
        "classes": lambda d: neardup.classes(d),
    }


NAMES = ["licenses", "mix", "mixed_documents", "secrets", "mask", "lm", "contamination", "quality", "tokens", "classes"]
WHOLE = set(NAMES) - {"mixed_documents"}


@pytest.mark.parametrize("name", NAMES)
def test_every_row_has_a_result(name, docs, bench):
    rows = _operators(bench)[name](docs).collect()
    if name in WHOLE:
        assert len(rows) == len(_rows())


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(name, docs, bench):
    assert _operators(bench)[name](docs.limit(0)).collect() == []


def test_extra_columns_stay(docs, bench):
    for name in ("licenses", "mask", "lm", "contamination", "quality", "tokens"):
        out = _operators(bench)[name](docs)
        assert set(docs.columns) <= set(out.columns), name
        assert out.select("quality", "row", "size", "words", "id").distinct().count() == 2, name


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_pipeline_stage_edges(stage, spark, docs, bench, tmp_path):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    name, function = stage
    for table in (docs, docs.limit(0)):
        out = function(spark, table, str(tmp_path))
        assert set(docs.columns) <= set(out.columns)
        assert name == "source_mix" or out.columns == docs.columns
        out.collect()


def test_queries_on_empty_tables(spark, tmp_path):
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, query in queries.QUERIES.items():
        rows = query(spark, str(tmp_path)).collect()
        assert len(rows) == (1 if name == "op4_chat_format" else 0), name


def test_null_conversations_and_pages(spark):
    rows = spark.createDataFrame(
        [(None, None, None, None), (1, None, None, None), (1, 0, "assistant", ""), (1, 0, "assistant", ""), (2, 1, "a<|im_sep|>b", "<\\|x<|y")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    got = {r.conv_id: r for r in chat.format_conversations(rows, "/opt/tokenizers/byte_bpe_50k.json").collect()}
    assert {k: r.n_turns for k, r in got.items()} == {None: 1, 1: 3, 2: 1}
    assert chat.read_back(got[2].formatted) == [("a<|im_sep|>b", "<\\|x<|y")]
    pages = spark.createDataFrame([(1, None, None), (2, "no host", ""), (3, "http://h/", "<p>a"), (3, "http://h/", "<p>a"), (4, "http://h/", "<")],
                                  "page_id bigint, url string, html string")
    assert sorted((r.page_id, r.text) for r in wrappers.with_main_text(pages).collect()) == [(1, ""), (2, ""), (3, "a"), (3, "a"), (4, "<")]
