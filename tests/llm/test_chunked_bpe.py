"""Ids and decoded texts against the tokenizers library on whole texts."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from serploom.llm import chunked_bpe, queries

SF = "/root/testdata/sf0.001"
PATH = f"{queries.TOKENIZERS}/word_bpe_49k.json"
DEFINITION = open(PATH, encoding="utf-8").read()


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(PATH)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _library_row(tok, doc_id, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))


def _ids(encoded):
    import numpy as np

    return np.frombuffer(encoded, np.int32).tolist()


PIECES = ["the", "The", "it's", "I'LL", " ", "  ", "\n", "\t", "\x0b", "\x0c", " ", " ", "\u0085", "e", "́", "é", "가", "ᆨ", "中文",
          "<|startoftext|>", "<|endoftext|>", "<|", "|>", "12", "'", "'s", "...", "\U0001f4a5", "İ", "Σ", "ß", "ﬁ", "\x00", "​", "_", "-"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join))
def test_pieces_between_blanks_are_the_whole(text):
    assert _ids(ENCODER(text.encode())) == ENCODER.tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    data = text.encode("utf-8", "replace")
    assert _ids(ENCODER(data)) == ENCODER.tok.encode(data.decode(), add_special_tokens=False).ids


ENCODER = chunked_bpe.Encoder(DEFINITION)


def test_chunks_are_whole_characters_and_meet_again():
    rnd = random.Random(3)
    words = ["alpha", "betaé", "中文字", "\U0001f4a5", "gamma,"]
    passage = " ".join(rnd.choice(words) + str(rnd.randrange(99)) for _ in range(900))
    a, b = f"one {passage} end".encode(), f"another start, {passage}".encode()
    for data in (a, b, b"", b"x", b"y" * 20_000, "é".encode() * 9_000, bytes([0x80]) * 9_000):
        ends = chunked_bpe.chunk_ends(data)
        assert (ends[-1] if ends else 0) == len(data) and ends == sorted(set(ends))
        assert all(e - s <= chunked_bpe.MOST for s, e in zip([0, *ends], ends, strict=False))
    for s, e, _ in chunked_bpe.chunks_of(a):
        a[s:e].decode()
    keys = [{k for _, _, k in chunked_bpe.chunks_of(x)} for x in (a, b)]
    assert len(keys[0] & keys[1]) >= 0.9 * len(keys[0]) > 10


def test_joins_are_repaired(library):
    """Any subset of the chunks may come from elsewhere."""
    rnd = random.Random(7)
    for _ in range(60):
        text = "".join(rnd.choice(PIECES) if rnd.random() < 0.3 else rnd.choice(["word", "Another ", "nón ", "x"]) for _ in range(rnd.randrange(1, 900)))
        if rnd.random() < 0.3:
            text += "中noblanks" * 900 + " end"
        data = text.encode()
        want = library.encode(text, add_special_tokens=False).ids
        chunks = chunked_bpe.chunks_of(data)
        for share in (0.0, 0.5, 1.0):
            given = {}
            for s, e, key in chunks:
                if rnd.random() < share:
                    a, b = chunked_bpe.kept_part(data[s:e])
                    given[key] = ENCODER(data[s + a : s + b])
            assert _ids(ENCODER.with_shared(data, given)) == want


def test_query_against_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = sorted(tuple(r) for r in queries.op12_bpe_round_trip(spark, SF).collect())
    assert got == sorted(_library_row(library, d.doc_id, d.text) for d in docs)


def test_edges(spark, library):
    rnd = random.Random(11)
    passage = " ".join(f"w{rnd.randrange(500)}" for _ in range(400))
    long = "lorem ipsum " * 60_000
    texts = [None, "", " \n", "<|endoftext|>", long, passage, passage, f"new start {passage}", f"{passage} new end", "a" * 30_000, None]
    rows = [(k, t, "extra", 1) for k, t in enumerate(texts)] + [(None, passage, None, None), (None, None, None, None), (4, long, "again", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, mark string, k1 int").repartition(3)
    assert chunked_bpe.shared_chunks(docs).count() > 5
    got = chunked_bpe.with_token_ids(docs, PATH)
    assert got.columns == [*docs.columns, "token_ids"]
    found = got.collect()
    assert len(found) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.mark or "", r.k1 or 0) for r in found) == sorted((r[0] is None, r[0] or 0, r[2] or "", r[3] or 0) for r in rows)
    for r in found:
        assert r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids
    assert chunked_bpe.with_token_ids(docs.limit(0), PATH).collect() == []
    with pytest.raises(ValueError, match="mark"):
        chunked_bpe.with_token_ids(docs, PATH, out="mark")


def test_other_tokenizers_are_refused(spark):
    with pytest.raises(ValueError, match="blanks"):
        chunked_bpe.with_token_ids(spark.range(1).select(F.lit("a").alias("text")), f"{queries.TOKENIZERS}/byte_bpe_50k.json")


def test_a_full_table_changes_nothing(spark, library, monkeypatch):
    monkeypatch.setattr(chunked_bpe, "MOST_BITS", 1024)
    monkeypatch.setattr(chunked_bpe, "bit_table", lambda shared: __import__("numpy").full(16, -1, "int64"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for r in chunked_bpe.with_token_ids(docs, PATH).collect():
        assert r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids
