"""Runs against a brute-force search of every period, and the query against the contract restated in plain loops."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from serploom.llm import periodic_runs, queries

SF = "/root/testdata/sf0.001"


def brute_runs(words, min_length=6, min_exponent=4):
    """Every period by a scan over the words; a stretch found under a smaller period keeps that."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_length, min_exponent * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def runs(words, **limits):
    return periodic_runs.runs_of(periodic_runs.numbered(words), **limits)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
def test_runs_of_few_letters(words):
    assert runs(words) == brute_runs(words)
    assert runs(words, min_length=4, min_exponent=2) == brute_runs(words, 4, 2)


def test_runs_with_planted_repetitions():
    rnd = random.Random(5)
    for _ in range(150):
        words = [b"%d" % rnd.randrange(40) for _ in range(rnd.randrange(1, 250))]
        for _ in range(rnd.randrange(3)):
            at, q, times = rnd.randrange(len(words)), rnd.randrange(1, 14), rnd.randrange(2, 9)
            piece = [rnd.choice(words) for _ in range(q)]
            words[at:at] = (piece * times)[: q * times - rnd.randrange(q)]
        for limits in ((6, 4), (2, 2), (12, 3)):
            assert runs(words, min_length=limits[0], min_exponent=limits[1]) == brute_runs(words, *limits)


def test_long_periodic_texts():
    one = [b"x"] * 50_000
    assert runs(one) == [(0, 50_000, 1)]
    two = [b"%d" % (i % 777) for i in range(40_000)]
    assert runs([b"!", *two, b"?"]) == [(1, 40_000, 777)]
    fibonacci, other = [b"a"], [b"a", b"b"]
    while len(other) < 3000:
        fibonacci, other = other, other + fibonacci
    assert runs(other, min_length=2, min_exponent=2) == brute_runs(other[:], 2, 2)


def test_window_is_shared_by_every_reported_run():
    assert periodic_runs.window(6, 4) == 5 and periodic_runs.window(2, 2) == 1
    for limits in ((6, 4), (9, 3), (3, 2)):
        w = periodic_runs.window(*limits)
        assert all(periodic_runs.needed(q, *limits) - q >= w for q in range(1, 200))
    words = [b"a"] * 6
    assert runs(words) == [(0, 6, 1)] and runs(words[:5]) == []


def _contract(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n > 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    of = brute_runs(words)
    best = min(of, key=lambda r: (-r[1], r[0], r[2])) if of else None
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in of)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(of), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in of)), sha(" ".join(kept)))


def test_query_against_the_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    short = [d for d in docs if len((d.text or "").split()) < 1500]
    assert len(short) > 150
    got = {r[0]: tuple(r) for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len({d.doc_id for d in docs})
    for d in short:
        assert got[d.doc_id] == _contract(d.doc_id, d.text)
    assert sum(r[1] > 0 for r in got.values()) > 10


def test_edges(spark, tmp_path):
    long = "lorem ipsum dolor " * 40_000
    texts = [None, "", " \n", "a a a a a a", long, "a b a b a b a b c", "a b a b a b a b c", "x\x0by\x0cz"]
    rows = [(k, t, "extra") for k, t in enumerate(texts)] + [(None, "a a a a a a a", None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, words string").repartition(3)
    got = {(r.doc_id, r.text and len(r.text)): r.runs for r in periodic_runs.with_runs(docs).collect()}
    assert len(got) == len(rows)
    assert got[0, None].n_words == 0 and got[0, None].runs == [] and got[0, None].collapsed == b""
    assert [tuple(x) for x in got[3, 11].runs] == [(0, 6, 1)] and got[3, 11].collapsed == b"a"
    assert [tuple(x) for x in got[4, len(long)].runs] == [(0, 120_000, 3)] and got[4, len(long)].collapsed == b"lorem ipsum dolor"
    assert got[5, 17] == got[6, 17] and got[5, 17].collapsed == b"a b c" and got[7, 5].n_words == 3
    assert [tuple(x) for x in got[None, 13].runs] == [(0, 7, 1)]
    with pytest.raises(ValueError, match="words"):
        periodic_runs.with_runs(docs, out="Words")
    assert periodic_runs.with_runs(docs.limit(0)).collect() == []


def test_ranks_compare_stretches():
    rnd = random.Random(9)
    ids = np.array([rnd.randrange(3) for _ in range(300)])
    levels = periodic_runs.doubled_ranks(ids)
    a, b = np.array([rnd.sample(range(290), 2) for _ in range(2000)]).T  # two places
    length = np.array([rnd.randrange(1, 301 - max(x, y)) for x, y in zip(a, b, strict=True)])
    want = [bool((ids[x : x + m] == ids[y : y + m]).all()) for x, y, m in zip(a, b, length, strict=True)]
    assert periodic_runs.equal_stretches(levels, a, b, length).tolist() == want
