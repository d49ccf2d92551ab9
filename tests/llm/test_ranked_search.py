"""Rankings against a brute-force scoring of every document, and the bounds against the scores they promise."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from serploom.llm import queries, ranked_search

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]


def brute(docs, items, k=20):
    """[(item, rank, id, score)] of (id, text) rows."""
    bags = [(d, Counter(_terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in set(items):
        scores = []
        for d, b, n in bags:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 12 * m)) for t, c in Counter(_terms(text)).items() if b[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def _found(rows):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in rows.collect()), key=str)


def test_query_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.op11_ranked_search(spark, SF)
    assert dict(got.dtypes) == {"item_id": dict(spark.read.parquet(f"{SF}/benchmark.parquet").dtypes)["item_id"], "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert _found(got) == brute(docs, items)


def test_blocks_buckets_and_ties(spark, monkeypatch):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rnd.choices(words, weights, k=rnd.randrange(1, 30)))) for i in range(700)]
    docs += [(1000 + i, docs[5][1]) for i in range(90)] + [(5, docs[5][1])] * 3 + [(None, docs[5][1])]  # ties, repeated rows, no id
    items = [(i, " ".join(rnd.choices(words, k=rnd.randrange(1, 9)))) for i in range(12)] + [(50, docs[5][1]), (50, docs[5][1]), (51, "unheard of")]
    monkeypatch.setattr(ranked_search, "BLOCK_WORDS", 20)
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = ranked_search.search(table, spark.createDataFrame(items, "item_id bigint, text string"))
    assert _found(got) == brute(docs, items)


@pytest.mark.parametrize("bucket", [7, 64])
def test_bounds_lose_nothing(bucket):
    """Bucket by bucket, every document that reaches the least score is a candidate, and most others are not."""
    rnd = random.Random(8)
    v, k = 400, 5
    weights = np.array([rnd.randrange(0, 6000) for _ in range(v)])
    rows = []
    for i in range(600):
        tf = Counter(rnd.choices(range(v), [1 / (j + 3) for j in range(v)], k=rnd.randrange(1, 60)))
        rows.append((i, sum(tf.values()), tf))
    total = sum(n for _, n, _ in rows)
    counts = [dict(Counter(rnd.choices(range(v), k=rnd.randrange(1, 12)))) for _ in range(20)] + [dict(rows[3][2])]
    score = lambda of, n, tf: sum(c * int(weights[t]) * int(ranked_search.impacts(np.array([tf[t]]), np.array([n]), len(rows), total)[0]) for t, c in of.items() if t in tf)
    length = lambda n, tf: math.sqrt(sum(int(weights[t]) * float(ranked_search.impacts(np.array([f]), np.array([n]), len(rows), total)[0]) ** 2 for t, f in tf.items()))
    rows = sorted(((length(n, tf), i, n, tf) for i, n, tf in rows), reverse=True)
    items, best, tried, pairs = ranked_search.Items(counts, weights), ranked_search.Best(k, [0] * len(counts)), 0, 0
    for at in range(0, len(rows), bucket):
        part = rows[at : at + bucket]
        sizes = np.array([len(tf) for *_, tf in part])
        terms = np.array([t for *_, tf in part for t in tf], np.int64)
        tfs = np.array([f for *_, tf in part for f in tf.values()], np.int64)
        impact = ranked_search.impacts(tfs, np.repeat(np.array([n for _, _, n, _ in part]), sizes), len(rows), total)
        b = ranked_search.Bucket(items, terms, impact, sizes, np.array([x for x, *_ in part]))
        for i, of in enumerate(counts):
            found = set(b.candidates(items, i, best.least[i]).tolist()) if len(items.terms[i]) else set()
            pairs, tried = pairs + len(part), tried + len(found)
            for d, (_, _, n, tf) in enumerate(part):
                s = score(of, n, tf)
                assert s < max(1, best.least[i]) or d in found
        ids = [i for _, i, _, _ in part]
        best.add(items, b, ids, np.argsort(np.argsort(ids)))
    for i, of in enumerate(counts):
        want = sorted((-score(of, n, tf), 0, d) for _, d, n, tf in rows if score(of, n, tf) > 0)[:k]
        assert best.rows[i] == [(s, bool(z), d) for s, z, d in want]
    assert tried < 0.5 * pairs


def test_edges(spark):
    long = "common words here " * 50_000
    docs = [(None, None, "x"), (1, "", "x"), (2, "...", "x"), (3, long, "x"), (4, "common", "x"), (5, "common", None), (None, "here we are", None)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string").repartition(2)
    items = spark.createDataFrame([(None, "common"), (1, None), (2, ""), (3, long), (4, "Here, WE are; common"), (4, "we")], "item_id bigint, text string")
    got = ranked_search.search(table, items, k=2)
    assert _found(got) == brute([d[:2] for d in docs], [tuple(r) for r in items.collect() if r.text], k=2)
    assert ranked_search.search(table.limit(0), items).collect() == []
    assert ranked_search.search(table, items.limit(0)).collect() == []
    named = table.selectExpr("cast(doc_id as string) as id", "text as body")
    words = items.selectExpr("item_id as q", "text as words")
    other = ranked_search.search(named, words, k=2, id="id", text="body", item="q", item_text="words")
    assert other.columns == ["q", "rank", "id", "score"] and other.count() == got.count()
