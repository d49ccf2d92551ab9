"""Each operator against a brute-force version, an exact round trip or held-out documents."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from serploom.llm import chat, common, decontam, licenses, lm_scores, mixing, neardup, quality, queries, secret_scan, token_counts, wrappers
from serploom.llm.common import words_of

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _documents(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- 1 licenses


def test_license_places(spark):
    texts = ["Released under the MIT License. Under-the mit\nlicense", "Apache License, Version 2.0 mit mit", "CC BY-NC 4.0 cc by nc", "mit license under the",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this thing and to deal in the Software without restriction"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.licenses for r in licenses.with_licenses(docs).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (2, 1, 5, "mit")
    assert (got[1].n_base, got[1].labels) == (1, "apache-2") and (got[2].n_base, got[2].labels) == (2, "cc-by-nc")
    assert (got[3].n_base, got[3].first_word, got[3].labels, got[3].score) == (0, None, "", 0.0)
    assert got[4].labels == "" and got[4].n_base == 0  # the key phrases stand at other relative places
    assert all(0 <= r.score <= 1 for r in got.values())


def test_license_query_brute_force(spark):
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    want = {}
    for d in _documents(spark):
        w = WORD.findall(_lower(d["text"]))
        at = [(i, k) for k, p in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want[d["doc_id"]] = (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({k for _, k in at})))
    got = {r[0]: tuple(r)[1:6] for r in queries.op1_license_scan(spark, SF).collect()}
    assert got == want


# --- 2 near-duplicates


def _brute_classes(texts):
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    words = [words_of((t or "").encode()) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            a, b = words[i], words[j]
            same = a == b if a or b else texts[i] == texts[j]
            if texts[i] and texts[j] and (same or a and b and 2 * min(len(a), len(b)) >= 0.8 * (len(a) + len(b)) and set(zip(a, a[1:], a[2:], a[3:], a[4:], strict=False)) & set(zip(b, b[1:], b[2:], b[3:], b[4:], strict=False)) and neardup.distance(a, b) <= 0.2 * (len(a) + len(b))):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_near_duplicate_classes(spark):
    docs = sorted(_documents(spark), key=lambda d: d["doc_id"])
    want = _brute_classes([d["text"] for d in docs])
    got = {r.doc_id: r.class_id for r in queries.op2_near_duplicates(spark, SF).collect()}
    assert got == {d["doc_id"]: docs[k]["doc_id"] for d, k in zip(docs, want, strict=True)}


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = [" ".join(base)]
    for _ in range(150):
        w = list(base)
        for _ in range(4):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    passage = " ".join(rng.choice(vocabulary) for _ in range(55))  # shared by texts that are no copies
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(200)) for _ in range(40)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == _brute_classes(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=40), st.lists(st.integers(0, 6), max_size=40))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert neardup.common_subsequence(a, b, 80) == table[-1][-1]


def test_banded_alignment_of_long_texts():
    rng = random.Random(1)
    a = [rng.randrange(2000) for _ in range(9000)]
    b = [x for x in a if rng.random() > 0.05]
    assert neardup.common_subsequence(a, b, 1000) == len(b) == neardup.common_subsequence(a, b, 10_000)


def _links(spark, texts, buckets):
    """Links of texts (id: words) with given buckets (id: bucket list); the id with the most buckets leads."""
    size = Counter(k for b in buckets.values() for k in b)
    rows = [(i, len(w), " ".join(w).encode()) for i, w in texts.items()]
    keys = [(i, len(texts[i]), k, size[k]) for i, b in buckets.items() for k in b]
    found = neardup.links_of(spark.createDataFrame(rows, "id bigint, n bigint, body binary"), spark.createDataFrame(keys, "id bigint, n bigint, bucket bigint, size bigint"))
    return {(r.a, r.b) for r in found.collect()}


def test_truncated_versions_are_not_pruned(spark):
    words = [f"w{i}" for i in range(100)]
    texts = {9: words, 2: words[:70], 1: words[:60]}
    assert _links(spark, texts, {9: [5], 2: [5], 1: [5]}) == {(2, 9), (1, 2)}


@pytest.mark.parametrize("block", [4, 1024])
def test_pairs_in_a_crowded_bucket_meet(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block, raising=False)
    rng = random.Random(8)
    texts = {i: [f"w{rng.randrange(2000)}" for _ in range(60)] for i in range(40)}
    pairs = {(k, k + 1) for k in (0, 2, 4)}
    for a, b in pairs:
        texts[b] = texts[a][:30] + texts[a][33:]
    extra = {i: [100 + i] for i in range(10, 40)}  # others lead: they are in one more bucket, with one more text
    texts |= {1000 + i: [f"x{i}-{k}" for k in range(60)] for i in extra}
    buckets = {i: [5, *extra.get(i, [])] for i in range(40)} | {1000 + i: e for i, e in extra.items()}
    assert _links(spark, texts, buckets) == pairs


@pytest.mark.parametrize("n, m", [(100, 60), (6000, 5000), (6000, 4500)])
def test_distance_bounds(n, m):
    rng = random.Random(n + m)
    a = [rng.randrange(50) for _ in range(n)]
    b = a[n - m :] if m == 5000 else [rng.randrange(50) for _ in range(m)]
    true = len(a) + len(b) - 2 * neardup.common_subsequence(a, b, n + m)
    d, least = neardup.bounds(a, b)
    assert least <= true <= d and d == neardup.distance(a, b)


# --- 3 mixing


def _brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, capped = mixing.SHARE * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free} if free else {}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target | {s: 2.0 * sizes[s] for s in capped}
        capped |= over


def test_mix_targets_and_totals(spark):
    rows = queries.op3_mix_sources(spark, SF).collect()
    docs = {d["doc_id"]: d for d in _documents(spark)}
    sizes = Counter()
    for d in docs.values():
        sizes[d["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
    want = _brute_targets(dict(sizes))
    taken, largest = Counter(), Counter()
    for r in rows:
        source = docs[r.doc_id]["source"]
        assert r.source_size == sizes[source] and abs(r.target - want[source]) < 1e-6 and r.taken in (0, r.size, 2 * r.size)
        taken[source] += r.taken
        largest[source] = max(largest[source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op3_mix_sources(spark, SF).collect()))


def test_mix_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rng = random.Random(2)
    rows = [(i, " ".join(["x"] * rng.randrange(0, 60)), "hot" if i % 3 else rng.choice(["a", None, "z"])) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert len(got) == 3000
    for s in ("hot", "a", None, "z"):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 60
        rate = own[0].target / own[0].source_size
        assert abs(sum(r.times for r in own) - rate * len(own)) <= 3


def test_flight_keeps_both_totals():
    rng = random.Random(3)
    sizes = [rng.randrange(1, 500) for _ in range(400)]
    chances = [0.37] * 400
    out = mixing.flight(chances, sizes, 7)
    assert sum(0 < p < 1 for p in out) <= 2
    assert abs(sum(out) - 148) < 1e-6 and abs(np.dot(out, sizes) - 0.37 * sum(sizes)) < 1e-3


# --- 4 chat


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "x<|im_sep|>"]), st.text(alphabet="a <|\\>é💥\nim_startend", max_size=40)), max_size=5))
def test_chat_round_trip(turns):
    tok = chat.tokenizer_of(open("/opt/tokenizers/byte_bpe_50k.json").read())
    text, ids, starts, ends, mask = chat.encode([turns], tok)[0]
    assert chat.read_back(text) == turns
    assert chat.loss_text(text, list(starts), list(ends), list(mask)) == "".join(t for r, t in turns if r == "assistant")


def test_chat_query_brute_force(spark):
    said = {}
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        said.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    probe = "<|im_end|><|im_start|>assistant ok"
    said[-1] = [("user", probe), ("assistant", probe)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"), sha("".join(x for r, x in t if r == "assistant")))
            for c, t in said.items()}
    assert {r.conv_id: tuple(r)[1:5] for r in queries.op4_chat_format(spark, SF).collect()} == want


# --- 5 secrets


def _brute_base(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def test_secret_query_brute_force(spark):
    want = {}
    for d in _documents(spark):
        spans = _brute_base(d["text"] or "")
        want[d["doc_id"]] = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
    assert {r.doc_id: r.base_sha256 for r in queries.op5_secret_scan(spark, SF).collect()} == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["token", "API_KEY", "=", ": ", '"', "ſecret", "AKIA", "0123456789abcdef", "ABCDEFGH", "é", " ", "\n", "pass", "word"]), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    assert [x[:3] for x in secret_scan.spans_of(text.encode()) if x[0] != "named"] == _brute_base(text)


def test_constants_reach_sensitive_names():
    text = 'a = "Zx81kQ0vLm2Pq"\nb = a\ndb_passphrase = b\nname = "Zx81kQ0vLm2Pq9"\npassphrase = "changeme123"\n<client_pwd>Rt5%kk20Qp1</client_pwd>\n'
    spans = secret_scan.spans_of(text.encode())
    assert [(x[0], text[x[1] : x[2]]) for x in spans] == [("named", "Zx81kQ0vLm2Pq"), ("named", "Rt5%kk20Qp1")]
    again = secret_scan.masked(text.encode(), spans)
    assert "= \"Zx81kQ0vLm2Pq\"" not in again and not secret_scan.spans_of(again.encode())
    assert secret_scan.spans_of("It was said: the token of the day. Time: 10:30, see http://a.b/c?d=e".encode()) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d", "salt", "auth", "db_password"]), st.sampled_from(["a", "b", "c", "d", "salt", "auth", '"Zx81kQ0vLm2Pq"', '"Kq7_ws90Lm33x"'])), max_size=12))
def test_constants_take_the_most_sensitive_name(lines):
    text = "".join(f"{name} = {value}\n" for name, value in lines)
    names = {name for name, _ in lines}
    want, at = [], 0
    for name, value in lines:
        reach = {name}
        for _ in lines:
            reach |= {n for n, v in lines if v in reach}
        start = at + len(name) + 4
        top, best = max((secret_scan.name_score(n), n) for n in reach & names)
        if value[0] == '"' and top >= secret_scan.MIN_SCORE:
            want.append((start, start + len(value) - 2, best, top))
        at += len(name) + len(value) + 4
    assert secret_scan.named_literals(text) == want


def test_long_chain_of_constants():
    n = 20_000
    text = "".join(f'c{i} = "Zx81kQ0vLm2P{i}"\nc{i + 1} = c{i}\n' for i in range(n)) + f"db_password = c{n}\n"
    found = secret_scan.named_literals(text)  # walking on from every constant would take 200 million steps
    assert len(found) == n and {x[2] for x in found} == {"db_password"}


@pytest.mark.parametrize("line, value", [
    ("AUTH_KEY=sk-live-9f8a7b6c5d4e", "sk-live-9f8a7b6c5d4e"),
    ("export private_key=MIIEvQ/IBADANBg+kqhkiG9w0==", "MIIEvQ/IBADANBg+kqhkiG9w0=="),
    ("signing_key=QUJDREVG+a1b2c3", "QUJDREVG+a1b2c3"),
    ("db_pwd: Tr0ub4dor&3xyz", "Tr0ub4dor&3xyz"),
    ("  client_pwd: Tr0ub#4d=or-3 # note", "Tr0ub#4d=or-3"),
    ("signing_key=9fA-live-abc", "9fA-live-abc"),
    ("url=http://h.example/p?user=bob&auth_key=sk-live=9f8a7b6c&n=1", "sk-live=9f8a7b6c"),
    ("a = db_pwd = Zx81-kQ0v/Lm2Pq;", None),
])
def test_unquoted_literals_are_read_whole(line, value):
    text = f"x: 1\n{line}\ny=2\n"
    found = [text[x[3] : x[4]] for x in secret_scan.spans_of(text.encode())]
    assert found == ([value] if value else [])
    if value:
        assert secret_scan.masked(text.encode(), secret_scan.spans_of(text.encode())) == text.replace(value, secret_scan.MASK)


def test_unquoted_names_stay_references():
    text = 'part = "Zx81kQ0vLm2Pq"\nrest = "Kq7_ws90Lm33x"\ndb_pwd = part+rest\nauth_key=part\n'
    assert [(text[s:e], n) for s, e, n, _ in secret_scan.named_literals(text)] == [("Zx81kQ0vLm2Pq", "auth_key"), ("Kq7_ws90Lm33x", "db_pwd")]
    assert len(secret_scan.named_literals("x=" + "&auth_key=sk-live-9f8a7b" * 40_000)) == 40_000  # linear in the literal


# --- 6 language models


def test_lm_scores_tell_held_out_documents_apart(spark):
    rng = random.Random(4)
    good, bad = [f"g{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    make = lambda words: " ".join(rng.choice(words + ["the", "of"]) for _ in range(60))
    rows = [(i, make(good if i % 2 else bad)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = lm_scores.with_lm_scores(docs, docs.filter("doc_id < 200 and doc_id % 2 = 1").select("doc_id")).collect()
    held = [(r.lm.score < 0) == (r.doc_id % 2 == 1) for r in out if r.doc_id >= 200]
    assert sum(held) >= 0.95 * len(held)


def test_lm_loss_brute_force(spark):
    texts = {0: "a b a b c", 1: "a b d", 2: "c a b", 3: "", 4: "a"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.lm for r in lm_scores.with_lm_scores(docs, docs.filter("doc_id = 0").select("doc_id")).collect()}

    def losses(ids):
        uni, bi, words = Counter(), Counter(), {i: t.split() for i, t in texts.items()}
        seen = Counter(w for x in words.values() for w in x)
        known = {w for w, n in seen.items() if n >= 2}
        listed = {p for p, n in Counter(p for x in words.values() for p in zip(x, x[1:], strict=False)).items() if n >= 2}
        for i in ids:
            uni.update(w if w in known else None for w in words[i])
            bi.update(p for p in zip(words[i], words[i][1:], strict=False) if p in listed)
        share = lambda w: (uni[w] + 0.5) / (sum(uni.values()) + 0.5 * (len(known) + 1))
        held = lambda v, w: 0.6 * bi[v, w] / max(1, uni[v]) if (v, w) in listed else 0
        out = {}
        for i, x in words.items():
            x = [w if w in known else None for w in x]
            p = [share(x[0]) if x else 1] + [held(v, w) + (1 - sum(held(v, y) for y in known)) * share(w) for v, w in zip(x, x[1:], strict=False)]
            out[i] = -sum(np.log(p)) / len(x) if x else None
        return out

    background, target = losses(texts), losses([0])
    for i in texts:
        assert got[i].loss_background == (None if background[i] is None else pytest.approx(background[i]))
        assert got[i].score == (None if background[i] is None else pytest.approx(target[i] - background[i]))


def test_lm_scores_list_rare_entries_too(spark, monkeypatch):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(rng.randrange(0, 60)))) for i in range(60)] * 2, "doc_id bigint, text string")
    runs = []
    for share in (2e-6, 0.01, 1.0):  # what is broadcast changes no score
        monkeypatch.setattr(lm_scores, "MIN_SHARE", share)
        runs.append(sorted((r.doc_id, r.lm.n_tokens, r.lm.loss_background, r.lm.score) for r in lm_scores.with_lm_scores(docs, docs.filter("doc_id < 9").select("doc_id")).collect()))
    for run in runs[1:]:
        for x, y in zip(runs[0], run, strict=True):
            assert x[:2] == y[:2] and (x[2:] == y[2:] if x[2] is None else x[2:] == pytest.approx(y[2:], abs=1e-9))


# --- 7 decontamination


@pytest.mark.parametrize("block_words", [12, 60_000])
def test_contamination_brute_force(spark, block_words):
    bench = [r.asDict() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [{"item_id": 900, "text": "the and"}]
    patterns = {}
    for b in bench:
        w = WORD.findall(_lower(b["text"]))
        for i in range(max(1, len(w) - 9)) if w else []:
            patterns.setdefault(tuple(w[i : i + 10]), set()).add(b["item_id"])
    want = {}
    for d in _documents(spark):
        w = WORD.findall(_lower(d["text"]))
        hit, items = set(), set()
        for k in {len(p) for p in patterns}:
            for i in range(len(w) - k + 1):
                if (p := tuple(w[i : i + k])) in patterns:
                    hit |= set(range(i, i + k))
                    items |= patterns[p]
        want[d["doc_id"]] = (len(w), len(hit), sorted(items))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    table = spark.createDataFrame([(b["item_id"], b["text"]) for b in bench], "item_id bigint, text string")
    got = decontam.with_contamination(docs, table, block_words=block_words).collect()
    assert {r.doc_id: (r.contamination.n_words, r.contamination.n_hit, r.contamination["items"]) for r in got} == want
    for r in got:  # spans of the original hold the hit words
        assert sum(len(WORD.findall(_lower(r.text[s.start : s.end]))) for s in r.contamination.spans) == r.contamination.n_hit


# --- 8 pages

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href=/a>{a}</a><li><a href=/b>{b}</a></ul></nav><div class="cookie-notice">We use cookies</div>{open}
<h1>{h} &amp; more</h1><p>One  <b>two</b><br>three<p>Four{p}</p><form><input name=q><label>Find</label></form><aside>side</aside>{close}
<section id="comments"><article class="comment"><p>{a} said</p></article></section><div class="ad">{b}</div><script>var x = "<p>no</p>";</script>
<footer>&copy; x</footer></body></html>"""


def _page(k, article):
    more = "".join(f"<p>More {i} of {k}" for i in range(k % 4))
    return PAGE.format(a=f"a{k}", b=f"b{k}", h=f"Head {k}", p=more, open="<article>" if article else '<div id="content">', close="</article>" if article else "</div>")


def test_pages_of_two_templates(spark):
    rows = [(k, f"http://{'art' if k % 2 else 'div'}.example/{k}", _page(k, k % 2 == 1)) for k in range(200)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for r in wrappers.with_main_text(pages).collect():
        k = r.page_id
        assert r.text == "\n".join([f"Head {k} & more", "One two three", "Four", *[f"More {i} of {k}" for i in range(k % 4)]]), k
    got = {r.host: r for r in wrappers.wrappers(pages).collect()}
    assert got["art.example"].root == "article" and got["div.example"].root.endswith("div#content")
    assert got["art.example"].n_pages == 100 and ")?" in got["art.example"].wrapper or ")+" in got["art.example"].wrapper


def test_given_pages(spark):
    import html

    for r in queries.op8_html_extraction(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", body)]
        assert r.text == "\n".join(x for x in blocks if x), r.page_id


# --- 9 quality


def test_quality_brute_force(spark):
    want = {}
    for d in _documents(spark):
        text = d["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        often = Counter(windows)
        inside = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
        want[d["doc_id"]] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed)
    rows = queries.op9_quality_rules(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows} == want
    assert not any(r.kept and r.base_failed for r in rows)


def test_quality_verdicts_agree_with_labels(spark):
    rows = queries.op9_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert all(r.kept or r.base_failed for r in rows if r.quality == 1)
    bad = [r for r in rows if r.quality == 0]
    assert sum(not r.kept for r in bad) >= 0.8 * len(bad)
    p, q = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert quality.js_distance(p, q) == pytest.approx(1) and quality.js_distance(p, p) == 0


# --- 10 token counts


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_token_counts_equal_the_tokenizer(spark, byte_fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_counts.vocabulary_of("/opt/tokenizers/piece_bpe_32k.model")
    if not byte_fallback:
        vocabulary = [(p, round(s / 500)) for p, s in vocabulary if not re.fullmatch("<0x..>", p)][:20_000]  # many ties
    tok = Tokenizer(models.Unigram(vocabulary, 0, byte_fallback))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    model = token_counts.UnigramCounter([(p, float(s)) for p, s in vocabulary])
    texts = [d["text"] or "" for d in _documents(spark)] + ["", " ", "  a  b", "▁x ▁", "日本語💥 é́", "\n\t<0x0A> <s>", "a" * 5000, "x\n" * 3000]
    for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert model.count(t) == len(e.ids), t[:80]


# --- pipeline


def test_pipeline(spark):
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    docs = sorted(_documents(spark), key=lambda d: d["doc_id"])
    references = quality._references()
    good = [d for d in docs if quality.judge((d["text"] or "").encode(), d["lang"], references)[-1]]
    first = [d for d, k in zip(good, _brute_classes([d["text"] for d in good]), strict=True) if good[k] is d]
    block = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    automaton = decontam.automaton_of(block)
    clean = {d["doc_id"]: d for d in first if not decontam.scan(d["text"].encode(), [automaton])[1]}
    assert set(out) <= set(clean)
    for i, r in out.items():
        raw = clean[i]["text"].encode()
        assert r.text == secret_scan.masked(raw, secret_scan.spans_of(raw)) and r.copies in (1, 2)
    assert {c for c in spark.read.parquet(f"{SF}/documents.parquet").columns} | {"copies"} == set(next(iter(out.values())).asDict())


def test_landed_tables_leave_no_shuffle_files(spark, tmp_path):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    known = files()
    table = common.landed(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "test")
    for _ in range(50):  # removed a moment later
        if not (left := files() - known):
            break
        time.sleep(0.2)
    assert not left and sorted(r.n for r in table.collect()) == [142, 143, 143, 143, 143, 143, 143]
    assert spark.conf.get(name, None) == before
