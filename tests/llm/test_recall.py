"""Share of similar pairs that meet in one class, by similarity of their five-word shingles."""

import itertools
import random

from serploom.llm import neardup

LEVELS = [(0.80, 0.85), (0.85, 0.95), (0.95, 1.01)]


def _shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_recall_by_similarity(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(90):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 400))]
        texts.append(base)
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randrange(1, 1 + len(w) // 28)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = [rng.choice(vocabulary) for _ in range(rng.randrange(2))]
            texts.append(w)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    of = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    shingles, found, pairs = [_shingles(w) for w in texts], dict.fromkeys(LEVELS, 0), dict.fromkeys(LEVELS, 0)
    for group in range(0, len(texts), 5):
        for a, b in itertools.combinations(range(group, group + 5), 2):
            similarity = len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
            for level in LEVELS:
                if level[0] <= similarity < level[1]:
                    pairs[level] += 1
                    found[level] += of[a] == of[b]
    recall = {level: found[level] / pairs[level] for level in LEVELS}
    print(recall, pairs)
    assert all(pairs[level] >= 30 for level in LEVELS) and all(r >= 0.9 for r in recall.values())
    # texts of different bases stay apart
    assert all(of[a] // 5 == a // 5 for a in of)


def test_a_crowded_bucket_loses_no_link(spark):
    """A passage that many short texts share, and beside it pairs of near copies: only the copies are linked."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(50)]
    texts = [passage + [f"u{k}-{i}" for i in range(24)] for k in range(120)]
    copies = {}
    for k in range(0, 120, 6):
        w = list(texts[k])
        w[50 + rng.randrange(24)] = "changed"
        copies[len(texts)] = k
        texts.append(w)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    of = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert all(of[i] == copies.get(i, i) for i in of)


def test_rows_that_share_an_id_are_told_apart_by_their_text(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue white black grey")
    rows = [(1, a, "x"), (5, a, "y"), (5, b, "z"), (None, c, "n"), (9, c, "m"), (9, c, "m"), (None, None, "e"), (7, "", "f"), (5, b, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, tid string")
    kept = sorted(map(str, (tuple(r) for r in neardup.drop_near_duplicates(docs).collect())))
    assert kept == sorted(map(str, [(1, a, "x"), (5, b, "z"), (9, c, "m"), (None, None, "e"), (7, "", "f")]))
