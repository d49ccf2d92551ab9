"""Language-model scoring by cross-entropy difference.

Two bigram models, one of the target documents and one of all documents, share one vocabulary, one list of
bigrams and one smoothing: p(w | v) = L c(v, w) / c(v) + g(v) p(w), where g(v) is what the listed bigrams of v
leave and p(w) = (c(w) + A) / (N + A (V + 1)) with one entry for unknown words. Each document is scored by the
mean over its words of target loss less background loss (natural logarithm): the lower, the more it is like
the target.

Counts cover all documents, and every word and bigram met ``MIN_COUNT`` times or more is listed, however many
there are. (A bigram met that often has words met that often, so bigrams are counted without the vocabulary.)
A document's log probability is a sum over its words and listed bigrams, so the model is a written table of
hashed keys and what each adds. Entries with ``MIN_SHARE`` of the running text or more, of which there can only
be a fixed number, are broadcast; a document's other keys are joined with the table and summed by document.

Defined results: a null or empty text has 0 words and null losses; without target documents the target model
is uniform over the vocabulary; documents without an id are no targets; repeated rows count as often as they
come; extra columns stay untouched; an empty table stays empty.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serploom.llm.common import WordHashes, bytes_of, fresh, landed, words_of

#: share of the running text from which on an entry is broadcast instead of joined; it changes no result
MIN_SHARE = 2e-6
MIN_COUNT = 2
INTERPOLATION = 0.6
ADDED = 0.5
DIGITS = 12

_TURN = 23
_LAST = np.uint64(0x9E3779B97F4A7C15)
_MODELS: dict[str, tuple] = {}


def pair_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of neighbouring words: the hash of the first, turned, and that of the second."""
    v = hashes[:-1]
    return (v << np.uint64(_TURN) | v >> np.uint64(64 - _TURN)) ^ hashes[1:]


def pair_key(v: Column, w: Column) -> Column:
    """``pair_keys`` of two columns."""
    return F.shiftleft(v, _TURN).bitwiseOR(F.shiftrightunsigned(v, 64 - _TURN)).bitwiseXOR(w)


def gram_counts(docs: DataFrame) -> DataFrame:
    """Rows (v, w, n, t): counts over all documents and over the targets, of words (w null) and of bigrams. docs: body, target."""

    def count(batches):
        hashes_of = WordHashes()
        for b in batches:
            found = [hashes_of(words_of(t.as_py())) for t in b.column(0)]
            if not found:
                continue
            good = np.repeat(b.column(1).to_numpy(), [len(h) for h in found])
            words = np.concatenate(found)
            ends = np.cumsum([len(h) for h in found])
            inside = np.ones(max(len(words) - 1, 0), bool)
            inside[ends[(ends > 0) & (ends < len(words))] - 1] = False  # not over the end of a document
            first = np.flatnonzero(inside)
            for keys, at, flags in ((words, None, good), (pair_keys(words)[first], first, good[first])):
                key, where, place, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
                t = np.bincount(place.ravel(), weights=flags, minlength=len(key)).astype(np.int64)
                if at is None:
                    v, w = key, pa.nulls(len(key), pa.int64())
                else:  # by first word, so that rows of one word lie together and the shuffle's codec writes it once
                    order = np.argsort(words[at[where]], kind="stable")
                    where, n, t = where[order], n[order], t[order]
                    v, w = words[at[where]], pa.array(words[at[where] + 1].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), w, pa.array(n.astype(np.int64)), pa.array(t)], names=["v", "w", "n", "t"])

    parts = docs.select(bytes_of(F.col("body")).alias("b"), "target").mapInArrow(count, "v bigint, w bigint, n bigint, t bigint")
    return parts.groupBy("v", "w").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def fit(docs: DataFrame, targets: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, float, list[float]]:
    """The model: a table (key, n, b, t), the count from which on entries are broadcast, log probabilities of the
    unknown word. ``targets``: the ids of the target documents. b and t are what a key adds to the log probability
    under the background and the target model; keys are words (against the unknown word, with what they leave to
    the next), last words (which have no next) and bigrams (against their words)."""
    (flag, key, good) = fresh(docs, "flag", "key", "good")
    wanted = targets.select(F.col(targets.columns[0]).alias(key)).filter(F.col(key).isNotNull()).distinct().withColumn(good, F.lit(1))
    # the ids grow with the documents, so they are never broadcast, whatever a planner thinks of their size
    wanted = wanted.hint("merge")
    # documents without an id are dealt by their text and match nothing
    spread = F.when(F.col(id).isNull(), F.xxhash64(F.col(text))).otherwise(F.col(id))
    flagged = docs.select(spread.alias(flag), F.col(id).isNotNull().alias("known"), F.col(text).alias("body")).join(
        wanted, (F.col(flag) == F.col(key)) & F.col("known"), "left"
    ).select("body", F.coalesce(F.col(good), F.lit(0)).alias("target"))
    grams = landed(gram_counts(flagged).filter((F.col("n") >= MIN_COUNT) | F.col("w").isNull()), "lm-grams")
    single, pairs = grams.filter("w is null"), grams.filter("w is not null")
    rare = F.col("n") < MIN_COUNT
    size, *sums = single.agg(
        F.count(F.when(~rare, 1)), *[F.coalesce(F.sum(x), F.lit(0)) for c in ("n", "t") for x in (F.col(c), F.when(rare, F.col(c)))]
    ).first()
    totals = [sums[0] + ADDED * (size + 1), sums[2] + ADDED * (size + 1)]
    unknown = [float(np.log(((x or 0) + ADDED) / total)) for x, total in zip((sums[1], sums[3]), totals, strict=True)]
    heads = pairs.groupBy("v").agg(F.sum("n").alias("hn"), F.sum("t").alias("ht"))
    left = lambda c: F.greatest(1 - INTERPOLATION * F.coalesce(f"h{c}", F.lit(0)) / F.greatest(F.col(c), F.lit(1)), F.lit(1e-9))
    words = landed(
        single.filter(~rare).select("v", "n", "t").join(heads.hint("merge"), "v", "left").select(
            "v", "n", "t", *[left(c).alias(f"rest_{c}") for c in "nt"],
            *[((F.col(c) + ADDED) / F.lit(total)).alias(f"share_{c}") for c, total in zip("nt", totals, strict=True)],
        ), "lm-words",
    )
    one = words.select(
        F.col("v").alias("key"), "n",
        *[(F.log(f"share_{c}") - F.lit(u) + F.log(f"rest_{c}")).alias(o) for c, u, o in zip("nt", unknown, "bt", strict=True)],
    )
    last = words.select(pair_key(F.col("v"), F.lit(int(_LAST.view(np.int64)))).alias("key"), "n", *[(-F.log(f"rest_{c}")).alias(o) for c, o in (("n", "b"), ("t", "t"))])
    before = words.select("v", *[F.col(c).alias(f"c{c}") for c in "nt"], "rest_n", "rest_t").hint("merge")
    after = words.select(F.col("v").alias("w"), "share_n", "share_t").hint("merge")
    base = lambda c: F.col(f"rest_{c}") * F.col(f"share_{c}")
    held = lambda c: INTERPOLATION * F.col(c) / F.greatest(F.col(f"c{c}"), F.lit(1))
    two = pairs.join(before, "v").join(after, "w").select(
        pair_key(F.col("v"), F.col("w")).alias("key"), "n", *[F.log((held(c) + base(c)) / base(c)).alias(o) for c, o in (("n", "b"), ("t", "t"))]
    )
    model = landed(one.unionByName(last).unionByName(two), "lm-model")
    return model, max(MIN_COUNT, MIN_SHARE * sums[0]), unknown


def keys_of(hashes: np.ndarray) -> np.ndarray:
    """All keys of a text: its words, its last word, its bigrams."""
    if not len(hashes):
        return hashes
    return np.concatenate([hashes, pair_keys(np.array([hashes[-1], _LAST])), pair_keys(hashes)])


def _often(name: str, shared) -> tuple[np.ndarray, np.ndarray]:
    """The broadcast entries, once a process: sorted keys, and what they add (with a row of zeros for others)."""
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = shared.value
    return _MODELS[name]


def _places(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted known ones; their number if it is none of them."""
    at = np.searchsorted(known, keys)
    return np.where(np.append(known, 0)[at] == keys, at, len(known)) if len(known) else at


def with_lm_scores(docs: DataFrame, targets: DataFrame, id: str = "doc_id", text: str = "text", out: str = "lm") -> DataFrame:
    """Adds a struct: n_tokens, loss_background, loss_target, score (target less background)."""
    model, least, unknown = fit(docs, targets, id, text)
    often = model.filter(F.col("n") >= least).select("key", "b", "t").toArrow()  # at most 3 / MIN_SHARE rows
    known = often.column("key").to_numpy().view(np.uint64)
    order = np.argsort(known)
    adds = np.stack([often.column(c).to_numpy() for c in "bt"], axis=1)[order] if len(known) else np.zeros((0, 2))
    shared = docs.sparkSession.sparkContext.broadcast((known[order], np.concatenate([adds, np.zeros((1, 2))])))
    name = uuid.uuid4().hex
    # equal texts have equal scores, so a text is known by 64 bits; those without a character are dealt by their id
    same = F.when(F.length(F.col(text)) > 0, F.xxhash64(F.col(text))).otherwise(F.xxhash64(F.col(id)))

    def asked(batches):
        hashes_of = WordHashes()
        for b in batches:
            entries, _ = _often(name, shared)
            found = [keys_of(hashes_of(words_of(t.as_py()))) for t in b.column(1)]
            if found:
                keys = np.concatenate(found)
                at = np.flatnonzero(_places(keys, entries) == len(entries))
                ids = np.repeat(b.column(0).to_numpy(), [len(k) for k in found])[at]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys[at].view(np.int64))], names=["tid", "key"])

    rare = model.filter(F.col("n") < least).select("key", "b", "t").hint("merge")
    wanted = docs.select(same.alias("tid"), bytes_of(F.col(text)).alias("body")).mapInArrow(asked, "tid bigint, key bigint")
    more = wanted.join(rare, "key").select("tid", "b", "t", F.lit(0).alias("copies"))
    copies = docs.select(same.alias("tid"), F.lit(0.0).alias("b"), F.lit(0.0).alias("t"), F.lit(1).alias("copies"))
    tid, base, of, mb, mt = fresh(docs, "tid", "base", "of", "more_b", "more_t")
    sums = more.unionByName(copies).groupBy("tid").agg(*[F.sum(c).alias(c) for c in ("b", "t", "copies")]).select(
        F.col("tid").alias(of), (F.col("b") / F.col("copies")).alias(mb), (F.col("t") / F.col("copies")).alias(mt)
    ).hint("merge")

    @F.arrow_udf(returnType="n bigint, b double, t double")
    def scored(texts: pa.Array) -> pa.Array:
        hashes_of, (entries, values) = WordHashes(), _often(name, shared)
        rows = [hashes_of(words_of(t.as_py())) for t in texts]
        sums = [values[_places(keys_of(h), entries)].sum(axis=0) + len(h) * np.array(unknown) for h in rows]
        pick = lambda k: pa.array([float(x[k]) for x in sums], pa.float64())
        return pa.StructArray.from_arrays([pa.array(list(map(len, rows)), pa.int64()), pick(0), pick(1)], names=["n", "b", "t"])

    read = docs.withColumn(tid, same).withColumn(base, scored.asNondeterministic()(bytes_of(F.col(text))))
    joined = read.join(sums, F.col(tid) == F.col(of), "left")
    n = F.col(base)["n"]
    loss = lambda c, m: F.when(n > 0, F.round(-(F.col(base)[c] + F.coalesce(F.col(m), F.lit(0.0))) / n, DIGITS))
    b, t = loss("b", mb), loss("t", mt)
    made = F.struct(n.alias("n_tokens"), b.alias("loss_background"), t.alias("loss_target"), F.round(t - b, DIGITS).alias("score"))
    return joined.withColumn(out, made).drop(tid, base, of, mb, mt)
