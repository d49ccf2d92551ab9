"""Ranked lexical search over norm buckets, in the manner of LEMP.

Documents and items are sparse vectors over the items' terms. With the term weights w and impacts of the ranking, a
document's coordinate is sqrt(w) * impact and an item's is sqrt(w) * its count of the term, so that the inner product is
the score. Documents are sorted by the length of their vectors and stand in files of falling length; a task reads
them as buckets of up to BUCKET documents.

Pruning, each step exact for a given least score that an item still asks for:

- Cauchy-Schwarz: a bucket is skipped when its longest document times the item's length stays below it. The least length
  any item asks for is pushed to the scan as well, so files of short documents are never read.
- Coordinates: the item's largest coordinates are taken until the rest of the item, times the longest document, stays below
  it; a document outside the lists of these terms cannot reach it. For the others, what the coordinates seen give plus what
  the unseen rest of both vectors allows must reach it.
- Survivors are scored in 64-bit integers over all their terms.

The longest documents (HEAD of all) go first; each item's k-th score among them is the least score for all others. Within a
task it rises further. Equal scores are never pruned, so ties are decided by ascending id alone.

Items are taken in blocks of some BLOCK_WORDS words, each block against all documents. A block's vocabulary, weights and
items are broadcast; their size is bounded by the block (one item is never split, it is one cell).

Defined results: terms are lower-cased words (A-Z only); null and empty texts have none, such documents count nowhere and such
items have no rows. Repeated documents are ranked each by itself, ids that are null come last among equal scores; item rows of equal
id and text are one item, those that share an id only are ranked each by itself. Extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from serploom.llm.common import LOWER, UPPER, WORD_PATTERN, bytes_of, landed, words_of
from serploom.session import ensure_checkpoint_dir

#: documents of a bucket; words and items of a block; share of the documents that set the least scores
BUCKET = 4096
BLOCK_WORDS, BLOCK_ITEMS = 200_000, 5_000
HEAD = 1 / 64
#: what rounding may take from a bound
SLACK = 1 - 1e-9

_VOCABULARIES: dict[str, dict[bytes, int]] = {}


def weight(n_documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_documents: int, n_terms: int) -> np.ndarray:
    m = 75 + (25 * n_documents * n) // max(1, n_terms)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Items:
    """Vectors of a block's items: terms by falling coordinate, and how long what follows each of them is."""

    def __init__(self, counts: list[dict[int, int]], weights: np.ndarray):
        self.weights, self.roots = weights, np.sqrt(weights.astype(float))
        self.terms, self.whole, self.coordinates, self.rest = [], [], [], []
        for of in counts:
            t = np.array([x for x in of if weights[x] > 0], np.int64)
            c = np.array([of[x] for x in t.tolist()], np.int64)
            q = c * self.roots[t] if len(t) else np.empty(0)
            order = np.argsort(-q, kind="stable")
            t, c, q = t[order], c[order], q[order]
            self.terms.append(t)
            self.whole.append(c * weights[t] if len(t) else c)
            self.coordinates.append(q)
            self.rest.append(np.sqrt(np.append(np.cumsum((q * q)[::-1])[::-1], 0.0)))


class Bucket:
    """Documents of about one length, as rows and as inverted lists."""

    def __init__(self, items: Items, terms: np.ndarray, impact: np.ndarray, sizes: np.ndarray, length: np.ndarray):
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.terms, self.impact, self.length, self.longest = terms, impact, length, float(length.max(initial=0.0))
        order = np.argsort(terms, kind="stable")
        self.documents = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.values = (items.roots[terms] * impact)[order]
        self.bounds = np.append(0, np.cumsum(np.bincount(terms, minlength=len(items.weights))))

    def candidates(self, items: Items, i: int, least: int) -> np.ndarray:
        """Documents whose score with item i may reach ``least``."""
        rest, floor = items.rest[i], least * SLACK
        if rest[0] * self.longest < floor:
            return np.empty(0, np.int64)
        # rest falls; the first place where the rest alone is too short
        taken = int(np.searchsorted(-rest * self.longest, -floor, side="right")) if least > 0 else len(rest) - 1
        taken = min(taken, len(rest) - 1)
        got, seen = np.zeros(len(self.sizes)), np.zeros(len(self.sizes))
        for t, q in zip(items.terms[i][:taken].tolist(), items.coordinates[i][:taken].tolist(), strict=True):
            a, b = self.bounds[t], self.bounds[t + 1]
            d, v = self.documents[a:b], self.values[a:b]
            got[d] += q * v
            seen[d] += v * v
        most = got + rest[taken] * np.sqrt(np.maximum(self.length * self.length - seen, 0.0))
        return np.flatnonzero((seen > 0) & (most >= floor))

    def scores(self, items: Items, i: int, documents: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact scores; ``dense`` is a row of zeros as long as the vocabulary and is so again afterwards."""
        sizes = self.sizes[documents]
        ends = np.cumsum(sizes)
        at = np.arange(int(sizes.sum())) - np.repeat(ends - sizes, sizes) + np.repeat(self.starts[documents], sizes)
        dense[items.terms[i]] = items.whole[i]
        each = dense[self.terms[at]] * self.impact[at]
        dense[items.terms[i]] = 0
        return np.add.reduceat(each, ends - sizes) if len(documents) else np.empty(0, np.int64)


class Best:
    """The k best (score, id) of each item, and the least score it still asks for."""

    def __init__(self, k: int, least: list[int]):
        self.k, self.least, self.rows = k, list(least), [[] for _ in least]

    def add(self, items: Items, bucket: Bucket, ids: list, order: np.ndarray) -> None:
        """``order``: place of each document among the bucket's ids."""
        dense = np.zeros(len(items.weights), np.int64)
        for i, least in enumerate(self.least):
            if not len(items.terms[i]):
                continue
            found = bucket.candidates(items, i, least)
            if not len(found):
                continue
            scores = bucket.scores(items, i, found, dense)
            good = scores >= max(1, least)
            found, scores = found[good], scores[good]
            if len(found) > self.k:
                first = np.lexsort((order[found], -scores))[: self.k]
                found, scores = found[first], scores[first]
            if len(found):
                fresh = [(-s, ids[d] is None, 0 if ids[d] is None else ids[d]) for s, d in zip(scores.tolist(), found.tolist(), strict=True)]
                self.rows[i] = sorted(self.rows[i] + fresh)[: self.k]
                if len(self.rows[i]) == self.k:
                    self.least[i] = max(least, -self.rows[i][-1][0])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def vectors(docs: DataFrame, vocabulary: list[bytes], id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n (all terms of the text), terms and tfs (those of the vocabulary, by number), of documents with a term."""
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf(returnType="n bigint, terms array<int>, tfs array<int>")
    def counted(texts: pa.Array) -> pa.Array:
        if key not in _VOCABULARIES:
            _VOCABULARIES.clear()
            _VOCABULARIES[key] = {w: i for i, w in enumerate(shared.value)}
        number = _VOCABULARIES[key].get
        n, terms, tfs = [], [], []
        for t in texts:
            words = words_of(t.as_py())
            of = Counter(map(number, words))
            of.pop(None, None)
            n.append(len(words))
            terms.append(list(of))
            tfs.append(list(of.values()))
        lists = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(terms, lists), pa.array(tfs, lists)], names=["n", "terms", "tfs"])

    v = docs.select(F.col(id).alias("id"), counted.asNondeterministic()(bytes_of(F.col(text))).alias("v"))
    return v.select("id", "v.*").filter("n > 0")


def by_length(table: DataFrame, weights: np.ndarray, n_documents: int, n_terms: int) -> DataFrame:
    """Vectors with their length, in files of falling length; those of length 0 can't be found and go."""

    @F.arrow_udf(returnType="double")
    def length(n: pa.Array, terms: pa.Array, tfs: pa.Array) -> pa.Array:
        t, sizes = _flat(terms)
        tf, _ = _flat(tfs)
        impact = impacts(tf, np.repeat(n.to_numpy(zero_copy_only=False).astype(np.int64), sizes), n_documents, n_terms).astype(float)
        row = np.repeat(np.arange(len(sizes)), sizes)
        return pa.array(np.sqrt(np.bincount(row, weights[t] * impact * impact, minlength=len(sizes))), pa.float64())

    # the row number parts documents of equal length, however many there are
    measured = table.withColumn("length", length.asNondeterministic()("n", "terms", "tfs")).filter("length > 0")
    return landed(measured.repartitionByRange(F.desc("length"), F.asc("row")).sortWithinPartitions(F.desc("length")), "by-length")


def searched(table: DataFrame, counts: list[dict[int, int]], weights: np.ndarray, n_documents: int, n_terms: int, k: int, least: list[int]) -> DataFrame:
    """item (number), id, score: the k best of each task, at least ``least``."""
    shared = table.sparkSession.sparkContext.broadcast((counts, weights, least))
    kind = table.schema["id"].dataType.simpleString()

    def search(batches):
        counts, weights, least = shared.value
        items, best, kind = Items(counts, weights), Best(k, least), pa.int64()
        for batch in batches:
            kind = batch.schema.field("id").type
            for at in range(0, batch.num_rows, BUCKET):
                part = batch.slice(at, BUCKET)
                terms, sizes = _flat(part["terms"])
                tf, _ = _flat(part["tfs"])
                n = part["n"].to_numpy(zero_copy_only=False).astype(np.int64)
                bucket = Bucket(items, terms, impacts(tf, np.repeat(n, sizes), n_documents, n_terms), sizes, part["length"].to_numpy(zero_copy_only=False))
                order = np.empty(part.num_rows, np.int64)
                order[pc.sort_indices(part["id"], null_placement="at_end").to_numpy()] = np.arange(part.num_rows)
                best.add(items, bucket, part["id"].to_pylist(), order)
        rows = [(i, None if none else id, -s) for i, of in enumerate(best.rows) for s, none, id in of]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], kind), pa.array(columns[2], pa.int64())], names=["item", "id", "score"])

    return table.select("id", "n", "terms", "tfs", "length").mapInArrow(search, f"item int, id {kind}, score bigint")


def top(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item with their rank."""
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def search_block(docs: DataFrame, texts: list[bytes], k: int, id: str, text: str) -> DataFrame:
    """item (place in ``texts``), id, score, rank."""
    words = [words_of(t) for t in texts]
    vocabulary = sorted({w for of in words for w in of})
    number = {w: i for i, w in enumerate(vocabulary)}
    counts = [dict(Counter(number[w] for w in of)) for of in words]
    table = landed(vectors(docs, vocabulary, id, text).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n_documents, n_terms = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = table.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()  # a row for each word of the block at most
    weights = np.zeros(max(1, len(vocabulary)), np.int64)
    for t, n in zip(df["t"].to_pylist(), df["count"].to_pylist(), strict=True):
        weights[t] = weight(n_documents, n)
    table = by_length(table, weights, n_documents, n_terms)
    cut = table.agg(F.percentile_approx("length", 1 - HEAD, 1000)).first()[0] or 0.0
    run = lambda part, least: searched(part, counts, weights, n_documents, n_terms, k, least)
    head = landed(top(run(table.filter(F.col("length") >= cut), [0] * len(texts)), k), "best-of-head")
    least = [0] * len(texts)
    for r in head.filter(F.col("rank") == k).select("item", "score").collect():  # a row for each item of the block at most
        least[r.item] = r.score
    items = Items(counts, weights)
    asked = [least[i] / items.rest[i][0] for i in range(len(texts)) if len(items.terms[i])]
    rest = table.filter((F.col("length") < cut) & (F.col("length") >= min(asked, default=0.0) * SLACK))
    return top(head.drop("rank").unionByName(run(rest, least)), k)


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Item, rank (int, from 1), id and score of the k documents with the highest scores above 0 of each item."""
    spark = docs.sparkSession
    found = f"{ensure_checkpoint_dir(spark)}/ranked-{uuid.uuid4().hex}"
    words = F.size(F.regexp_extract_all(F.translate(F.col("text"), UPPER, LOWER), F.lit(WORD_PATTERN), F.lit(0)))
    asked = items.select(F.col(item).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).distinct()
    asked = landed(asked.withColumn("n", words).filter("n > 0").withColumn("number", F.monotonically_increasing_id()), "items")
    n_items, n_words = asked.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, -(-n_words // BLOCK_WORDS), -(-n_items // BLOCK_ITEMS))
    for b in range(blocks):
        of = asked.filter(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b).select("number", F.col("text").cast("binary").alias("text")).toArrow()
        numbers = spark.createDataFrame(list(enumerate(of["number"].to_pylist())), "item int, number bigint")
        best = search_block(docs, of["text"].to_pylist(), k, id, text)
        best.join(F.broadcast(numbers), "item").select("number", "id", "score", "rank").write.parquet(f"{found}/block-{b}")
    ranked = spark.read.parquet(*[f"{found}/block-{b}" for b in range(blocks)])
    return ranked.join(asked.select("number", "item_id"), "number").select(F.col("item_id").alias(item), "rank", F.col("id").alias(id), "score")
