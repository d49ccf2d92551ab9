"""Near-duplicate classes with Order MinHash, verified by banded alignment.

The words of a text give five-word shingles, each labelled with its occurrence number. Each of ``SKETCHES``
hash functions takes the ``PICKED`` labelled shingles of smallest hash and keeps them in text order, so a
sketch is shared by texts that share those shingles in the same order. Texts that share a sketch are
candidates; a pair is a link if the longest common subsequence L of its words, computed bit-parallel in a
band, gives 2 L / (n1 + n2) >= ``SIMILARITY``. Texts whose five-word shingles are 0.8 similar share a sketch
but for about one pair in ten million; of less similar ones that still align, most do.

Copies (the same words, or the same text if it has none) are one text from the start. Inside a bucket no
pairs are emitted: all members are compared with the bucket's leader, the member whose sketches are the most
common ones; the next leader comes from those that are no links of one so far. What the leaders link are first
classes. After ``ROUNDS`` rounds, and others while these close a tenth of the open members, each member is compared with
its neighbours by length if they are of another class. The texts of buckets that still hold several classes then
go through an exact similarity join: words are labelled by occurrence and ordered by rarity;
L >= 0.4 (n1 + n2) means that as many labelled words are shared, so the two share one among the first n + 1 - 0.4 (n1 + n2)
of each, and only pairs of different classes that meet so, and whose sets of words allow it, are aligned. So two texts that share a sketch are linked, or
linked by others, if they are similar, however crowded the bucket. Links become classes by alternating star
contraction, all as shuffles of number pairs.

Defined results: null and empty texts are no copies of one another, each is a class of its own; texts of
fewer than five words have one shingle; a repeated row is a copy; extra columns stay untouched; documents are
told apart by their text, so rows that share an id may have different classes; the class of texts that have null
ids only is null. A text is known by 64 bits of its words.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from serploom.llm.common import WordHashes, bytes_of, fresh, landed, mixed, windows_hash, words_of

SHINGLE = 5
PICKED = 2
SKETCHES = 16
SIMILARITY = 0.8
#: leader rounds at least, and the share of open members above which more of them close too few
ROUNDS = 2
CLOSING = 0.9
#: parts of a bucket that are put in order apart, so that a crowded one is not sorted in one task
CHAINS = 8
#: bits that tell words apart in a first comparison
BITS = 1024
#: a text's length is at most so many times that of a shorter one it is similar to
RATIO = SIMILARITY / (2 - SIMILARITY)

_SEEDS = mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def labelled(h: np.ndarray) -> np.ndarray:
    """Hashes with the number of their occurrence so far mixed in."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    if (s[1:] == s[:-1]).any():
        first = np.concatenate([[True], s[1:] != s[:-1]])
        start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
        number = np.empty(len(s), np.uint64)
        number[order] = (np.arange(len(s)) - start).astype(np.uint64)
        h = np.where(number > 0, mixed(h + number), h)
    return h


def labelled_shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles in text order, each with its occurrence number mixed in."""
    if not len(hashes):
        return hashes
    h = windows_hash(hashes, SHINGLE) if len(hashes) >= SHINGLE else windows_hash(hashes, len(hashes))
    return labelled(h)


def sketches(labelled: np.ndarray) -> np.ndarray:
    """One value per hash function: the picked shingles of smallest hash, in text order."""
    if not len(labelled):
        return np.empty(0, np.uint64)
    picked = min(PICKED, len(labelled))
    out = np.empty(SKETCHES, np.uint64)
    with np.errstate(over="ignore"):
        for i, seed in enumerate(_SEEDS):
            h = (labelled ^ seed) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            at = np.sort(np.argpartition(h, picked - 1)[:picked]) if len(h) > picked else np.arange(picked)
            value = seed
            for x in labelled[at]:
                value = (value ^ x) * np.uint64(0x9FB21C651E98DF25)
                value ^= value >> np.uint64(28)
            out[i] = value
    return out


def common_subsequence(a: list, b: list, band: int) -> int:
    """Length of the longest common subsequence, of alignments inside the band ``|i - j| <= band``."""
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    same, a, b = i, a[i:], b[i:]
    i = 0
    while i < len(a) and i < len(b) and a[-1 - i] == b[-1 - i]:
        i += 1
    same += i
    if i:
        a, b = a[:-i], b[:-i]
    if not a or not b:
        return same
    places: dict = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    n = len(a)
    if n <= 2 * band + 1 or n <= 4096:  # the band covers all of it, or wider costs less
        full = (1 << n) - 1
        v = full
        for x in b:
            m = places.get(x, 0)
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & full
        return same + n - v.bit_count()
    low, done, v, width = 0, 0, 0, 0
    for j, x in enumerate(b):
        if (shift := max(0, j - band) - low) > 0:
            gone = min(shift, width)
            done += gone - (v & ((1 << gone) - 1)).bit_count()
            v >>= gone
            width -= gone
            low += shift
        if (reach := min(n, j + band + 1)) > low + width:
            v |= ((1 << (reach - low - width)) - 1) << width
            width = reach - low
        if width <= 0:
            break
        full = (1 << width) - 1
        u = v & (places.get(x, 0) >> low) & full
        v = ((v + u) | (v - u)) & full
    return same + done + width - v.bit_count()


def distance(a: list, b: list) -> int:
    """Words to delete and insert, n1 + n2 - 2 L; the pair's own sum if it can't be similar."""
    return bounds(a, b)[0]


def bounds(a: list, b: list) -> tuple[int, int]:
    """``distance`` and a lower bound of the true n1 + n2 - 2 L, which it exceeds where the alignment is left out or banded."""
    total, least = len(a) + len(b), abs(len(a) - len(b))
    if 2 * min(len(a), len(b)) < SIMILARITY * total:
        return total, least
    limit = int((1 - SIMILARITY) * total + 1e-9)
    d = total - 2 * common_subsequence(a, b, limit + 1)
    if d <= limit or len(a) <= 4096:  # every alignment of a link stands in the band
        return d, d
    return d, max(least, limit + 1)


def text_id(raw: bytes, words: list[bytes]) -> int | None:
    """64 bits of the words, or of the text if it has none; null for an empty text."""
    return xxhash.xxh3_64_intdigest(b" ".join(words) if words else b"\n" + raw) - 2**63 if raw else None


@F.arrow_udf(returnType=LongType())
def _text_id(texts: pa.Array) -> pa.Array:
    return pa.array([text_id(t.as_py(), words_of(t.as_py())) for t in texts], pa.int64())


def sketched(text: Column) -> Column:
    """Struct of a text: its id (of its words; null without any character), number of words, sketches."""

    @F.arrow_udf(returnType="struct<tid:bigint,n:bigint,keys:array<bigint>>")
    def measured(texts: pa.Array) -> pa.Array:
        hashes_of = WordHashes()
        same, counts, keys = [], [], []
        for t in texts:
            raw = t.as_py()
            words = words_of(raw)
            same.append(text_id(raw, words))
            counts.append(len(words))
            keys.append(sketches(labelled_shingles(hashes_of(words))).view(np.int64))
        sizes = np.cumsum([0, *map(len, keys)])
        flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
        return pa.StructArray.from_arrays(
            [pa.array(same, pa.int64()), pa.array(counts, pa.int64()),
             pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int64()))],
            names=["tid", "n", "keys"],
        )

    return measured.asNondeterministic()(bytes_of(text))


@F.arrow_udf(returnType=StructType([StructField("d", LongType()), StructField("least", LongType())]))
def _distances(a: pa.Array, b: pa.Array) -> pa.Array:
    found = [bounds(words_of(x.as_py()), words_of(y.as_py())) for x, y in zip(a, b, strict=True)]
    return pa.StructArray.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["d", "least"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) with their distance, its lower bound and whether they are links."""
    left = texts.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("body").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("body").alias("tb"))
    joined = pairs.join(left, "a").join(right, "b")
    total = F.col("na") + F.col("nb")
    return joined.select("a", "b", "na", "nb", _distances("ta", "tb").alias("m")).select("a", "b", "na", "nb", "m.d", "m.least").withColumn(
        "link", F.col("d") <= (1 - SIMILARITY) * total + 1e-9
    )


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


@F.arrow_udf(returnType=StructType([StructField("words", ArrayType(LongType())), StructField("bits", ArrayType(LongType()))]))
def _labelled_words(texts: pa.Array) -> pa.Array:
    """Hashes of a text's labelled words, and which of ``BITS`` bits they set."""
    hashes_of, words, bits = WordHashes(), [], []
    for t in texts:
        h = labelled(hashes_of(words_of(t.as_py())))
        table = np.zeros(BITS, np.uint8)
        table[(h % np.uint64(BITS)).astype(np.int64)] = 1
        words.append(h.view(np.int64))
        bits.append(np.packbits(table, bitorder="little").view(np.int64))
    lists = []
    for of in (words, bits):
        sizes = pa.array(np.cumsum([0, *map(len, of)]), pa.int32())
        lists.append(pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(of) if of else np.empty(0, np.int64), pa.int64())))
    return pa.StructArray.from_arrays(lists, names=["words", "bits"])


def _size(n: str) -> Column:
    """Class of a length: two texts of like length are in one class or in neighbours."""
    return F.floor(F.log(n) / float(-np.log(RATIO)))


def similar_pairs(open_texts: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a < b) of different classes that can be links, no link left out. open_texts: id, n, root; texts: id, body.

    Both sides carry only the words of which a link shares one: the shorter text as many as any partner of its length or more
    asks for, the longer as many as its shortest partner does, and the pair's own lengths decide in the join. Lengths
    meet by classes whose width is the largest ratio of two similar lengths, so a text looks into its own and the next."""
    read = landed(open_texts.join(texts.select("id", "body"), "id").select("id", "n", "root", _labelled_words("body").alias("w")).select("id", "n", "root", "w.*"), "dup-words")
    words = read.select("id", "n", F.explode("words").alias("word"))
    # counted in place: every word stays beside its text, so nothing is joined
    counted = words.withColumn("df", F.count("*").over(Window.partitionBy("word")))
    order = Window.partitionBy("id").orderBy("df", "word")
    least = lambda share: F.expr(f"n + 1 - ceil({share}D * n - 1e-9)")
    # words of one text alone take the first places and meet nobody
    shared = counted.withColumn("k", F.row_number().over(order)).filter("df > 1")
    first = shared.filter(F.col("k") <= least(RATIO)).select("id", "word", "k").join(read.select("id", "n", "root", "bits"), "id")
    first = landed(first.withColumn("size", _size("n")), "dup-prefixes")
    x = first.filter(F.col("k") <= least(SIMILARITY)).alias("x")
    y = first.withColumn("size", F.explode(F.array(F.col("size"), F.col("size") - 1))).alias("y")
    shared = f"ceil({SIMILARITY / 2}D * (x.n + y.n) - 1e-9)"
    # a bit that the other text does not set is a word, or more, that it does not have
    lacks = lambda a, b: " + ".join(f"bit_count({a}.bits[{i}] & ~{b}.bits[{i}])" for i in range(BITS // 64))
    met = x.join(y, (F.col("x.word") == F.col("y.word")) & (F.col("x.size") == F.col("y.size")) & F.expr(
        f"(x.n < y.n or x.n = y.n and x.id < y.id) and x.root <> y.root and x.k <= x.n + 1 - {shared} and y.k <= y.n + 1 - {shared}"
        f" and {lacks('x', 'y')} <= x.n - {shared} and {lacks('y', 'x')} <= y.n - {shared}"
    ))
    return met.select(*_pair(F.col("x.id"), F.col("y.id"))).distinct()


def linked(texts: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between different texts, and the classes (id, root) they make. texts: id, n, body; keys: id, n, bucket, size of the bucket."""
    central = keys.groupBy("id").agg(F.sum("size").alias("central"))
    members = landed(keys.select("bucket", "id", "n").join(central, "id"), "dup-members")
    active, tried, rounds, left, all_leaders = members, None, 0, members.count(), []
    while True:
        leaders = landed(active.groupBy("bucket").agg(F.max(F.struct("central", "id")).alias("top")).select("bucket", F.col("top.id").alias("leader")), "dup-leaders")
        all_leaders.append(leaders)
        # a leader meets all members, so that what several leaders are linked to joins their classes
        pairs = members.join(leaders, "bucket").filter("id <> leader").select(*_pair(F.col("id"), F.col("leader"))).distinct()
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        done = landed(_verified(pairs, texts), "dup-pairs")
        tried = done if tried is None else tried.unionByName(done)
        # what stays open: members that are no links of a leader
        met = active.join(leaders, "bucket").filter("id <> leader").select("bucket", "id", "n", "central", *_pair(F.col("id"), F.col("leader")))
        rest = met.join(tried.filter("link").select("a", "b"), ["a", "b"], "left_anti").drop("a", "b")
        several = rest.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
        active = landed(rest.join(several.select("bucket"), "bucket", "left_semi"), "dup-open")
        rounds, before, left = rounds + 1, left, active.count()
        if not left or rounds >= ROUNDS and left > CLOSING * before:
            break
    links = tried.filter("link").select("a", "b")
    known = members.select("bucket", "id", "n").join(components(links), "id", "left").withColumn("root", F.coalesce("root", "id"))
    # leaders have met all members of their buckets
    led = landed(reduce(DataFrame.unionByName, all_leaders).distinct(), "dup-led")
    rest = landed(known.join(led.withColumnRenamed("leader", "id"), ["bucket", "id"], "left_anti").withColumn("size", _size("n")), "dup-rest")
    roots = known.select("id", "root").distinct()
    # neighbours by length first: a member has as many of them as it has buckets, so a large class takes in most of what belongs to it
    order = Window.partitionBy("bucket", F.pmod(F.xxhash64("id"), F.lit(CHAINS))).orderBy("n", F.xxhash64("bucket", "id"))
    chained = rest.select("id", "root", *[F.lag(c, k).over(order).alias(f"{c}{k}") for c in ("id", "root") for k in (1, 2)])
    beside = [chained.filter(f"root <> root{k}").select(*_pair(F.col("id"), F.col(f"id{k}"))) for k in (1, 2)]
    done = landed(_verified(beside[0].unionByName(beside[1]).distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti"), texts), "dup-beside")
    tried, more = tried.unionByName(done), done.filter("link").select("a", "b")
    links, roots = links.unionByName(more), landed(_merged(roots, more), "dup-roots")
    # of the others, those that have a text of another class and like length beside them
    rest = rest.drop("root").join(roots, "id")
    near = rest.select("bucket", F.explode(F.array(F.col("size") - 1, "size", F.col("size") + 1)).alias("size"), "root")
    several = near.groupBy("bucket", "size").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    still = landed(rest.join(several.select("bucket", "size"), ["bucket", "size"], "left_semi").select("id", "n", "root").distinct(), "dup-still")
    more = similar_pairs(still, texts).join(tried.select("a", "b"), ["a", "b"], "left_anti")
    more = landed(_verified(more, texts), "dup-more").filter("link").select("a", "b")
    return links.unionByName(more), _merged(roots, more)


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Classes (id, root) after further links between their members; only the classes that are linked are contracted."""
    ends = links.join(roots.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
    above = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("id").alias("root"), F.col("root").alias("top"))
    return roots.join(above, "root", "left").select("id", F.coalesce("top", "root").alias("root"))


def links_of(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The links of ``linked``."""
    return linked(texts, keys)[0]


def components(links: DataFrame) -> DataFrame:
    """Smallest id of each node's component: (id, root), for nodes with links. Large and small stars in turn."""
    edges = landed(links.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "dup-edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = landed(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "dup-large")
        least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        linked = down.join(least, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        after = landed(small.distinct(), "dup-small")
        # done when no node has two parents and no parent has one of its own
        parents = after.select(F.col("v").alias("p"))
        if after.join(parents, after.u == parents.p, "left_semi").isEmpty() and after.groupBy("u").count().filter("count > 1").isEmpty():
            return after.select(F.col("u").alias("id"), F.col("v").alias("root"))
        edges = after


def _classified(docs: DataFrame, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc, tid), tid null for texts without a character, and one row per text: tid, root, class_id, n_copies, n_links."""
    rows = docs.select(F.col(id).alias("doc"), F.col(text).alias("body"))
    marked = rows.select("doc", sketched(F.col("body")).alias("s")).select("doc", "s.tid", "s.n", "s.keys")
    narrow = landed(marked, "dup-docs")
    # one text per set of copies; its keys and its body come from its smallest document
    owners = landed(narrow.filter("tid is not null").groupBy("tid").agg(F.min("doc").alias("doc"), F.count("*").alias("copies")), "dup-texts")
    first = narrow.join(owners.select("tid", "doc"), ["tid", "doc"], "left_semi").filter("n > 0")
    keys = first.select(F.col("tid").alias("id"), "n", F.explode("keys").alias("bucket")).distinct()
    shared = keys.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    keys = landed(keys.join(shared, "bucket"), "dup-keys")
    wanted = keys.select("id", "n").distinct().join(owners.select(F.col("tid").alias("id"), "doc"), "id")
    texts = landed(
        rows.join(wanted, "doc").select("id", "n", bytes_of(F.col("body")).alias("body")).filter(_text_id("body") == F.col("id")).dropDuplicates(["id"]),
        "dup-bodies",
    )
    links, roots = linked(texts, keys)
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    members = owners.join(roots, owners.tid == roots.id, "left").select("tid", "doc", "copies", F.coalesce("root", "tid").alias("root"))
    smallest = members.groupBy("root").agg(F.min("doc").alias("class_id"))
    named = members.join(smallest, "root").join(degree, members.tid == degree.id, "left").select(
        "tid", "root", "class_id", F.col("copies").alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    return narrow.select("doc", "tid"), named


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, class_id (smallest id of its class), n_copies of its text, n_links.

    n_links is the number of verified links found with other texts: members that both link to a leader need not be
    compared, so it is no count of all similar texts and depends on which leaders were drawn."""
    narrow, named = _classified(docs, id, text)
    # texts without a character stay alone; they are dealt by their id so that they don't meet in one task
    key = fresh(narrow, "deal")[0]
    left = narrow.select("doc", "tid", F.coalesce("tid", F.xxhash64("doc")).alias(key))
    out = left.join(named.select(F.col("tid").alias("of"), "class_id", "n_copies", "n_links"), (F.col(key) == F.col("of")) & F.col("tid").isNotNull(), "left")
    return out.select(
        F.col("doc").alias(id), F.coalesce("class_id", "doc").alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class stays, with its own columns only: the one of smallest id (null last), then of smallest text number.

    Decided by text, not by id: rows that share an id stay if their texts do, and of rows equal in both one stays. Texts
    without a character all stay."""
    narrow, named = _classified(docs, id, text)
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "tid")
    of, one = fresh(docs, "tid", "one")
    kept = landed(narrow.join(named.select("tid", "root"), "tid").groupBy("root").agg(F.min(place).alias("first")).select(F.col("first.tid").alias(of)), "dup-kept")
    told = docs.withColumn(of, _text_id.asNondeterministic()(bytes_of(F.col(text))))
    # one row of each text is left before anything travels, and the classes are met on the same key
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]  # others have no hash
    order = Window.partitionBy(of).orderBy(F.asc_nulls_last(id), F.xxhash64(*plain))
    single = told.filter(F.col(of).isNotNull()).withColumn(one, F.row_number().over(order)).filter(F.col(one) == 1)
    return single.join(kept, of, "left_semi").select(*docs.columns).unionByName(told.filter(F.col(of).isNull()).select(*docs.columns))
