"""Weighted reciprocal-rank fusion of many ranked lists per query.

Ranking needs numbers only. Votes are reduced to one row per (query, URL) with a number for each of the nine
providers, in a hash aggregation that is partial before its shuffle; families are bits, resale is bit tests against
one row of numbers per query. The ranking windows are both cut to their row limit on the map side. Titles and
texts are read again for the URLs that are left. A query that owns a third of all rows is spread by
its URLs; only the join with the row of its query, which AQE may split, and its ranked rows meet by query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serploom import dims
from serploom.functions.urls import bind
from serploom.session import landed

_OPTIONAL = {
    "snippet": "string",
    "content": "string",
    "published_at": "timestamp",
    "upstream_engines": "array<string>",
}


def attach_provider(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds the facts of each row's provider (nine fixed rows, broadcast)."""
    facts = dims.providers(df.sparkSession, weights).drop("display_name")
    return df.join(F.broadcast(facts), "provider")


def best_rank_votes(results: DataFrame, texts: bool = True) -> DataFrame:
    """One vote per (query, URL, provider): the row with the best rank, never below 1.

    Without ``texts`` a vote is its keys and its rank (and ``result_limit``, if there is one). The ranks of a URL's known
    providers then travel as one row of numbers, so its spelling is shuffled once and nothing is sorted.
    """
    if not texts:
        return _rank_votes(results)
    for name, kind in _OPTIONAL.items():
        if name not in results.columns:
            results = results.withColumn(name, F.lit(None).cast(kind))
    vote = F.struct(
        F.greatest("provider_rank", F.lit(1)).alias("rank"),
        "url",
        "title",
        *_OPTIONAL,  # a row without a snippet comes before one with an empty one
        "host",
    )
    keys = ["query_id", "canonical_url", "provider"]
    limits = [F.max("result_limit").alias("result_limit")] if "result_limit" in results.columns else []
    # strings can't be reduced in a hash aggregation; with a number in front, sorting compares numbers
    return results.groupBy(F.xxhash64(*keys).alias("_number"), *keys).agg(F.min(vote).alias("_vote"), *limits).select(
        *keys, "_vote.*", *(["result_limit"] if limits else [])
    )


def _rank_votes(results: DataFrame) -> DataFrame:
    known = [p[0] for p in dims.PROVIDERS]
    numbers = {"rank": F.min}
    if "result_limit" in results.columns:
        numbers["result_limit"] = F.max
    rows = results.withColumn("rank", F.greatest("provider_rank", F.lit(1)))
    # a provider that is not listed, or none, is a key of its own
    listed = F.coalesce(F.col("provider").isin(*known), F.lit(False))
    rows = rows.select("query_id", "canonical_url", "provider", listed.alias("_listed"), F.when(~listed, F.col("provider")).alias("_other"), *numbers)

    def slot(name: str, which: Column) -> list[Column]:
        return [f(F.when(which, F.col(c))).alias(f"_{c}_{name}") for c, f in numbers.items()]

    slots = [x for i, p in enumerate(known) for x in slot(str(i), F.col("provider") == p)] + slot("other", ~F.col("_listed"))
    wide = rows.groupBy("query_id", "canonical_url", "_listed", "_other").agg(*slots)

    def vote(name: str, provider: Column) -> Column:
        # a rank is never null, so its slot tells whether the provider voted
        return F.when(F.col(f"_rank_{name}").isNotNull(), F.struct(provider.alias("provider"), *[F.col(f"_{c}_{name}").alias(c) for c in numbers]))

    votes = [vote(str(i), F.lit(p)) for i, p in enumerate(known)] + [vote("other", F.col("_other"))]
    return wide.select("query_id", "canonical_url", F.explode(F.array_compact(F.array(*votes))).alias("_vote")).select(
        "query_id", "canonical_url", "_vote.*"
    )


def owned_families(responses: DataFrame) -> DataFrame:
    """Per query: families of the direct providers that answered, even with no rows."""
    facts = attach_provider(responses)
    return facts.filter(~F.col("is_aggregator")).select("query_id", "family").distinct()


# --- scores on columns of fixed width -----------------------------------------------------------------
_FAMILIES = sorted({p[2] for p in dims.PROVIDERS} | set(dims.INDEPENDENT_FAMILIES))
_INDEPENDENT_BITS = sum(1 << _FAMILIES.index(f) for f in dims.INDEPENDENT_FAMILIES)
#: what a row says of its engines is a number below 256; this one says that it names none
_UNNAMED = 255
_AGGREGATORS = [p[0] for p in dims.PROVIDERS if p[3]]


def _vote(provider: str) -> str:
    return f"_vote_{provider}"


def _family_bit(provider: Column) -> Column:
    """Bit of a direct provider's family, 0 for aggregators."""
    bit = F.lit(0)
    for name, _, family, aggregator, *_ in dims.PROVIDERS:
        if not aggregator:
            bit = F.when(provider == name, F.lit(1 << _FAMILIES.index(family))).otherwise(bit)
    return bit


def _offer(engines: Column) -> Column:
    """The independent families that a list of engines names, in order: three digits of base four, the first lowest."""

    def digit(engine: Column) -> Column:
        # as ``labels.engine_family``, with the family's number at once
        name, number = F.lower(engine), F.lit(0)
        for needle, family in reversed(dims.ENGINE_FAMILIES):
            independent = family in dims.INDEPENDENT_FAMILIES
            place = dims.INDEPENDENT_FAMILIES.index(family) + 1 if independent else 0
            number = F.when(name.contains(needle), F.lit(place)).otherwise(number)
        return number

    def coded(named: Column) -> Column:
        return sum((F.coalesce(F.try_element_at(named, F.lit(i + 1)), F.lit(0)) * 4**i for i in range(3)), F.lit(0))

    named = F.array_distinct(F.filter(F.transform(engines, digit), lambda n: n > 0))
    return F.when(engines.isNull(), F.lit(_UNNAMED)).when(F.size(engines) == 0, F.lit(0)).otherwise(bind(named, coded))


def _resold_bits() -> list[int]:
    """For each offer below 64 and each set of owned independent families: the bit of the first family of the offer that is owned, else 0."""
    bits = [1 << _FAMILIES.index(f) for f in dims.INDEPENDENT_FAMILIES]
    out = []
    for offer in range(64):
        named = [d - 1 for d in (offer & 3, offer >> 2 & 3, offer >> 4) if d]
        out += [next((bits[i] for i in named if owned >> i & 1), 0) for owned in range(1 << len(bits))]
    return out


def _independent(owned: Column) -> Column:
    """The independent families among the owned ones, as a number below eight."""
    places = [_FAMILIES.index(f) for f in dims.INDEPENDENT_FAMILIES]
    return sum((F.shiftright(owned, p).bitwiseAND(1) * (1 << i) for i, p in enumerate(places)), F.lit(0))


def _resold(offer: Column, independent: Column) -> Column:
    """Bit of the first family of an offer whose own index answered the query too, else 0.

    Looked up in a folded list: spelled out for every aggregator, the conditions make a method that the JVM no longer compiles."""
    table = F.array(*[F.lit(x) for x in _resold_bits()])
    return F.when(offer < 64, F.get(table, offer * 8 + independent)).otherwise(0)


def _best_votes(results: DataFrame) -> DataFrame:
    """One row per (query, URL): for each provider its best rank, with what the row said of its engines in the low byte.

    Keys may be strings in a hash aggregation as long as what is reduced has a fixed width, so nothing is sorted
    and no text travels. A host that is spelled out in its URL is read from there afterwards; only another one travels.
    """
    rank = F.greatest("provider_rank", F.lit(1)).cast("bigint")
    offer = F.lit(_UNNAMED)
    if "upstream_engines" in results.columns:
        offer = F.when(F.col("provider").isin(*_AGGREGATORS), _offer(F.col("upstream_engines"))).otherwise(0)
    keyed = results.select(
        "query_id", "canonical_url", "host", "provider", (rank * 256 + offer).alias("_vote"),
        *(["result_limit"] if "result_limit" in results.columns else []),
    ).filter(F.col("provider").isin(*[p[0] for p in dims.PROVIDERS]))
    limits = [F.max("result_limit").alias("result_limit")] if "result_limit" in results.columns else []
    spelled = F.col("canonical_url").startswith(F.concat(F.lit("https://"), "host", F.lit("/"))) & ~F.col("host").contains("/")
    keyed = keyed.withColumn("_spelled", F.coalesce(spelled, F.lit(False)))
    return keyed.groupBy("query_id", "canonical_url", "_spelled", F.when(~F.col("_spelled"), F.col("host")).alias("_other")).agg(
        *[F.min(F.when(F.col("provider") == p[0], F.col("_vote"))).alias(_vote(p[0])) for p in dims.PROVIDERS], *limits
    )


def _with_host(votes: DataFrame) -> DataFrame:
    spelled = F.substring_index(F.expr("substr(canonical_url, 9)"), "/", 1)
    return votes.withColumn("host", F.when(F.col("_spelled"), spelled).otherwise(F.col("_other"))).drop("_spelled", "_other")


def _query_context(responses: DataFrame) -> DataFrame:
    """One row of numbers per query: the families owned, and for each aggregator what its response said of its engines."""
    if "upstream_engines" not in responses.columns:
        responses = responses.withColumn("upstream_engines", F.lit(None).cast("array<string>"))
    said = F.when(F.col("provider").isin(*_AGGREGATORS), _offer(F.col("upstream_engines")))
    coded = responses.select("query_id", "provider", _family_bit(F.col("provider")).alias("_bit"), said.alias("_said"))
    return coded.groupBy("query_id").agg(
        F.bit_or("_bit").alias("_owned"), *[F.min(F.when(F.col("provider") == p, F.col("_said"))).alias(f"_said_{p}") for p in _AGGREGATORS]
    )


def scored_clusters(
    results: DataFrame,
    responses: DataFrame | None = None,
    weights: dict[str, float] | None = None,
    k: float = 60.0,
    independent_weight: float = 1.0,
    resold_weight: float = 0.7,
    scraper_weight: float = 1.0,
    votes: DataFrame | None = None,
) -> DataFrame:
    """One row per (query, URL): score, corroboration, families and best rank, with the votes as numbers.

    A row that names its engines, even an empty list, is judged by them; only a row without the list
    falls back to what the whole response said. Shuffles: one for the clusters, which are reduced before it, and
    one by query for what is known of it, a row of a few numbers, so AQE may split a query with many URLs. ``votes`` are
    the reduced rows, if they are there already.
    """
    votes = _best_votes(results) if votes is None else votes
    if responses is None:
        responses = results.select("query_id", "provider")
    df = votes.join(_query_context(responses), "query_id", "left")
    if "_spelled" in df.columns:
        df = _with_host(df)
    df = df.withColumn("_independent", _independent(F.coalesce("_owned", F.lit(0))))
    named, said = {}, {}
    for name in _AGGREGATORS:
        named[name] = _resold(F.col(_vote(name)).bitwiseAND(255).cast("int"), F.col("_independent"))
        said[name] = _resold(F.coalesce(f"_said_{name}", F.lit(_UNNAMED)), F.col("_independent"))
    df = df.withColumns({f"_named_{n}": x for n, x in named.items()} | {f"_by_{n}": x for n, x in said.items()})
    score, families, best, staged = F.lit(0.0), F.lit(0), [], {}
    for name, _, family, aggregator, scraper, _ in dims.PROVIDERS:
        vote = F.col(_vote(name))
        rank = F.shiftright(vote, 8)
        own = 1 << _FAMILIES.index(family)
        bit, resold = F.lit(own), F.lit(False)
        if aggregator:
            named = F.col(f"_named_{name}")
            bit = F.when(named != 0, named).otherwise(F.lit(own))
            by_response = F.col(f"_by_{name}")
            resold = F.when(vote.bitwiseAND(255) == _UNNAMED, by_response != 0).otherwise(named != 0)
        staged[f"_bit_{name}"] = F.when(vote.isNotNull(), bit).otherwise(0)
        weight = (
            F.lit((weights or {}).get(name, 1.0) * (scraper_weight if scraper else 1.0))
            * F.when(bit.bitwiseAND(_INDEPENDENT_BITS) != 0, F.lit(independent_weight)).otherwise(1.0)
            * F.when(resold, F.lit(resold_weight)).otherwise(1.0)
        )
        staged[f"_share_{name}"] = F.when(vote.isNotNull(), weight / (F.lit(k) + rank)).otherwise(0.0)
        score = score + F.col(f"_share_{name}")
        families = families.bitwiseOR(F.col(f"_bit_{name}"))
        best.append(rank)
    df = df.withColumns(staged).withColumns({"score": F.round(score, 12), "_families": families, "best_rank": F.least(*best).cast("int")})
    corroborated = (F.bit_count("_families") >= 2) & (F.col("_families").bitwiseAND(_INDEPENDENT_BITS) != 0)
    return df.withColumn("corroborated", corroborated).drop(
        *staged, "_owned", "_independent", *[f"{x}_{p}" for p in _AGGREGATORS for x in ("_said", "_named", "_by")]
    )


def with_sources(scored: DataFrame) -> DataFrame:
    """Votes as lists: ``sources``, best rank first, and ``families`` in order."""
    seen = F.array(*[
        F.when(F.col(_vote(p[0])).isNotNull(), F.struct(F.shiftright(_vote(p[0]), 8).alias("rank"), F.lit(p[5]).alias("place"), F.lit(p[0]).alias("provider")))
        for p in dims.PROVIDERS
    ])
    families = F.array_compact(F.array(*[F.when(F.col("_families").bitwiseAND(1 << i) != 0, F.lit(f)) for i, f in enumerate(_FAMILIES)]))
    return scored.withColumns(
        {"sources": F.transform(F.array_sort(F.array_compact(seen)), lambda x: x["provider"]), "families": families}
    ).drop("_families", *[_vote(p[0]) for p in dims.PROVIDERS])


def _longest(name: str) -> Column:
    """The longest value; the better ranked vote wins a tie."""
    candidate = F.struct(
        F.length(name), -F.col("rank"), -F.col("provider_order"), F.col(name).alias("text")
    )
    return F.max(F.when(F.col(name).isNotNull(), candidate))["text"]


def representatives(results: DataFrame) -> DataFrame:
    """What a cluster shows: title and URL of its best rank, the richest texts, the earliest date."""
    return _shown(attach_provider(best_rank_votes(results)))


#: what a cluster shows
SHOWN = ["title", "url", "snippet", "content", "published_at"]


def _shown(votes: DataFrame, *others: str, more: Sequence[Column] = ()) -> DataFrame:
    place = ["rank", "provider_order"]
    titled = F.when(F.col("title") != "", F.struct(*place, "title"))
    return votes.groupBy(*others, "query_id", "canonical_url").agg(
        F.min(titled)["title"].alias("title"),
        F.min(F.struct(*place, "url"))["url"].alias("url"),
        _longest("snippet").alias("snippet"),
        _longest("content").alias("content"),
        F.min("published_at").alias("published_at"),
        *more,
    )


# --- rows of the ranked URLs
_BLOCK_BITS, _MOST_BLOCKS = 32768, 1024


def _number_of(query: str, url: str) -> Column:
    return F.xxhash64(query, url)


def _places(number: Column) -> list[Column]:
    """Two bits of a number inside its block."""
    return [F.shiftrightunsigned(number, n).bitwiseAND(_BLOCK_BITS - 1) for n in (32, 48)]


def _marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose ``_number`` is marked by one of ``wanted``: all that it holds, and a few others.

    The marks are bits in blocks of 4 KB, at most 4 MB of them however many numbers are wanted; if they are very many, more
    rows pass, and the join behind drops them.
    """
    blocks = 1
    while blocks < _MOST_BLOCKS and blocks * _BLOCK_BITS < 16 * wanted.count():
        blocks *= 2
    block = F.col("_number").bitwiseAND(blocks - 1).alias("_block")
    marks = wanted.select(block, F.explode(F.array(*_places(F.col("_number")))).alias("_place"))
    marks = marks.groupBy("_block").agg(F.bitmap_construct_agg(F.col("_place")).alias("_bits"))
    # 32 bits to a number, the first byte highest
    words = F.transform(F.sequence(F.lit(0), F.lit(_BLOCK_BITS // 32 - 1)), lambda i: F.conv(F.hex(F.substring("_bits", i * 4 + 1, F.lit(4))), 16, 10).cast("bigint"))
    marks = marks.select("_block", words.alias("_words"))

    def marked(place: Column) -> Column:
        bit = (3 - F.shiftright(place, 3).bitwiseAND(3)) * 8 + place.bitwiseAND(7)
        return F.getbit(F.get(F.col("_words"), F.shiftright(place, 5).cast("int")), bit.cast("int")) == 1

    met = rows.withColumn("_block", block).join(F.broadcast(marks), "_block")
    first, second = _places(F.col("_number"))
    return met.filter(marked(first) & marked(second)).drop("_block", "_words")


def _shown_of(results: DataFrame, ranked: DataFrame) -> DataFrame:
    """The representatives of the ranked (query, URL) pairs, beside their ``ranked`` row.

    Rows are met by a number of their pair, which is never null: a URL that an inner join compares may not be null, and Catalyst asks
    for that below all of its stages, as one filter that spells the canonical form out again for every row. Rows that
    no ranked pair marks go before anything is shuffled; the others travel once, by that number, which every later step groups by.
    """
    for name, kind in _OPTIONAL.items():
        if name not in results.columns:
            results = results.withColumn(name, F.lit(None).cast(kind))
    keyed = ranked.filter("query_id is not null and canonical_url is not null")
    keyed = keyed.withColumnsRenamed({"query_id": "_query", "canonical_url": "_wanted"}).withColumn("_number", _number_of("_query", "_wanted"))
    rows = results.select(
        "query_id", "canonical_url", "provider", F.greatest("provider_rank", F.lit(1)).alias("rank"), "url", "title", "snippet", "content",
        "published_at", _number_of("query_id", "canonical_url").alias("_number"),
    )
    # no semi join here: Catalyst would put it below the marks, and every text would travel to meet it
    rows = _marked(rows, keyed.select("_number")).repartition("_number")
    vote = F.struct("rank", "url", "title", "snippet", "content", "published_at")
    votes = rows.groupBy("_number", "query_id", "canonical_url", "provider").agg(F.min(vote).alias("_vote")).select(
        "_number", "query_id", "canonical_url", "provider", "_vote.*"
    )
    shown = _shown(attach_provider(votes), "_number").withColumnRenamed("_number", "_of")
    same = F.coalesce((F.col("query_id") == F.col("_query")) & (F.col("canonical_url") == F.col("_wanted")), F.lit(False))
    return shown.join(keyed, (F.col("_number") == F.col("_of")) & same).select(*ranked.columns, *SHOWN)


def rank_clusters(scored: DataFrame, limit: int = 8, per_host: int = 2) -> DataFrame:
    """Ranked, host-diverse top of every query, numbered from 1.

    ``per_host`` of zero or less disables the host cap. With a ``result_limit`` column each query has
    its own limit. Filters that compare with a literal are applied by the optimizer before the
    shuffle too.
    """
    order = [F.desc("score"), F.desc("corroborated"), F.asc("best_rank"), F.asc("canonical_url")]
    if per_host > 0:
        by_host = Window.partitionBy("query_id", "host").orderBy(*order)
        scored = (
            scored.withColumn("_in_host", F.row_number().over(by_host))
            .filter(F.col("_in_host") <= per_host)
            .drop("_in_host")
        )
    personal = "result_limit" in scored.columns
    ranked = scored.withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    )
    if personal:
        return ranked.filter(F.col("rank") <= F.col("result_limit")).drop("result_limit")
    return ranked.filter(F.col("rank") <= limit)


def fuse(
    results: DataFrame,
    responses: DataFrame | None = None,
    limit: int = 8,
    per_host: int = 2,
    **weighting,
) -> DataFrame:
    """Fused results of every query.

    ``results(query_id, provider, provider_rank, title, url, canonical_url, host[, snippet, content,
    published_at, upstream_engines, result_limit])``; ``responses(query_id, provider[,
    upstream_engines])`` also names providers that answered with nothing, and is taken from the
    results when not given.

    Two passes over the results: ranking on numbers, then texts of the ranked URLs alone. The reduced votes and the few ranked
    rows are landed in the shared folder (jobs run when this is called), so the shuffles before them are gone when the next begin.
    """
    votes = landed(_best_votes(results), "votes")
    scored = scored_clusters(results, responses, votes=votes, **weighting)
    ranked = landed(with_sources(rank_clusters(scored, limit, per_host)), "ranked")
    return _shown_of(results, ranked)


def _votes_with_texts(results: DataFrame) -> DataFrame:
    """``_best_votes`` and ``representatives`` in one: a row per (query, URL), with its numbers and with what it shows."""
    for name, kind in _OPTIONAL.items():
        if name not in results.columns:
            results = results.withColumn(name, F.lit(None).cast(kind))
    known = results.filter(F.col("provider").isin(*[p[0] for p in dims.PROVIDERS]))
    rank = F.greatest("provider_rank", F.lit(1)).alias("rank")
    offer = F.when(F.col("provider").isin(*_AGGREGATORS), _offer(F.col("upstream_engines"))).otherwise(0)
    limits = [F.max("result_limit").alias("result_limit")] if "result_limit" in results.columns else []
    of, url = ["query_id", "canonical_url"], ["query_id", "canonical_url", "host"]
    votes = known.groupBy(*url, "provider").agg(
        F.min(F.struct(rank, "url", "title", "snippet", "content", "published_at")).alias("_shown"),
        F.min(rank.cast("bigint") * 256 + offer).alias("_vote"), *limits,
    )
    place = F.lit(None).cast("int")
    for name, *_, order in dims.PROVIDERS:
        place = F.when(F.col("provider") == name, F.lit(order)).otherwise(place)
    votes = votes.select(*url, "provider", place.alias("provider_order"), "_shown.*", "_vote", *(["result_limit"] if limits else []))
    numbers = [F.min(F.when(F.col("provider") == p[0], F.col("_vote"))).alias(_vote(p[0])) for p in dims.PROVIDERS]
    return _shown(votes, *url[2:], more=[*numbers, *limits]).select(*of, "host", *SHOWN, *[_vote(p[0]) for p in dims.PROVIDERS], *(["result_limit"] if limits else []))


def fuse_by_query(
    results: DataFrame,
    responses: DataFrame | None = None,
    limit: int = 8,
    per_host: int = 2,
    **weighting,
) -> DataFrame:
    """``fuse`` in one pass, for results that lie by query already and of whose URLs most are shown.

    Texts stay with the numbers, so the rows are made once. If rows and responses are dealt out by query, nothing is shuffled;
    otherwise every text travels, and ``fuse`` is the one to take. A canonical URL has one host here.
    """
    scored = scored_clusters(results, responses, votes=_votes_with_texts(results), **weighting)
    ranked = with_sources(rank_clusters(scored, limit, per_host)).filter("query_id is not null and canonical_url is not null")
    return ranked.select(*[c for c in ranked.columns if c not in SHOWN], *SHOWN)


def fusion_diagnostics(
    results: DataFrame, responses: DataFrame | None = None, **weighting
) -> DataFrame:
    """Every cluster of every query before ranking: score, corroboration, best rank, families and sources."""
    return with_sources(scored_clusters(results, responses, **weighting))
