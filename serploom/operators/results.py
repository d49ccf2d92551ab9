"""From raw result rows to the clean, deduplicated silver table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from serploom.functions import text, urls


def keyed_results(
    raw: DataFrame,
    include: str | Sequence[str] | None = None,
    exclude: str | Sequence[str] | None = None,
) -> DataFrame:
    """Rows with a repaired URL, its canonical form and host; unusable URLs and filtered domains are dropped.

    Domain rules are the name of an array column or a plain list. No shuffle: projections and filters.
    """
    df = raw.withColumn("url", urls.repair_url(F.col("url"))).filter(F.col("url").isNotNull())
    if include or exclude:
        named = lambda rules: F.col(rules) if isinstance(rules, str) else list(rules or [])
        # before the canonical form, whose staged expressions a filter on its host would copy
        df = df.filter(urls.domain_filter(urls.url_host(F.col("url")), named(include), named(exclude)))
    return urls.with_canonical_url(df, "url", host_out="host")


def cleaned_results(keyed: DataFrame) -> DataFrame:
    """Titles and texts without markup; a row without a title is named by its host."""
    added = {
        "title": F.coalesce(text.clean_text(F.col("title")), F.col("host")),
        "snippet": text.clean_text(F.col("snippet")),
    }
    if "content" in keyed.columns:
        added["content"] = F.nullif(urls.trim_ws(F.col("content")), F.lit(""))
    return keyed.withColumns(added)


def drop_invalid(
    raw: DataFrame,
    include: str | Sequence[str] | None = None,
    exclude: str | Sequence[str] | None = None,
) -> DataFrame:
    """Repaired, canonical and cleaned result rows; ``raw`` has ``url``, ``title``, ``snippet`` and optionally ``content``."""
    return cleaned_results(keyed_results(raw, include, exclude))


def dedupe_in_response(results: DataFrame) -> DataFrame:
    """First row per (query, provider, canonical URL).

    ``row_number() = 1`` is cut down before the shuffle as well, so a URL repeated many times by one
    source never travels whole. Rows without ``title`` or ``snippet`` are told apart by what they have: whoever
    shows neither may leave them out and gets the same rows. The URL leads the sort before the shuffle, so
    neighbours that are written together share most of their spelling.
    """
    order = Window.partitionBy("canonical_url", "query_id", "provider").orderBy(
        "provider_rank", "url", *[c for c in ("title", "snippet") if c in results.columns]
    )
    return results.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def silver_results(
    raw: DataFrame,
    include: str | Sequence[str] | None = None,
    exclude: str | Sequence[str] | None = None,
) -> DataFrame:
    """The silver step: keys first, then the first row of each URL in a response, and only the texts of first rows are cleaned.

    Rows of one rank and URL stay until their clean texts decide; both windows are met by one shuffle. The host is part of
    the canonical URL, so it does not travel beside it.
    """
    first = Window.partitionBy("canonical_url", "query_id", "provider").orderBy("provider_rank", "url")
    keyed = keyed_results(raw, include, exclude)
    kept = keyed.drop("host").withColumn("_first", F.rank().over(first)).filter("_first = 1").drop("_first")
    kept = kept.withColumn("host", urls.canonical_host(F.col("canonical_url"))).select(*keyed.columns)
    return dedupe_in_response(cleaned_results(kept))


def filter_domains_at_scale(results: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """Keeps result rows whose host passes the include / exclude rules of their query.

    ``rules(query_id, kind, domain)`` with kind include or exclude; they stay rows, so a block list of millions of
    domains is never gathered. Suffix matching becomes an equi join on (query_id, suffix): a host has a few dot
    suffixes, and only the distinct (query_id, host) pairs are joined. Their verdicts come back by a left
    join on (query_id, host), so a busy query is spread over its hosts. Rules for suffixes that no host of their query
    has go before anything is grouped, so a task that reads a long list keeps none of it.
    """
    # an empty inclusion still limits its query
    limited = rules.filter("kind = 'include'").select("query_id").distinct().withColumn("_limited", F.lit(True))
    of = results.select("query_id", F.col(host).alias("_host")).distinct()
    labels = F.split(F.lower("_host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    below = of.select("query_id", "_host", F.explode(suffixes).alias("_suffix"))
    clean = rules.select("query_id", "kind", urls.normalize_domain(F.col("domain")).alias("_suffix")).filter("_suffix <> ''")
    clean = clean.join(below.select("query_id", "_suffix").distinct(), ["query_id", "_suffix"], "left_semi")
    clean = clean.groupBy("query_id", "_suffix").agg(
        F.max(F.col("kind") == "exclude").alias("_out"), F.max(F.col("kind") == "include").alias("_in")
    )
    met = below.join(clean, ["query_id", "_suffix"])
    verdict = met.groupBy(F.col("query_id").alias("_query"), F.col("_host").alias("_of")).agg(F.max("_out").alias("_out"), F.max("_in").alias("_in"))
    judged = results.join(verdict, (F.col("query_id") == F.col("_query")) & (F.col(host) == F.col("_of")), "left")
    kept = judged.filter(~F.coalesce("_out", F.lit(False))).join(limited, "query_id", "left")
    return kept.filter(F.col("_limited").isNull() | F.coalesce("_in", F.lit(False))).drop("_query", "_of", "_out", "_in", "_limited")
