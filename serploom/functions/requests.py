"""Search request clean-up: locale, limits, digest and pseudonym."""

from __future__ import annotations

import hashlib

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serploom.functions.text import collapse_ws
from serploom.functions.urls import trim_ws


def locale_language(raw: Column) -> Column:
    return F.nullif(F.lower(F.element_at(_locale_parts(raw), 1)), F.lit(""))


def locale_region(raw: Column) -> Column:
    region = F.upper(F.try_element_at(_locale_parts(raw), F.lit(2)))
    return F.when(F.length(region) == 2, region)


def locale_identifier(raw: Column) -> Column:
    return F.concat_ws("-", locale_language(raw), locale_region(raw))


def _locale_parts(raw: Column) -> Column:
    parts = F.filter(F.split(trim_ws(raw), "[-_]"), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("")))


def request_digest(
    query: Column,
    max_results: Column,
    recency: Column,
    mode: Column,
    include: Column,
    exclude: Column,
    locale: Column,
    providers: Column,
) -> Column:
    """SHA-256 over the parts of a request that change its answer; result budgets do not."""

    def listed(values: Column, lower: bool = True) -> Column:
        values = F.transform(values, F.lower) if lower else values
        return F.array_join(F.array_sort(values), ",")

    return F.sha2(
        F.concat_ws(
            "\u001f",
            F.lower(collapse_ws(query)),
            F.concat(F.lit("n="), max_results.cast("string")),
            F.concat(F.lit("recency="), recency),
            F.concat(F.lit("mode="), mode),
            F.concat(F.lit("inc="), listed(include)),
            F.concat(F.lit("exc="), listed(exclude)),
            F.concat(F.lit("locale="), F.coalesce(locale, F.lit(""))),
            F.concat(F.lit("providers="), listed(providers, lower=False)),
        ),
        256,
    )


def query_pseudonym(query: Column, key: bytes) -> Column:
    """Keyed HMAC-SHA-256 of the query, first 64 bits, as ``q`` and hex without leading zeros."""
    if len(key) > 64:  # a key longer than a block is hashed first
        key = hashlib.sha256(key).digest()
    block = key.ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in block))
    outer = F.lit(bytes(b ^ 0x5C for b in block))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(query, "UTF-8")), 256))
    mac = F.sha2(F.concat(outer, first), 256)
    short = F.regexp_replace(F.substring(mac, 1, 16), "^0+(?=.)", "")
    return F.concat(F.lit("q"), short)


def clamp_requests(
    df: DataFrame,
    query: str = "query",
    max_results: str = "max_results",
    domains: Sequence[str] = (),
    max_characters: str | None = None,
) -> DataFrame:
    """Adds the effective limits and ``reject_reason`` (NULL for an accepted request)."""
    text = collapse_ws(F.col(query))
    limit = F.least(F.greatest(F.coalesce(F.col(max_results), F.lit(8)), F.lit(1)), F.lit(20))
    reason = F.when(F.coalesce(text, F.lit("")) == "", F.lit("query must not be empty"))
    for name in domains:
        reason = reason.when(F.size(F.col(name)) > 20, F.lit(f"{name} has more than 20 entries"))
    added = {
        "clean_query": text,
        "result_limit": limit.cast("int"),
        "provider_budget": F.least(F.lit(20), limit * 2).cast("int"),
        "reject_reason": reason,
    }
    if max_characters:
        added["character_limit"] = F.least(
            F.greatest(F.coalesce(F.col(max_characters), F.lit(12_000)), F.lit(1000)), F.lit(50_000)
        ).cast("int")
    return df.withColumns(added)


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) halves of a clamped request table."""
    return (
        df.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        df.filter(F.col("reject_reason").isNotNull()),
    )
