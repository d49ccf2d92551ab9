"""Dates, categories and provider facts as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serploom import dims
from serploom.functions.urls import trim_ws


def parse_date(raw: Column) -> Column:
    """The date spellings seen in provider payloads, as a timestamp; NULL when none fits."""
    text = trim_ws(raw)
    # the cast of a text that is no number throws inside, so it comes after the shape
    seconds = F.when(text.rlike(r"^[-+]?[0-9.]+([eE][-+]?[0-9]+)?$"), text.try_cast("double"))
    dated = F.regexp_replace(text, r"(?i)^[a-z]{3},\s*", "")
    zoned = F.regexp_replace(dated, r"(?i)\s(GMT|UTC|Z)$", " +0000")

    def attempt(value: Column, pattern: str, shape: str) -> Column:
        return F.when(value.rlike(shape), F.try_to_timestamp(value, F.lit(pattern)))

    iso = r"^\d{4}-\d{2}-\d{2}"
    month = r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}"
    return F.coalesce(
        F.timestamp_micros(F.round(seconds * 1e6).try_cast("bigint")),
        F.when(
            text.rlike(iso + r"T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"),
            F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp"),
        ),
        F.when(text.rlike(iso + "$"), text.try_cast("timestamp")),
        F.when(text.rlike(iso + r"[ T]\d{2}:\d{2}:\d{2}$"), text.try_cast("timestamp")),
        attempt(text, "yyyy/MM/dd", r"^\d{4}/\d{2}/\d{2}$"),
        attempt(zoned, "d MMM yyyy HH:mm:ss xx", month + r" [+-]\d{4}$"),
        attempt(dated, "d MMM yyyy HH:mm:ss", month + "$"),
    )


def recency_cutoff(recency: Column, now: Column) -> Column:
    """Oldest publication time a recency value admits; NULL means no limit."""
    days = F.create_map(*[F.lit(x) for pair in dims.RECENCY_DAYS.items() for x in pair])
    span = F.try_element_at(days, recency)
    return F.timestamp_micros(F.unix_micros(now) - span.cast("bigint") * 86_400_000_000)


def within_recency(published_at: Column, recency: Column, now: Column) -> Column:
    cutoff = recency_cutoff(recency, now)
    return cutoff.isNull() | F.coalesce(published_at >= cutoff, F.lit(False))


def retry_after_ms(raw: Column, now: Column) -> Column:
    """``Retry-After`` as seconds or an HTTP date, clamped to one day; NULL when meaningless."""
    text = F.trim(raw)
    seconds = F.when(
        text.rlike(r"(?i)^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[-+]?[0-9]+)?$"), text.try_cast("double")
    )
    dated = F.when(text.rlike(r"(?i)^[a-z]{3}, \d{1,2} [a-z]{3} \d{4} "), parse_date(text))
    wait = F.coalesce(seconds, (F.unix_micros(dated) - F.unix_micros(now)) / F.lit(1e6))
    bounded = F.least(F.greatest(wait, F.lit(0.0)), F.lit(86_400.0))
    finite = wait.isNotNull() & ~F.isnan(wait) & (F.abs(wait) < float("inf"))
    return F.when(finite, F.floor(bounded * 1000).cast("bigint"))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def engine_family(engine: Column) -> Column:
    """Family of an upstream engine name; the first matching substring decides."""
    name = F.lower(engine)
    (first, family), *rest = dims.ENGINE_FAMILIES
    result = F.when(name.contains(first), F.lit(family))
    for needle, family in rest:
        result = result.when(name.contains(needle), F.lit(family))
    return result


def is_independent(family: Column) -> Column:
    return family.isin(*dims.INDEPENDENT_FAMILIES)


def provider_kind(is_scraper: Column, is_aggregator: Column, independent: Column) -> Column:
    return (
        F.when(is_scraper, F.lit("scraper"))
        .when(is_aggregator, F.lit("aggregator"))
        .when(independent, F.lit("index"))
        .otherwise(F.lit("search"))
    )


def error_category(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in dims.ERROR_CATEGORIES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit("network"))


def is_transient(category: Column) -> Column:
    return F.coalesce(category.isin(*dims.TRANSIENT_CATEGORIES), F.lit(False))


def with_status_category(
    df: DataFrame,
    provider: str = "provider",
    status: str = "status_code",
    body: str | None = None,
    out: str = "status_category",
) -> DataFrame:
    """Outcome category of an HTTP status; the few provider exceptions come from a fixed table.

    With ``body`` given, a 422 of one provider that blames the token counts as authentication.
    """
    overrides = F.broadcast(
        dims.status_overrides(df.sparkSession).withColumnsRenamed(
            {"provider": "_o_provider", "status_code": "_o_status"}
        )
    )
    joined = df.join(
        overrides,
        (F.col(provider) == F.col("_o_provider")) & (F.col(status) == F.col("_o_status")),
        "left",
    )
    code = F.col(status)
    scraper = F.col(provider).isin("duckduckgo", "startpage")
    token_blamed = F.lit(False)
    if body:
        error_code = F.upper(F.get_json_object(F.col(body), "$.error.code"))
        component = F.lower(F.get_json_object(F.col(body), "$.error.meta.component"))
        token_blamed = F.coalesce(
            error_code.contains("SUBSCRIPTION_TOKEN"), F.lit(False)
        ) | F.coalesce(component == "authentication", F.lit(False))
    category = (
        F.when(F.col("override_category").isNotNull(), F.col("override_category"))
        .when(code.between(200, 299), F.lit("ok"))
        .when(code == 429, F.lit("rate_limited"))
        .when(scraper, F.lit("server_error"))
        .when(code.isin(401, 403), F.lit("authentication"))
        .when(
            (F.col(provider) == "brave") & (code == 422) & token_blamed, F.lit("authentication")
        )
        .when(code.between(500, 599), F.lit("server_error"))
        .otherwise(F.lit("unsupported_request"))
    )
    return joined.withColumn(out, category).drop("_o_provider", "_o_status", "override_category")
