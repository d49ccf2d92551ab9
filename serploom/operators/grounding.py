"""Source material for generated answers and the check of their citations.

A query has at most twenty numbered sources, so its sources travel as one small array; the answers are
matched with a salted lookup and everything else happens inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serploom.functions.text import clip_ellipsis, neutralize_fences
from serploom.functions.urls import bind, comparable_url, trim_ws
from serploom.operators.joins import salted_lookup

PER_RESULT = 1200
TOTAL = 14_000
INSUFFICIENT = "INSUFFICIENT:"
REMOVED_LINK = "[link removed: not one of the fetched results]"

_MARKER = r"\[\d{1,3}\]"
_LINK = r"https?://[^\s\p{Z}<>()\[\]\"']+"


def pack_corpus(sources: DataFrame, per_result: int = PER_RESULT, total: int = TOTAL) -> DataFrame:
    """One prompt corpus per query from its numbered results.

    ``sources(query_id, source_index, title, url, snippet, content)``. A block over the budget leaves a
    stub and costs nothing, so a later smaller one may still fit; the first block is always kept.
    """
    detail = F.coalesce(F.nullif("snippet", F.lit("")), "content", F.lit(""))
    head = F.concat(
        F.lit("["), F.col("source_index").cast("string"), F.lit("] "),
        neutralize_fences(F.col("title")), F.lit("\nURL: "), neutralize_fences(F.col("url")), F.lit("\n"),
    )
    rows = sources.select(
        "query_id",
        F.struct(
            "source_index",
            head.alias("head"),
            neutralize_fences(clip_ellipsis(detail, per_result)).alias("body"),
        ).alias("block"),
    )
    grouped = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("block")).alias("blocks"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("parts"))

    def add(state: Column, block: Column) -> Column:
        full = F.concat(block["head"], block["body"])
        over = (state["used"] + F.length(full) > total) & (F.size(state["parts"]) > 0)
        stub = F.concat(block["head"], F.lit("(omitted for length)"))
        return F.struct(
            F.when(over, state["used"]).otherwise(state["used"] + F.length(full)).alias("used"),
            F.concat(state["parts"], F.array(F.when(over, stub).otherwise(full))).alias("parts"),
        )

    packed = F.aggregate("blocks", start, add)
    return grouped.select("query_id", packed.alias("p")).select(
        "query_id", F.array_join("p.parts", "\n\n").alias("corpus"), F.col("p.used").alias("used")
    )


def _sources_by_query(sources: DataFrame) -> DataFrame:
    extra = [c for c in ("title", "sources") if c in sources.columns]
    return sources.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("source_index", "url", *extra))).alias("_sources")
    )


def check_answers(
    answers: DataFrame, sources: DataFrame, spread: list[str], salts: int = 16
) -> DataFrame:
    """Answers with their citations validated and renumbered.

    ``answers(query_id, text, …)`` with ``spread`` naming columns that tell the answers of one query
    apart; ``sources(query_id, source_index, url[, title, sources])`` numbered from 1. Adds status,
    answer, cited (original numbers in order of first use), citations, stripped_markers,
    stripped_links.
    """
    df = salted_lookup(answers, _sources_by_query(sources), "query_id", spread, salts)
    known = F.coalesce("_sources", F.array().cast(df.schema["_sources"].dataType))
    insufficient = F.col("text").startswith(INSUFFICIENT)
    body = F.when(
        insufficient, trim_ws(F.substring("text", len(INSUFFICIENT) + 1, 2**31 - 1))
    ).otherwise(F.col("text"))
    df = df.withColumns({"_body": body, "_known": known, "_insufficient": insufficient})
    numbers = F.transform(
        F.regexp_extract_all("_body", F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda n: n.cast("int")
    )
    df = df.withColumn("_numbers", numbers)
    valid = lambda n: (n >= 1) & (n <= F.size("_known"))
    df = df.withColumns(
        {
            "cited": F.array_distinct(F.filter("_numbers", valid)),
            "stripped_markers": F.size(F.filter("_numbers", lambda n: ~valid(n))),
        }
    )
    df = df.withColumn("_text", _renumbered(F.col("_body"), F.col("cited")))
    supplied = F.transform("_known", lambda s: comparable_url(s["url"]))
    df = df.withColumn("_supplied", supplied)
    unknown = F.filter(
        F.regexp_extract_all("_text", F.lit(_LINK), F.lit(0)),
        lambda link: ~F.array_contains("_supplied", comparable_url(link)),
    )
    df = df.withColumns(
        {
            "stripped_links": F.size(unknown),
            "_text": trim_ws(_without_unknown_links(F.col("_text"), F.col("_supplied"))),
        }
    )
    notes = F.concat(
        F.when(
            F.col("stripped_markers") > 0,
            F.format_string(
                "\n\n> Note: %d citation marker(s) in the model's answer did not match a supplied "
                "result and were removed.",
                "stripped_markers",
            ),
        ).otherwise(""),
        F.when(
            F.col("stripped_links") > 0,
            F.format_string(
                "\n\n> Note: %d link(s) in the model's answer did not match a fetched result and "
                "were removed.",
                "stripped_links",
            ),
        ).otherwise(""),
    )
    citations = F.transform(
        "cited",
        lambda n, i: F.struct((i + 1).alias("index"), F.element_at("_known", n).alias("source")),
    )
    df = df.withColumns(
        {
            "status": F.when(F.col("_insufficient"), F.lit("insufficient")).otherwise("answered"),
            "answer": F.concat("_text", notes),
            "citations": citations,
        }
    )
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def _renumbered(text: Column, cited: Column) -> Column:
    """Valid markers take their new number, invalid ones vanish."""
    tokens = F.regexp_extract_all(text, F.lit(rf"(?s)({_MARKER}|\[|[^\[]+)"), F.lit(1))

    def rewrite(token: Column) -> Column:
        place = F.array_position(cited, F.regexp_extract(token, r"\d+", 0).try_cast("int"))
        return F.when(
            token.rlike(f"^{_MARKER}$"),
            bind(
                place,
                lambda p: F.when(p > 0, F.concat(F.lit("["), p.cast("string"), F.lit("]"))).otherwise(""),
            ),
        ).otherwise(token)

    return F.array_join(F.transform(tokens, rewrite), "")


def _without_unknown_links(text: Column, supplied: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(rf"(?s)({_LINK}|h|[^h]+)"), F.lit(1))
    checked = F.transform(
        tokens,
        lambda t: F.when(
            t.rlike("^https?://.") & ~F.array_contains(supplied, comparable_url(t)), REMOVED_LINK
        ).otherwise(t),
    )
    return F.array_join(checked, "")


def resolve_citations(checked: DataFrame) -> DataFrame:
    """One row per citation of a checked answer: new number, original number and source."""
    return checked.select(
        *[c for c in checked.columns if c not in ("citations", "cited", "text", "answer")],
        F.explode("citations").alias("c"),
    ).select("*", F.col("c.index").alias("index"), "c.source.*").drop("c")


def unverified_links(answers: DataFrame, sources: DataFrame, spread: list[str]) -> DataFrame:
    """Links in answers that match none of the query's sources, one row per link."""
    links = answers.select(
        "query_id", *spread, F.explode(F.regexp_extract_all("text", F.lit(_LINK), F.lit(0))).alias("link")
    ).withColumn("comparable", comparable_url(F.col("link")))
    supplied = sources.select("query_id", comparable_url(F.col("url")).alias("comparable")).distinct()
    return links.join(supplied, ["query_id", "comparable"], "left_anti").drop("comparable")
