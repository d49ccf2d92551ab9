"""Text clean-up as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from serploom import dims
from serploom.functions.urls import WHITE_SPACE, bind, trim_ws

FENCE_OPEN = "<untrusted-search-results>"
FENCE_CLOSE = "</untrusted-search-results>"


def collapse_ws(text: Column) -> Column:
    """Runs of Unicode white space become one space; the ends are trimmed."""
    spaced = F.translate(text, WHITE_SPACE, " " * len(WHITE_SPACE))
    return F.trim(
        bind(
            spaced,
            lambda t: F.when(t.contains("  "), F.regexp_replace(t, " {2,}", " ")).otherwise(t),
        )
    )


def strip_tags(text: Column) -> Column:
    """Text outside angle brackets; every closing bracket leaves a space."""

    def strip(t: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), "<[^>]*$", "")
        return F.when(t.contains("<"), F.replace(bare, F.lit(">"), F.lit(" "))).otherwise(t)

    return bind(text, strip)


def decode_entities(text: Column) -> Column:
    """One pass over the known entities, so nothing is decoded twice."""
    table = F.create_map(*[F.lit(x) for pair in dims.ENTITIES.items() for x in pair])

    def decode(t: Column) -> Column:
        tokens = F.regexp_extract_all(t, F.lit("(&[^;]{0,8};|[^&]+|&)"), F.lit(1))
        decoded = F.array_join(
            F.transform(tokens, lambda x: F.coalesce(F.try_element_at(table, x), x)), ""
        )
        return F.when(t.contains("&"), decoded).otherwise(t)

    return bind(text, decode)


def clean_text(text: Column) -> Column:
    """Markup, entities and stray white space removed; NULL when nothing is left."""
    return bind(
        collapse_ws(decode_entities(strip_tags(text))), lambda t: F.when(t != "", t)
    )


def clip_words(text: Column, limit: int) -> tuple[Column, Column]:
    """(text cut to ``limit`` at a word edge when one lies in the second half, truncated flag)."""
    prefix = F.substring(text, 1, limit)
    head = F.regexp_extract(prefix, r"(?sU)^(.*)\s", 1)
    cut = F.when(F.length(head) > limit // 2, head).otherwise(prefix)
    truncated = F.length(text) > limit
    return F.when(truncated, cut).otherwise(text), truncated


def clip_ellipsis(text: Column, limit: int) -> Column:
    body = trim_ws(F.replace(text, F.lit("\r\n"), F.lit("\n")))
    return F.when(
        F.length(body) > limit, F.concat(F.substring(body, 1, limit), F.lit("…"))
    ).otherwise(body)


def normalize_lines(text: Column) -> Column:
    """White space collapsed per line, at most one blank line in a row, none at the edges."""
    lines = F.array_join(F.transform(F.split(text, "\n"), collapse_ws), "\n")
    lines = F.regexp_replace(lines, "\n{3,}", "\n\n")
    return F.regexp_replace(lines, "^\n+|\n+$", "")


def _heading(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(line), "^#+", ""))


def opens_with_title(title: Column, text: Column) -> Column:
    """The first line repeats the title, ignoring case, accents and heading marks."""
    line = _heading(F.substring_index(text, "\n", 1))
    wanted = _heading(title)
    same = F.collate(line, "UNICODE_CI_AI") == F.collate(wanted, "UNICODE_CI_AI")
    return F.coalesce((line != "") & (wanted != "") & same, F.lit(False))


def leading_title(text: Column) -> Column:
    """Value of the first ``Title:`` among the first five non-empty lines."""
    lines = F.slice(F.filter(F.split(text, "\n"), lambda s: s != ""), 1, 5)
    hit = F.try_element_at(
        F.filter(lines, lambda s: F.lower(F.trim(s)).startswith("title:")), F.lit(1)
    )
    return F.nullif(F.trim(F.substr(F.trim(hit), F.lit(7))), F.lit(""))


def neutralize_fences(text: Column) -> Column:
    """Corpus delimiters inside data are replaced; the replacement cannot form a new one."""
    return F.regexp_replace(text, "(?i)</?untrusted-search-results>", "[delimiter removed]")


def escape_control(text: Column) -> Column:
    """One printable line: quotes, backslashes and every control or format character escaped."""
    tokens = F.regexp_extract_all(
        text, F.lit(r'([\\"\p{Cc}\p{Cf}]|[^\\"\p{Cc}\p{Cf}]+)'), F.lit(1)
    )

    def escape(token: Column) -> Column:
        code = F.hex(F.encode(token, "UTF-32"))
        short = F.regexp_replace(code, "^0+(?=..)", "")
        return (
            F.when(token == "\\", F.lit("\\\\"))
            .when(token == '"', F.lit('\\"'))
            .when(token == "\n", F.lit("\\n"))
            .when(token == "\r", F.lit("\\r"))
            .when(token == "\t", F.lit("\\t"))
            .when(
                token.rlike(r"^[\p{Cc}\p{Cf}]$"),
                F.concat(F.lit("\\u{"), short, F.lit("}")),
            )
            .otherwise(token)
        )

    return F.when(
        text.rlike(r'[\\"\p{Cc}\p{Cf}]'), F.array_join(F.transform(tokens, escape), "")
    ).otherwise(text)


def leak_markers(text: Column, secrets: dict[str, str] | None = None) -> Column:
    """Sorted names of the credential markers and known secret values found in ``text``."""
    found = [F.when(text.contains(m), F.lit(m)) for m in dims.LEAK_MARKERS]
    for name, value in (secrets or {}).items():
        if len(value) >= 8:
            found.append(F.when(text.contains(value), F.lit(f"{name} value")))
    return F.array_sort(F.array_compact(F.array(*found)))


def sse_last_json(body: Column) -> Column:
    """The JSON object of a plain body, or the last one on a ``data:`` line of an event stream."""
    text = trim_ws(body)
    objects = F.regexp_extract_all(
        text, F.lit(r"(?m)^[ \t]*data:[ \t]*(\{[^\n]*?)[ \t\r]*$"), F.lit(1)
    )
    last = F.try_element_at(objects, F.lit(-1))
    return F.when(text.startswith("{"), text).otherwise(F.coalesce(last, text))


def contains_any(text: Column, markers: Sequence[str]) -> Column:
    condition = F.lit(False)
    for marker in markers:
        condition = condition | text.contains(marker)
    return condition
