"""Node probe payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROBE_SCHEMA = (
    "results array<struct<engine:string,engines:array<string>>>, unresponsive_engines array<array<string>>"
)


def read_node_probes(raw: DataFrame) -> DataFrame:
    """Landed probes as node states.

    ``raw(node, ts, event_id, is_local, status_code, unreachable, body, latency_ms)``. State is down,
    degraded or up; an answer that is not the expected payload or has no results is degraded.
    """
    parsed = raw.withColumn("_p", F.from_json("body", PROBE_SCHEMA))
    success = F.col("status_code").between(200, 299)
    decoded = success & F.col("_p.results").isNotNull()
    none = F.array().cast("array<string>")
    n = F.when(decoded, F.size("_p.results")).otherwise(0)
    error = (
        F.when(F.col("unreachable"), F.lit("unreachable"))
        .when(F.col("status_code") == 403, F.lit("JSON disabled (add `json` to search.formats)"))
        .when(~success, F.concat(F.lit("HTTP "), F.col("status_code").cast("string")))
        .when(~decoded, F.lit("JSON response was not a SearXNG payload"))
        .when(n == 0, F.lit("no results returned"))
    )
    state = (
        F.when(F.col("unreachable"), F.lit("down"))
        .when(error.isNotNull(), F.lit("degraded"))
        .otherwise(F.lit("up"))
    )
    named = F.flatten(
        F.transform(
            "_p.results",
            lambda r: F.array_compact(F.concat(F.array(r["engine"]), F.coalesce(r["engines"], none))),
        )
    )
    unavailable = F.transform(
        F.filter("_p.unresponsive_engines", lambda e: F.size(e) >= 2),
        lambda e: F.concat(e[0], F.lit(": "), e[1]),
    )
    reachable = decoded & ~F.col("unreachable")
    return parsed.withColumns(
        {
            "state": state,
            "error": error,
            "result_count": F.when(reachable, n).otherwise(0),
            "engines": F.when(reachable, F.array_sort(F.array_distinct(named))).otherwise(none),
            "unavailable_engines": F.when(reachable, F.coalesce(unavailable, none)).otherwise(none),
            "latency_ms": F.when(~F.col("unreachable"), F.col("latency_ms")),
        }
    ).drop("_p", "body", "unreachable")
