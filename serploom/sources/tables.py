"""Landed tables, in batch or as streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SCHEMA = "page_id bigint, url string, html string"
RUN_SCHEMA = (
    "query_id bigint, ts timestamp, latency_ms int, served_from_cache boolean, "
    "providers_used array<string>, providers_failed array<struct<provider:string,category:string,"
    "message:string>>, result_count int"
)


# Types by file ending; a file without one is taken for a page.
FILE_TYPES = {
    "html": "text/html", "htm": "text/html", "xhtml": "application/xhtml+xml", "txt": "text/plain", "md": "text/markdown", "json": "application/json",
    "xml": "application/xml", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg",
}
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def read_pages(spark: SparkSession, path: str, kind: str = "parquet", stream: bool = False, **options) -> DataFrame:
    """Fetched pages: a table (parquet) or one file per page (binaryFile), in batch or as a stream."""
    reader = spark.readStream if stream else spark.read
    if kind == "binaryFile":
        return page_files(reader.options(**options).format("binaryFile").schema(FILE_SCHEMA).load(path))
    return reader.options(**options).schema(PAGE_SCHEMA).parquet(path)


def page_files(files: DataFrame, largest: int | None = None, since: dt.datetime | None = None) -> DataFrame:
    """Files as page bodies: url, fetched_at, length, content_type, body.

    ``largest`` and ``since`` are compared with what the file system says of a file, before it is opened; in batch a filter on
    ``length`` or ``fetched_at`` that comes later reaches the source as well.
    """
    if largest is not None:
        files = files.filter(F.col("length") <= largest)
    if since is not None:
        files = files.filter(F.col("modificationTime") >= F.lit(since))
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair])
    return files.select(
        F.col("path").alias("url"), F.col("modificationTime").alias("fetched_at"), "length",
        F.coalesce(F.try_element_at(known, ending), F.lit("text/html")).alias("content_type"), F.col("content").alias("body"),
    )


def read_attempts(runs: DataFrame) -> DataFrame:
    """One row per (query, provider) try from per-query run rows with used and failed lists."""
    used = runs.select(
        "query_id", "ts", F.explode("providers_used").alias("provider"), F.lit(True).alias("ok"),
        F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("message"),
    )
    failed = runs.select("query_id", "ts", F.explode("providers_failed").alias("f")).select(
        "query_id", "ts", "f.provider", F.lit(False).alias("ok"), "f.category", "f.message"
    )
    return used.unionByName(failed)
