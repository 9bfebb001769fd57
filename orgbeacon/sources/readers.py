"""Inputs: requests, search hits, page snapshots, labels, and what is still to be acquired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orgbeacon.functions.codes import is_valid_inn, kind, normalize_inn, or_empty
from orgbeacon.functions.html import MOST_HTML
from orgbeacon.stored import stored

_TRIM = r"(?U)^\s+|\s+$"
MOST_SNIPPET = 1200


def requests_from_lines(lines: DataFrame) -> DataFrame:
    """From (request_id, value): one request a line that is neither blank nor begins with ``#``."""
    source = F.regexp_replace("value", _TRIM, "")
    rows = lines.where(~F.startswith("value", F.lit("#"))).select("request_id", source.alias("source")).where("source != ''")
    return rows.select("request_id", "source", normalize_inn("source").alias("inn"), is_valid_inn("source").alias("is_valid"), kind("source").alias("kind"))


#: What ends a line, beside the line feed and the carriage return that the text source knows.
LINE_BREAKS = "[\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"


def numbered_lines(parts: DataFrame) -> DataFrame:
    """From (file, block, value), the rows of a text source in their order: (request_id, value), a row for each line, numbered from 0 over all files.

    Values are split at the other line breaks. Lines are counted by block and blocks by file, so ids don't depend on how files were split.
    """
    lines = stored(parts.select("file", "block", F.explode(F.split("value", LINE_BREAKS, -1)).alias("value")).withColumn("__i", F.monotonically_increasing_id()))
    blocks = lines.groupBy("file", "block").agg(F.min("__i").alias("__low"), F.count("*").alias("__n"))
    files = blocks.groupBy("file").agg(F.sum("__n").alias("__in_file"))
    files = files.select("file", (F.sum("__in_file").over(Window.orderBy("file")) - F.col("__in_file")).alias("__files_before"))  # a row a file
    before = F.sum("__n").over(Window.partitionBy("file").orderBy("block")) - F.col("__n")
    offsets = blocks.select("file", "block", "__low", before.alias("__before")).join(files, "file")
    return lines.join(offsets, ["file", "block"]).select((F.col("__files_before") + F.col("__before") + F.col("__i") - F.col("__low")).alias("request_id"), "value")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests of text files; their ids are the numbers of the lines, files in the order of their names."""
    parts = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    return requests_from_lines(numbered_lines(parts))


def shape_hits(raw: DataFrame) -> DataFrame:
    """From (inn, query_no, query, reply), the search service's JSON: a row for each hit, rank from 1."""
    schema = "struct<results: array<struct<title: string, url: string, text: string, highlights: array<string>>>>"
    hits = raw.select("inn", "query_no", "query", F.posexplode(F.from_json("reply", schema)["results"]).alias("pos", "hit"))
    snippet = F.concat(F.array_join(F.coalesce("hit.highlights", F.array().cast("array<string>")), " "), F.lit(" "), or_empty("hit.text"))
    return hits.select("inn", "query_no", "query", (F.col("pos") + 1).alias("rank"), or_empty("hit.title").alias("title"), or_empty("hit.url").alias("url"), F.substring(F.regexp_replace(snippet, _TRIM, ""), 1, MOST_SNIPPET).alias("snippet"))


def numbered_hits(*hits: DataFrame) -> DataFrame:
    """All hits with hit_no, their place in an organisation's results; a url that several queries found counts for each."""
    union = hits[0]
    for more in hits[1:]:
        union = union.unionByName(more)
    return union.withColumn("hit_no", F.row_number().over(Window.partitionBy("inn").orderBy("query_no", "rank")))


def good_pages(fetches: DataFrame) -> DataFrame:
    """From (url, final_url, status, content_type, html, error, fetch_no): the last good fetch of each url.

    Html of another content type is dropped and long html is cut; a failed fetch never replaces a good one.
    """
    is_html = F.contains(or_empty("content_type"), F.lit("html")) | (or_empty("content_type") == "")
    rows = fetches.select("url", F.coalesce("final_url", "url").alias("final_url"), "status", F.when(is_html, F.substring(or_empty("html"), 1, MOST_HTML)).otherwise("").alias("html"), "error", "fetch_no")
    best = F.max_by(F.struct("final_url", "status", "html", "error"), F.struct(F.col("status").isNotNull(), "fetch_no"))
    return rows.groupBy("url").agg(best.alias("p")).select("url", "p.*")


def labels_from_json(rows: DataFrame) -> DataFrame:
    """From (value), a JSON object each: a key ``expected`` with null is a confirmed negative, no such key is no label."""
    whole = F.from_json("value", "map<string, string>")
    lists = F.from_json("value", "struct<alt: array<string>, tags: array<string>>")
    none = F.array().cast("array<string>")
    return rows.select(whole["inn"].alias("inn"), F.coalesce(F.map_contains_key(whole, "expected"), F.lit(False)).alias("is_labelled"), whole["expected"].alias("expected"), F.coalesce(lists["alt"], none).alias("alt"), F.coalesce(lists["tags"], none).alias("tags"))


def cache_key(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 32)


def pending(needed: DataFrame, known: DataFrame, good: Column) -> DataFrame:
    """Distinct keys of needed (key) without a good entry in known (key, ..): what is still to be acquired."""
    return needed.select("key").distinct().join(known.where(F.coalesce(good, F.lit(False))).select("key"), "key", "left_anti").select("key", cache_key(F.col("key")).alias("cache_key"))
