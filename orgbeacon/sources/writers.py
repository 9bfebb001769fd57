"""Outputs, as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def short_lines(results: DataFrame) -> DataFrame:
    """(request_id, value): source line, domain and proof of each request, nulls written."""
    return results.select("request_id", F.to_json(F.struct(F.col("source").alias("inn"), "domain", "proof"), {"ignoreNullFields": "false"}).alias("value"))


def full_lines(results: DataFrame) -> DataFrame:
    """(request_id, value): whole results, nulls dropped."""
    return results.select("request_id", F.to_json(F.struct(*(c for c in results.columns if c != "request_id"))).alias("value"))


def write_in_order(lines: DataFrame, path: str) -> None:
    """One line a request in the order of the input: files of a global sort."""
    lines.orderBy("request_id").select("value").write.mode("overwrite").text(path)


def evaluation_lines(summary: DataFrame, runs: DataFrame) -> DataFrame:
    """(config, part, value): the summary of each configuration, nulls written, and its runs one a line, nulls dropped."""
    line = lambda df, part, keep: df.select("config", F.lit(part).alias("part"), F.to_json(F.struct(*(c for c in df.columns if c != "config")), {"ignoreNullFields": keep}).alias("value"))
    return line(summary, "summary", "false").unionByName(line(runs, "runs", "true"))


def write_evaluation(summary: DataFrame, runs: DataFrame, path: str) -> None:
    """A folder for each configuration, with one for its summary and one for its runs."""
    evaluation_lines(summary, runs).write.mode("overwrite").partitionBy("config", "part").text(path)
