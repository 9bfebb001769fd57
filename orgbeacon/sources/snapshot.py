"""The snapshot of pages as a table bucketed by url, so that looking urls up moves no page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgbeacon.sources.readers import cache_key

#: What of a page its evidence depends on.
PAGE = ("url", "final_url", "status", "html")


def row_digest(*columns: str | Column) -> Column:
    """128 bits of a row's values, as two longs in a string; null differs from every value."""
    row = F.to_json(F.struct(*columns))
    return F.concat_ws(":", F.xxhash64(row).cast("string"), F.xxhash64(F.lit(1), row).cast("string"))


def digest_of_rows(digest: Column | str) -> Column:
    """Aggregate: one string for a set of rows, whatever their order; a row more, or one less, changes it."""
    part = lambda i: F.sum(F.split_part(F.col(digest) if isinstance(digest, str) else digest, F.lit(":"), F.lit(i)).cast("decimal(20,0)")).cast("string")
    return F.concat_ws(":", F.count("*").cast("string"), part(1), part(2))


def with_digest(pages: DataFrame) -> DataFrame:
    """Pages with page_digest, unless they have it."""
    return pages if "page_digest" in pages.columns else pages.withColumn("page_digest", row_digest(*PAGE))


def page_digests(pages: DataFrame) -> DataFrame:
    """(url, page_digest) of distinct urls; of a snapshot table only these two columns are read and nothing is shuffled."""
    return with_digest(pages).groupBy("url").agg(digest_of_rows("page_digest").alias("page_digest"))


def write_snapshot(pages: DataFrame, table: str, buckets: int) -> DataFrame:
    """Writes pages with page_digest to ``table`` of the session's catalog, bucketed and sorted by url, and reads it.

    ``buckets``: so many that one holds what a task can read. Rows of a null url are kept; no look-up finds them.
    """
    rows = with_digest(pages).repartition(buckets, "url")
    rows.write.bucketBy(buckets, "url").sortBy("url").format("parquet").mode("overwrite").saveAsTable(table)
    return read_snapshot(pages.sparkSession, table)


def read_snapshot(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def pending_pages(needed: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(url, cache_key) of distinct urls of ``needed`` without a page with a status; only ``needed`` is shuffled."""
    good = snapshot.where("status IS NOT NULL").select("url")
    return needed.select("url").where("url IS NOT NULL").distinct().join(good, "url", "left_anti").select("url", cache_key(F.col("url")).alias("cache_key"))
