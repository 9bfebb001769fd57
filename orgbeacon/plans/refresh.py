"""Running the job again after some of its inputs changed, working only on the numbers whose inputs did.

What an answer rests on is written beside it: a digest of the number's hits, cards and replies, the domains that were looked at, the
urls that were looked up for each of them (found or not) and the digests of their pages. A number is worked on again if any of these
differs, so answers are those of a run from the start. Facts of pages are kept too: only pages that are new or differ are parsed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgbeacon.functions.html import page_facts, page_text
from orgbeacon.operators.evidence import looked_up
from orgbeacon.plans.resolve import answers_of, for_requests
from orgbeacon.sources.snapshot import digest_of_rows, page_digests, row_digest, with_digest
from orgbeacon.stored import stored

ANSWER = ("reason", "answer", "confidence", "proof", "verdict")
TABLES = {
    "numbers": "inn string, input_digest string, reason string, answer string, confidence double, proof string, verdict string",
    "sites": "inn string, domain string",
    "urls": "domain string, url string, page_digest string",
}


def input_digests(asked: DataFrame, hits: DataFrame, cards: DataFrame, replies: DataFrame) -> DataFrame:
    """(inn, input_digest) of each asked number. Rows become 128 bits before they are shuffled, and sums of these are combined early."""
    rows = asked.select("inn", F.lit(None).cast("string").alias("d"))
    for name, part in (("hit", hits), ("card", cards), ("reply", replies)):
        rows = rows.union(part.join(asked, "inn", "left_semi").select("inn", row_digest(F.lit(name).alias("row_of"), *sorted(part.columns)).alias("d")))
    return rows.groupBy("inn").agg(digest_of_rows("d").alias("input_digest"))


def _known(spark: SparkSession, folder: str | None, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name]) if folder is None else spark.read.parquet(f"{folder}/{name}")


def changed_sites(urls: DataFrame, digests: DataFrame) -> DataFrame:
    """Distinct domains of which a page that was looked up is new, gone or another one."""
    now = urls.join(digests.withColumnRenamed("page_digest", "now"), "url", "left")
    return now.where(~F.col("page_digest").eqNullSafe(F.col("now"))).select("domain").distinct()


def refresh(requests: DataFrame, hits: DataFrame, cards: DataFrame, pages: DataFrame, replies: DataFrame, folder: str, previous: str | None = None) -> DataFrame:
    """The rows of ``resolve``, and ``again``: whether the number was worked on in this run (null where no number was).

    ``previous``: the folder of an earlier run, or None; ``folder``: another one, in storage that all executors share, to which what the
    next run needs is written: that of the numbers asked for now. A run that was cut short leaves ``previous`` as it was and is simply
    run again. ``pages`` may be a snapshot table (sources.snapshot): its digests are then read, not computed, and pages aren't shuffled.
    """
    if previous is not None and previous.rstrip("/") == folder.rstrip("/"):
        raise ValueError("the folder to write must not be the one to read")
    spark, pages = requests.sparkSession, with_digest(pages)
    requests = stored(requests)
    asked = stored(requests.where("is_valid").select("inn").distinct())
    old, old_sites, old_urls = (_known(spark, previous, t) for t in TABLES)
    inputs, digests = stored(input_digests(asked, hits, cards, replies)), stored(page_digests(pages))

    moved = stored(changed_sites(old_urls, digests))
    same = stored(inputs.join(old, ["inn", "input_digest"]).join(old_sites.join(moved, "domain").select("inn").distinct(), "inn", "left_anti"))
    todo = stored(asked.join(same, "inn", "left_anti"))

    if previous is None:
        facts = page_facts(page_text(pages)).join(digests, "url", "left")
    else:
        kept = spark.read.parquet(f"{previous}/facts").join(digests, ["url", "page_digest"], "left_semi")
        new = digests.join(kept.select("url", "page_digest"), ["url", "page_digest"], "left_anti")
        facts = kept.unionByName(page_facts(page_text(pages.join(new.select("url"), "url", "left_semi"))).join(new, "url"))
    facts.write.mode("overwrite").parquet(f"{folder}/facts")
    facts = spark.read.parquet(f"{folder}/facts").drop("page_digest")

    known, scored = answers_of(todo, hits, cards, facts, replies)
    done = todo.join(inputs, "inn").join(known, "inn", "left").select("inn", "input_digest", *ANSWER, F.lit(True).alias("again"))
    same.select("inn", "input_digest", *ANSWER, F.lit(False).alias("again")).union(done).write.mode("overwrite").parquet(f"{folder}/numbers")
    fresh = stored(scored.select("inn", "domain").distinct())
    old_sites.join(same, "inn", "left_semi").union(fresh).write.mode("overwrite").parquet(f"{folder}/sites")
    read = spark.read.parquet(f"{folder}/sites").select("domain").distinct()
    still = old_urls.join(moved, "domain", "left_anti")
    unknown = stored(read.join(still.select("domain").distinct(), "domain", "left_anti"))
    urls = still.join(read, "domain", "left_semi").union(looked_up(unknown, facts).join(digests, "url", "left").select("domain", "url", "page_digest"))
    urls.write.mode("overwrite").parquet(f"{folder}/urls")
    return for_requests(requests, spark.read.parquet(f"{folder}/numbers").drop("input_digest"))
