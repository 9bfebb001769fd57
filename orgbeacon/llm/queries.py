"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgbeacon.llm import conversations, decontamination, language_id, lm_scoring, media_columns, near_dedup, packing, periodic_runs, quality, quality_rules, sharding, substring_dedup, url_filters
from orgbeacon.llm.shared import id_remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from the labels: 0 toxic, 1 of low quality, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, graded(table(spark, sf_dir, "labels")))
    return quality.score(docs, model, tail=2, keep=["doc_id"]).withColumn("selected", quality.selected())


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(id_remainder("doc_id", 5) != 0))
    out = language_id.predict(docs, model, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The rules that the contract states.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
def listed_pages(pages: DataFrame) -> DataFrame:
    """The block list: canonical urls of one page in 16, by the digest of its id."""
    return pages.where(F.startswith(F.md5(F.col("page_id").cast("string").cast("binary")), F.lit("0"))).select(url_filters.canonical(F.col("url")).alias("url_key"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge(pages, rules, listed_pages(pages)).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
c AS (SELECT *, CASE WHEN host = '' THEN NULL ELSE regexp_replace(regexp_replace(host, '^.*@', ''), '(:80|:443)?$', '') || CASE WHEN path = '' THEN '/' ELSE path END END AS url_key FROM p),
listed AS (SELECT DISTINCT url_key FROM c WHERE url_key IS NOT NULL AND starts_with(md5(CAST(page_id AS VARCHAR)), '0')),
j AS (SELECT c.*, '.' || host AS dotted, l.url_key IS NOT NULL AS is_listed FROM c LEFT JOIN listed l ON c.url_key = l.url_key),
r AS (SELECT page_id, host, path, is_listed,
  CASE WHEN dotted LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
       WHEN dotted LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
       WHEN dotted LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
       WHEN dotted LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
       WHEN dotted LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule FROM j)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL OR is_listed THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    read = media_columns.read_streams(media_columns.store_texts(docs))
    last = F.coalesce(F.element_at("pts", -1), F.lit(0))
    feature = F.format_string("pes=%d rap=%d first=%d last=%d errors=%d", F.size("pts"), F.size("random_access"), F.coalesce(F.element_at("random_access", 1), F.lit(-1)), last, F.col("continuity_errors"))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    by_source = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(sharding.SHARDS))
    out = sharding.reshard_files(docs, by_source)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.remove_repeats(docs, keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm_scoring.score(docs, id_remainder("doc_id", 10) != 0)
    return out.select("doc_id", F.coalesce(id_remainder("doc_id", 10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    return conversations.repair(conversations.damaged(rows, F.pmod(F.crc32(name.cast("binary")), F.lit(20))), rows)


def rated(labels: DataFrame) -> DataFrame:
    """Classes from the labels."""
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", kind.alias("class"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.train(docs, rated(table(spark, sf_dir, "labels")))
    out = quality_rules.judge(docs, rules, keep=["doc_id"])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    kept = ~failed & F.coalesce(F.col("verdict") == "good", F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "verdict")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents of one id in ten, by its checksum, repeat a stretch of words up to their end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.withColumns({"h": h, "w": F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != ""))})
    docs = docs.withColumns({"n": F.size("w").cast("long"), "g": F.floor(F.col("h") / 10)}).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), again), " ")
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")), keep=["doc_id"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    longer = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), longer)
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.concat(lines, F.when(F.size("runs") > 0, "\n").otherwise("")).alias("lines"), "collapsed_text")
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_language_id": op2_language_id,
    "op3_packing": op3_packing,
    "op4_decontamination": op4_decontamination,
    "op5_url_filters": op5_url_filters,
    "op6_near_dedup": op6_near_dedup,
    "op7_media_columns": op7_media_columns,
    "op8_sharding": op8_sharding,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_conversations": op11_conversations,
    "op12_quality_rules": op12_quality_rules,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {"op5_url_filters": OP5_SQL}
