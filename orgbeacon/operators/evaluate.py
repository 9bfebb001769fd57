"""Results against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("n", "labelled", "correct", "wrong", "missed", "positives", "negatives", "false_positives", "answered", "proven")


def is_correct() -> Column:
    """From expected, alt, domain: a label of null asks for no answer."""
    alt = F.coalesce("alt", F.array().cast("array<string>"))
    return F.when(F.col("expected").isNull(), F.col("domain").isNull()).otherwise(F.coalesce((F.col("domain") == F.col("expected")) | F.array_contains(alt, F.col("domain")), F.lit(False)))


def marks(labels: DataFrame, results: DataFrame) -> DataFrame:
    """A mark for each number and configuration: ? without a label, else OK or BAD."""
    rows = labels.join(results, "inn")
    return rows.select("inn", "config", F.when(~F.col("is_labelled"), "?").when(is_correct(), "OK").otherwise("BAD").alias("mark"))


def counts(labels: DataFrame, results: DataFrame) -> DataFrame:
    """(tag, config, n, labelled, correct, ..): the counts of each configuration, with tag null, and of each of its tags.

    A result counts once under null and once under each tag, so results are read, joined and shuffled once for all.
    results: (config, inn, domain, proof, raw_answer, elapsed_s).
    """
    rows = results.join(labels, "inn").withColumn("__ok", is_correct())
    tags = F.concat(F.array(F.lit(None).cast("string")), F.coalesce("tags", F.array().cast("array<string>")))
    yes, lab, pos = F.count_if, F.col("is_labelled"), F.col("expected").isNotNull()
    answered = F.col("domain").isNotNull()
    return rows.withColumn("tag", F.explode(tags)).groupBy("tag", "config").agg(
        F.count("*").alias("n"), yes(lab).alias("labelled"), yes(lab & F.col("__ok")).alias("correct"), yes(lab & pos & answered & ~F.col("__ok")).alias("wrong"),
        yes(lab & pos & ~answered).alias("missed"), yes(lab & pos).alias("positives"), yes(lab & ~pos).alias("negatives"), yes(lab & ~pos & answered).alias("false_positives"),
        yes(answered).alias("answered"), yes(F.col("proof").isin("inn_on_site", "ogrn_on_site")).alias("proven"),
        yes(lab & F.coalesce(F.col("raw_answer") == F.col("expected"), F.lit(False))).alias("raw_llm_correct"), F.round(F.avg("elapsed_s"), 6).alias("time_avg"),
    )


def summarize(labels: DataFrame, results: DataFrame, calls: DataFrame, steps: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """A row for each configuration. Calls and steps are summed before they are joined, so that nothing is counted twice.

    results: as in ``counts``; calls: (config, inn, json_ok_first_try, repaired, failed, completion_tokens); steps: (config, inn, invalid,
    repeated). ``counted``: what ``counts`` gave, where that is stored for the tags too.
    """
    yes = F.count_if
    base = (counts(labels.withColumn("tags", F.lit(None).cast("array<string>")), results) if counted is None else counted).where("tag IS NULL").drop("tag")
    called = calls.groupBy("config").agg(F.count("*").alias("llm_calls"), yes("failed").alias("llm_failed"), yes("repaired").alias("json_repairs"), F.round(F.avg(F.col("json_ok_first_try").cast("int")), 6).alias("json_first_try"), F.sum("completion_tokens").alias("out_tokens"))
    walked = steps.groupBy("config").agg(F.round(F.count("*") / F.count_distinct("inn"), 6).alias("agent_steps_avg"), yes("invalid").alias("agent_invalid"), yes("repeated").alias("agent_repeated"))
    joined = base.join(called, "config", "left").join(walked, "config", "left").fillna(0, ["llm_calls", "llm_failed", "json_repairs", "out_tokens", "agent_invalid", "agent_repeated"])
    return joined.withColumns({
        "accuracy": F.round(F.try_divide("correct", "labelled"), 6),
        "precision": F.round(F.try_divide(F.col("correct"), F.col("correct") + F.col("wrong") + F.col("false_positives")), 6),
        "null_rate": F.round(F.coalesce(F.try_divide(F.col("n") - F.col("answered"), F.col("n")), F.lit(0.0)), 6),
    })


def by_tag(labels: DataFrame, results: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """(tag, config, ok, total) over labelled rows; ``counted``: as in ``summarize``."""
    rows = counts(labels, results) if counted is None else counted
    return rows.where("tag IS NOT NULL AND labelled > 0").select("tag", "config", F.col("correct").alias("ok"), F.col("labelled").alias("total"))


def promotable(labels: DataFrame, results: DataFrame) -> DataFrame:
    """(inn, domain): numbers without a label that were answered with a registry code; the last configuration (config_no) wins."""
    rows = results.where(F.col("proof").isin("inn_on_site", "ogrn_on_site") & F.col("domain").isNotNull()).join(labels.where("NOT is_labelled").select("inn"), "inn", "left_semi")
    return rows.groupBy("inn").agg(F.max_by("domain", "config_no").alias("domain"))


def metric_table(summary: DataFrame, configs: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """A row for each metric, a column for each configuration."""
    long = summary.select("config", *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot("config", list(metrics), "metric", "value")
    return long.groupBy("metric").pivot("config", configs).agg(F.first("value"))


def call_telemetry(attempts: DataFrame) -> DataFrame:
    """From (call_id, attempt, transport_ok, accepted, prompt_tokens, completion_tokens): a row for each call.

    json_ok_first_try stays true where the first attempt failed in transport; tokens are those of the last attempt.
    """
    first_rejected = F.bool_or((F.col("attempt") == 1) & F.col("transport_ok") & ~F.col("accepted"))
    return attempts.groupBy("call_id").agg(
        F.count("*").alias("attempts"), (~first_rejected).alias("json_ok_first_try"), first_rejected.alias("repaired"), (~F.bool_or("accepted")).alias("failed"),
        F.max_by("prompt_tokens", "attempt").alias("prompt_tokens"), F.max_by("completion_tokens", "attempt").alias("completion_tokens"),
    )
