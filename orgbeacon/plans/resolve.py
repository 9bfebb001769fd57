"""The whole job: one answer for each request, worked out once for each distinct valid number.

What several steps read is written once (``stored``): page facts, cards with their spellings, short lists, verified candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgbeacon.functions.codes import not_empty
from orgbeacon.functions.html import page_facts, page_text
from orgbeacon.joins import one_each
from orgbeacon.operators import candidates as C
from orgbeacon.operators import decisions as R
from orgbeacon.operators import evidence as E
from orgbeacon.stored import stored


def judged_candidates(hits: DataFrame, cards: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All scored candidates, and the first five of each number with their item_no; ``facts`` of pages should be stored."""
    cards = stored(C.with_variants(cards))
    named = cards.select("inn", "variants")
    ranked = C.collect_candidates(hits, cards).join(named, "inn").withColumn("prior", C.prior_rank(F.col("variants")))
    short = stored(C.shortlist(ranked.drop("variants")).drop("prior"))
    verified = stored(E.verify_pages(short, cards, facts))
    more = E.verify_pages(stored(E.redirect_candidates(verified)), cards, facts)
    scored = stored(E.prefer_ru_siblings(E.score_candidates(verified.unionByName(more).join(named, "inn"))))
    return scored, C.shortlist(scored.drop("item_no"), "score", C.JUDGED)


def one_card_each(cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cards with a name, one a number, and (inn, reason) of numbers whose cards differ."""
    named = cards.where(F.coalesce(not_empty("name_short"), not_empty("name_full")).isNotNull())
    facts = [c for c in named.columns if c not in ("inn", "source")]
    rows = one_each(named, "inn")
    kinds = named.groupBy("inn").agg(F.min(F.to_json(F.struct(*facts))).alias("low"), F.max(F.to_json(F.struct(*facts))).alias("high")).where("low != high")
    return rows, kinds.select("inn", F.lit("card: several that differ").alias("reason"))


def answers_of(asked: DataFrame, hits: DataFrame, cards: DataFrame, facts: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of distinct valid numbers (inn) with a card: (inn, reason, answer, confidence, proof, verdict); and all their scored candidates."""
    named, differing = one_card_each(cards.join(asked, "inn", "left_semi"))
    named, differing = stored(named), stored(differing)
    clear = named.join(differing, "inn", "left_anti")
    scored, judged = judged_candidates(hits.join(clear.select("inn"), "inn", "left_semi"), clear, facts)
    parsed = stored(R.parse_decisions(replies.join(asked, "inn", "left_semi")))
    chosen = R.choose(judged, R.first_valid(parsed))
    answers = R.guards(chosen.select("inn", "c.domain", *(f"c.{c}" for c in ("inn_on_site", "ogrn_on_site", "site_field_hits", "email_hits", "reachable", "foreign_inn", "blacklisted_without_proof"))))
    unread = scored.where("page_error IS NOT NULL").groupBy("inn").agg(F.min("page_error").alias("reason"))
    asked_of = scored.select("inn").distinct()  # a reply is asked for only where there are candidates
    failed = differing.select("inn", "reason", F.lit(0).alias("step")).union(unread.select("inn", "reason", F.lit(1))).union(R.reply_errors(parsed).join(asked_of, "inn").select("inn", "reason", F.lit(2)))
    failed = failed.groupBy("inn").agg(F.min_by("reason", "step").alias("reason"))
    known = named.select("inn").join(answers.select("inn", "answer", "confidence", "proof", "verdict"), "inn", "left").join(failed, "inn", "left")
    broken = F.col("reason").isNotNull()
    known = known.select("inn", "reason", *(F.when(~broken, F.col(c)).alias(c) for c in ("answer", "confidence", "proof")), F.when(broken, "failed").otherwise(F.coalesce("verdict", F.lit("no_candidates"))).alias("verdict"))
    return known, scored


def for_requests(requests: DataFrame, known: DataFrame) -> DataFrame:
    """The answers of numbers given to the requests that ask for them, with all other columns of ``known``."""
    key = F.when(F.col("is_valid"), F.col("inn")).otherwise(F.concat(F.lit("-"), F.xxhash64("request_id", "source").cast("string")))  # rows that are not valid share no key
    rows = requests.withColumn("__key", key).join(known.withColumnRenamed("inn", "__key"), "__key", "left")
    verdict = F.when(~F.col("is_valid"), "invalid").otherwise(F.coalesce("verdict", F.lit("no_name")))
    more = [c for c in known.columns if c not in ("inn", "reason", "answer", "confidence", "proof", "verdict")]
    return rows.select("request_id", "source", "inn", F.col("answer").alias("domain"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "proof", verdict.alias("verdict"), "reason", *more)


def resolve(requests: DataFrame, hits: DataFrame, cards: DataFrame, pages: DataFrame, replies: DataFrame) -> DataFrame:
    """Per request: request_id, source, inn, domain, confidence, proof, verdict, reason.

    verdict: accepted, or why there is no answer (invalid, no_name, no_candidates, none, blocked, unreachable, foreign), or failed: a
    card, page or reply of this number couldn't be used, for the reason given; all others are answered. Rows of cards, pages and replies
    that repeat count once.
    """
    requests = stored(requests)
    asked = requests.where("is_valid").select("inn").distinct()
    known, _ = answers_of(asked, hits, cards, stored(page_facts(page_text(pages))), replies)
    return for_requests(requests, known)


def traces(results: DataFrame, scored: DataFrame, calls: DataFrame) -> DataFrame:
    """Per number: calls, failed, repaired and output tokens, the first candidates in a line each, and degraded (a call failed)."""
    called = calls.groupBy("inn").agg(F.count("*").alias("calls"), F.count_if("failed").alias("failed"), F.count_if("repaired").alias("repaired"), F.sum("completion_tokens").alias("out_tokens"))
    flag = lambda c, label: F.when(F.col(c), label)
    flags = F.concat_ws(" ", flag("inn_on_site", "inn"), flag("ogrn_on_site", "ogrn"), F.when(F.col("site_field_hits") > 0, "site_field"), F.when(F.col("email_hits") > 0, "email"), flag("blacklisted_without_proof", "blocked"))
    row = F.struct((-F.col("score")).alias("s"), "first_seen", F.concat_ws(" ", "domain", F.format_string("%.2f", "score"), flags).alias("line"))
    listed = scored.groupBy("inn").agg(F.slice(F.sort_array(F.collect_list(row)), 1, 6).alias("rows")).select("inn", F.transform("rows", lambda r: r["line"]).alias("candidates"))
    out = results.select("inn", "domain", "proof").distinct().join(called, "inn", "left").join(listed, "inn", "left").fillna(0, ["calls", "failed", "repaired", "out_tokens"])
    return out.withColumn("degraded", F.col("failed") > 0)
