"""Model replies: parsing, choice of a candidate, contradiction guards and grades."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from orgbeacon.functions.codes import not_empty
from orgbeacon.functions.suffixes import registrable
from orgbeacon.operators.evidence import has_proof

# Answers that name no domain, in the two modes.
NO_ANSWER = ("", "null", "none", "нет", "-")
NO_ANSWER_AGENT = ("", "null", "none")
CONFIDENCES = ("high", "medium", "low")
_FENCED = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL | re.IGNORECASE)


def _first_object(text: str) -> str | None:
    """The first balanced {...} of a text, braces in strings apart."""
    begin = text.find("{")
    depth, quoted, escaped = 0, False, False
    for i in range(begin, len(text)) if begin >= 0 else ():
        c = text[i]
        if quoted:
            quoted, escaped = escaped or c != '"', c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[begin : i + 1]
    return None


def json_object(reply: str | None) -> str | None:
    fenced = _FENCED.search(reply or "")
    for part in ((fenced[1],) if fenced else ()) + (reply or "",):
        found = _first_object(part)
        try:
            if found is not None and isinstance(json.loads(found), dict):
                return found
        except ValueError:
            continue
    return None


def _json_or_error(reply: str | None) -> tuple[str | None, str | None]:
    try:
        return json_object(reply), None
    except RecursionError as error:  # too many brackets in one another
        return None, f"reply: {type(error).__name__}"


#: Replies that a worker holds as Python objects at a time.
REPLIES_AT_ONCE = 100


@F.arrow_udf(StructType([StructField("json", StringType()), StructField("error", StringType())]))
def read_reply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The JSON object in a model's reply, and why it couldn't be looked for, where that failed."""
    kind = pa.struct([("json", pa.string()), ("error", pa.string())])
    for reply in batches:
        for at in range(0, len(reply), REPLIES_AT_ONCE):
            few = (_json_or_error(r.as_py()) for r in reply.slice(at, REPLIES_AT_ONCE))
            yield pa.array([{"json": found, "error": error} for found, error in few], kind)


def extract_json(reply: Column | str) -> Column:
    """The JSON object in a model's reply: that of a fenced block, else the first one; null if there is none."""
    return read_reply(reply)["json"]


def parse_decisions(replies: DataFrame) -> DataFrame:
    """From (inn, attempt, raw_reply): with is_valid, domain, confidence, reason, and error where a reply couldn't be read at all."""
    rows = replies.withColumn("__r", read_reply("raw_reply")).withColumn("__j", F.col("__r.json"))
    at = lambda key: F.get_json_object("__j", f"$.{key}")
    kinds = F.from_json("__j", "map<string, string>")
    raw = F.try_parse_json("__j")
    text = lambda key: F.coalesce(F.schema_of_variant(F.try_variant_get(raw, f"$.{key}", "variant")), F.lit("VOID"))
    confidence = F.when(F.map_contains_key(kinds, "confidence"), at("confidence")).otherwise("low")
    good = F.col("__j").isNotNull() & text("domain").isin("STRING", "VOID") & F.coalesce(confidence.isin(*CONFIDENCES), F.lit(False)) & (~F.map_contains_key(kinds, "reason") | (text("reason") == "STRING"))
    valid = F.coalesce(good, F.lit(False))
    return rows.select(*replies.columns, valid.alias("is_valid"), F.when(valid, at("domain")).alias("domain"), F.when(valid, confidence).alias("confidence"), F.when(valid, F.coalesce(at("reason"), F.lit(""))).alias("reason"), F.col("__r.error").alias("error"))


def first_valid(parsed: DataFrame, attempts: int = 2) -> DataFrame:
    """(inn, decided, raw_domain, confidence, reason): the first valid of the first two attempts; decided is false if none is."""
    best = F.min_by(F.struct("domain", "confidence", "reason"), F.when(F.col("is_valid") & (F.col("attempt") <= attempts), F.col("attempt")))
    rows = parsed.groupBy("inn").agg(F.bool_or(F.col("is_valid") & (F.col("attempt") <= attempts)).alias("decided"), best.alias("d"))
    return rows.select("inn", "decided", *(F.when(F.col("decided"), F.col(f"d.{c}")).alias(n) for c, n in (("domain", "raw_domain"), ("confidence", "model_confidence"), ("reason", "model_reason"))))


def reply_errors(parsed: DataFrame, attempts: int = 2) -> DataFrame:
    """(inn, reason): numbers of which a reply before the first valid one couldn't be read at all."""
    tried = F.col("attempt") <= attempts
    failed = F.when(tried & F.col("error").isNotNull(), F.col("attempt"))
    rows = parsed.groupBy("inn").agg(F.min(failed).alias("at"), F.min_by("error", failed).alias("reason"), F.min(F.when(tried & F.col("is_valid"), F.col("attempt"))).alias("valid"))
    return rows.where(F.col("at").isNotNull() & (F.col("valid").isNull() | (F.col("at") < F.col("valid")))).select("inn", "reason")


def answer_value(raw: Column, none: tuple[str, ...] = NO_ANSWER) -> Column:
    """What a model named, stripped and lower-cased; null where it named nothing."""
    value = F.lower(F.regexp_replace(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""), r'^"+|"+$', ""))
    return F.when(~value.isin(*none), value)


def _named(domain: str = "domain") -> Column:
    """How a candidate is what a decision (__v, __r) names: 1 its domain, 2 a url of it, 3 its number in the list; null if it is not."""
    number = F.when(F.col("__v").rlike("^[0-9]+$"), F.expr("try_cast(__v AS int)"))
    return F.when(F.col(domain) == F.col("__v"), 1).when(F.col(domain) == F.col("__r"), 2).when(F.col("item_no") == number, 3)


def _with_value(decisions: DataFrame) -> DataFrame:
    return decisions.withColumn("__v", answer_value(F.col("raw_domain"))).withColumn("__r", registrable("__v"))


def resolve_choice(decisions: DataFrame, judged: DataFrame) -> DataFrame:
    """Decisions (one a number) with the chosen candidate's row (c): the list's domain, a url of it, or its number in the list."""
    rows = _with_value(decisions).join(judged.select("inn", "domain", "item_no", F.struct(*judged.columns).alias("c")), "inn", "left").withColumn("__how", _named())
    best = rows.groupBy("inn").agg(F.first(F.struct(*(c for c in decisions.columns if c != "inn"))).alias("d"), F.min_by("c", "__how").alias("c"), F.min("__how").alias("how"))
    return best.select("inn", *(F.col(f"d.{c}").alias(c) for c in decisions.columns if c != "inn"), F.when(F.col("how").isNotNull(), F.col("c")).alias("c"))


def choose(judged: DataFrame, decisions: DataFrame) -> DataFrame:
    """(inn, c) for each number of judged: what its decision names, or the best candidate with proof where there is none; one aggregation."""
    rows = judged.join(_with_value(decisions), "inn", "left").withColumn("__how", F.when(F.coalesce("decided", F.lit(False)), _named()).when(has_proof(), 4))
    pick = F.struct("__how", "item_no")
    best = rows.groupBy("inn").agg(F.min_by(F.struct(*judged.columns), F.when(F.col("__how").isNotNull(), pick)).alias("c"), F.min("__how").alias("how"))
    return best.select("inn", F.when(F.col("how").isNotNull(), F.col("c")).alias("c"))


def proven_best(judged: DataFrame) -> DataFrame:
    """(inn, c): the best-scoring candidate with proof, where a model gave no decision."""
    best = F.row_number().over(Window.partitionBy("inn").orderBy(F.desc("score"), "item_no"))
    return judged.where(has_proof()).withColumn("__n", best).where("__n = 1").select("inn", F.struct(*judged.columns).alias("c"))


def evidence_grade() -> tuple[Column, Column]:
    """Confidence and proof by the class of evidence, from columns of a candidate."""
    classes = ((F.col("inn_on_site"), 0.97, "inn_on_site"), (F.col("ogrn_on_site"), 0.93, "ogrn_on_site"), (F.col("site_field_hits") > 0, 0.75, "directory_site_field"), (F.col("email_hits") > 0, 0.7, "corporate_email"))
    confidence = proof = F
    for condition, c, p in classes:
        confidence, proof = confidence.when(condition, F.lit(c)), proof.when(condition, F.lit(p))
    return confidence.otherwise(0.5), proof.otherwise(F.lit(None).cast("string"))


def guards(chosen: DataFrame, mode: str = "chain") -> DataFrame:
    """From candidate columns (all null where nothing was chosen): with answer, confidence, proof, verdict.

    The two modes differ in order: in agent mode proof accepts first, and a foreign number is no reason to refuse.
    """
    named, proven = F.col("domain").isNotNull(), F.coalesce(has_proof(), F.lit(False))
    blocked = F.coalesce("blacklisted_without_proof", F.lit(False))
    if mode == "chain":
        verdict = F.when(~named, "none").when(blocked, "blocked").when(F.col("reachable").eqNullSafe(False), "unreachable").when(not_empty("foreign_inn").isNotNull() & ~proven, "foreign").otherwise("accepted")
    else:
        verdict = F.when(~named, "none").when(proven, "accepted").when(blocked, "blocked").when(F.coalesce("reachable", F.lit(False)), "accepted").otherwise("unreachable")
    confidence, proof = evidence_grade()
    good = F.col("verdict") == "accepted"
    return chosen.withColumn("verdict", verdict).withColumns({"answer": F.when(good, F.col("domain")), "confidence": F.when(good, confidence).otherwise(0.0), "proof": F.when(good, proof)})
