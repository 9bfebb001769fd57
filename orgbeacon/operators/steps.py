"""Logs of step-by-step sessions: what was done, repeated, and where a session ends."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from orgbeacon.functions.codes import not_empty
from orgbeacon.functions.suffixes import registrable
from orgbeacon.operators.decisions import NO_ANSWER_AGENT, json_object

MOST_STEPS, MOST_INVALID, MOST_OBSERVATION = 10, 3, 1400


_FIELDS = ["action", "args", "args_in_order", "domain"]


def _dumped(value: object, in_order: bool = False) -> str:
    text = json.dumps(value, sort_keys=in_order, ensure_ascii=False)
    return text.encode("utf-8", "replace").decode()  # half of a surrogate pair is no text


def step_of(reply: str | None) -> dict | None:
    """The action a reply asks for, with its arguments as they were written and with the keys of all objects in order; null if it asks for none."""
    try:
        found = json.loads(json_object(reply) or "{}")
    except RecursionError:
        return None
    if not isinstance(found.get("action"), str):
        return None
    args = found.get("args") if isinstance(found.get("args"), dict) else {}
    domain = args.get("domain")
    return {"action": _plain(found["action"].strip()), "args": _dumped(args), "args_in_order": _dumped(args, in_order=True), "domain": _plain(domain) if isinstance(domain, str) else None}


def _plain(text: str) -> str:
    return text.encode("utf-8", "replace").decode()


@F.pandas_udf(StructType([StructField(c, StringType()) for c in _FIELDS]))
def read_step(reply: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([step_of(r) or dict.fromkeys(_FIELDS) for r in reply], columns=_FIELDS)


def parse_steps(steps: DataFrame) -> DataFrame:
    """From (session, index, raw): with action, args (a JSON object with the types it was written with), args_in_order (the same, the keys of
    all its objects in order), named (its ``domain``, if that is a string) and invalid.
    """
    rows = steps.withColumn("__s", read_step("raw"))
    return rows.select(*steps.columns, "__s.action", "__s.args", "__s.args_in_order", F.col("__s.domain").alias("named"), F.col("__s.action").isNull().alias("invalid"))


def signature() -> Column:
    """An action with its arguments; numbers, booleans and strings differ, the order of keys doesn't."""
    return F.concat("action", F.lit(":"), "args_in_order")


def flag_repeats(steps: DataFrame) -> DataFrame:
    """With repeated: the same action with the same arguments, in any order, was taken earlier in the session."""
    own = ~F.col("invalid") & (F.col("action") != "finish")
    key = F.when(own, signature())
    nth = F.row_number().over(Window.partitionBy("session", "__s").orderBy("index"))
    return steps.withColumn("__s", key).withColumn("repeated", F.coalesce(F.col("__s").isNotNull() & (nth > 1), F.lit(False))).drop("__s")


def cut_sessions(steps: DataFrame) -> DataFrame:
    """Steps up to the first finish, the third invalid one in a row, or the tenth step."""
    w = Window.partitionBy("session").orderBy("index")
    good_before = F.sum(F.when(F.col("invalid"), 0).otherwise(1)).over(w)
    in_row = F.sum(F.when(F.col("invalid"), 1).otherwise(0)).over(Window.partitionBy("session", "__g").orderBy("index"))
    rows = steps.withColumn("__g", good_before).withColumn("__r", in_row).withColumn("__n", F.row_number().over(w))
    ends = F.when(F.coalesce(F.col("action") == "finish", F.lit(False)) | (F.col("__r") >= MOST_INVALID) | (F.col("__n") >= MOST_STEPS), F.col("__n"))
    stop = F.min(ends).over(Window.partitionBy("session"))
    return rows.withColumn("__stop", stop).where("__stop IS NULL OR __n <= __stop").drop("__g", "__r", "__n", "__stop")


def raw_answers(steps: DataFrame) -> DataFrame:
    """(session, answer): what the first finish of each session names, as a registrable domain where it has one; only a string names something."""
    value = F.lower(F.regexp_replace("named", r"(?U)^\s+|\s+$", ""))
    finished = F.coalesce(~F.col("invalid") & (F.col("action") == "finish"), F.lit(False))
    rows = steps.groupBy("session").agg(F.min_by(value, F.when(finished, F.col("index"))).alias("v"), F.bool_or(finished).alias("finished"))
    named = F.when(F.col("finished") & ~F.col("v").isin(*NO_ANSWER_AGENT), F.col("v"))
    return rows.withColumn("__v", named).select("session", F.coalesce(registrable("__v"), "__v").alias("answer"))


# The sentences of a transcript.
TRANSCRIPT = {
    "head": "Company to find the website for:\n- INN: ",
    "ogrn": "\n- OGRN: ",
    "name": "\n- Legal name: ",
    "city": "\n- City: ",
    "unknown": "unknown",
    "no_name": "unknown (find it yourself)",
    "first": "\nYou have %d steps. Output your first action as one JSON object.",
    "so_far": "\n\nWhat you did so far:\n",
    "invalid": "[step %d] INVALID OUTPUT -- %s",
    "step": "[step %d] action=%s args=%s\nobservation: %s",
    "left": "\n\nYou have %d step(s) left. Output the next action as one JSON object.",
    "last": " This is your LAST step: you must use finish.",
}


def transcripts(steps: DataFrame, cards: DataFrame, most: int = MOST_STEPS) -> DataFrame:
    """(session, transcript) for each of cards: the card, a line or two for each step, and how many steps are left."""
    say = TRANSCRIPT
    seen = F.coalesce("observation", F.lit(""))
    line = F.when(F.col("invalid"), F.format_string(say["invalid"], "index", seen)).otherwise(F.format_string(say["step"], "index", "action", "args", F.substring(seen, 1, MOST_OBSERVATION)))
    rows = steps.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("index", line.alias("line")))).alias("rows"))  # ten steps at most
    known = lambda c: F.coalesce(not_empty(c), F.lit(say["unknown"]))
    name = F.coalesce(not_empty("name_full"), not_empty("name_short"), F.lit(say["no_name"]))
    head = F.concat(F.lit(say["head"]), "inn", F.lit(say["ogrn"]), known("ogrn"), F.lit(say["name"]), name, F.lit(say["city"]), known("city"), F.lit("\n"))
    left = F.lit(most) - F.size("rows")
    done = F.concat(F.lit(say["so_far"]), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.format_string(say["left"], left), F.when(left <= 1, say["last"]).otherwise(""))
    return cards.join(rows, "session", "left").select("session", F.concat(head, F.when(F.col("rows").isNull(), say["first"] % most).otherwise(done)).alias("transcript"))
