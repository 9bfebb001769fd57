"""Quality rules: counts against brute force on all rows, what is learned on held-out rows, odd rows."""

import collections
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orgbeacon.llm import quality_rules, queries
from orgbeacon.llm.shared import id_remainder

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def plain(text):
    """The contract's counts, one text at a time."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


FIVE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ODD = [None, "", "  \n\t", "a", "x\nx\n\nx \nx", "é ü\né ü\r\né ü\r", "# | <>", "a b c d e f g h " * 2, "a b c d e f g h i " * 2, "w " * 300_000, "w " * 300_000]


def test_counts_of_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(ODD)], "doc_id long, text string, n_words int")
    out = quality_rules.statistics(docs)
    assert "text" in out.columns and out.columns.count("n_words") == 1
    got = {r.doc_id: tuple(r[c] for c in FIVE) for r in out.collect()}
    assert got == {i: plain(t) for i, t in enumerate(ODD)}
    assert quality_rules.statistics(docs.limit(0)).count() == 0
    one = out.where("doc_id = 6").first()
    assert (one.n_letters, one.n_capitals, one.n_marks, one.n_same_next, one.n_distinct) == (0, 0, 0, 0, 3)


def test_covering_finds_planted_rules():
    rnd = np.random.default_rng(3)
    x = {"a": rnd.random(3000), "b": rnd.random(3000), "c": rnd.random(3000)}
    classes = np.where((x["a"] > 0.8) & (x["b"] < 0.5), "bad", np.where(x["c"] > 0.9, "odd", "good"))
    found = quality_rules.cover(x, classes, np.ones(3000), rnd.random(3000) < 0.66, 0.9, 6)
    assert found.default == "good" and {n for n, _ in found.rules} == {"bad", "odd"}
    verdict = np.full(3000, "good")
    for name, conditions in reversed(found.rules):
        verdict[quality_rules._fits(x, conditions, np.ones(3000, bool))] = name
    assert (verdict == classes).mean() > 0.97


def test_without_ratings_and_with_one_class(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "c")], "doc_id long, text string")
    none = quality_rules.train(docs, spark.createDataFrame([(None, "x"), (1, None)], "doc_id long, class string"))
    assert [r.verdict for r in quality_rules.judge(docs, none).collect()] == [None] * 3
    one = quality_rules.train(docs, spark.createDataFrame([(1, "x"), (1, "x"), (9, "x")], "doc_id long, class string"))
    assert {r.verdict for r in quality_rules.judge(docs, one).collect()} == {"x"} and str(one) == "else -> x"
    gone = quality_rules.train(docs, spark.createDataFrame([(9, "x"), (9, "y")], "doc_id long, class string"))
    assert gone.default == "y"


def test_verdicts_are_spark_expressions(spark):
    rules = quality_rules.DecisionList([("low", [("symbols", ">=", 0.5), ("words", "<", 5.0)]), ("toxic", [("markers_0", ">=", 1.0)])], "good", [["idiot", "scum"]])
    docs = spark.createDataFrame([(1, "# #"), (2, "# # a b c d e"), (3, "an Idiot, and so"), (4, "idiots are not known")], "doc_id long, text string")
    out = quality_rules.judge(docs, rules)
    assert {r.doc_id: r.verdict for r in out.collect()} == {1: "low", 2: "good", 3: "toxic", 4: "good"}
    assert "CASE WHEN" in out._jdf.queryExecution().optimizedPlan().toString() and "Python" not in out.select(rules.verdict())._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]


@needs_tables
def test_query(spark):
    out = queries.op12_quality_rules(spark, SF)
    assert out.columns[:8] == ["doc_id", *FIVE, "base_failed", "kept"]
    got, rows = {r.doc_id: r for r in out.collect()}, spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        want, own = plain(r.text), got[r.doc_id]
        assert tuple(own[c] for c in FIVE) == want
        assert own.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (own.base_failed and own.kept)
    labels = queries.rated(spark.read.parquet(f"{SF}/labels.parquet")).join(spark.createDataFrame([(i, r.kept) for i, r in got.items()], "doc_id long, kept boolean"), "doc_id")
    kept = {r["class"]: r["share"] for r in labels.groupBy("class").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert kept["good"] >= 0.95 and kept["toxic"] <= 0.25 and kept["low"] <= 0.6


@needs_tables
def test_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels, held = queries.rated(spark.read.parquet(f"{SF}/labels.parquet")).dropna(), id_remainder("doc_id", 5) == 0
    rules = quality_rules.train(docs, labels.where(~held))
    got = quality_rules.judge(docs, rules, keep=["doc_id"]).join(labels.where(held), "doc_id")
    good, left = got.where("class = 'good'").agg(F.count("*"), F.count_if(F.col("verdict") == "good")).first()
    bad, caught = got.where("class = 'toxic'").agg(F.count("*"), F.count_if(F.col("verdict") != "good")).first()
    assert left >= 0.95 * good and caught >= 0.6 * bad
