"""Rows that fail or repeat, hot keys, types in step logs, line breaks, windows, bounds of likeness."""

import difflib
import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_operators import INN, PAGES, STORY, cards_of, hits

from orgbeacon.functions import brands, codes
from orgbeacon.functions.html import page_facts, page_text
from orgbeacon.joins import dealt_join, one_each
from orgbeacon.operators import decisions, evaluate, evidence, steps
from orgbeacon.plans import resolve
from orgbeacon.sources import readers

OTHER = "7707083893"
HOME = f"<body>ИНН {INN} <a href='/x'>q</a></body>"


def answers(spark, pages, cards=None, replies=(), more_hits=None):
    rows = [(i, n) for i, n in enumerate((INN, OTHER, INN))]
    requests = readers.requests_from_lines(spark.createDataFrame(rows, "request_id long, value string"))
    found = hits(spark, *STORY)
    if more_hits is not None:
        found = found.unionByName(more_hits)
    replies = spark.createDataFrame(list(replies), "inn string, attempt int, raw_reply string")
    out = resolve.resolve(requests, found, cards_of(spark) if cards is None else cards, spark.createDataFrame(pages, PAGES), replies)
    return {(r.request_id, r.domain, r.verdict, r.reason) for r in out.collect()}


def test_rows_that_repeat_count_once(spark):
    page = ("https://dadata.ru/", None, 200, HOME, None)
    worse = ("https://dadata.ru/", None, None, "", "timeout")
    twice = cards_of(spark).union(cards_of(spark))
    want = {(0, "dadata.ru", "accepted", None), (1, None, "no_name", None), (2, "dadata.ru", "accepted", None)}
    assert answers(spark, [page, page, worse], twice) == want
    assert answers(spark, [worse, page, page], twice.repartition(3)) == want


def other_story(spark):
    return hits(spark, ("Сбербанк", "https://sberbank.ru/", ""), inn=OTHER)


def both_cards(spark):
    return cards_of(spark).union(cards_of(spark, "ПАО «Сбербанк»", OTHER, "1027700132195"))


GOOD, SBER = ("https://dadata.ru/", None, 200, HOME, None), ("https://sberbank.ru/", None, 200, f"ИНН {OTHER}", None)


def test_a_page_that_cannot_be_parsed_fails_its_number_only(spark):
    got = answers(spark, [GOOD, ("https://sberbank.ru/", None, 200, "<![bad[ x]]>", None)], both_cards(spark), more_hits=other_story(spark))
    assert {g[:3] for g in got} == {(0, "dadata.ru", "accepted"), (1, None, "failed"), (2, "dadata.ru", "accepted")}
    assert next(g[3] for g in got if g[0] == 1).startswith("page: AssertionError")
    # a page of a site that can't be reached is not looked at
    got = answers(spark, [GOOD, ("https://sberbank.ru/", None, 404, "<![bad[ x]]>", None)], both_cards(spark), more_hits=other_story(spark))
    assert next(g[2] for g in got if g[0] == 1) == "none"


def test_cards_that_differ_and_replies_that_cannot_be_read(spark):
    cards = both_cards(spark).union(cards_of(spark, "ПАО «Другое»", OTHER, "1027700132195"))
    got = answers(spark, [GOOD, SBER], cards, more_hits=other_story(spark))
    assert (1, None, "failed", "card: several that differ") in got and (0, "dadata.ru", "accepted", None) in got
    deep = '{"a": ' + "[" * 50_000 + "]" * 50_000 + "}"
    got = answers(spark, [GOOD, SBER], both_cards(spark), [(OTHER, 1, deep), (INN, 1, '{"domain": "1"}'), (INN, 2, deep)], other_story(spark))
    assert (1, None, "failed", "reply: RecursionError") in got and (0, "dadata.ru", "accepted", None) in got


def test_one_each_is_the_same_in_any_order(spark):
    rows = spark.createDataFrame([(1, "a", None), (1, "b", 2), (1, "b", 1), (2, "c", 1)], "k int, x string, y int")
    for parts in (1, 3):
        got = one_each(rows.repartition(parts), "k", best=(F.col("x"),)).collect()
        assert {(r.k, r.x) for r in got} == {(1, "b"), (2, "c")}
    assert one_each(rows.limit(0), "k").count() == 0


def test_a_domain_of_very_many_numbers_is_dealt_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        rows = spark.range(20_000).selectExpr("CAST(id AS STRING) AS inn", "CASE WHEN id % 10 < 3 THEN 'hot.ru' ELSE concat('d', id, '.ru') END AS domain")
        sites = rows.select("domain").distinct().withColumn("title", F.lit("t"))
        out = evidence.with_sites(rows, sites, each=500)
        assert out.count() == 20_000 and out.columns == ["domain", "inn", "title"]
        each = [r["count"] for r in out.where("domain = 'hot.ru'").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(each) == 6000 and len(each) >= 8 and max(each) <= 0.3 * 6000
        plan = dealt_join(rows, sites.withColumn("n", F.lit(1)), "domain", "n", 20_000)._jdf.queryExecution().optimizedPlan().toString()
        assert "codes" not in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", 4)


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=8)


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.text(max_size=4), JSON, max_size=4), st.text(max_size=5), st.booleans())
def test_arguments_keep_their_types(args, action, ascii_only):
    got = steps.step_of("so: " + json.dumps({"action": action, "args": args}, ensure_ascii=ascii_only))
    plain = lambda t: t.encode("utf-8", "replace").decode()
    assert got["action"] == plain(action.strip())
    assert got["args"] == plain(json.dumps(args, ensure_ascii=False)) and got["args_in_order"] == plain(json.dumps(args, ensure_ascii=False, sort_keys=True))
    assert got["domain"] == (plain(args["domain"]) if isinstance(args.get("domain"), str) else None)


def test_types_tell_actions_apart(spark):
    raw = ['{"action": "a", "args": {"n": 1}}', '{"action": "a", "args": {"n": "1"}}', '{"action": "a", "args": {"n": 1.0}}', '{"action": "a", "args": {"n": true}}', '{"action": "a", "args": {"n": null}}', '{"action": "a", "args": {"x": {"a": 1, "b": [{"d": 1, "c": 2}]}}}',
           '{"action": "a", "args": {"x": {"b": [{"c": 2, "d": 1}], "a": 1}}}', '{"action": "a", "args": {"n":1}}', '{"action": "finish", "args": {"domain": ["a.ru"]}}', '{"action": "finish", "args": {"domain": "b.ru"}}', '{"action": "a", "args": {"n": 1e0}}', '{"action": "b", "args": {"s": "\\ud800"}}']
    parsed = steps.parse_steps(spark.createDataFrame([("s", i, r, "ok") for i, r in enumerate(raw)], "session string, index int, raw string, observation string"))
    assert [r["index"] for r in steps.flag_repeats(parsed).where("repeated").orderBy("index").collect()] == [6, 7, 10]
    assert steps.raw_answers(parsed).first().answer is None
    text = steps.transcripts(parsed, spark.createDataFrame([("s", INN, None, None, None, None)], "session string, inn string, ogrn string, name_full string, name_short string, city string")).first().transcript
    assert 'args={"n": true}' in text and 'args={"n": null}' in text and 'args={"n": 1.0}' in text


def test_lines_end_as_in_python(spark, tmp_path):
    text = "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i\nj\r\nk\rl\n\n# m\n  # n\n" + "\n".join(f"x{i}\x0b{i}" for i in range(5000))
    (tmp_path / "one.txt").write_bytes(text.encode())
    (tmp_path / "two.txt").write_bytes(b"z\x0by\n")
    got = []
    for size in ("128m", "5k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        got.append(sorted((r.request_id, r.source) for r in readers.read_requests(spark, str(tmp_path)).collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    lines = text.splitlines()
    want = [(i, x.strip()) for i, x in enumerate(lines) if x.strip() and not x.startswith("#")]
    assert got[0] == got[1] and got[0] == want + [(len(lines), "z"), (len(lines) + 1, "y")]


def test_windows_of_very_many_places(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice([INN, "x" * rnd.randint(0, 90), INN + "1", "да"]) for _ in range(40)) for _ in range(30)] + [f"{INN} " * 50_000, INN, "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.w for r in rows.select("i", codes.windows_near("t", F.lit(INN)).alias("w")).where("i <> 30").collect()}
    import re

    for i, t in enumerate(texts):
        if i != 30:
            want = [t[max(0, m.start() - 220) : m.end() + 220] for m in re.finditer(rf"(?<![0-9]){INN}(?![0-9])", t or "")]
            assert got[i] == want
    many = rows.where("i = 30").select(F.explode(codes.windows_near("t", F.lit(INN))).alias("w")).agg(F.count("*"), F.max(F.length("w"))).first()
    assert tuple(many) == (50_000, 450)


def test_best_likeness_with_fewer_comparisons():
    rnd, full = random.Random(4), 0
    known: dict = {}
    for _ in range(300):
        label = "".join(rnd.choices("abcdeklmnoprst", k=rnd.randint(3, 12)))
        forms = ["".join(rnd.choices("abcdeklmnoprst", k=rnd.randint(3, 14))) for _ in range(8)] + [label[: rnd.randint(2, len(label))] + "x"]
        best = max(difflib.SequenceMatcher(None, label, f).ratio() for f in forms)
        assert brands.most_alike(label, forms, known) == best
        full += len(forms)
    assert 5 * len(known) <= full
    assert brands.most_alike("a", ["", "b"], {}) == 0.0 and brands.most_alike("a", [], {}) == 0.0


@pytest.mark.parametrize("stored_once", [True, False])
def test_counts_of_configurations_and_tags(spark, stored_once):
    labels = spark.createDataFrame([("1", True, "a.ru", [], ["t", "u"]), ("2", True, None, [], ["t"]), ("3", False, None, [], None)], "inn string, is_labelled boolean, expected string, alt array<string>, tags array<string>")
    results = spark.createDataFrame([("c", "1", "a.ru", None, None, 1.0), ("c", "2", "x.ru", None, None, 2.0), ("c", "3", "y.ru", None, None, 3.0)], "config string, inn string, domain string, proof string, raw_answer string, elapsed_s double")
    counted = evaluate.counts(labels, results)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Aggregate") == 2 or "AdaptiveSparkPlan" in plan
    got = {(r.tag, r.n, r.labelled, r.correct) for r in counted.collect()}
    assert got == {(None, 3, 2, 1), ("t", 2, 2, 1), ("u", 1, 1, 1)}
    tags = evaluate.by_tag(labels, results, counted if stored_once else None)
    assert {(r.tag, r.ok, r.total) for r in tags.collect()} == {("t", 1, 2), ("u", 1, 1)}


def test_replies_are_read_whatever_they_hold(spark):
    rows = [("1", 1, "[" * 5), ("2", 1, None), ("3", 1, '{"domain": "a.ru"} {'), ("4", 1, "{" * 100_000 + "}" * 100_000)]
    got = {r.inn: (r.is_valid, r.error) for r in decisions.parse_decisions(spark.createDataFrame(rows, "inn string, attempt int, raw_reply string")).collect()}
    assert got["3"] == (True, None) and not got["1"][0] and not got["2"][0] and not got["4"][0]


def test_facts_hold_errors(spark):
    facts = page_facts(page_text(spark.createDataFrame([("https://a.ru/", None, 200, "<![bad[ x]]>", None), ("https://b.ru/", None, 200, "<p>x", None)], PAGES)))
    assert {r.url: bool(r.parse_error) for r in facts.collect()} == {"https://a.ru/": True, "https://b.ru/": False}
