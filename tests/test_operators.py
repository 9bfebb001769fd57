"""Golden tables: cards, candidates, evidence, guards, sessions, evaluation, the whole job."""

from pyspark.sql import functions as F

from orgbeacon.functions.html import page_facts, page_text
from orgbeacon.operators import candidates, cards, decisions, evaluate, evidence, steps
from orgbeacon.plans import resolve
from orgbeacon.sources import readers, writers

HITS = "inn string, query_no int, query string, rank int, title string, url string, snippet string, hit_no int"
INN = "7721581040"


def hits(spark, *rows, inn=INN):
    return spark.createDataFrame([(inn, 0, "q", i, t, u, s, i) for i, (t, u, s) in enumerate(rows, 1)], HITS)


def card(spark, h):
    got = cards.extract_cards(cards.card_blobs(cards.card_hits(h))).collect()
    return got[0] if got else None


def test_card_of_the_right_organisation(spark):
    mixed = card(spark, hits(spark, ('ООО "ЧУЖАЯ" ИНН 7804582055', "", ""), ('ООО "НАША" ИНН 7721581040', "", "ОГРН 5077746329876 ИНН 7721581040")))
    assert "НАША" in mixed.name_short and mixed.ogrn == "5077746329876"
    crowded = card(spark, hits(spark, ("", "", "АО Альфа-Банк ИНН 7728168971 " + "т" * 500 + " ПАО Сбербанк ИНН 7707083893"), inn="7707083893"))
    assert "Сбербанк" in crowded.name_short
    person = card(spark, hits(spark, ("ИП Мясина Елена Анатольевна (ИНН 500100732259)", "", "ОГРНИП 304500116000157 ИНН 500100732259"), inn="500100732259"))
    assert person.name_short == "ИП Мясина Елена Анатольевна" and person.ogrn == "304500116000157"
    assert card(spark, hits(spark, ('ООО "ЧУЖАЯ" ИНН 7804582055', "", ""))) is None


def cards_of(spark, name="ООО «Дейта Кью»", inn=INN, ogrn="5077746329876"):
    return spark.createDataFrame([(inn, ogrn, None, name, "Москва", "s")], "inn string, ogrn string, name_full string, name_short string, city string, source string")


STORY = (('ООО "ДЕЙТА КЬЮ" ИНН 7721581040', "https://fbc.ru/inn/7721581040/", "Телефон +7 495 220-19-62 почта info@dadata.ru"), ("DaData.ru", "https://dadata.ru/", "API подсказок"))


def test_candidates_in_text(spark):
    for parts in (1, 3):
        got = {r.domain: r for r in candidates.collect_candidates(hits(spark, *STORY).repartition(parts), cards_of(spark)).collect()}
        assert got["fbc.ru"].requires_proof and got["dadata.ru"].email_hits == 1 and got["dadata.ru"].mention_count == 1
        assert got["dadata.ru"].first_seen == (1, 1) and not got["dadata.ru"].requires_proof and got["dadata.ru"].mentioned_by_registry


def scored(spark, domain, variants=(), **more):
    base = {"inn": INN, "domain": domain, "mention_count": 0, "best_rank": 99, "site_field_hits": 0, "email_hits": 0, "snippet_hits": 0, "mentioned_by_registry": False, "requires_proof": False, "inn_on_site": False, "ogrn_on_site": False, "foreign_inn": None, "reachable": True, "name_similarity": 0.0, "titles": [], "snippets": [], "variants": list(variants)}
    schema = "inn string, domain string, mention_count int, best_rank int, site_field_hits int, email_hits int, snippet_hits int, mentioned_by_registry boolean, requires_proof boolean, inn_on_site boolean, ogrn_on_site boolean, foreign_inn string, reachable boolean, name_similarity double, titles array<string>, snippets array<string>, variants array<string>"
    df = spark.createDataFrame([tuple((base | more).values())], schema).withColumn("pages", F.array().cast("array<struct<url:string,excerpt:string>>"))
    out = evidence.score_candidates(df)
    return out.select("score", "blacklisted_without_proof", evidence.has_proof().alias("proof"), evidence.has_entity_evidence().alias("entity"), F.array_join(evidence.evidence_lines(), "\n").alias("lines")).first()


def test_scores(spark):
    assert (x := scored(spark, "x.ru", inn_on_site=True)).score >= 100 and x.proof
    assert not scored(spark, "deytakyu.ru", mention_count=3).entity
    assert scored(spark, "ozon.ru", requires_proof=True, mention_count=5).score == -100
    assert scored(spark, "ozon.ru", requires_proof=True, inn_on_site=True).score >= 100
    assert (y := scored(spark, "yandex.ru", requires_proof=True, name_similarity=1.0)).score > 0 and not y.blacklisted_without_proof
    assert scored(spark, "ozon.ru", ["yandex"], requires_proof=True, mention_count=3).blacklisted_without_proof
    bad = scored(spark, "ms-s.pro", foreign_inn="7804582055", mention_count=3)
    assert bad.score < 0 and "DIFFERENT" in bad.lines
    good = scored(spark, "dadata.ru", inn_on_site=True, foreign_inn="7725861463")
    assert good.score >= 100 and "DIFFERENT" not in good.lines


PAGES = "url string, final_url string, status int, html string, error string"


def test_page_scan_stops_at_the_own_number(spark):
    pages = spark.createDataFrame([
        ("https://d.ru/", "https://d.ru/", 200, "<body>ИНН 7725861463</body>", None), ("https://d.ru/contacts", None, 200, f"ОГРН 5077746329876", None),
        ("https://d.ru/contact", None, 200, f"ИНН {INN}", None), ("https://d.ru/kontakty", None, 200, "ИНН 1111111111", None),
        ("https://e.ru/", None, 404, "", None), ("http://e.ru/", None, 200, "<p>x", None), ("https://f.ru/", None, None, "", "t"), ("http://f.ru/", "https://www.g.ru/", 200, "<p>x", None), ("https://h.ru/", None, 200, "домен припаркован", None),
    ], PAGES)
    empty = F.array().cast("array<string>")
    asked = spark.createDataFrame([(INN, d, i, 1, 99, 0, 0, 0) for i, d in enumerate(("d.ru", "e.ru", "f.ru", "h.ru", "none.ru"))], "inn string, domain string, item_no int, mention_count int, best_rank int, site_field_hits int, email_hits int, snippet_hits int").select("*", empty.alias("titles"), empty.alias("snippets"), F.lit(False).alias("requires_proof"), F.lit(False).alias("mentioned_by_registry"), F.struct(F.lit(1).alias("hit_no"), F.lit(0).alias("sub_no")).alias("first_seen"))
    got = {r.domain: r for r in evidence.verify_pages(asked, cards_of(spark), page_facts(page_text(pages))).collect()}
    d = got["d.ru"]
    assert d.inn_on_site and d.ogrn_on_site and d.foreign_inn == "7725861463" and [p.url for p in d.pages] == ["https://d.ru/", "https://d.ru/contacts", "https://d.ru/contact"]
    assert not got["e.ru"].reachable and got["f.ru"].reachable and got["f.ru"].redirects_to == "g.ru"
    assert not got["h.ru"].reachable and len(got["h.ru"].pages) == 1 and not got["none.ru"].reachable and got["none.ru"].final_url is None
    assert [p.excerpt for p in d.pages] == ["ИНН 7725861463", "ОГРН 5077746329876", f"ИНН {INN}"]
    more = evidence.redirect_candidates(evidence.verify_pages(asked, cards_of(spark), page_facts(page_text(pages)))).collect()
    assert [(r.domain, r.mention_count) for r in more] == [("g.ru", 1)]


def test_decisions(spark):
    rows = [("1", 1, '{"domain": null, "confidence": "high", "reason": "z"}'), ("2", 1, "bad"), ("2", 2, '{"domain": "a.ru"}'), ("3", 1, '{"domain": "a.ru", "confidence": "sure"}'), ("3", 2, '{"domain": 5}'), ("4", 3, '{"domain": "late.ru"}')]
    got = {r.inn: r for r in decisions.first_valid(decisions.parse_decisions(spark.createDataFrame(rows, "inn string, attempt int, raw_reply string"))).collect()}
    assert got["1"].decided and got["1"].raw_domain is None and got["2"].raw_domain == "a.ru" and got["2"].model_confidence == "low"
    assert not got["3"].decided and not got["4"].decided


def test_sessions(spark):
    raw = ['{"action":"check","args":{"a":1,"b":2}}', '{"action":"check","args":{"b":2,"a":1}}', "z", "z", '{"action":"x"}', "z", "z", "z", '{"action":"finish"}']
    other = ['{"action":" finish ","args":{"domain":" https://www.A.ru/x "}}', "z"]
    parsed = steps.parse_steps(spark.createDataFrame([(s, i, r) for s, rows in (("s", raw), ("t", other)) for i, r in enumerate(rows, 1)], "session string, index int, raw string"))
    cut = [(r.session, r["index"]) for r in steps.cut_sessions(parsed).orderBy("session", "index").collect()]
    assert cut == [("s", i) for i in range(1, 9)] + [("t", 1)]
    assert [r["index"] for r in steps.flag_repeats(parsed).where("repeated").collect()] == [2]
    assert {r.session: r.answer for r in steps.raw_answers(parsed).collect()} == {"s": None, "t": "a.ru"}


def test_labels_and_summary(spark):
    lines = ['{"inn": "1", "expected": "a.ru", "alt": ["b.ru"], "tags": ["t"]}', '{"inn": "2", "expected": null, "tags": ["t", "no-site"]}', '{"inn": "3", "tags": []}']
    labels = readers.labels_from_json(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [(r.inn, r.is_labelled, r.expected) for r in labels.orderBy("inn").collect()] == [("1", True, "a.ru"), ("2", True, None), ("3", False, None)]
    results = spark.createDataFrame([("c", 1, "1", "b.ru", "inn_on_site", "b.ru", 1.0), ("c", 1, "2", "x.ru", None, None, 2.0), ("c", 1, "3", "z.ru", "ogrn_on_site", None, 3.0)], "config string, config_no int, inn string, domain string, proof string, raw_answer string, elapsed_s double")
    calls = spark.createDataFrame([("c", "1", True, False, False, 10), ("c", "1", False, True, False, 20)], "config string, inn string, json_ok_first_try boolean, repaired boolean, failed boolean, completion_tokens int")
    logs = spark.createDataFrame([("c", "1", False, True), ("c", "1", True, False), ("c", "2", False, False)], "config string, inn string, invalid boolean, repeated boolean")
    s = evaluate.summarize(labels, results, calls, logs).first()
    assert (s.n, s.labelled, s.correct, s.wrong, s.false_positives, s.proven, s.llm_calls, s.out_tokens, s.agent_steps_avg) == (3, 2, 1, 0, 1, 2, 2, 30, 1.5)
    assert s.precision == 0.5 and s.raw_llm_correct == 0 and s.null_rate == 0.0
    assert [(r.inn, r.domain) for r in evaluate.promotable(labels, results).collect()] == [("3", "z.ru")]
    assert {(r.tag, r.ok, r.total) for r in evaluate.by_tag(labels, results).collect()} == {("t", 1, 2), ("no-site", 0, 1)}


def test_whole_job(spark, tmp_path):
    (tmp_path / "in.txt").write_text(f"# note\n{INN}\n\n  # x\n{INN}\nabc\n7707083893\n")
    requests = readers.read_requests(spark, str(tmp_path / "in.txt"))
    pages = spark.createDataFrame([("https://dadata.ru/", "https://dadata.ru/", 200, f"<body>ИНН {INN} <a href='/x'>q</a></body>", None)], PAGES)
    replies = spark.createDataFrame([(INN, 1, '{"domain": "1", "reason": "ok"}')], "inn string, attempt int, raw_reply string")
    out = resolve.resolve(requests, hits(spark, *STORY), cards_of(spark), pages, replies)
    writers.write_in_order(writers.short_lines(out), str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines) == sorted([f'{{"inn":"{INN}","domain":"dadata.ru","proof":"inn_on_site"}}'] * 2 + ['{"inn":"# x","domain":null,"proof":null}', '{"inn":"abc","domain":null,"proof":null}', '{"inn":"7707083893","domain":null,"proof":null}'])
    verdicts = sorted(r.verdict for r in out.collect())
    assert verdicts == ["accepted", "accepted", "invalid", "invalid", "no_name"]


def test_empty_tables(spark):
    none = hits(spark, *STORY).limit(0)
    assert candidates.collect_candidates(none, cards_of(spark)).count() == 0
    assert resolve.resolve(readers.requests_from_lines(spark.createDataFrame([], "request_id long, value string")), none, cards_of(spark), spark.createDataFrame([], PAGES), spark.createDataFrame([], "inn string, attempt int, raw_reply string")).count() == 0


def test_pages_are_read_and_parsed_once(spark, tmp_path):
    from orgbeacon.stored import stored

    spark.createDataFrame([("https://d.ru/", None, 200, f"ИНН {INN}", None)], PAGES).write.parquet(str(tmp_path / "pages"))
    facts = page_facts(page_text(spark.read.parquet(str(tmp_path / "pages"))))
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("ArrowEvalPython") == 1
    asked = spark.createDataFrame([(INN, "d.ru", [], [])], "inn string, domain string, titles array<string>, snippets array<string>")
    plan = evidence.verify_pages(asked, cards_of(spark), stored(facts))._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and "parse_page" not in plan and len(plan) < 40_000


def test_transcripts(spark):
    cards = spark.createDataFrame([("s", INN, None, None, "Имя", ""), ("none", INN, "1", "Полное", None, "Москва")], "session string, inn string, ogrn string, name_full string, name_short string, city string")
    raw = ['{"action": "check", "args": {"a": "1", "b": "\\"2"}}', "z"] + ['{"action": "x"}'] * 7
    parsed = steps.parse_steps(spark.createDataFrame([("s", i, r, f"saw {i}") for i, r in enumerate(raw, 1)], "session string, index int, raw string, observation string"))
    got = {r.session: r.transcript for r in steps.transcripts(parsed, cards).collect()}
    assert got["none"].endswith("- City: Москва\n\nYou have 10 steps. Output your first action as one JSON object.")
    assert '[step 1] action=check args={"a": "1", "b": "\\"2"}\nobservation: saw 1\n[step 2] INVALID OUTPUT -- saw 2\n[step 3] action=x args={}' in got["s"]
    assert got["s"].endswith("You have 1 step(s) left. Output the next action as one JSON object. This is your LAST step: you must use finish.")


def test_evaluation_is_written(spark, tmp_path):
    summary = spark.createDataFrame([("a", 2, None), ("b", 3, 0.5)], "config string, n int, precision double")
    runs = spark.createDataFrame([("a", "1", None), ("b", "1", "x.ru")], "config string, inn string, domain string")
    writers.write_evaluation(summary, runs, str(tmp_path / "out"))
    got = {(r.config, r.part, r.value) for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert got == {("a", "summary", '{"n":2,"precision":null}'), ("b", "summary", '{"n":3,"precision":0.5}'), ("a", "runs", '{"inn":"1"}'), ("b", "runs", '{"inn":"1","domain":"x.ru"}')}
