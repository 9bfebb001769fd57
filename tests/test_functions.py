"""Golden cases of the scalar functions, and properties."""

import difflib
from functools import cache

import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orgbeacon.functions import brands, codes, domains, html, suffixes
from orgbeacon.operators import decisions


def values(spark, column, *rows):
    names = "abcde"[: len(rows[0])]
    schema = ", ".join(f"{n} string" for n in names)
    return [r.x for r in spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"i int, {schema}").orderBy("i").select(column.alias("x")).collect()]


def test_numbers(spark):
    raw = [("7721581040",), ("7721581041",), ("500100732259",), ("abc",), ("123",), (None,), ("77-2158-1040",)]
    assert values(spark, codes.is_valid_inn("a"), *raw) == [True, False, True, False, False, False, True]
    assert values(spark, codes.kind("a"), *raw)[:3] == ["legal", "legal", "entrepreneur"]
    valid = ["7804582055", "7728168971", "7707083893", "7736207543", "7704217370", "7710140679"]
    assert all(values(spark, codes.is_valid_inn("a"), *[(v,) for v in valid]))
    assert not any(values(spark, codes.is_valid_inn("a"), ("5001112233",), ("7725861463",)))


def test_one_control_digit_is_right(spark):
    rows = [(f"{prefix:09d}{d}",) for prefix in (0, 1, 123456789, 999999999, 770708389) for d in range(10)]
    got = values(spark, codes.is_valid_inn("a"), *rows)
    assert [sum(got[i : i + 10]) for i in range(0, 50, 10)] == [1] * 5


def test_codes_in_text(spark):
    code = "7721581040"
    texts = [("ИНН 7721581040, КПП", code), ("12377215810401", code), ("ИНН 7721581040", code), (None, code), ("x", None), ("x", "")]
    assert values(spark, codes.contains_code("a", "b"), *texts) == [True, False, True, False, False, False]
    assert values(spark, codes.code_runs("a"), ("a 7721581040 b 123 5077746329876x 7721581040",), (None,)) == [["7721581040", "5077746329876"], []]
    assert values(spark, codes.published_inns("a"), ("ИНН: 7804582055, КПП 780401001",), ("тел. 8 812 4263626",), ("инн 500100732259",)) == [["7804582055"], [], ["5001007322"]]
    assert values(spark, codes.windows_near("a", "b", 2), ("q 77 w 77 e 177", "77"), ("none", "77"), (None, "77")) == [["q 77 w", "w 77 e"], [], []]
    long = "x" * 100 + f" {code} " + "y" * 100
    assert values(spark, codes.excerpt_around("a", "b"), (long, code), ("z", code)) == ["x" * 79 + f" {code} " + "y" * 79, ""]
    assert values(spark, codes.looks_parked("a"), ("Этот ДОМЕН ПРОДАЁТСЯ",), ("Добро пожаловать",), (None,)) == [True, False, False]


def test_registrable(spark):
    rows = [("https://www.dadata.ru/api/x",), ("http://a.b.example.co.uk/x",), ("не url",), (None,), ("",), ("http://127.0.0.1/",), ("HTTP://Сайт.РФ/x",), ("com",), ("user@host.example.org:8080/x",)]
    assert values(spark, suffixes.registrable("a"), *rows) == ["dadata.ru", "example.co.uk", None, None, None, None, "сайт.рф", None, "example.org"]


@cache
def ascii_labels(name):
    return [x if x.isascii() else x.encode("idna").decode() for x in name.split(".")]


def longest_suffix(host, rules):
    """Brute force: of all suffixes of a host the longest that a rule fits, label by label; the registrable domain has one label more."""
    labels = host.rstrip(".").split(".")
    if "" in labels or len(labels) < 2:
        return None
    fits = []
    for rule in rules:
        parts = ascii_labels(rule.lstrip("!"))
        own = ascii_labels(host.rstrip("."))[-len(parts) :]
        if len(own) == len(parts) and all(p in ("*", o) for p, o in zip(parts, own, strict=True)):
            fits.append((len(parts), rule.startswith("!")))
    if not fits:
        return None
    size, exception = max(fits)
    size -= exception
    return ".".join(labels[-size - 1 :]) if len(labels) > size else None


def test_registrable_against_brute_force(spark):
    own = frozenset({"ck", "*.ck", "!www.ck", "uk", "co.uk", "*.x.ck", "d'or"})
    hosts = ["www.ck", "a.www.ck", "a.b.ck", "b.ck", "ck", "x.y.co.uk", "y.co.uk", "co.uk", "a.b.x.ck", "q.a.b.x.ck", "x.ck", "s.d'or", "a..uk", ".uk", "a.uk.", "a.uk...", "...", "a.zz"]
    assert values(spark, suffixes.registrable("a", own), *((h,) for h in hosts)) == [longest_suffix(h, own) for h in hosts]
    rules = suffixes.public_suffixes()
    some = [r for r in sorted(rules) if r[0] in "*!" or not r.isascii() or (len(r) * 7 + ord(r[0])) % 61 == 0 or r.count(".") == 3]
    hosts = [p + h for r in some for h in (r.lstrip("*!."),) for p in ("", "a.", "b.a.", "c.b.a.")]
    got = values(spark, suffixes.registrable("a"), *((h,) for h in hosts))
    by_end = {}
    for r in rules:
        by_end.setdefault(r.rpartition(".")[2], []).append(r)
    for h, g in zip(hosts, got, strict=True):
        assert g == longest_suffix(h, by_end[h.rpartition(".")[2]]), h
    once = [(g,) for g in got if g]
    assert values(spark, suffixes.registrable("a"), *once) == [g for (g,) in once]


def test_other_full_stops_and_ascii_forms(spark):
    rows = [("http://Www.Сайт\u3002рф/x",), ("a.xn--p1ai",), ("a.公司.xn--j6w193g",)]
    assert values(spark, suffixes.registrable("a"), *rows) == ["сайт.рф", "a.xn--p1ai", "a.公司.xn--j6w193g"]


def test_suffixes_run_in_the_jvm(spark):
    text = F.concat("a", F.lit(" website: x.co.uk"))
    df = spark.createDataFrame([("https://a.ru/",)], "a string").select("a", suffixes.registrable("a").alias("d"), domains.mine_domains(text).alias("m"), domains.domains_in_text(text).alias("t"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "Exchange" not in plan and "INSET" in plan
    assert [m.domain for m in df.head().m] == ["x.co.uk", "a.ru"]


def test_lists(spark):
    assert values(spark, domains.is_blocked(F.col("a")), ("rusprofile.ru",), ("hh.ru",), ("dadata.ru",), (None,)) == [True, True, False, False]


def mined(spark, text):
    return [tuple(x) for x in values(spark, domains.mine_domains(F.col("a")), (text,))[0]]


def test_mining(spark):
    assert mined(spark, "Сайт: https://dadata.ru ·") == [("dadata.ru", "site_field")]
    assert ("dadata.ru", "email") in mined(spark, "почта info@dadata.ru")
    assert mined(spark, "пишите на ivan@mail.ru") == []
    assert ("dadata.ru", "mention") in mined(spark, "торговая марка DADATA.RU")
    assert mined(spark, "Сайт:dadata.ru") == [("dadata.ru", "mention")]
    assert mined(spark, "ivan.pro@mail.ru") == [("ivan.pro", "mention")]
    assert mined(spark, None) == []


def test_registry_hits(spark):
    name = "ООО «Дейта Кью»"
    rows = [("https://fbc.ru/inn/7721581040/", "", "7721581040", None, name), ("https://x.ru/c/5077746329876", "", "7721581040", "5077746329876", name), ("https://dadata.ru/", "DaData.ru — подсказки", "7721581040", None, name), ("https://sberbank.ru/rekvizity", "Реквизиты ПАО Сбербанк ИНН 7707083893", "7707083893", None, "ПАО «Сбербанк»")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, url string, title string, inn string, ogrn string, name string").withColumn("domain", suffixes.registrable("url"))
    hit = domains.looks_like_registry_hit(F.col("url"), F.col("title"), F.col("inn"), F.col("ogrn"), brands.brand_variants(F.col("name"), F.lit("")), F.col("domain"))
    assert [r.x for r in df.orderBy("i").select(hit.alias("x")).collect()] == [True, True, False, False]


def test_brands(spark):
    assert values(spark, brands.brand_variants(F.col("a"), F.lit("")), ("ООО «Дейта Кью»",))[0] == ["дейта", "deyta", "deita", "кью", "kyu", "kju", "дейтакью", "deytakyu", "deitakju"]
    assert "yandex" in values(spark, brands.brand_variants(F.col("a")), ("ООО \"Яндекс\"",))[0]
    assert values(spark, brands.name_similarity(F.col("a"), F.array("b")), ("yandex.ru", 'ООО "Яндекс"'), ("ozon.ru", None)) == [1.0, 0.0]
    assert values(spark, brands.brand_in_domain(F.col("a"), F.array("b")), ("ya.ru", "яндекс"), ("my-shop.ru", "shop"), ("a.ru", None)) == [False, True, False]


@given(st.lists(st.tuples(st.text(max_size=8), st.text(max_size=8)), max_size=5))
def test_similarity_is_difflibs(pairs):
    got = brands.similarity.func(pd.Series([a for a, _ in pairs], dtype=object), pd.Series([b for _, b in pairs], dtype=object))
    assert list(got) == [difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() if a and b else 0.0 for a, b in pairs]


def test_pages():
    page = html._parsed('<html><head><title> T &amp; x </title><style>p{}</style></head><body><script>z</script><p>a&nbsp;b c</p><svg><text>no</text></svg><a href="/contacts#1">Контакты</a><a href="mailto:x@y.ru">info</a><a href="/contacts">x</a></body></html>', "https://d.ru/q/")
    assert page["title"] == "T & x" and page["text"] == "a b c Контакты info x" and page["links"] == ["https://d.ru/contacts"]
    assert html._parsed(None, None) == {"text": "", "title": "", "links": [], "codes": [], "parse_error": None}
    assert html._parsed("<p>unclosed <b>x", "u")["text"] == "unclosed x"


def test_json_in_replies():
    assert decisions.json_object('Вот:\n```json\n{"a": 1}\n``` да') == '{"a": 1}'
    assert decisions.json_object('{"d": "a.ru", "s": "}"}') == '{"d": "a.ru", "s": "}"}'
    assert decisions.json_object("просто текст") is None and decisions.json_object(None) is None and decisions.json_object("[1]") is None
    assert decisions.json_object('{"a": "\\"}"} tail }') == '{"a": "\\"}"}'


def test_choices(spark):
    judged = spark.createDataFrame([(str(i), d, n) for i in range(9) for n, d in ((1, "dadata.ru"), (2, "dp.ru"))], "inn string, domain string, item_no int")
    raw = ["dadata.ru", "https://www.dadata.ru/", "2", None, "null", "none", "", "-", "вымышленный.ru"]
    rows = spark.createDataFrame([(str(i), r) for i, r in enumerate(raw)], "inn string, raw_domain string")
    got = {r.inn: r.d for r in decisions.resolve_choice(rows, judged).select("inn", F.col("c.domain").alias("d")).collect()}
    assert [got[str(i)] for i in range(9)] == ["dadata.ru", "dadata.ru", "dp.ru", None, None, None, None, None, None]


@pytest.mark.parametrize("text", ["", "x", "ИНН 7721581040 и 12345 77215810401"])
def test_runs_agree_with_containment(spark, text):
    for code in ("7721581040", "123456789012"):
        runs = values(spark, codes.code_runs("a"), (text,))[0]
        assert values(spark, codes.contains_code("a", "b"), (text, code))[0] == (code in runs)


def test_suffixes_need_no_jar(monkeypatch, tmp_path):
    import pyspark

    monkeypatch.setattr(pyspark, "__file__", str(tmp_path / "pyspark" / "__init__.py"))  # a Spark without its folder of jars
    suffixes.public_suffixes.cache_clear()
    rules = suffixes.public_suffixes()
    assert {"ru", "co.uk", "com"} <= rules and "blogspot.com" not in rules
    own = tmp_path / "list.txt"
    own.write_text("// mine\nzz\n*.yy\n!www.yy\n// ===END ICANN DOMAINS===\nprivate.zz\n")
    rules = suffixes.public_suffixes(str(own))
    assert rules == {"zz", "*.yy", "!www.yy"}
    assert [longest_suffix(h, rules) for h in ("a.b.zz", "a.b.yy", "www.yy", "private.zz", "zz")] == ["b.zz", "a.b.yy", "www.yy", "private.zz", None]


def test_codes_with_excerpts():
    text = "x" * 200 + " 7721581040 y 7721581040 123 5077746329876" + "z" * 200
    got = html.codes_with_excerpts(text)
    assert [c["code"] for c in got] == ["7721581040", "5077746329876"] and got[0]["excerpt"] == text[121:291].strip()


def test_pages_are_held_a_few_at_a_time():
    import pyarrow as pa

    pages = [f"<title>t{i} &amp</title><p>ИНН {7721581040 + i}</p><a href='/contacts'>к</a>" if i % 7 else None for i in range(2 * html.PAGES_AT_ONCE + 5)]
    got = list(html.parse_page.func(iter([(pa.array(pages, pa.string()), pa.array(["https://d.ru/"] * len(pages)))])))
    assert [len(part) for part in got] == [html.PAGES_AT_ONCE, html.PAGES_AT_ONCE, 5]
    assert [row for part in got for row in part.to_pylist()] == [html._parsed(page, "https://d.ru/") for page in pages]


def test_likeness_is_worked_out_a_few_rows_at_a_time():
    import pyarrow as pa

    n = brands.ROWS_AT_ONCE
    labels = [f"label{i % 50}" if i % 9 else None for i in range(n + 7)]
    forms = [[f"labe{i % 60}", "лейбл", None] if i % 11 else None for i in range(n + 7)]
    got = list(brands.best_similarity.func(iter([(pa.array(labels, pa.string()), pa.array(forms, pa.list_(pa.string())))])))
    assert [len(part) for part in got] == [n, 7]
    assert [x for part in got for x in part.to_pylist()] == [brands.most_alike(a, b, {}) if a and b is not None else 0.0 for a, b in zip(labels, forms, strict=True)]


def test_references_without_a_semicolon_are_read_as_browsers_do():
    page = html._parsed("<title>a &amp;&amp</title><h1>b &amp</h1><p>c &am</p>", "u")
    assert (page["title"], page["text"]) == ("a &&", "b & c &am")


def test_plain_tags_end_texts_and_hidden_ones_hide():
    page = html._parsed('<p>a<b>b</b>c<br>d</p><script>"</p>x"</script><P>e</P ><style>f</b></style><svg><p>g</p></svg><p class="x">h<li>i 12345678901 1234567890', "u")
    assert (page["text"], [c["code"] for c in page["codes"]]) == ("a b c d e h i 12345678901 1234567890", ["1234567890"])


def test_ratios_are_those_of_difflib():
    import difflib

    pairs = [("Ромашка", "romashka"), ("АБВ", "абв"), ("abcabd", "abdabc"), ("ab" * 130, "ab" * 130), ("abc" * 90, "bca" * 80), ("a", ""), ("x", "y")]
    assert [brands._ratio(a, b) for a, b in pairs] == [difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() if a and b else 0.0 for a, b in pairs]


def test_replies_are_held_a_few_at_a_time():
    import pyarrow as pa

    from orgbeacon.operators import decisions

    n = decisions.REPLIES_AT_ONCE
    replies = [None if i % 3 == 0 else f'x {{"a": {i}}}' if i % 3 == 1 else "none" for i in range(n + 3)]
    got = list(decisions.read_reply.func(iter([pa.array(replies, pa.string())])))
    assert [len(part) for part in got] == [n, 3]
    assert [(r["json"], r["error"]) for part in got for r in part.to_pylist()] == [decisions._json_or_error(r) for r in replies]
