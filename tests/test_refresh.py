"""Runs that begin from what an earlier run left, and the snapshot table."""

import pytest
from test_operators import PAGES

from orgbeacon.plans.refresh import refresh
from orgbeacon.plans.resolve import resolve
from orgbeacon.sources import readers, snapshot



def number(i):
    digits = f"{770000000 + i:09d}"
    return digits + str(sum(w * int(d) for w, d in zip((2, 4, 10, 3, 5, 9, 4, 6, 8), digits, strict=True)) % 11 % 10)


HIT = "inn string, query_no int, query string, rank int, title string, url string, snippet string, hit_no int"
CARD = "inn string, ogrn string, name_full string, name_short string, city string, source string"
N = 14


def inputs(spark, changed=False):
    """Fourteen numbers with a site each. What is another than before: 0 nothing, 1 card, 2 a hit more, 3 no reply any more, 4 home page, 5 a page that was looked up and was not
    there, 6 home page gone, 7 a page that nobody looks up, 8 the page that its home redirects to, 9 nothing, but a card twice before and now, 10 has no hits, 11 no card, 12 a broken page is whole now, 13 is asked for only now."""
    at = lambda i, j: changed and i == j
    cards, found, replies, pages = [], [], [], [("https://dealt.ru/", None, 200, "x", None)]
    for i in range(N):
        inn, site = number(i), f"site{i}.ru"
        cards += [(inn, f"1{i:012d}", None, f"ООО «Имя{i}{'а' if at(i, 1) else ''}»", "Москва", "s")] * (0 if i == 11 else 2 if i == 9 else 1)
        found += [] if i == 10 else [(inn, 0, "q", 1, "t", f"https://{site}/", "", 1)] + ([(inn, 0, "q", 2, "t", "https://other.com/", "", 2)] if at(i, 2) else [])
        replies += [] if at(i, 3) else [(inn, 1, '{"domain": "1", "confidence": "high"}')]
        text = {4: f"ИНН {inn}" if at(i, 4) else "x", 12: f"ИНН {inn}" if at(i, 12) else "<![bad[ x]]>"}.get(i, f"ИНН {inn}" if i % 2 else "x")
        pages += [] if at(i, 6) else [(f"https://{site}/", "https://away.ru/" if i == 8 else None, 200, f"<body>{text}</body>", None)]
        pages += [(f"https://{site}/contacts", None, 200, f"ИНН {inn}", None)] if at(i, 5) else []
        pages += [("https://away.ru/", None, 200, f"ИНН {inn}" if changed else "y", None)] if i == 8 else []
        pages += [(f"https://{site}/nobody/looks/here", None, 200, "z", None)] if at(i, 7) else []
    asked = [(i, number(i)) for i in range(N if changed else N - 1)] + [(100, number(0)), (101, "12"), (102, None)]
    requests = readers.requests_from_lines(spark.createDataFrame(asked, "request_id long, value string"))
    return {"requests": requests, "hits": spark.createDataFrame(found, HIT), "cards": spark.createDataFrame(cards, CARD), "pages": spark.createDataFrame(pages, PAGES), "replies": spark.createDataFrame(replies, "inn string, attempt int, raw_reply string")}


def test_only_numbers_with_other_inputs_are_worked_on(spark, tmp_path):
    first = {k: v.limit(0) for k, v in inputs(spark).items()}
    assert refresh(**first, folder=str(tmp_path / "0")).count() == 0
    before = refresh(**inputs(spark), folder=str(tmp_path / "1"), previous=str(tmp_path / "0")).collect()
    assert {r.inn for r in before if r.again} == {number(i) for i in range(N - 1)} and {r.request_id for r in before if r.again is None} == {101}
    verdicts = {r.request_id: r.verdict for r in before}
    assert verdicts[12] == "failed" and verdicts[11] == "no_name" and verdicts[10] == "no_candidates" and verdicts[1] == "accepted" == verdicts[9]

    now = inputs(spark, changed=True)
    now["pages"] = snapshot.write_snapshot(now["pages"], "pages_of_refresh", 3)  # digests are the same, written or computed
    got = refresh(**now, folder=str(tmp_path / "2"), previous=str(tmp_path / "1")).collect()
    assert {r.request_id for r in got if r.again} == {1, 2, 3, 4, 5, 6, 8, 12, 13}
    assert {r.request_id for r in got if r.again is False} == {0, 7, 9, 10, 11, 100}
    plain = lambda rows: sorted(str({k: v for k, v in r.asDict().items() if k != "again"}) for r in rows)
    assert plain(got) == plain(resolve(**now).collect())
    assert {r.request_id: r.verdict for r in got}[12] == "accepted"

    last = {k: v.repartition(3) for k, v in now.items()}
    third = refresh(**last, folder=str(tmp_path / "3"), previous=str(tmp_path / "2")).collect()
    assert plain(third) == plain(got) and not any(r.again for r in third)
    with pytest.raises(ValueError):
        refresh(**now, folder=str(tmp_path / "1"), previous=f"{tmp_path / '1'}/")


def test_looking_up_urls_moves_no_page(spark):
    many = spark.createDataFrame([(None, None, 200, "x", None)] + [(f"https://d{i}.ru/", None, 200 if i % 2 else None, "x" * i, None) for i in range(200)], PAGES)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        table = snapshot.write_snapshot(many, "pages_for_test", 6)
        assert table.count() == 201
        needed = spark.createDataFrame([(f"https://d{i}.ru/",) for i in range(0, 210, 3)] * 2 + [(None,)], "url string")
        out = snapshot.pending_pages(needed, table)
        assert {r.url for r in out.collect()} == {f"https://d{i}.ru/" for i in range(0, 210, 3) if i >= 200 or i % 2 == 0}
        plan = out._jdf.queryExecution().executedPlan().toString()
        scan = plan[plan.index("FileScan parquet") - 600 :]
        assert "Bucketed: true" in plan and "html" not in scan.split("ReadSchema")[1]
        asked_side, pages_side = plan.split("Initial Plan")[-1].rsplit("ExistingRDD", 1)  # the subtree of the pages is printed last
        assert "Exchange" in asked_side and "Exchange" not in pages_side and "FileScan" in pages_side
        digests = snapshot.page_digests(table)
        plan = digests._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "html" not in plan.split("ReadSchema")[1]
        assert {tuple(r) for r in digests.collect()} == {tuple(r) for r in snapshot.page_digests(many).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS pages_for_test")
