"""Recorded deliveries of providers as data sources."""

import json

import pytest

from orgbeacon.sources import readers
from orgbeacon.sources.providers import ProviderFetches, ProviderReplies, write_recorded

RAW = "inn string, query_no int, query string, reply string"


@pytest.fixture
def sources(spark):
    for source in (ProviderReplies, ProviderFetches):
        spark.dataSource.register(source)
    yield spark.read.format("provider_replies")
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("size", [1, 7, 64, 10**6])
def test_lines_belong_to_one_piece(sources, tmp_path, size):
    lines = ['{"inn": "1", "query_no": 2, "query": "я", "reply": "{}", "more": 1}', "", "broken {", "[1]", '{"inn": 5, "query_no": "x", "reply": {"a": ["ж"]}}', '{"query_no": true}', "  ", json.dumps({"inn": "2", "reply": "ы" * 300})]
    (tmp_path / "a.jsonl").write_text("\n".join(lines), "utf-8")
    (tmp_path / "b.jsonl").write_text("", "utf-8")
    (tmp_path / "_ignored").write_text("x", "utf-8")
    got = sources.option("pieceBytes", size).load(str(tmp_path)).collect()
    want = [("1", 2, "я", "{}"), (None,) * 4, (None,) * 4, ("5", None, None, '{"a": ["ж"]}'), (None,) * 4, ("2", None, None, "ы" * 300)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_no_files(sources, tmp_path):
    assert sources.load(str(tmp_path)).count() == 0


def test_only_files_that_may_hold_the_keys_are_opened(spark, sources, tmp_path):
    rows = [(str(i) if i else None, i % 3, f"q{i}", None if i % 5 == 0 else '{"results": [{"url": "http://x.com"}]}') for i in range(200)]
    folder = str(tmp_path / "f")
    write_recorded(spark.createDataFrame(rows, RAW), folder, "inn", 16)
    whole = sources.load(folder)
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(rows, key=repr) and whole.rdd.getNumPartitions() == 16
    assert whole.where("inn = '7'").count() == 1

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pushing = spark.read.format("provider_replies").option("pushdown", "true").load(folder)
    for condition, keys, most in (("inn = '7'", {"7"}, 1), ("inn IN ('7', '8', 'x') AND query_no = 1", {"7"}, 3), ("inn = '7' AND inn = '8'", set(), 1), ("inn IS NULL", {None}, 16), ("inn > '98'", {"99"}, 16)):
        found = pushing.where(condition)
        assert {r.inn for r in found.collect()} == keys, condition
        assert found.rdd.getNumPartitions() <= most, condition


def test_sources_feed_hits_and_pages(spark, sources, tmp_path):
    reply = json.dumps({"results": [{"title": "t", "url": "http://a.ru", "text": "x"}, {"url": "http://b.ru"}]})
    write_recorded(spark.createDataFrame([("1", 0, "q", reply), ("2", 0, "q", "no json")], RAW), str(tmp_path / "r"), "inn", 2)
    assert [(r.inn, r["rank"], r.url) for r in readers.shape_hits(sources.load(str(tmp_path / "r"))).orderBy("rank").collect()] == [("1", 1, "http://a.ru"), ("1", 2, "http://b.ru")]
    fetches = [("u", None, 200, "text/html", "<b>1</b>", None, 1), ("u", "v", None, None, None, "timeout", 2), ("w", None, None, None, None, "e", 1)]
    write_recorded(spark.createDataFrame(fetches, "url string, final_url string, status int, content_type string, html string, error string, fetch_no int"), str(tmp_path / "p"), "url", 2)
    pages = readers.good_pages(spark.read.format("provider_fetches").load(str(tmp_path / "p")))
    assert sorted((p.url, p.status, p.html) for p in pages.collect()) == [("u", 200, "<b>1</b>"), ("w", None, "")]


def test_a_large_bucket_is_written_by_several_tasks(spark, sources, tmp_path):
    rows = spark.range(0, 20_000, 1, 20).selectExpr("CAST(id AS STRING) AS inn", "0 AS query_no", "sha2(CAST(id AS STRING), 512) AS query", "'{}' AS reply")
    folder = str(tmp_path / "f")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        write_recorded(rows, folder, "inn", 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = [f for f in (tmp_path / "f").rglob("*.json") if f.stat().st_size]
    assert len(files) > 8 and max(f.stat().st_size for f in files) < sum(f.stat().st_size for f in files) / 4
    assert sorted(map(tuple, sources.load(folder).collect())) == sorted(map(tuple, rows.collect()))
