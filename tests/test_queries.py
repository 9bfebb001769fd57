"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from orgbeacon.plans.queries import ORACLES, QUERIES
from orgbeacon.plans.views import view

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def rows(frame):
    def plain(v):
        if v is None or isinstance(v, str):
            return v
        return round(float(v), 6)

    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(repr([plain(v) for v in r]) for r in frame.values.tolist())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_likeness_and_text(spark, sf):
    """The queries that SQL can't express, and texts of pages, on all their rows, against the standard library."""
    import difflib
    import hashlib
    import re

    from orgbeacon.functions import brands

    labels = {r.k: r for r in view(spark, sf, "SELECT k, domain, label, CASE k % 3 WHEN 0 THEN label || 'x' WHEN 1 THEN substr(label, 1, 3) ELSE 'zz-zz' END AS variant FROM org").collect()}
    ratio = lambda a, b: difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() if a and b else 0.0
    got = {r.k: r.ratio for r in QUERIES["d9_similarity"](spark, sf).collect()}
    assert got == {k: round(ratio(r.label, r.variant), 6) for k, r in labels.items()}

    table = str.maketrans({**brands.LATIN})
    other = str.maketrans({**brands.LATIN, **brands.OTHERWISE})

    def best(k, domain, label):
        name = {0: f"Хлеб Цех {label}", 1: f"{label} юбками", 2: f"{label}-{label.upper()}"}[k % 3]
        joined = "".join([t for t in re.split(r"[\s\-_,.]+", name) if len(t) > 2][:6])
        forms = [joined.lower(), joined.lower().translate(table), joined.lower().translate(other)]
        forms += [f.replace("ks", "x") for f in forms] + [f.replace("iy", "y") for f in forms]
        return round(max(ratio(domain.split(".")[0].replace("-", ""), f) for f in forms), 6)

    got = {r.k: r.ratio for r in QUERIES["d10_name_similarity"](spark, sf).collect()}
    assert got == {k: best(k, r.domain, r.label) for k, r in labels.items()}

    import html

    def text_of(page):  # the given pages are well formed: tags go, entities are decoded
        body = re.sub(r"(?is)<(script|style|noscript|svg)\b.*?</\1>|<title>.*?</title>|<!--.*?-->|<![^>]*>", " ", page)
        return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", body)).split())

    pages = {r.page_id: text_of(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.k: (r.text_sha256, r.size) for r in QUERIES["h1_html_to_text"](spark, sf).collect()}
    assert got == {k: (hashlib.sha256(t.encode()).hexdigest(), len(t)) for k, t in pages.items()}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) - set(ORACLES) == {"d9_similarity", "d10_name_similarity"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
