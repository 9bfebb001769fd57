"""A query for each operator on views of the given tables, and SQL with the same rows where SQL can express it.

"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgbeacon.functions import brands, codes, domains, html, suffixes
from orgbeacon.operators import candidates, cards, decisions, evaluate, evidence, steps
from orgbeacon.plans import refresh as again
from orgbeacon.plans import resolve as whole
from orgbeacon.plans.views import CTE, view
from orgbeacon.sources import providers, readers, snapshot, writers
from orgbeacon.stored import shared_folder, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable:
    def register(build: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: build(lambda v: view(spark, sf_dir, v if v.upper().startswith("SELECT") else f"SELECT * FROM {v}"))
        if sql:
            ORACLES[name] = CTE + sql
        return build

    return register


def _in(column: str, values: tuple[str, ...]) -> str:
    return f"coalesce({column} IN (" + ", ".join(f"'{v}'" for v in values) + "), false)"


def _any_of(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _joined(*names: str) -> list:
    return [F.array_join(n, "|").alias(n) for n in names]


# ---- sources and sinks

_LINES = """SELECT k AS request_id, CASE k % 6 WHEN 0 THEN '# note ' || raw WHEN 1 THEN '   ' WHEN 2 THEN '  ' || raw || ' ' WHEN 3 THEN ' # x' ELSE raw END AS value FROM raw"""
_VALID = """CASE WHEN length(d) = 10 THEN {c10} = CAST(substr(d, 10, 1) AS INT) WHEN length(d) = 12 THEN {c11} = CAST(substr(d, 11, 1) AS INT) AND {c12} = CAST(substr(d, 12, 1) AS INT) ELSE false END"""


def _valid_sql() -> str:
    from orgbeacon.plans.views import W10, W11, W12, control

    safe = lambda w: control("rpad(d, 12, '0')", w)
    return _VALID.format(c10=safe(W10), c11=safe(W11), c12=safe(W12))


# a file in three, a block a row, and line breaks of several kinds within a row
_LINE = "\u2028"
_PARTS = f"SELECT 'file' || CAST(request_id % 3 AS STRING) AS file, request_id AS block, value || CASE request_id % 4 WHEN 1 THEN chr(11) || value WHEN 2 THEN '{_LINE}' || '#' || chr(28) || chr(133) || value ELSE '' END AS value FROM ({_LINES}) l"
_SPLIT = f"""SELECT request_id, value FROM (SELECT file, block, pos, value, row_number() OVER (ORDER BY file, block, pos) - 1 AS request_id FROM (
  SELECT file, block, unnest(string_split_regex(value, '[' || chr(11) || chr(28) || chr(133) || '{_LINE}' || ']')) AS value, generate_subscripts(string_split_regex(value, '[' || chr(11) || chr(28) || chr(133) || '{_LINE}' || ']'), 1) AS pos FROM ({_PARTS}) p) l) n"""


@_query("s1_read_requests", f"""SELECT request_id, source, d AS inn, {_valid_sql()} AS is_valid, CASE WHEN length(d) = 12 THEN 'entrepreneur' ELSE 'legal' END AS kind
  FROM (SELECT request_id, trim(value) AS source, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM ({_SPLIT}) l WHERE value NOT LIKE '#%' AND trim(value) <> '') x""")
def _build(v):
    return readers.requests_from_lines(readers.numbered_lines(v(_PARTS)))


_REPLY = """SELECT inn, 0 AS query_no, 'q' AS query, '{"results": [{"title": "' || label || '", "url": "https://' || domain || '/", "text": "body ' || CAST(k AS STRING) || '", "highlights": ["one", "two"]}, {"url": "http://x.com"}]}' AS reply FROM org"""


@_query("s2_shape_hits", """SELECT inn, 0 AS query_no, 'q' AS query, 1 AS rank, label AS title, 'https://' || domain || '/' AS url, 'one two body ' || CAST(k AS STRING) AS snippet FROM org
  UNION ALL SELECT inn, 0, 'q', 2, '', 'http://x.com', '' FROM org""")
def _build(v):
    return readers.shape_hits(v(_REPLY))


def _recorded(rows: DataFrame, source: type) -> DataFrame:
    """``rows`` as a provider's recorded lines, read back through its data source."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/{source.name()}-{uuid.uuid4().hex}"
    providers.write_recorded(rows, folder, source.key, 8)
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load(folder)


@_query("s2_provider_replies", ORACLES["s2_shape_hits"].removeprefix(CTE))
def _build(v):
    return readers.shape_hits(_recorded(v(_REPLY), providers.ProviderReplies))


@_query("s3_union_hits", "SELECT inn, query_no, rank, url, CAST(row_number() OVER (PARTITION BY inn ORDER BY query_no, rank) AS INT) AS hit_no FROM hit_rows")
def _build(v):
    parts = [v(f"SELECT * FROM hit_rows WHERE query_no = {n}") for n in range(3)]
    return readers.numbered_hits(*parts).select("inn", "query_no", "rank", "url", "hit_no")


_FETCHES = """SELECT url, CAST(NULL AS STRING) AS final_url, CASE WHEN (page_id + n) % 3 = 0 THEN NULL ELSE 200 + n END AS status, CASE WHEN page_id % 5 = 0 THEN 'application/pdf' WHEN page_id % 5 = 1 THEN NULL ELSE 'text/html; charset=utf-8' END AS content_type,
  html, CAST(NULL AS STRING) AS error, n AS fetch_no FROM (SELECT page_id, 'u' || CAST(page_id AS STRING) AS url, html, 1 AS n FROM pages UNION ALL SELECT page_id, 'u' || CAST(page_id AS STRING), html, 2 FROM pages) x"""


@_query("s4_page_gate", f"""SELECT url, url AS final_url, status, CASE WHEN content_type LIKE '%html%' OR coalesce(content_type, '') = '' THEN length(substr(html, 1, 400000)) ELSE 0 END AS size
  FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY CASE WHEN status IS NULL THEN 0 ELSE 1 END DESC, fetch_no DESC) AS r FROM ({_FETCHES}) f) y WHERE r = 1""")
def _build(v):
    return readers.good_pages(v(_FETCHES)).select("url", "final_url", "status", F.length("html").cast("long").alias("size"))


@_query("s4_provider_fetches", ORACLES["s4_page_gate"].removeprefix(CTE))
def _build(v):
    pages = readers.good_pages(_recorded(v(_FETCHES), providers.ProviderFetches))
    return pages.select("url", "final_url", "status", F.length("html").cast("long").alias("size"))


_LABEL_LINES = """SELECT '{"inn": "' || inn || '"' || CASE WHEN NOT is_labelled THEN '' WHEN expected IS NULL THEN ', "expected": null' ELSE ', "expected": "' || expected || '"' END || ', "tags": ["' || tag || '", "all"]}' AS value FROM lab"""


@_query("s5_read_labels", "SELECT inn, is_labelled, CASE WHEN is_labelled THEN expected END AS expected, '' AS alt, tag || '|all' AS tags FROM lab")
def _build(v):
    return readers.labels_from_json(v(_LABEL_LINES)).select("inn", "is_labelled", "expected", *_joined("alt", "tags"))


@_query("s6_pending", """SELECT DISTINCT key, substr(sha256(key), 1, 32) AS cache_key FROM (SELECT url AS key FROM hits) n WHERE key NOT IN (SELECT 'https://' || domain || '/' FROM org WHERE k % 2 = 0) AND key NOT IN (SELECT 'https://www.' || domain || '/about' FROM org WHERE k % 2 = 1)""")
def _build(v):
    known = v("SELECT 'https://' || domain || '/' AS key, k % 2 = 0 AS good FROM org UNION ALL SELECT 'https://www.' || domain || '/about', k % 2 = 1 FROM org")
    return readers.pending(v("SELECT url AS key FROM hits"), known, F.col("good"))


@_query("s6_pending_pages", """SELECT DISTINCT url, substr(sha256(url), 1, 32) AS cache_key FROM hits WHERE url NOT IN (SELECT url FROM snapshot WHERE k % 4 <> 1)""")
def _build(v):
    pages = v("SELECT url, final_url, CASE WHEN k % 4 <> 1 THEN status END AS status, error, html FROM snapshot")
    needed = v("SELECT url FROM hits")
    return snapshot.pending_pages(needed, snapshot.write_snapshot(pages, f"snapshot_{uuid.uuid4().hex}", 8))


_RESULTS = "SELECT k AS request_id, raw AS source, CASE WHEN k % 3 = 0 THEN 'a' || CAST(k AS STRING) || '.ru' END AS domain, CASE WHEN k % 6 = 0 THEN 'inn_on_site' END AS proof FROM raw"


@_query("s7_write_short", f"""SELECT request_id, '{{"inn":"' || source || '","domain":' || coalesce('"' || domain || '"', 'null') || ',"proof":' || coalesce('"' || proof || '"', 'null') || '}}' AS value FROM ({_RESULTS}) r""")
def _build(v):
    return writers.short_lines(v(_RESULTS))


@_query("s8_write_full", f"""SELECT request_id, '{{"source":"' || source || '"' || coalesce(',"domain":"' || domain || '"', '') || coalesce(',"proof":"' || proof || '"', '') || '}}' AS value FROM ({_RESULTS}) r""")
def _build(v):
    return writers.full_lines(v(_RESULTS))


_RUNS = "SELECT config, inn, domain, proof FROM res"


@_query("s9_write_eval", f"""SELECT config, 'summary' AS part, '{{"n":' || CAST(count(*) AS STRING) || ',"best":' || coalesce('"' || max(raw_answer) || '"', 'null') || '}}' AS value FROM res GROUP BY config
  UNION ALL SELECT config, 'runs', '{{"inn":"' || inn || '"' || coalesce(',"domain":"' || domain || '"', '') || coalesce(',"proof":"' || proof || '"', '') || '}}' FROM ({_RUNS}) r""")
def _build(v):
    return writers.evaluation_lines(v("SELECT config, count(*) AS n, max(raw_answer) AS best FROM res GROUP BY config"), v(_RUNS))


# ---- codes


@_query("c1_normalize_inn", "SELECT k, regexp_replace(raw, '[^0-9]', '', 'g') AS inn FROM raw")
def _build(v):
    return v("raw").select("k", codes.normalize_inn("raw").alias("inn"))


@_query("c2_is_valid_inn", f"SELECT k, {_valid_sql()} AS is_valid FROM (SELECT k, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM raw) x")
def _build(v):
    return v("raw").select("k", codes.is_valid_inn("raw").alias("is_valid"))


@_query("c3_kind", "SELECT k, CASE WHEN length(regexp_replace(raw, '[^0-9]', '', 'g')) = 12 THEN 'entrepreneur' ELSE 'legal' END AS kind FROM raw")
def _build(v):
    return v("raw").select("k", codes.kind("raw").alias("kind"))


_TEXTS = "SELECT k, inn, ogrn, 'x ' || CASE k % 4 WHEN 0 THEN 'ИНН: ' || inn || ', КПП' WHEN 1 THEN 'ИНН' || chr(160) || inn WHEN 2 THEN '9' || inn || ' ОГРН ' || ogrn ELSE repeat('слово ', 40) || inn || ' инн ' || inn || repeat(' end', 60) END AS text FROM org"


@_query("c4_contains_code", f"SELECT k, regexp_matches(text, '(^|[^0-9])' || inn || '([^0-9]|$)') AS has_inn, regexp_matches(text, '(^|[^0-9])' || ogrn || '([^0-9]|$)') AS has_ogrn FROM ({_TEXTS}) t")
def _build(v):
    return v(_TEXTS).select("k", codes.contains_code("text", "inn").alias("has_inn"), codes.contains_code("text", "ogrn").alias("has_ogrn"))


@_query("c5_code_runs", f"SELECT DISTINCT k, run FROM (SELECT k, unnest(regexp_extract_all(text, '[0-9]+')) AS run FROM ({_TEXTS}) t) u WHERE length(run) IN (10, 12, 13, 15)")
def _build(v):
    return v(_TEXTS).select("k", F.explode(codes.code_runs("text")).alias("run"))


@_query("c6_excerpt", f"""SELECT k, CASE WHEN k % 4 = 2 THEN '' ELSE trim(substr(n, greatest(p - 1 - 80, 0) + 1, p - 1 + length(inn) + 80 - greatest(p - 1 - 80, 0))) END AS excerpt
  FROM (SELECT k, inn, replace(text, chr(160), ' ') AS n, instr(replace(text, chr(160), ' '), inn) AS p FROM ({_TEXTS}) t) x""")
def _build(v):
    return v(_TEXTS).select("k", codes.excerpt_around("text", "inn").alias("excerpt"))


@_query("c7_published_inns", f"SELECT k, CASE WHEN k % 4 = 2 THEN '' ELSE substr(inn, 1, 10) END AS found FROM ({_TEXTS}) t")
def _build(v):
    return v(_TEXTS).select("k", F.array_join(codes.published_inns("text"), "|").alias("found"))


_PARKED = "SELECT page_id AS k, html || CASE page_id % 4 WHEN 0 THEN 'Этот ДОМЕН ПРОДАЕТСЯ' WHEN 1 THEN 'Domain is for sale!' WHEN 2 THEN 'домен хороший' ELSE '' END AS text FROM pages"


@_query("c8_looks_parked", f"SELECT k, {_any_of('lower(text)', codes.PARKED)} AS parked FROM ({_PARKED}) t")
def _build(v):
    return v(_PARKED).select("k", codes.looks_parked("text").alias("parked"))


@_query("c9_windows", f"""SELECT k, 0 AS pos, substr(text, greatest(p - 1 - 220, 0) + 1, p - 1 + length(inn) + 220 - greatest(p - 1 - 220, 0)) AS piece FROM (SELECT *, instr(text, inn) AS p FROM ({_TEXTS}) t WHERE k % 4 <> 2) a
  UNION ALL SELECT k, 1, substr(text, greatest(p - 1 - 220, 0) + 1, p - 1 + length(inn) + 220 - greatest(p - 1 - 220, 0)) FROM (SELECT *, length(repeat('слово ', 40)) + 2 + length(inn) + 5 + 1 AS p FROM ({_TEXTS}) t WHERE k % 4 = 3) b""")
def _build(v):
    return v(_TEXTS).select("k", F.posexplode(codes.windows_near("text", "inn")).alias("pos", "piece"))


# ---- domains and brands


@_query("d1_registrable", "SELECT page_id AS k, regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS domain FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host FROM pages) h")
def _build(v):
    return v("SELECT page_id AS k, url FROM pages").select("k", suffixes.registrable("url").alias("domain"))


_SOME = "SELECT k, CASE k % 5 WHEN 0 THEN 'rusprofile.ru' WHEN 1 THEN 'hh.ru' WHEN 2 THEN 'mail.ru' WHEN 3 THEN 'focus.kontur.ru' ELSE domain END AS domain FROM org"


@_query("d2_domain_lists", f"SELECT k, {_in('domain', domains.AGGREGATORS)} AS is_aggregator, {_in('domain', domains.AGGREGATORS + domains.PLATFORMS)} AS is_blocked, {_in('domain', domains.FREE_MAIL)} AS is_free_mail FROM ({_SOME}) d")
def _build(v):
    d = F.col("domain")
    return v(_SOME).select("k", domains.is_aggregator(d).alias("is_aggregator"), domains.is_blocked(d).alias("is_blocked"), domains.is_free_mail(d).alias("is_free_mail"))


_NAMES = "SELECT k, CASE k % 3 WHEN 0 THEN 'ООО «Хлеб Цех ' || label || '»' WHEN 1 THEN 'Торговый дом ' || label || ' с юбками' ELSE 'АО ' || label || '-' || upper(label) END AS name, label, domain FROM org"


@_query("d3_transliterate", """SELECT k, CASE k % 3 WHEN 0 THEN 'ooo «hleb ceh ' || label || '»' WHEN 1 THEN 'torgovyy dom ' || label || ' s yubkami' ELSE 'ao ' || label || '-' || label END AS latin,
  CASE k % 3 WHEN 0 THEN 'ooo «khleb tsekh ' || label || '»' WHEN 1 THEN 'torgovyi dom ' || label || ' s jubkami' ELSE 'ao ' || label || '-' || label END AS alt FROM org""")
def _build(v):
    return v(_NAMES).select("k", brands.transliterate(F.col("name")).alias("latin"), brands.transliterate(F.col("name"), alt=True).alias("alt"))


_CLEAN = "SELECT k, CASE k % 3 WHEN 0 THEN 'Хлеб Цех ' || label WHEN 1 THEN label || '   юбками' ELSE label || '-' || upper(label) END AS brand FROM org"
_TOKENS = r"list_slice(list_filter(regexp_split_to_array({}, '[ _,.-]+'), lambda t: length(t) > 2), 1, 6)"


@_query("d4_clean_name", _CLEAN)
def _build(v):
    return v(_NAMES).select("k", brands.clean_name("name").alias("brand"))


@_query("d5_brand_tokens", f"SELECT k, array_to_string({_TOKENS.format('brand')}, '|') AS tokens FROM ({_CLEAN}) c")
def _build(v):
    return v(_NAMES).select("k", F.array_join(brands.brand_tokens("name"), "|").alias("tokens"))


@_query("d6_spelling_variants", "SELECT k, value || CASE WHEN value LIKE '%ks%' THEN '|' || replace(value, 'ks', 'x') ELSE '' END || CASE WHEN value LIKE '%iy%' THEN '|' || replace(value, 'iy', 'y') ELSE '' END AS forms FROM (SELECT k, label || CASE WHEN k % 2 = 0 THEN 'ks' ELSE '' END || CASE WHEN k % 3 = 0 THEN 'iy' ELSE '' END AS value FROM org) x")
def _build(v):
    rows = v("SELECT k, label || CASE WHEN k % 2 = 0 THEN 'ks' ELSE '' END || CASE WHEN k % 3 = 0 THEN 'iy' ELSE '' END AS value FROM org")
    return rows.select("k", F.array_join(brands.spelling_variants(F.col("value")), "|").alias("forms"))


_SPELT = "SELECT k, label || CASE k % 4 WHEN 0 THEN 'ks' WHEN 1 THEN 'iy' WHEN 2 THEN '-ksiy' ELSE '' END AS brand FROM org"


@_query("d7_brand_variants", f"""
, tokens AS (SELECT k, {_TOKENS.format("brand")} AS ts FROM ({_SPELT}) s),
words AS (SELECT k, list_concat(ts, [array_to_string(ts, '')]) AS ws, len(ts) AS n FROM tokens),
spelt AS (SELECT k, flatten(list_transform(ws, lambda w, i: list_filter([w, CASE WHEN contains(w, 'ks') THEN replace(w, 'ks', 'x') END, CASE WHEN contains(w, 'iy') THEN replace(w, 'iy', 'y') END], lambda f: f IS NOT NULL AND length(f) > CASE WHEN i > n THEN 3 ELSE 0 END))) AS fs FROM words)
SELECT k, array_to_string(list_filter(fs, lambda f, i: list_position(fs, f) = i), '|') AS variants FROM spelt""")
def _build(v):
    rows = v(f"SELECT k, 'ООО «' || brand || '»' AS name FROM ({_SPELT}) s")
    return rows.select("k", F.array_join(brands.brand_variants(F.col("name"), F.lit("")), "|").alias("variants"))


_LABELS = "SELECT k, domain, CASE k % 3 WHEN 0 THEN label || 'x' WHEN 1 THEN substr(label, 1, 3) ELSE 'zz-zz' END AS variant, label FROM org"


@_query("d8_brand_in_domain", f"SELECT k, length(l) >= 4 AND length(w) >= 4 AND (l LIKE '%' || w || '%' OR w LIKE '%' || l || '%') AS same FROM (SELECT k, replace(label, '-', '') AS l, replace(variant, '-', '') AS w FROM ({_LABELS}) a) b")
def _build(v):
    return v(_LABELS).select("k", brands.brand_in_domain(F.col("domain"), F.array("variant")).alias("same"))


@_query("d9_similarity")
def _build(v):
    return v(_LABELS).select("k", F.round(brands.similarity(F.col("label"), F.col("variant")), 6).alias("ratio"))


@_query("d10_name_similarity")
def _build(v):
    return v(_NAMES).select("k", F.round(brands.name_similarity(F.col("domain"), F.array("name")), 6).alias("ratio"))


_MENTIONS = "SELECT k, domain, 'см. ' || upper(domain) || ', также www.' || domain || ' и test' || CAST(k AS STRING) || '.io; но не a.zz' AS text FROM org"


@_query("d11_domains_in_text", f"""
, found AS (SELECT k, list_transform(regexp_extract_all(lower(text), '(?:[a-z0-9-]+[.])+(?:com|net|org|io|ru)'), lambda d: regexp_extract(d, '([^.]+[.][^.]+)$', 1)) AS ds FROM ({_MENTIONS}) m)
SELECT k, array_to_string(list_filter(ds, lambda d, i: list_position(ds, d) = i), '|') AS found FROM found""")
def _build(v):
    return v(_MENTIONS).select("k", F.array_join(domains.domains_in_text(F.col("text")), "|").alias("found"))


_MINING = "SELECT k, CASE k % 5 WHEN 0 THEN 'Сайт: https://' || domain || ' ·' WHEN 1 THEN 'почта info@' || domain || ' и ivan@mail.ru' WHEN 2 THEN 'марка ' || upper(domain) || ' на hh.ru' WHEN 3 THEN 'сайт:' || domain ELSE 'info@' || domain || ' website ' || domain || ' x' || CAST(k AS STRING) || '.com' END AS text FROM org"


@_query("d12_mine_domains", """SELECT k, 1 AS pos, domain, CASE k % 5 WHEN 0 THEN 'site_field' WHEN 1 THEN 'email' WHEN 2 THEN 'mention' WHEN 3 THEN 'mention' ELSE 'site_field' END AS kind FROM org
  UNION ALL SELECT k, 2, 'x' || CAST(k AS STRING) || '.com', 'mention' FROM org WHERE k % 5 = 4""")
def _build(v):
    return domains.mined(v(_MINING), F.col("text")).select("k", "pos", "domain", "kind")


_REGISTRY = """SELECT k, inn, ogrn, label, CASE k % 5 WHEN 0 THEN 'https://fbc.ru/inn/' || inn WHEN 1 THEN 'https://x.ru/c/' || ogrn WHEN 2 THEN 'https://other.ru/' WHEN 3 THEN 'https://' || label || '.ru/r' ELSE 'https://' || domain || '/' END AS url,
  CASE k % 5 WHEN 4 THEN 'О нас' ELSE 'Реквизиты ИНН ' || inn END AS title FROM org"""


_HIT_SQL = f"""contains(lower(url), inn) OR contains(lower(url), ogrn) OR ({_any_of("lower(title)", domains.REGISTRY_WORDS)} AND contains(title, inn)
  AND NOT (length(l) >= 4 AND length(w) >= 4 AND (contains(l, w) OR contains(w, l))))"""
_HIT_ROWS = f"""(SELECT *, replace(regexp_extract(d, '^([^.]+)', 1), '-', '') AS l, replace(label, '-', '') AS w FROM (SELECT *, regexp_extract(regexp_extract(url, '://([^/]+)', 1), '([^.]+[.][^.]+)$', 1) AS d FROM ({_REGISTRY}) r) x)"""


@_query("d13_registry_hit", f"SELECT k, {_HIT_SQL} AS is_hit FROM {_HIT_ROWS} y")
def _build(v):
    rows = v(_REGISTRY).withColumn("domain", suffixes.registrable("url"))
    return rows.select("k", domains.looks_like_registry_hit(F.col("url"), F.col("title"), F.col("inn"), F.col("ogrn"), F.array("label"), F.col("domain")).alias("is_hit"))


@_query("d14_is_registry", f"SELECT k, {_in('d', domains.AGGREGATORS)} OR {_HIT_SQL} AS is_registry FROM {_HIT_ROWS} y")
def _build(v):
    rows = v(_REGISTRY).withColumn("domain", suffixes.registrable("url"))
    return rows.select("k", domains.is_registry(F.col("domain"), F.col("url"), F.col("title"), F.col("inn"), F.col("ogrn"), F.array("label")).alias("is_registry"))


# ---- pages


def _entities(sql: str) -> str:
    for name, sign in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        sql = f"replace({sql}, '&{name};', '{sign}')"
    return sql


# the given pages are well formed: what is hidden and tags go, entities are read
_TITLE_SQL = f"substr(trim({_entities("regexp_extract(html, '<title>([^<]*)</title>', 1)")}), 1, 200)"
_HIDDEN = r"(?is)<script.*?</script>|<style.*?</style>|<noscript.*?</noscript>|<svg.*?</svg>|<title>.*?</title>|<!--.*?-->|<![^>]*>|<[^>]+>"
_TEXT_SQL = f"trim(regexp_replace({_entities(f"regexp_replace(html, '{_HIDDEN}', ' ', 'g')")}, '\\s+', ' ', 'g'))"


@_query("h1_html_to_text", f"SELECT page_id AS k, sha256({_TEXT_SQL}) AS text_sha256, length({_TEXT_SQL}) AS size FROM pages")
def _build(v):
    return v("SELECT page_id AS k, url, url AS final_url, html FROM pages").select("k", html.parse_page("html", "url").alias("p")).select("k", F.sha2("p.text", 256).alias("text_sha256"), F.length("p.text").cast("long").alias("size"))


@_query("h2_html_title", f"SELECT page_id AS k, {_TITLE_SQL} AS title FROM pages")
def _build(v):
    return v("SELECT page_id AS k, url, html FROM pages").select("k", html.parse_page("html", "url").alias("p")).select("k", "p.title")


_LINKS = """SELECT k, 'https://' || domain || '/a/' AS base, '<a href="#x">контакты</a><a href="mailto:a@b.ru">info</a><a href="/privacy">p</a><a href="kontakt.html#f">Контакты</a><a href="/no">нет</a><a href="https://' || label || '.com/about">О компании</a><a href="/privacy#2">политика</a>' AS html FROM org"""


@_query("h3_interesting_links", "SELECT k, 'https://' || label || '.com/about|https://' || domain || '/a/kontakt.html|https://' || domain || '/privacy' AS links FROM org")
def _build(v):
    return v(_LINKS).select("k", html.parse_page("html", "base").alias("p")).select("k", F.array_join("p.links", "|").alias("links"))


_HOMES = """SELECT 'https://' || domain || '/' AS url, 'https://' || domain || '/' AS final_url, CASE k % 3 WHEN 0 THEN 200 WHEN 1 THEN 404 END AS status, CASE WHEN k % 3 = 0 THEN '<body>s</body>' ELSE '' END AS html, CAST(NULL AS STRING) AS error FROM org
  UNION ALL SELECT 'http://' || domain || '/', 'http://' || domain || '/z', 200, '<body>p</body>', CAST(NULL AS STRING) FROM org WHERE k % 2 = 0"""


@_query("h4_home_page", """SELECT inn, domain, k % 3 = 0 OR (k % 3 = 2 AND k % 2 = 0) AS reachable, CASE WHEN k % 3 = 2 AND k % 2 = 0 THEN 'http://' || domain || '/z' ELSE 'https://' || domain || '/' END AS final_url FROM org""")
def _build(v):
    return evidence.home_pages(v("SELECT inn, domain FROM org"), html.page_facts(html.page_text(v(_HOMES)))).select("inn", "domain", "reachable", "final_url")


@_query("h5_crawl_targets", "SELECT k, 'https://' || label || '.com/about|https://' || domain || '/a/kontakt.html|https://' || domain || '/privacy|https://' || domain || '/contacts|https://' || domain || '/contact' AS targets FROM org")
def _build(v):
    rows = v("SELECT a.k, a.base, a.html, b.domain FROM (" + _LINKS + ") a JOIN org b ON a.k = b.k").withColumn("p", html.parse_page("html", "base"))
    return rows.select("k", F.array_join(html.crawl_targets(F.col("domain"), F.concat(F.lit("https://"), "domain", F.lit("/")), F.col("base"), F.col("p.links")), "|").alias("targets"))


@_query("h6_redirect_target", "SELECT k, CASE WHEN k % 13 = 5 AND label || '.net' <> domain THEN label || '.net' END AS redirects_to FROM org WHERE k % 10 <> 9")
def _build(v):
    rows = v("SELECT s.k, s.final_url, o.domain FROM snapshot s JOIN org o ON s.k = o.k WHERE s.url NOT LIKE '%/contacts'").withColumn("r", suffixes.registrable("final_url"))
    return rows.select("k", F.when(F.col("r") != F.col("domain"), F.col("r")).alias("redirects_to"))


@_query("h7_page_view", f"""SELECT 'https://' || p.domain || '/contacts' AS url, CASE WHEN p.k % 10 = 9 THEN 'page not readable (status=None, error=None)' ELSE 'title: ' || {_TITLE_SQL} || chr(10) || 'text: ' || substr(CASE WHEN p.k % 4 = 1 THEN 'ИНН ' || p.inn ELSE 'ОГРН ' || p.ogrn END || ' ' || {_TEXT_SQL}, 1, 1400) END AS view FROM org p""")
def _build(v):
    return html.page_view(html.page_text(v("SELECT url, final_url, status, error, html FROM snapshot")), v("SELECT 'https://' || domain || '/contacts' AS url FROM org"))


# ---- cards


@_query("g1_card_hits", "SELECT inn, hit_no FROM (SELECT *, sum(CASE WHEN query_no = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY inn) AS n FROM hits) h WHERE query_no = 0 OR (query_no = 1 AND n < 3)")
def _build(v):
    return cards.card_hits(v("hits")).select("inn", "hit_no")


@_query("g2_relevant_hits", "SELECT inn, hit_no FROM hits WHERE instr(title || ' ' || snippet, inn) > 0")
def _build(v):
    return cards.relevant_hits(v("hits")).select("inn", "hit_no")


@_query("g3_card_blob", "SELECT inn, sha256(blob) AS blob_sha256, CAST(length(blob) AS INT) AS size FROM (SELECT inn, string_agg(title || ' ' || title || ' ' || snippet, ' ' ORDER BY hit_no) AS blob FROM hits WHERE contains(title || ' ' || snippet, inn) GROUP BY inn) b")
def _build(v):
    return cards.card_blobs(v("hits")).select("inn", F.sha2("blob", 256).alias("blob_sha256"), F.length("blob").alias("size"))


_CARD = """SELECT inn, ogrn, CASE WHEN k % 7 = 0 THEN 'ИП Иванов Иван Иванович' END AS name_full, name AS name_short, 'Москва' AS city, 'search_fallback' AS source FROM org"""


@_query("g4_extract_card", _CARD)
def _build(v):
    return cards.extract_cards(cards.card_blobs(cards.card_hits(v("hits"))))


_PART = "SELECT inn, CASE WHEN k % 3 = 0 THEN '' ELSE ogrn END AS ogrn, CAST(NULL AS STRING) AS name_full, CASE WHEN k % 4 = 0 THEN NULL ELSE name END AS name_short, '' AS city, 's' AS source FROM org"


@_query("g5_needs_model", f"SELECT inn FROM ({_PART}) c WHERE (coalesce(ogrn, '') = '' OR name_short IS NULL) AND inn IN (SELECT inn FROM hits WHERE instr(title || ' ' || snippet, inn) > 0)")
def _build(v):
    return cards.cards_to_extract(v(_PART), v("hits"))


@_query("g6_extraction_prompt", "SELECT inn, substr(string_agg('- ' || title || ' :: ' || snippet, chr(10) ORDER BY hit_no), 1, 4000) AS snippets FROM hits WHERE instr(title || ' ' || snippet, inn) > 0 GROUP BY inn")
def _build(v):
    return cards.extraction_prompts(v("hits"))


_EXTRACTED = "SELECT inn, k % 2 = 0 AS found, 'Имя' AS name_short, CAST(NULL AS STRING) AS name_full, '1000000000000' AS ogrn, 'Тула' AS city FROM org"


@_query("g7_merge_extraction", f"""SELECT c.inn, CASE WHEN c.ogrn <> '' THEN c.ogrn WHEN e.found THEN e.ogrn END AS ogrn, CAST(NULL AS STRING) AS name_full, coalesce(c.name_short, CASE WHEN e.found THEN e.name_short END) AS name_short, CASE WHEN e.found THEN e.city END AS city, c.source
  FROM ({_PART}) c JOIN ({_EXTRACTED}) e ON c.inn = e.inn""")
def _build(v):
    return cards.merge_extractions(v(_PART), v(_EXTRACTED))


@_query("g8_display_name", f"SELECT inn, coalesce(name_short, 'ИНН ' || inn) AS shown FROM ({_PART}) c")
def _build(v):
    return v(_PART).select("inn", cards.display_name().alias("shown"))


# ---- candidates


@_query("k1_build_queries", """SELECT inn, 0 AS query_no, '"' || inn || '"' AS query FROM cards UNION ALL SELECT inn, 1, 'ИНН ' || inn || ' официальный сайт' FROM cards UNION ALL SELECT inn, 2, name_short || ' официальный сайт' FROM cards
  UNION ALL SELECT inn, 3, name_short || ' Москва' FROM cards WHERE city IS NOT NULL UNION ALL SELECT inn, CASE WHEN city IS NULL THEN 3 ELSE 4 END, 'extra' FROM cards""")
def _build(v):
    return candidates.build_queries(v("cards").withColumn("model_queries", F.array(F.lit("extra"), F.lit(""), F.lit("extra"))))


_NAMED_ROWS = """
, own AS (SELECT inn, hit_no, rank, CASE WHEN url LIKE 'https://fbc.ru%' THEN 'fbc.ru' WHEN url LIKE 'https://hh.ru%' THEN 'hh.ru' WHEN url = 'не url' THEN NULL ELSE regexp_extract(url, '://(?:www[.])?([^/]+)/', 1) END AS domain, url, title, snippet FROM hits),
o2 AS (SELECT w.*, o.domain AS real, o.label, o.k, coalesce(w.domain = 'fbc.ru', false) AS registry FROM own w JOIN org o ON w.inn = o.inn),
mined AS (
  SELECT inn, hit_no, 1 AS sub_no, real AS domain, CASE WHEN k % 4 = 1 THEN 'email' ELSE 'site_field' END AS kind, registry, domain AS hit_domain, snippet FROM o2 WHERE domain = 'fbc.ru'
  UNION ALL SELECT inn, hit_no, 1, real, 'mention', registry, domain, snippet FROM o2 WHERE domain = 'hh.ru'
  UNION ALL SELECT inn, hit_no, 1, real, 'site_field', registry, domain, snippet FROM o2 WHERE domain IS NULL
  UNION ALL SELECT inn, hit_no, 2, 'partner.org', 'mention', registry, domain, snippet FROM o2 WHERE domain IS NULL),
rows_all AS (
  SELECT inn, domain, hit_no, 0 AS sub_no, 'url' AS kind, rank, registry OR domain = 'hh.ru' AS requires_proof, false AS by_registry, title, snippet FROM o2 WHERE domain IS NOT NULL
  UNION ALL SELECT inn, domain, hit_no, sub_no, kind, NULL, false, registry, '', snippet FROM mined),
collected AS (
  SELECT inn, domain, CAST(sum(CASE WHEN kind = 'url' THEN 1 ELSE 0 END) AS INT) AS mention_count, CAST(coalesce(min(rank), 99) AS INT) AS best_rank, CAST(sum(CASE WHEN kind = 'site_field' THEN 1 ELSE 0 END) AS INT) AS site_field_hits,
    CAST(sum(CASE WHEN kind = 'email' THEN 1 ELSE 0 END) AS INT) AS email_hits, CAST(sum(CASE WHEN kind = 'mention' THEN 1 ELSE 0 END) AS INT) AS snippet_hits, bool_or(by_registry) AS mentioned_by_registry, bool_or(requires_proof) AS requires_proof,
    min(hit_no * 100 + sub_no) AS seen,
    coalesce(array_to_string(list_slice(list(title ORDER BY hit_no, sub_no) FILTER (title <> ''), 1, 3), '|'), '') AS titles, coalesce(array_to_string(list_slice(list(snippet ORDER BY hit_no, sub_no) FILTER (snippet <> ''), 1, 3), '|'), '') AS snippets FROM rows_all GROUP BY inn, domain)
"""


@_query("k2_collect_candidates", _NAMED_ROWS + "SELECT * FROM collected")
def _build(v):
    rows = candidates.collect_candidates(v("hits"), v("cards"))
    return rows.withColumn("seen", F.col("first_seen.hit_no") * 100 + F.col("first_seen.sub_no")).withColumns({c: F.array_join(c, "|") for c in ("titles", "snippets")}).drop("first_seen")


_PRIORS = "SELECT k, inn, domain, mention_count, best_rank, requires_proof, site_field_hits, email_hits, snippet_hits, mentioned_by_registry, CASE WHEN k % 2 = 0 THEN regexp_extract(domain, '^([^.]+)', 1) ELSE '$$$$$' END AS variant FROM verified"


@_query("k3_prior_rank", f"""SELECT k, mention_count * 3.0 + greatest(0, 10 - best_rank) * 0.5 - CASE WHEN requires_proof THEN 6.0 ELSE 0 END + CASE WHEN site_field_hits > 0 THEN 20.0 ELSE 0 END + CASE WHEN email_hits > 0 THEN 14.0 ELSE 0 END + 4.0 * least(snippet_hits, 3)
  + CASE WHEN mentioned_by_registry THEN 5.0 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 6.0 + CASE WHEN length(replace(variant, '-', '')) >= 4 THEN 8.0 ELSE 0 END ELSE 0 END AS prior FROM ({_PRIORS}) p""")
def _build(v):
    return v(_PRIORS).select("k", F.round(candidates.prior_rank(F.array("variant")), 6).alias("prior"))


@_query("k4_shortlist", """SELECT inn, domain, CAST(item_no AS INT) AS item_no FROM (SELECT inn, domain, row_number() OVER (PARTITION BY inn ORDER BY rank DESC, hit_no) AS item_no FROM (SELECT inn, url AS domain, rank, hit_no FROM hits) h) x WHERE item_no <= 3""")
def _build(v):
    return candidates.shortlist(v("SELECT inn, url AS domain, rank AS prior, hit_no AS first_seen FROM hits"), k=3).select("inn", "domain", "item_no")


_EMPTY = "array() AS titles, array() AS snippets, 1 AS mention_count, 1 AS best_rank, 0 AS site_field_hits, 0 AS email_hits, 0 AS snippet_hits, false AS mentioned_by_registry, false AS requires_proof, named_struct('hit_no', 1, 'sub_no', 0) AS first_seen, 1 AS item_no"
_PROVEN = """SELECT inn, domain, k % 10 <> 9 AND k % 11 <> 0 AS reachable, k % 10 <> 9 AND k % 11 <> 0 AND k % 4 IN (0, 1) AS inn_on_site, k % 10 <> 9 AND k % 11 <> 0 AND k % 4 IN (2, 3) AS ogrn_on_site,
  CASE WHEN k % 10 = 9 THEN NULL WHEN k % 4 = 0 AND k % 7 = 0 THEN substr(inn, 1, 10) WHEN k % 4 = 2 THEN '7725861463' WHEN k % 4 = 1 AND k % 7 = 0 AND k % 11 <> 0 THEN substr(inn, 1, 10) END AS foreign_inn,
  CASE WHEN k % 10 = 9 OR k % 13 <> 5 OR label || '.net' = domain THEN NULL ELSE label || '.net' END AS redirects_to FROM org"""


def _facts(pages):
    return stored(html.page_facts(html.page_text(pages)))


def _verified(v):
    facts = _facts(v("SELECT url, final_url, status, error, html FROM snapshot"))
    return evidence.verify_pages(v(f"SELECT inn, domain, {_EMPTY} FROM org"), v("cards"), facts)


@_query("k5_verify_pages", _PROVEN)
def _build(v):
    return _verified(v).select("inn", "domain", "reachable", "inn_on_site", "ogrn_on_site", "foreign_inn", "redirects_to")


@_query("k6_foreign_inn", f"SELECT inn, foreign_inn FROM ({_PROVEN}) p WHERE foreign_inn IS NOT NULL")
def _build(v):
    return _verified(v).where("foreign_inn IS NOT NULL").select("inn", "foreign_inn")


@_query("k7_parked", "SELECT inn, k % 2 = 1 AS reachable FROM org")
def _build(v):
    facts = _facts(v("SELECT 'https://' || domain || '/' AS url, 'https://' || domain || '/' AS final_url, 200 AS status, CAST(NULL AS STRING) AS error, '<body>' || CASE WHEN k % 2 = 0 THEN 'Купить домен' ELSE 'x' END || '</body>' AS html FROM org"))
    return evidence.verify_pages(v(f"SELECT inn, domain, {_EMPTY} FROM org"), v("cards"), facts).select("inn", "reachable")


@_query("k8_redirects", f"SELECT inn, redirects_to AS domain, 1 AS mention_count, 1 AS best_rank FROM ({_PROVEN}) p WHERE redirects_to IS NOT NULL")
def _build(v):
    return evidence.redirect_candidates(stored(_verified(v))).select("inn", "domain", "mention_count", "best_rank")


@_query("k8b_evidence_flags", "SELECT k, inn_on_site OR ogrn_on_site AS has_proof, inn_on_site OR ogrn_on_site OR site_field_hits > 0 OR email_hits > 0 AS has_entity_evidence FROM verified")
def _build(v):
    return v("verified").select("k", evidence.has_proof().alias("has_proof"), evidence.has_entity_evidence().alias("has_entity_evidence"))


_SCORE = """
, flagged AS (SELECT *, length(replace(label, '-', '')) >= 4 AND k % 9 <> 4 AND k % 2 = 0 AS brand FROM verified),
judged AS (SELECT *, requires_proof AND NOT (inn_on_site OR ogrn_on_site OR brand OR likeness >= 0.8) AS blocked FROM flagged),
scored AS (SELECT *, CASE WHEN blocked THEN CAST(-100.0 AS DOUBLE) ELSE CAST(round(CASE WHEN inn_on_site THEN 100 ELSE 0 END + CASE WHEN ogrn_on_site THEN 55 ELSE 0 END + CASE WHEN site_field_hits > 0 THEN 38 ELSE 0 END + CASE WHEN email_hits > 0 THEN 28 ELSE 0 END
  + CASE WHEN mentioned_by_registry THEN 12 ELSE 0 END + 4 * least(snippet_hits, 3) + CASE WHEN brand THEN 22 ELSE 0 END + 25 * likeness + 6 * least(mention_count, 4) + CASE WHEN best_rank <= 10 THEN CAST(2.0 * (10 - best_rank) AS DOUBLE) / 10 ELSE 0 END
  + CASE WHEN domain LIKE '%.ru' THEN 6 ELSE 0 END - CASE WHEN foreign_inn IS NOT NULL AND NOT (inn_on_site OR ogrn_on_site) THEN 60 ELSE 0 END - CASE WHEN reachable = false THEN 40 ELSE 0 END, 2) AS DOUBLE) END AS score FROM judged)
"""


def _scored(v):
    rows = v("verified").withColumnRenamed("likeness", "name_similarity")
    return evidence.score_candidates(rows, F.when(F.col("k") % 2 == 0, F.array("label")).otherwise(F.array().cast("array<string>")))


@_query("k9_score", _SCORE + "SELECT k, blocked, CAST(round(score * 100) AS BIGINT) AS hundredths FROM scored")
def _build(v):
    return _scored(v).select("k", F.col("blacklisted_without_proof").alias("blocked"), F.round(F.col("score") * 100).cast("long").alias("hundredths"))


_SIBLINGS = "SELECT page_id AS k, CAST((page_id - page_id % 15) / 15 AS INT) AS inn, 'b' || CAST(page_id % 4 AS STRING) || CASE page_id % 3 WHEN 0 THEN '.ru' WHEN 1 THEN '.com' ELSE '.su' END AS domain, CAST(page_id % 20 AS DOUBLE) AS score FROM pages"


@_query("k10_ru_siblings", f"SELECT k, CASE WHEN n >= 2 AND domain LIKE '%.ru' THEN score + 15 ELSE score END AS score FROM (SELECT *, count(*) OVER (PARTITION BY inn, regexp_extract(domain, '^([^.]+)', 1)) AS n FROM ({_SIBLINGS}) s) x")
def _build(v):
    return evidence.prefer_ru_siblings(v(_SIBLINGS)).select("k", "score")


@_query("k11_judge_list", f"SELECT inn, k, CAST(item_no AS INT) AS item_no FROM (SELECT inn, k, row_number() OVER (PARTITION BY inn ORDER BY score DESC, k) AS item_no FROM ({_SIBLINGS}) s) x WHERE item_no <= 5")
def _build(v):
    return candidates.shortlist(v(_SIBLINGS).withColumn("first_seen", F.col("k")), "score", candidates.JUDGED).select("inn", "k", "item_no")


_PAGE = "'https://' || domain || '/p'"


def _shown(v):
    page = F.struct(F.concat(F.lit("https://"), "domain", F.lit("/p")).alias("url"), F.when(F.col("k") % 2 == 0, F.repeat(F.col("label"), 60)).otherwise("").alias("excerpt"))
    snippets = F.array(F.repeat(F.concat("label", F.lit(" s ")), 40), F.lit("b"), F.lit("c"))
    return _scored(v).withColumns({"titles": F.when(F.col("k") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("label")), "snippets": snippets, "pages": F.array(page), "item_no": F.lit(1)})


_YES = "CASE WHEN {0} THEN 'True' WHEN NOT {0} THEN 'False' ELSE 'None' END"
_LINES_SQL = f"""concat_ws(chr(10) || sep, 'domain: ' || domain, CASE WHEN k % 4 <> 0 THEN 'page title: ' || substr(label, 1, 160) END, 'reachable: ' || {_YES.format("reachable")}, 'INN found on site: ' || {_YES.format("inn_on_site")},
  CASE WHEN foreign_inn IS NOT NULL AND NOT (inn_on_site OR ogrn_on_site) THEN 'the site publishes INN ' || foreign_inn || ', which belongs to a DIFFERENT company' END, 'OGRN found on site: ' || {_YES.format("ogrn_on_site")},
  'brand-like domain name: ' || {_YES.format("brand")}, printf('name similarity: %.2f', likeness), printf('appeared in %d search result(s), best rank %d', mention_count, best_rank),
  CASE WHEN site_field_hits > 0 THEN 'a directory lists this domain in the company''s "website" field' END, CASE WHEN email_hits > 0 THEN 'the company''s contact e-mail is on this domain' END,
  CASE WHEN mentioned_by_registry THEN 'mentioned in a business-registry page about this company' END, CASE WHEN k % 2 = 0 THEN '[' || {_PAGE} || '] ' || substr(repeat(label, 60), 1, 300) END,
  '[search snippet] ' || substr(repeat(label || ' s ', 40), 1, 220), '[search snippet] b')"""


@_query("k12_evidence_lines", _SCORE + f"SELECT k, {_LINES_SQL} AS lines FROM (SELECT *, '' AS sep FROM scored) s")
def _build(v):
    return _shown(v).select("k", F.array_join(evidence.evidence_lines(), "\n").alias("lines"))


@_query("k13_decision_prompt", _SCORE + f"""SELECT s.inn, 'Company: ' || c.name_short || ', INN ' || s.inn || ', OGRN ' || c.ogrn || coalesce(', ' || c.city, '') || chr(10) || 'Full legal name: unknown' || chr(10) || 'Type: '
  || CASE WHEN length(s.inn) = 12 THEN 'individual entrepreneur (often has no website at all)' ELSE 'legal entity' END || chr(10) || chr(10) || 'Candidates:' || chr(10) || '1. ' || domain || chr(10) || '   - ' || {_LINES_SQL} || chr(10) || chr(10) || 'Answer:' AS prompt
  FROM (SELECT *, '   - ' AS sep FROM scored) s JOIN cards c ON s.inn = c.inn""")
def _build(v):
    return evidence.decision_prompts(_shown(v), v("cards"))


@_query("k14_domain_leads", """SELECT inn, 0 AS query_no, 'fbc.ru [aggregator] | ' || substr(name || ' ИНН ' || inn, 1, 90) || ' | ' || 'ОГРН ' || ogrn || ' г. Москва ' || CASE WHEN k % 4 = 1 THEN 'почта info@' || domain ELSE 'Сайт: https://' || domain || ' тел. 123' END
    || CASE WHEN k % 5 <> 2 THEN chr(10) || domain || ' | ' || label || ' | Каталог товаров' ELSE '' END || CASE WHEN k % 6 <> 1 THEN chr(10) || 'hh.ru [never-answer] | Вакансии ' || label || ' | ИНН ' || inn || ' на рынке ' || upper(domain) ELSE '' END AS results,
    domain || CASE WHEN k % 4 = 1 THEN ' (email)' ELSE ' (site_field)' END AS leads FROM org
  UNION ALL SELECT inn, 1, label || '-shop.com | ' || label || ' shop | пишите на ' || label || '@mail.ru' || chr(10) || label || '.com | Главная | ', '' FROM org
  UNION ALL SELECT inn, 2, '? | нет | website: ' || domain || ' и partner.org', domain || ' (site_field), partner.org (mention)' FROM org""")
def _build(v):
    return candidates.leads_by_query(v("hits"))


@_query("k15_check_pairs", f"SELECT inn, domain, reachable, inn_on_site, ogrn_on_site FROM ({_PROVEN}) p")
def _build(v):
    facts = _facts(v("SELECT url, final_url, status, error, html FROM snapshot"))
    asked = v("SELECT inn, 'https://www.' || domain || '/q' AS domain FROM org UNION ALL SELECT inn, domain FROM org")
    return evidence.check_pairs(asked, v("cards"), facts).select("inn", "domain", "reachable", "inn_on_site", "ogrn_on_site")


# ---- decisions


@_query("r1_extract_json", """SELECT inn, attempt, CASE form WHEN 0 THEN '{"domain": "a' || inn || '.ru", "confidence": "high", "reason": "x}"}' WHEN 1 THEN '{"domain": null, "confidence": "medium", "reason": "нет"}' WHEN 3 THEN '{"domain": "b.com", "confidence": "sure"}' WHEN 4 THEN '{"domain": "2"}' WHEN 5 THEN '{"domain": 5, "reason": "z"}' END AS json FROM replies""")
def _build(v):
    return v("replies").select("inn", "attempt", decisions.extract_json("raw_reply").alias("json"))


_PARSED = """SELECT inn, attempt, form IN (0, 1, 4) AS is_valid, CASE form WHEN 0 THEN 'a' || inn || '.ru' WHEN 4 THEN '2' END AS domain, CASE form WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 4 THEN 'low' END AS confidence, CASE form WHEN 0 THEN 'x}' WHEN 1 THEN 'нет' WHEN 4 THEN '' END AS reason FROM replies"""


@_query("r2_parse_decision", _PARSED)
def _build(v):
    return decisions.parse_decisions(v("replies")).select("inn", "attempt", "is_valid", "domain", "confidence", "reason")


@_query("r3_first_valid", f"""SELECT r.inn, f.inn IS NOT NULL AS decided, f.domain AS raw_domain, f.confidence AS model_confidence, f.reason AS model_reason FROM (SELECT DISTINCT inn FROM replies) r LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY inn ORDER BY attempt) AS n FROM ({_PARSED}) p WHERE is_valid AND attempt <= 2) x WHERE n = 1) f ON r.inn = f.inn""")
def _build(v):
    return decisions.first_valid(decisions.parse_decisions(v("replies")))


_CHOICES = "SELECT inn, k, CASE k % 6 WHEN 0 THEN '\"A' || CAST(k AS STRING) || '.ru\" ' WHEN 1 THEN 'https://www.b' || CAST(k AS STRING) || '.com/' WHEN 2 THEN '2' WHEN 3 THEN 'нет' WHEN 4 THEN '7' END AS raw_domain FROM org"
_JUDGED = "SELECT inn, 'a' || CAST(k AS STRING) || '.ru' AS domain, 1 AS item_no FROM org UNION ALL SELECT inn, 'b' || CAST(k AS STRING) || '.com', 2 FROM org"


@_query("r4_resolve_choice", "SELECT inn, CASE k % 6 WHEN 0 THEN 'a' || CAST(k AS STRING) || '.ru' WHEN 1 THEN 'b' || CAST(k AS STRING) || '.com' WHEN 2 THEN 'b' || CAST(k AS STRING) || '.com' END AS chosen FROM org")
def _build(v):
    return decisions.resolve_choice(v(_CHOICES), v(_JUDGED)).select("inn", F.col("c.domain").alias("chosen"))


_PROVED = "SELECT inn, domain || CAST(n AS STRING) AS domain, n AS item_no, CAST((k + n) % 3 AS DOUBLE) AS score, (k + n) % 2 = 0 AS inn_on_site, (k + n) % 5 = 0 AS ogrn_on_site FROM org JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3) m ON true"


@_query("r5_fallback", f"SELECT inn, domain FROM (SELECT *, row_number() OVER (PARTITION BY inn ORDER BY score DESC, item_no) AS r FROM ({_PROVED}) p WHERE inn_on_site OR ogrn_on_site) x WHERE r = 1")
def _build(v):
    return decisions.proven_best(v(_PROVED)).select("inn", "c.domain")


_CHOSEN = "SELECT k, inn, CASE WHEN k % 12 <> 7 THEN domain END AS domain, inn_on_site, ogrn_on_site, site_field_hits, email_hits, reachable, foreign_inn, requires_proof AS blacklisted_without_proof FROM verified"
_GRADE = """CASE WHEN inn_on_site THEN 0.97 WHEN ogrn_on_site THEN 0.93 WHEN site_field_hits > 0 THEN 0.75 WHEN email_hits > 0 THEN 0.7 ELSE 0.5 END"""
_PROOF = """CASE WHEN inn_on_site THEN 'inn_on_site' WHEN ogrn_on_site THEN 'ogrn_on_site' WHEN site_field_hits > 0 THEN 'directory_site_field' WHEN email_hits > 0 THEN 'corporate_email' END"""


def _guard_sql(verdict: str) -> str:
    return f"""SELECT k, verdict, CASE WHEN verdict = 'accepted' THEN domain END AS answer, CAST(CASE WHEN verdict = 'accepted' THEN {_GRADE} ELSE 0.0 END AS DOUBLE) AS confidence, CASE WHEN verdict = 'accepted' THEN {_PROOF} END AS proof FROM (SELECT *, {verdict} AS verdict FROM ({_CHOSEN}) c) g"""


@_query("r6_guards", _guard_sql("CASE WHEN domain IS NULL THEN 'none' WHEN blacklisted_without_proof THEN 'blocked' WHEN reachable = false THEN 'unreachable' WHEN foreign_inn IS NOT NULL AND NOT (inn_on_site OR ogrn_on_site) THEN 'foreign' ELSE 'accepted' END"))
def _build(v):
    return decisions.guards(v(_CHOSEN)).select("k", "verdict", "answer", "confidence", "proof")


@_query("r7_guards_agent", _guard_sql("CASE WHEN domain IS NULL THEN 'none' WHEN inn_on_site OR ogrn_on_site THEN 'accepted' WHEN blacklisted_without_proof THEN 'blocked' WHEN reachable THEN 'accepted' ELSE 'unreachable' END"))
def _build(v):
    return decisions.guards(v(_CHOSEN), "agent").select("k", "verdict", "answer", "confidence", "proof")


@_query("r8_evidence_grade", f"SELECT k, CAST({_GRADE} AS DOUBLE) AS confidence, {_PROOF} AS proof FROM verified")
def _build(v):
    confidence, proof = decisions.evidence_grade()
    return v("verified").select("k", confidence.alias("confidence"), proof.alias("proof"))


_ASKED = "SELECT 'r' || CAST(k AS STRING) AS request_id, raw AS source FROM raw UNION ALL SELECT 'o' || CAST(k AS STRING), inn FROM org UNION ALL SELECT 'd' || CAST(k AS STRING), ' ' || inn FROM org"


# a number's cards that differ, a page that can't be parsed and a reply that can't be read fail that number; cards and pages that repeat don't
_DEEP = "'{\"a\": ' || repeat('[', 20000) || repeat(']', 20000) || '}'"
_BROKEN_PAGES = """SELECT url, final_url, status, error, CASE WHEN k % 23 = 7 AND url NOT LIKE '%/contacts' THEN '<![bad[ x]]>' || html ELSE html END AS html FROM snapshot
  UNION ALL SELECT url, final_url, status, error, CASE WHEN k % 23 = 7 AND url NOT LIKE '%/contacts' THEN '<![bad[ x]]>' || html ELSE html END FROM snapshot WHERE k % 7 = 2"""


def _inputs(v):
    requests = readers.requests_from_lines(v(_ASKED).select("request_id", F.col("source").alias("value")))
    chosen = v("SELECT inn, 1 AS attempt, CASE WHEN k % 29 = 4 THEN " + _DEEP + " ELSE '{\"domain\": \"1\", \"confidence\": \"high\", \"reason\": \"r\"}' END AS raw_reply FROM org WHERE k % 3 <> 0")
    named = v("SELECT inn, ogrn, CAST(NULL AS STRING) AS name_full, CASE WHEN k % 17 = 3 THEN '' ELSE 'ООО «' || label || '»' END AS name_short, 'Москва' AS city FROM org"
              " UNION ALL SELECT inn, ogrn, NULL, 'ООО «' || label || CASE WHEN k % 31 = 5 THEN ' другая' ELSE '' END || '»', 'Москва' FROM org WHERE k % 31 IN (5, 6) AND k % 17 <> 3")
    return requests, v("SELECT * FROM hits WHERE k % 19 <> 4"), named, v(_BROKEN_PAGES), chosen


def _resolved(v):
    return whole.resolve(*_inputs(v))


# reachable sites publish a code; the others are refused, or not chosen where there is no reply
_RESOLVED = f"""
, asked AS (SELECT request_id, trim(source) AS source, regexp_replace(source, '[^0-9]', '', 'g') AS d FROM ({_ASKED}) a),
checked AS (SELECT *, {_valid_sql()} AS is_valid FROM asked),
joined AS (SELECT c.*, o.k, o.domain, o.k % 10 <> 9 AND o.k % 11 <> 0 AS reachable FROM checked c LEFT JOIN org o ON c.is_valid AND c.d = o.inn),
broken AS (SELECT *, CASE WHEN NOT is_valid OR k IS NULL OR k % 17 = 3 THEN NULL WHEN k % 31 = 5 THEN 'card: several that differ' WHEN k % 19 = 4 THEN NULL WHEN k % 23 = 7 AND reachable THEN 'page: AssertionError' WHEN k % 29 = 4 AND k % 3 <> 0 THEN 'reply: RecursionError' END AS reason FROM joined),
verdicts AS (SELECT *, CASE WHEN NOT is_valid THEN 'invalid' WHEN k IS NULL OR k % 17 = 3 THEN 'no_name' WHEN reason IS NOT NULL THEN 'failed' WHEN k % 19 = 4 THEN 'no_candidates' WHEN reachable THEN 'accepted' WHEN k % 3 <> 0 THEN 'unreachable' ELSE 'none' END AS verdict FROM broken)
"""


def _kind_of_reason():
    return F.substring_index("reason", ":", 2).alias("reason")  # what an error says may differ between versions


@_query("r9_early_exits", _RESOLVED + "SELECT request_id, verdict, reason FROM verdicts WHERE verdict IN ('invalid', 'no_name', 'no_candidates', 'failed')")
def _build(v):
    return _resolved(v).where("verdict IN ('invalid', 'no_name', 'no_candidates', 'failed')").select("request_id", "verdict", _kind_of_reason())


@_query("r10_resolve", _RESOLVED + """SELECT request_id, source, d AS inn, CASE WHEN verdict = 'accepted' THEN domain END AS domain, CAST(CASE WHEN verdict <> 'accepted' THEN 0.0 WHEN k % 4 IN (0, 1) THEN 0.97 ELSE 0.93 END AS DOUBLE) AS confidence,
  CASE WHEN verdict <> 'accepted' THEN NULL WHEN k % 4 IN (0, 1) THEN 'inn_on_site' ELSE 'ogrn_on_site' END AS proof, verdict, reason FROM verdicts""")
def _build(v):
    return _resolved(v).withColumn("reason", _kind_of_reason())


# before, some numbers had one hit less, another city, no reply or no such page; their sites are looked at but where there are no candidates
_WITHOUT_SITES = "k % 17 = 3 OR k % 31 = 5 OR k % 19 = 4"


@_query("r10_refresh", _RESOLVED + f"""SELECT v.request_id, v.verdict, CASE WHEN v.verdict = 'accepted' THEN v.domain END AS domain, v.reason,
  CASE WHEN v.verdict <> 'invalid' THEN coalesce(v.k % 16 = 1 AND v.k % 19 <> 4 OR v.k % 16 = 2 OR v.k % 16 = 3 AND v.k % 3 <> 0 OR v.k % 16 = 5 AND v.k % 10 <> 9 AND NOT ({_WITHOUT_SITES.replace("k %", "v.k %")}), false) END AS again FROM verdicts v""")
def _build(v):
    requests, hits, named, pages, chosen = _inputs(v)
    keys = stored(v("SELECT inn, k, domain FROM org"))
    of = lambda rest: keys.where(f"k % 16 = {rest}").select("inn")
    less = hits.where("NOT (k % 16 = 1 AND query_no = 1 AND rank = 1)")
    moved = named.join(of(2).withColumn("moved", F.lit(True)), "inn", "left").withColumn("city", F.when(F.col("moved"), "Тверь").otherwise(F.col("city"))).drop("moved")
    fewer = pages.join(keys.where("k % 16 = 5").select(F.concat(F.lit("https://"), "domain", F.lit("/")).alias("url")), "url", "left_anti")
    folder = f"{shared_folder(requests.sparkSession)}/refresh-{uuid.uuid4().hex}"
    again.refresh(requests, less, moved, fewer, chosen.join(of(3), "inn", "left_anti"), f"{folder}/1")
    return again.refresh(requests, hits, named, pages, chosen, f"{folder}/2", f"{folder}/1").select("request_id", "verdict", "domain", _kind_of_reason(), "again")


_CALLS = "SELECT o.inn, c.failed, c.repaired, c.completion_tokens FROM calls c JOIN org o ON o.k = CAST(floor(c.event_id / 4) AS BIGINT)"


@_query("r11_trace", _SCORE + f"""
, listed AS (SELECT s.inn, s.score + n AS shown, n, s.domain || CAST(n AS STRING) AS name, s.* EXCLUDE (inn, score) FROM scored s JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) m ON true),
lines AS (SELECT inn, array_to_string(list_slice(list(concat_ws(' ', name, printf('%.2f', shown), concat_ws(' ', CASE WHEN inn_on_site THEN 'inn' END, CASE WHEN ogrn_on_site THEN 'ogrn' END, CASE WHEN site_field_hits > 0 THEN 'site_field' END, CASE WHEN email_hits > 0 THEN 'email' END, CASE WHEN blocked THEN 'blocked' END)) ORDER BY shown DESC, n), 1, 6), '|') AS candidates FROM listed GROUP BY inn),
sums AS (SELECT inn, count(*) AS calls, count(*) FILTER (failed) AS failed, count(*) FILTER (repaired) AS repaired, CAST(sum(completion_tokens) AS BIGINT) AS out_tokens FROM ({_CALLS}) c GROUP BY inn)
SELECT o.inn, o.domain, coalesce(s.calls, 0) AS calls, coalesce(s.failed, 0) AS failed, coalesce(s.repaired, 0) AS repaired, coalesce(s.out_tokens, 0) AS out_tokens, coalesce(s.failed, 0) > 0 AS degraded, l.candidates FROM org o LEFT JOIN sums s ON o.inn = s.inn JOIN lines l ON o.inn = l.inn""")
def _build(v):
    results = v("SELECT inn, domain, CAST(NULL AS STRING) AS proof FROM org")
    many = _scored(v).withColumn("first_seen", F.explode(F.sequence(F.lit(1), F.lit(7))))
    many = many.withColumns({"score": F.col("score") + F.col("first_seen"), "domain": F.concat("domain", F.col("first_seen").cast("string"))})
    return whole.traces(results, many, v(_CALLS)).select("inn", "domain", "calls", "failed", "repaired", "out_tokens", "degraded", F.array_join("candidates", "|").alias("candidates"))


# ---- step logs

_STEPS = "SELECT session, index, raw, observation FROM step_rows"


_CHECK = """'{"a": 1, "b": {"x": 2.5, "y": [true, null]}}'"""
_ARGS = f"""CASE form WHEN 0 THEN '{{"a": 1, "b": {{"y": [true, null], "x": 2.5}}}}' WHEN 2 THEN '{{"b": {{"x": 2.5, "y": [true, null]}}, "a": 1}}' WHEN 3 THEN '{{"q": ' || CAST(index - 1 AS STRING) || '}}'
  WHEN 4 THEN '{{"domain": "https://WWW.site' || CAST(session AS STRING) || '.com/x"}}' WHEN 5 THEN '{{"a": "1", "b": {{"x": 2.5, "y": [true, null]}}}}' WHEN 6 THEN '{{"domain": 5}}' WHEN 7 THEN '{{}}' END"""
_ACTION = "CASE WHEN form IN (0, 2, 5) THEN 'check' WHEN form IN (3, 7) THEN 'search' WHEN form IN (4, 6) THEN 'finish' END"


@_query("a1_parse_steps", f"""SELECT session, index, form IN (1, 8) AS invalid, {_ACTION} AS action, {_ARGS} AS args, CASE WHEN form IN (0, 2) THEN {_CHECK} ELSE {_ARGS} END AS args_in_order,
  CASE WHEN form = 4 THEN 'https://WWW.site' || CAST(session AS STRING) || '.com/x' END AS named FROM step_rows""")
def _build(v):
    return steps.parse_steps(v(_STEPS)).select("session", "index", "invalid", "action", "args", "args_in_order", "named")


_SIGNED = "SELECT *, CASE WHEN form IN (0, 2) THEN 'c' WHEN form = 5 THEN 'typed' WHEN form = 3 THEN 's' || CAST(index AS STRING) WHEN form = 7 THEN 's' END AS sig FROM step_rows"


@_query("a2_flag_repeats", f"SELECT session, index, sig IS NOT NULL AND row_number() OVER (PARTITION BY session, sig ORDER BY index) > 1 AS repeated FROM ({_SIGNED}) s")
def _build(v):
    return steps.flag_repeats(steps.parse_steps(v(_STEPS))).select("session", "index", "repeated")


@_query("a3_cut_session", """
, grouped AS (SELECT *, sum(CASE WHEN form IN (1, 8) THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY index) AS g, row_number() OVER (PARTITION BY session ORDER BY index) AS n FROM step_rows),
runs AS (SELECT *, sum(CASE WHEN form IN (1, 8) THEN 1 ELSE 0 END) OVER (PARTITION BY session, g ORDER BY index) AS r FROM grouped),
stops AS (SELECT session, min(CASE WHEN form IN (4, 6) OR r >= 3 OR n >= 10 THEN n END) AS stop FROM runs GROUP BY session)
SELECT x.session, x.index FROM runs x JOIN stops s ON x.session = s.session WHERE s.stop IS NULL OR x.n <= s.stop""")
def _build(v):
    return steps.cut_sessions(steps.parse_steps(v(_STEPS))).select("session", "index")


@_query("a4_raw_answer", "SELECT session, CASE WHEN min(CASE WHEN form IN (4, 6) THEN index END) = min(CASE WHEN form = 4 THEN index END) THEN 'site' || CAST(session AS STRING) || '.com' END AS answer FROM step_rows GROUP BY session")
def _build(v):
    return steps.raw_answers(steps.parse_steps(v(_STEPS)))


_HEAD = "'Company to find the website for:' || chr(10) || '- INN: ' || CAST(session AS STRING) || chr(10) || '- OGRN: unknown' || chr(10) || '- Legal name: Имя' || chr(10) || '- City: unknown' || chr(10)"


@_query("a5_transcript", f"""
, lines AS (SELECT session, index, CASE WHEN form IN (1, 8) THEN printf('[step %d] INVALID OUTPUT -- ', index) || observation ELSE printf('[step %d] action=', index) || {_ACTION} || ' args=' || {_ARGS} || chr(10) || 'observation: ' || observation END AS line FROM step_rows),
told AS (SELECT session, string_agg(line, chr(10) ORDER BY index) AS lines, 10 - count(*) AS remaining FROM lines GROUP BY session)
SELECT session, {_HEAD} || chr(10) || chr(10) || 'What you did so far:' || chr(10) || lines || chr(10) || chr(10) || printf('You have %d step(s) left. Output the next action as one JSON object.', remaining) || CASE WHEN remaining <= 1 THEN ' This is your LAST step: you must use finish.' ELSE '' END AS transcript FROM told
UNION ALL SELECT session, {_HEAD} || chr(10) || 'You have 10 steps. Output your first action as one JSON object.' FROM (SELECT DISTINCT -1 - session AS session FROM step_rows) n""")
def _build(v):
    who = v("SELECT DISTINCT session, CAST(session AS STRING) AS inn, CAST(NULL AS STRING) AS ogrn, 'Имя' AS name_full, CAST(NULL AS STRING) AS name_short, '' AS city FROM (SELECT session FROM step_rows UNION ALL SELECT -1 - session FROM step_rows) s")
    return steps.transcripts(steps.parse_steps(v(_STEPS)), who)


# ---- evaluation

_OK = "CASE WHEN expected IS NULL THEN domain IS NULL ELSE coalesce(domain = expected OR domain = alt, false) END"
_LABELS_AND_RESULTS = ", both_sides AS (SELECT r.*, l.is_labelled, l.expected, l.tag, CASE WHEN l.k % 3 = 0 THEN 'd' || CAST((l.k + 1) % 7 AS STRING) || '.ru' END AS alt FROM lab l JOIN res r ON l.inn = r.inn), marked AS (SELECT *, " + _OK + " AS ok FROM both_sides) "


def _labels(v):
    return v("SELECT inn, is_labelled, expected, CASE WHEN k % 3 = 0 THEN array('d' || CAST((k + 1) % 7 AS STRING) || '.ru') ELSE array() END AS alt, array(tag, 'all') AS tags FROM lab")


@_query("e1_is_correct", _LABELS_AND_RESULTS + "SELECT inn, config, ok FROM marked")
def _build(v):
    return _labels(v).join(v("res"), "inn").select("inn", "config", evaluate.is_correct().alias("ok"))


_WALKED = "SELECT 'agent' AS config, CAST(session AS STRING) AS inn, form = 1 AS invalid, form = 2 AS repeated FROM step_rows"
_SUMMARY = _LABELS_AND_RESULTS + f"""
, b AS (SELECT config, count(*) AS n, count(*) FILTER (is_labelled) AS labelled, count(*) FILTER (is_labelled AND ok) AS correct, count(*) FILTER (is_labelled AND expected IS NOT NULL AND domain IS NOT NULL AND NOT ok) AS wrong,
  count(*) FILTER (is_labelled AND expected IS NOT NULL AND domain IS NULL) AS missed, count(*) FILTER (is_labelled AND expected IS NOT NULL) AS positives, count(*) FILTER (is_labelled AND expected IS NULL) AS negatives,
  count(*) FILTER (is_labelled AND expected IS NULL AND domain IS NOT NULL) AS false_positives, count(*) FILTER (domain IS NOT NULL) AS answered, count(*) FILTER (proof = 'inn_on_site') AS proven,
  count(*) FILTER (is_labelled AND raw_answer = expected) AS raw_llm_correct, round(avg(elapsed_s), 6) AS time_avg FROM marked GROUP BY config),
c AS (SELECT config, count(*) AS llm_calls, count(*) FILTER (failed) AS llm_failed, count(*) FILTER (repaired) AS json_repairs, round(avg(CASE WHEN json_ok_first_try THEN 1.0 ELSE 0.0 END), 6) AS json_first_try, CAST(sum(completion_tokens) AS BIGINT) AS out_tokens FROM calls GROUP BY config),
w AS (SELECT config, round(count(*) / count(DISTINCT inn), 6) AS agent_steps_avg, count(*) FILTER (invalid) AS agent_invalid, count(*) FILTER (repeated) AS agent_repeated FROM ({_WALKED}) x GROUP BY config),
summary AS (SELECT b.*, c.llm_calls, c.llm_failed, c.json_repairs, c.json_first_try, c.out_tokens, w.agent_steps_avg, coalesce(w.agent_invalid, 0) AS agent_invalid, coalesce(w.agent_repeated, 0) AS agent_repeated, round(CAST(b.correct AS DOUBLE) / b.labelled, 6) AS accuracy,
  round(CAST(b.correct AS DOUBLE) / (b.correct + b.wrong + b.false_positives), 6) AS precision, round(CAST(b.n - b.answered AS DOUBLE) / b.n, 6) AS null_rate FROM b JOIN c ON b.config = c.config LEFT JOIN w ON b.config = w.config)
"""


def _summary(v):
    return evaluate.summarize(_labels(v), v("res"), v("calls"), v(_WALKED))


@_query("e2_summarize", _SUMMARY + "SELECT * FROM summary")
def _build(v):
    return _summary(v)


@_query("e3_by_tag", _LABELS_AND_RESULTS + "SELECT tag, config, count(*) FILTER (ok) AS ok, count(*) AS total FROM (SELECT tag, config, ok FROM marked WHERE is_labelled UNION ALL SELECT 'all', config, ok FROM marked WHERE is_labelled) t GROUP BY tag, config")
def _build(v):
    return evaluate.by_tag(_labels(v), v("res"))


_COUNTED = """SELECT {tag} AS tag, config, count(*) AS n, count(*) FILTER (is_labelled) AS labelled, count(*) FILTER (is_labelled AND ok) AS correct, count(*) FILTER (is_labelled AND expected IS NOT NULL AND domain IS NOT NULL AND NOT ok) AS wrong,
  count(*) FILTER (domain IS NOT NULL) AS answered FROM marked GROUP BY ALL"""


@_query("e3b_counts_by_tag", _LABELS_AND_RESULTS + " UNION ALL ".join(_COUNTED.format(tag=t) for t in ("CAST(NULL AS STRING)", "tag", "'all'")))
def _build(v):
    return evaluate.counts(_labels(v), v("res")).select("tag", "config", "n", "labelled", "correct", "wrong", "answered")


@_query("e4_promotable", "SELECT inn, domain FROM (SELECT r.inn, r.domain, row_number() OVER (PARTITION BY r.inn ORDER BY r.config_no DESC) AS n FROM res r JOIN lab l ON r.inn = l.inn WHERE NOT l.is_labelled AND r.proof = 'inn_on_site' AND r.domain IS NOT NULL) x WHERE n = 1")
def _build(v):
    return evaluate.promotable(_labels(v), v("res"))


@_query("e5_metric_table", _SUMMARY + " UNION ALL ".join(f"SELECT '{m}' AS metric, " + ", ".join(f"CAST(max(CASE WHEN config = '{c}' THEN {m} END) AS DOUBLE) AS {c}" for c in ("base", "chain", "agent")) + " FROM summary" for m in evaluate.METRICS))
def _build(v):
    return evaluate.metric_table(_summary(v), ["base", "chain", "agent"])


@_query("e6_call_telemetry", """SELECT call_id, count(*) AS attempts, NOT bool_or(attempt = 1 AND transport_ok AND NOT accepted) AS json_ok_first_try, bool_or(attempt = 1 AND transport_ok AND NOT accepted) AS repaired, NOT bool_or(accepted) AS failed,
  max_by(prompt_tokens, attempt) AS prompt_tokens, max_by(completion_tokens, attempt) AS completion_tokens FROM attempts GROUP BY call_id""")
def _build(v):
    return evaluate.call_telemetry(v("attempts"))


@_query("e7_marks", _LABELS_AND_RESULTS + "SELECT inn, config, CASE WHEN NOT is_labelled THEN '?' WHEN ok THEN 'OK' ELSE 'BAD' END AS mark FROM marked")
def _build(v):
    return evaluate.marks(_labels(v), v("res"))


@_query("page_codes", """
, printed AS (SELECT CASE WHEN k % 13 = 5 THEN label || '.net' ELSE domain END AS domain, CASE k % 4 WHEN 0 THEN inn WHEN 2 THEN '7725861463' END AS code FROM org WHERE k % 10 <> 9 UNION SELECT domain, CASE WHEN k % 4 = 1 THEN inn ELSE ogrn END FROM org WHERE k % 10 <> 9),
known AS (SELECT inn, inn AS code, 'inn_on_site' AS proof FROM org UNION ALL SELECT inn, ogrn, 'ogrn_on_site' FROM org)
SELECT inn, domain, min(proof) AS proof, CAST(CASE WHEN min(proof) = 'inn_on_site' THEN 0.97 ELSE 0.93 END AS DOUBLE) AS confidence FROM printed p JOIN known n ON p.code = n.code GROUP BY inn, domain""")
def _build(v):
    known = v("SELECT inn, inn AS code, 'inn_on_site' AS proof FROM org UNION ALL SELECT inn, ogrn, 'ogrn_on_site' FROM org")
    return evidence.published_codes(html.page_text(v("SELECT url, final_url, status, error, html FROM snapshot")), known)
