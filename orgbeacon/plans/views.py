"""Inputs of the queries, derived from the given tables by SQL that Spark and DuckDB both run.

Every view has a row or a few for each row of a table, so the queries' work grows with the tables; each page gives an
organisation with a domain of its own, and its html, with codes planted in front, is what that site shows. The SQL keeps to what the
two dialects share; ``[.]`` stands for an escaped dot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("pages", "customer", "conversations", "documents", "events", "labels")


def _digit(s: str, i: int) -> str:
    return f"CAST(substr({s}, {i}, 1) AS INT)"


def control(s: str, weights: tuple[int, ...]) -> str:
    total = " + ".join(f"{w} * {_digit(s, i + 1)}" for i, w in enumerate(weights))
    return f"(({total}) % 11) % 10"


W10, W11, W12 = (2, 4, 10, 3, 5, 9, 4, 6, 8), (7, 2, 4, 10, 3, 5, 9, 4, 6, 8), (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)

# numbers of organisations: k from a table, ten digits, twelve where k is a multiple of 7
_NUMBERS = f"""
  SELECT k, CASE WHEN k % 7 = 0 THEN s11 || CAST({control("s11", W12)} AS STRING) ELSE s10 END AS inn FROM (
    SELECT k, s10, t10 || CAST({control("t10", W11)} AS STRING) AS s11 FROM (
      SELECT k, s9 || CAST({control("s9", W10)} AS STRING) AS s10, s9 || '1' AS t10 FROM (
        SELECT k, lpad(CAST((k * 7919 + 123456789) % 1000000000 AS STRING), 9, '0') AS s9 FROM {{source}}) a) b) c
"""

# the same for Spark, each string written once, so that plans stay short
_NUMBERS_ONCE = f"""
  SELECT k, CASE WHEN k % 7 = 0 THEN transform(transform(array(s9 || '1'), s -> s || CAST({control("s", W11)} AS STRING)), s -> s || CAST({control("s", W12)} AS STRING))[0]
    ELSE transform(array(s9), s -> s || CAST({control("s", W10)} AS STRING))[0] END AS inn
  FROM (SELECT k, lpad(CAST((k * 7919 + 123456789) % 1000000000 AS STRING), 9, '0') AS s9 FROM {{source}}) a
"""


def _cte(numbers: str) -> str:
    return f"""
WITH page_keys AS (SELECT page_id AS k FROM pages),
customer_keys AS (SELECT c_custkey AS k FROM customer),
page_numbers AS ({numbers.format(source="page_keys")}),
customer_numbers AS ({numbers.format(source="customer_keys")}),
raw AS (
  SELECT k, inn, CASE WHEN k % 5 = 0 THEN substr(inn, 1, length(inn) - 1) || CAST(({_digit("inn", 10)} + 1) % 10 AS STRING)
                      WHEN k % 11 = 0 THEN 'abc' WHEN k % 3 = 0 THEN substr(inn, 1, 2) || '-' || substr(inn, 3) ELSE inn END AS raw
  FROM customer_numbers),
hosts AS (
  SELECT page_id AS k, url, html, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host FROM pages),
named AS (
  SELECT k, url, html, host, regexp_extract(host, '([^.]+)[.]example[.][a-z]+$', 1) || 'n' || CAST(k AS STRING) AS label, regexp_extract(host, '([a-z]+)$', 1) AS tld FROM hosts),
org AS (
  SELECT n.k, m.inn, n.url, n.html, n.host, n.label, CASE WHEN n.k % 3 = 0 THEN n.label || '.ru' ELSE n.label || '.' || n.tld END AS domain,
    CASE WHEN n.k % 7 = 0 THEN '3' || lpad(CAST(n.k AS STRING), 14, '0') ELSE '1' || lpad(CAST(n.k AS STRING), 12, '0') END AS ogrn,
    CASE WHEN n.k % 7 = 0 THEN 'ИП Иванов Иван Иванович' ELSE 'ООО «' || n.label || '»' END AS name
  FROM named n JOIN page_numbers m ON n.k = m.k),
hit_rows AS (
  SELECT k, inn, 0 AS query_no, 'q0' AS query, 1 AS rank, name || ' ИНН ' || inn AS title, 'https://fbc.ru/inn/' || inn || '/' AS url,
    'ОГРН ' || ogrn || ' г. Москва ' || CASE WHEN k % 4 = 1 THEN 'почта info@' || domain ELSE 'Сайт: https://' || domain || ' тел. 123' END AS snippet FROM org
  UNION ALL SELECT k, inn, 0, 'q0', 2, label, 'https://www.' || domain || '/about', 'Каталог товаров' FROM org WHERE k % 5 <> 2
  UNION ALL SELECT k, inn, 0, 'q0', 3, 'Вакансии ' || label, 'https://hh.ru/employer/' || CAST(k AS STRING), 'ИНН ' || inn || ' на рынке ' || upper(domain) FROM org WHERE k % 6 <> 1
  UNION ALL SELECT k, inn, 1, 'q1', 1, label || ' shop', 'https://' || label || '-shop.com/x', 'пишите на ' || label || '@mail.ru' FROM org
  UNION ALL SELECT k, inn, 1, 'q1', 2, 'Главная', 'https://' || label || '.com/', '' FROM org
  UNION ALL SELECT k, inn, 2, 'q2', 1, 'нет', 'не url', 'website: ' || domain || ' и partner.org' FROM org),
hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY inn ORDER BY query_no, rank) AS INT) AS hit_no FROM hit_rows),
cards AS (SELECT inn, ogrn, CAST(NULL AS STRING) AS name_full, name AS name_short, CASE WHEN k % 2 = 0 THEN 'Москва' END AS city, 'search' AS source FROM org),
snapshot AS (
  SELECT k, 'https://' || domain || '/' AS url, CASE WHEN k % 13 = 5 THEN 'https://www.' || label || '.net/' ELSE 'https://' || domain || '/' END AS final_url,
    CASE WHEN k % 11 = 0 THEN 404 ELSE 200 END AS status, CAST(NULL AS STRING) AS error,
    '<body><script>x</script><p>' ||
    CASE k % 4 WHEN 0 THEN 'ИНН ' || inn WHEN 2 THEN 'ИНН 7725861463' ELSE 'О нас' END || '</p><a href="/contacts">Контакты</a><a href="/x">x</a></body>' || html AS html FROM org WHERE k % 10 <> 9
  UNION ALL
  SELECT k, 'https://' || domain || '/contacts', 'https://' || domain || '/contacts', 200, CAST(NULL AS STRING),
    '<body><p>' || CASE WHEN k % 4 = 1 THEN 'ИНН ' || inn ELSE 'ОГРН ' || ogrn END || '</p></body>' || html FROM org WHERE k % 10 <> 9),
verified AS (
  SELECT k, inn, CASE WHEN k % 9 = 4 THEN 'ozon.ru' ELSE domain END AS domain, label, k % 6 AS mention_count, CASE WHEN k % 5 = 0 THEN 99 ELSE k % 14 END AS best_rank, k % 3 AS site_field_hits,
    k % 2 AS email_hits, k % 5 AS snippet_hits, k % 4 = 1 AS mentioned_by_registry, k % 9 = 4 AS requires_proof, k % 8 = 1 AS inn_on_site, k % 8 = 2 AS ogrn_on_site,
    CASE WHEN k % 10 = 3 THEN '7725861463' END AS foreign_inn, CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS reachable, CAST(k % 100 AS DOUBLE) / 100 AS likeness FROM org),
replies AS (
  SELECT CAST(conv_id AS STRING) AS inn, CAST(turn + 1 AS INT) AS attempt, (conv_id + turn) % 6 AS form,
    CASE (conv_id + turn) % 6
      WHEN 0 THEN 'Ответ: ```json' || chr(10) || '{{"domain": "a' || CAST(conv_id AS STRING) || '.ru", "confidence": "high", "reason": "x}}"}}' || chr(10) || '```'
      WHEN 1 THEN '{{"domain": null, "confidence": "medium", "reason": "нет"}} конец'
      WHEN 2 THEN 'просто текст' WHEN 3 THEN '{{"domain": "b.com", "confidence": "sure"}}' WHEN 4 THEN '{{"domain": "2"}}' ELSE '{{"domain": 5, "reason": "z"}}' END AS raw_reply FROM conversations),
step_rows AS (
  SELECT conv_id AS session, CAST(turn + 1 AS INT) AS index, (conv_id * 3 + turn) % 9 AS form,
    CASE (conv_id * 3 + turn) % 9 WHEN 0 THEN '{{"action": "check", "args": {{"a": 1, "b": {{"y": [true, null], "x": 2.50}}}}}}' WHEN 1 THEN 'nothing'
      WHEN 2 THEN 'so: {{"action": " check ", "args": {{"b": {{"x": 2.5, "y": [true, null]}}, "a": 1}}}}' WHEN 3 THEN '{{"action": "search", "args": {{"q": ' || CAST(turn AS STRING) || '}}}}'
      WHEN 4 THEN '{{"action": "finish", "args": {{"domain": "https://WWW.site' || CAST(conv_id AS STRING) || '.com/x"}}}}' WHEN 5 THEN '{{"action": "check", "args": {{"a": "1", "b": {{"x": 2.5, "y": [true, null]}}}}}}'
      WHEN 6 THEN '{{"action": "finish", "args": {{"domain": 5}}}}' WHEN 7 THEN '{{"action": "search", "args": ["q"]}}' ELSE '{{"action": 7}}' END AS raw,
    'saw ' || CAST(turn AS STRING) AS observation FROM conversations),
lab AS (
  SELECT CAST(d.doc_id AS STRING) AS inn, l.doc_id IS NOT NULL AS is_labelled, CASE WHEN l.quality = 1 THEN 'd' || CAST(d.doc_id % 7 AS STRING) || '.ru' END AS expected, d.source AS tag, d.doc_id AS k
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
res AS (
  SELECT inn, c.config, c.config_no, CASE WHEN (k + c.config_no) % 4 = 0 THEN NULL WHEN (k + c.config_no) % 4 = 1 THEN 'd' || CAST((k + 1) % 7 AS STRING) || '.ru' ELSE 'd' || CAST(k % 7 AS STRING) || '.ru' END AS domain,
    CASE WHEN k % 5 = 0 THEN 'inn_on_site' WHEN k % 5 = 1 THEN 'corporate_email' END AS proof, CASE WHEN k % 2 = 0 THEN 'd' || CAST(k % 7 AS STRING) || '.ru' END AS raw_answer, CAST(k % 10 AS DOUBLE) / 2 AS elapsed_s
  FROM lab JOIN (SELECT 'base' AS config, 1 AS config_no UNION ALL SELECT 'chain', 2 UNION ALL SELECT 'agent', 3) c ON true),
calls AS (
  SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'chain' ELSE 'agent' END AS config, CAST(user_id AS STRING) AS inn, event_type <> 'error' AS json_ok_first_try, event_type = 'click' AS repaired,
    event_type = 'error' AS failed, CAST(event_id % 90 AS INT) AS completion_tokens FROM events),
attempts AS (
  SELECT event_id - event_id % 2 AS call_id, CAST(event_id % 2 + 1 AS INT) AS attempt, event_type <> 'error' AS transport_ok, event_type IN ('click', 'view', 'purchase') AS accepted,
    CAST(event_id % 50 AS INT) AS prompt_tokens, CAST(event_id % 90 AS INT) AS completion_tokens FROM events)
"""


CTE, SPARK_CTE = _cte(_NUMBERS), _cte(_NUMBERS_ONCE)


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over the views; the given tables are read from ``sf_dir``."""
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(SPARK_CTE + sql)
