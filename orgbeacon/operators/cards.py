"""Organisation cards out of the hits that name the organisation's number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgbeacon.functions.codes import is_entrepreneur, not_empty, or_empty, windows_near

# The patterns of registry number, names and city.
OGRN = r"ОГРН(?:ИП)?\s*:?\s*([15][0-9]{12}|3[0-9]{14})"
PERSON = r"ИП\s+([А-ЯЁ][а-яё\-]+(?:\s+[А-ЯЁ][а-яё\-]+){1,2})"
QUOTED = r"((?:ООО|ОАО|ЗАО|ПАО|АО|НАО|АНО|НКО|ФГУП|ГУП|МУП|ИП)\s*[«\"'][^»\"']{2,80}[»\"'])"
PLAIN = r"\b((?:ООО|ОАО|ЗАО|ПАО|АО|НАО|АНО|НКО)\s+[А-ЯЁ][А-Яа-яЁё\-]{2,30}(?:\s+[А-ЯЁ][А-Яа-яЁё\-]{2,30}){0,2})"
LONG = r"(ОБЩЕСТВО С ОГРАНИЧЕННОЙ ОТВЕТСТВЕННОСТЬЮ\s*[«\"'][^»\"']{2,80}[»\"'])"
CITY = r"\b(?:г\.|город)\s*([А-ЯЁ][а-яё\-]{2,25})"
FEW_HITS, PROMPT_HITS, MOST_PROMPT = 3, 8, 4000


def card_hits(hits: DataFrame) -> DataFrame:
    """Hits of the first card query (query_no 0); where they are fewer than three, of the second one too."""
    firsts = F.count_if(F.col("query_no") == 0).over(Window.partitionBy("inn"))
    return hits.withColumn("__n", firsts).where((F.col("query_no") == 0) | (F.col("query_no") == 1) & (F.col("__n") < FEW_HITS)).drop("__n")


def _titled(df_title: str = "title", df_snippet: str = "snippet") -> Column:
    return F.concat(or_empty(df_title), F.lit(" "), or_empty(df_snippet))


def relevant_hits(hits: DataFrame) -> DataFrame:
    """Hits whose title or snippet contains the number as a substring."""
    return hits.where(F.contains(_titled(), F.col("inn")))


def card_blobs(hits: DataFrame) -> DataFrame:
    """(inn, blob): titles, and what stands around the number, of the relevant hits in their order."""
    parts = F.concat(F.array(or_empty("title")), windows_near(_titled(), "inn"))
    return relevant_hits(hits).groupBy("inn").agg(F.sort_array(F.collect_list(F.struct("hit_no", parts.alias("parts")))).alias("rows")).select("inn", F.array_join(F.flatten(F.transform("rows", lambda r: r["parts"])), " ").alias("blob"))


def _first(pattern: str, flags: str = "(?U)") -> Column:
    return F.regexp_replace(not_empty(F.regexp_extract(or_empty("blob"), flags + pattern, 1)), r"(?U)\s+", " ")


def extract_cards(blobs: DataFrame) -> DataFrame:
    """(inn, ogrn, name_full, name_short, city, source) by patterns."""
    person = F.concat(F.lit("ИП "), _first(PERSON))
    full = F.when(is_entrepreneur("inn"), person).otherwise(_first(LONG, "(?iuU)"))
    short = F.when(is_entrepreneur("inn"), person).otherwise(F.coalesce(_first(QUOTED), not_empty(F.regexp_extract(or_empty("blob"), "(?U)" + PLAIN, 1)), _first(LONG, "(?iuU)")))
    return blobs.select("inn", not_empty(F.regexp_extract(or_empty("blob"), "(?U)" + OGRN, 1)).alias("ogrn"), full.alias("name_full"), short.alias("name_short"), not_empty(F.regexp_extract(or_empty("blob"), "(?U)" + CITY, 1)).alias("city"), F.lit("search_fallback").alias("source"))


def is_complete() -> Column:
    return not_empty("name_short").isNotNull() & not_empty("ogrn").isNotNull()


def extraction_prompts(hits: DataFrame) -> DataFrame:
    """(inn, snippets): the first eight relevant hits in lines."""
    first = relevant_hits(hits).withColumn("__n", F.row_number().over(Window.partitionBy("inn").orderBy("hit_no"))).where(F.col("__n") <= PROMPT_HITS)
    line = F.concat(F.lit("- "), or_empty("title"), F.lit(" :: "), or_empty("snippet"))
    lines = first.groupBy("inn").agg(F.sort_array(F.collect_list(F.struct("hit_no", line.alias("line")))).alias("rows"))
    return lines.select("inn", F.substring(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), 1, MOST_PROMPT).alias("snippets"))


def cards_to_extract(cards: DataFrame, hits: DataFrame) -> DataFrame:
    """Numbers whose card is incomplete though there are relevant hits: a model's work list."""
    return cards.where(~is_complete()).join(relevant_hits(hits).select("inn").distinct(), "inn", "left_semi").select("inn")


def merge_extractions(cards: DataFrame, extractions: DataFrame) -> DataFrame:
    """Blank fields of cards filled from extractions (inn, found, name_short, ..) that found something."""
    more = extractions.where("found").select("inn", *(F.col(c).alias(f"x_{c}") for c in ("name_short", "name_full", "ogrn", "city")))
    joined = cards.join(more, "inn", "left")
    return joined.select(*(F.coalesce(not_empty(c), f"x_{c}").alias(c) if c in ("name_short", "name_full", "ogrn", "city") else c for c in cards.columns))


def display_name() -> Column:
    return F.coalesce(not_empty("name_short"), not_empty("name_full"), F.concat(F.lit("ИНН "), "inn"))
