"""Candidate domains out of hits: queries, collection, order, short lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgbeacon.functions.brands import brand_in_domain, brand_variants, name_similarity
from orgbeacon.functions.codes import not_empty, or_empty
from orgbeacon.functions.domains import is_aggregator, is_blocked, is_registry, mine_domains
from orgbeacon.functions.suffixes import registrable

MOST_QUERIES, SHORTLIST, JUDGED = 6, 6, 5
NO_RANK = 99
#: Of the texts that a candidate gathers only the first ones are ever shown.
MOST_TEXTS = 3


def build_queries(cards: DataFrame) -> DataFrame:
    """From cards with model_queries (array, may be null): (inn, query_no, query), at most six distinct queries each."""
    name = F.coalesce(not_empty("name_short"), not_empty("name_full"))
    own = F.array(
        F.concat(F.lit('"'), "inn", F.lit('"')),
        F.concat(F.lit("ИНН "), "inn", F.lit(" официальный сайт")),
        F.concat(name, F.lit(" официальный сайт")),
        F.concat(name, F.lit(" "), not_empty("city")),
    )
    whole = F.concat(own, F.coalesce("model_queries", F.array().cast("array<string>")))
    queries = F.slice(F.array_distinct(F.filter(whole, lambda q: not_empty(q).isNotNull())), 1, MOST_QUERIES)
    return cards.select("inn", F.posexplode(queries).alias("query_no", "query"))


def with_variants(cards: DataFrame) -> DataFrame:
    """Cards with the spellings of their names, unless they have them."""
    return cards if "variants" in cards.columns else cards.withColumn("variants", brand_variants(or_empty("name_short"), or_empty("name_full")))


def hit_domains(hits: DataFrame, cards: DataFrame) -> DataFrame:
    """Hits with hit_domain and is_registry, and the variants of their card."""
    joined = hits.join(with_variants(cards).select("inn", "ogrn", "variants"), "inn").withColumn("hit_domain", registrable("url"))
    return joined.withColumn("is_registry", is_registry(F.col("hit_domain"), F.col("url"), F.col("title"), F.col("inn"), F.col("ogrn"), F.col("variants")))


def collect_candidates(hits: DataFrame, cards: DataFrame) -> DataFrame:
    """One row for each (inn, domain) that the hits' urls or texts name.

    Each hit is read once: its own domain and those mined from its text are rows of one aggregation, with partial sums before
    the shuffle. An organisation has a few queries of a few hits each, so the lists of texts are short.
    """
    text = F.concat(or_empty("title"), F.lit(" "), or_empty("snippet"))
    rows = hit_domains(hits, cards).withColumn("__found", mine_domains(text))
    itself = F.array(F.struct(F.col("hit_domain").alias("domain"), F.lit("url").alias("kind"), F.lit(0).alias("sub_no")))
    named = F.transform("__found", lambda f, i: F.struct(f["domain"].alias("domain"), f["kind"].alias("kind"), (i + 1).alias("sub_no")))
    own = F.col("f.kind") == "url"
    every = rows.select("*", F.explode_outer(F.concat(itself, named)).alias("f")).where(F.col("f.domain").isNotNull() & (own | ~F.col("f.domain").eqNullSafe(F.col("hit_domain")))).select(
        "inn", "f.domain", F.struct("hit_no", "f.sub_no").alias("seen"), "f.kind", F.when(own, not_empty("title")).alias("title"), not_empty("snippet").alias("snippet"), F.when(own, F.col("rank")).alias("rank"),
        (own & (F.col("is_registry") | is_blocked(F.col("hit_domain")))).alias("requires_proof"), (~own & F.coalesce("is_registry", F.lit(False))).alias("by_registry"),
    )
    times = lambda k: F.count_if(F.col("kind") == k).cast("int")
    texts = lambda c: F.slice(F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("seen", F.col(c).alias("text"))))), lambda x: x["text"]), 1, MOST_TEXTS)
    return every.groupBy("inn", "domain").agg(
        texts("title").alias("titles"), texts("snippet").alias("snippets"), times("url").alias("mention_count"), F.coalesce(F.min("rank"), F.lit(NO_RANK)).cast("int").alias("best_rank"),
        times("site_field").alias("site_field_hits"), times("email").alias("email_hits"), times("mention").alias("snippet_hits"),
        F.bool_or("by_registry").alias("mentioned_by_registry"), F.bool_or("requires_proof").alias("requires_proof"), F.min("seen").alias("first_seen"),
    )


def _one(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def prior_rank(variants: Column) -> Column:
    """In what order candidates are worth a look at their pages."""
    return (
        F.col("mention_count") * 3.0 + F.greatest(F.lit(0), 10 - F.col("best_rank")) * 0.5 - 6.0 * _one(F.col("requires_proof"))
        + 20.0 * _one(F.col("site_field_hits") > 0) + 14.0 * _one(F.col("email_hits") > 0) + 4.0 * F.least("snippet_hits", F.lit(3))
        + 5.0 * _one(F.col("mentioned_by_registry")) + 8.0 * _one(brand_in_domain(F.col("domain"), variants)) + 6.0 * name_similarity(F.col("domain"), variants)
    )


def shortlist(ranked: DataFrame, order: str = "prior", k: int = SHORTLIST) -> DataFrame:
    """The first k candidates of each number; equal ones in the order in which they were first seen."""
    row = F.row_number().over(Window.partitionBy("inn").orderBy(F.desc(order), "first_seen"))
    return ranked.withColumn("item_no", row).where(F.col("item_no") <= k)


def leads_by_query(hits: DataFrame) -> DataFrame:
    """(inn, query_no, results, leads): the first six hits of a query in lines and the first eight domains that its texts name."""
    domain = F.coalesce(registrable("url"), F.lit("?"))
    mark = F.when(is_aggregator(F.col("d")), " [aggregator]").when(is_blocked(F.col("d")), " [never-answer]").otherwise("")
    line = F.concat("d", mark, F.lit(" | "), F.substring(or_empty("title"), 1, 90), F.lit(" | "), F.substring(or_empty("snippet"), 1, 220))
    rows = hits.withColumn("d", domain).withColumn("line", line).withColumn("found", mine_domains(F.concat(or_empty("title"), F.lit(" "), or_empty("snippet"))))
    grouped = rows.groupBy("inn", "query_no").agg(F.sort_array(F.collect_list(F.struct("hit_no", "line", "found"))).alias("rows"))
    found = F.flatten(F.transform("rows", lambda r: r["found"]))
    names = F.transform(found, lambda f: f["domain"])
    first = F.filter(found, lambda f, i: F.array_position(names, f["domain"]) == i + 1)
    leads = F.array_join(F.transform(F.slice(first, 1, 8), lambda f: F.concat(f["domain"], F.lit(" ("), f["kind"], F.lit(")"))), ", ")
    return grouped.select("inn", "query_no", F.array_join(F.transform(F.slice("rows", 1, 6), lambda r: r["line"]), "\n").alias("results"), leads.alias("leads"))
