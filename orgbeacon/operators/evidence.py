"""Evidence on pages: what a candidate's pages publish, redirects, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgbeacon.functions.brands import brand_in_domain, name_similarity
from orgbeacon.functions.codes import is_entrepreneur, not_empty, or_empty
from orgbeacon.functions.domains import is_blocked
from orgbeacon.functions.html import crawl_targets
from orgbeacon.functions.suffixes import registrable
from orgbeacon.joins import dealt_join, one_each
from orgbeacon.operators.cards import display_name
from orgbeacon.stored import stored

# What evidence weighs.
WEIGHTS = {
    "inn_on_site": 100.0, "ogrn_on_site": 55.0, "site_field": 38.0, "corporate_email": 28.0, "registry_mention": 12.0,
    "snippet_mention": 4.0, "brand_in_domain": 22.0, "name_similarity": 25.0, "mention": 6.0, "rank": 2.0, "foreign_inn": -60.0,
    "unreachable": -40.0, "ru_zone": 6.0, "ru_sibling": 15.0, "blocked": -100.0,
}
OWN_BRAND = 0.8


def site_homes(domains: DataFrame, facts: DataFrame) -> DataFrame:
    """(domain, home_url, final_url, reachable, home) of distinct domains: the facts of https, or of http where https has neither html nor a status."""
    roles = F.array(*(F.struct(F.lit(r).alias("role"), F.concat(F.lit(f"{r}://"), "domain", F.lit("/")).alias("url")) for r in ("https", "http")))
    asked = domains.select("domain", F.explode(roles).alias("r")).select("domain", "r.role", "r.url")
    page = F.when(F.col("has_html").isNotNull(), F.struct(*(c for c in facts.columns if c != "url")))
    order = F.struct(F.col("status").isNotNull(), "has_html", F.xxhash64(F.to_json(page)))  # of a url that the facts hold twice, the better one
    of = lambda role: F.max_by(F.when(F.col("role") == role, page), F.when((F.col("role") == role) & page.isNotNull(), order)).alias(role)
    both = asked.join(facts, "url", "left").groupBy("domain").agg(of("https"), of("http"))
    secure = F.coalesce(F.col("https.has_html"), F.lit(False)) | F.col("https.status").isNotNull()
    url = F.concat(F.when(secure | F.col("http").isNull(), "https://").otherwise("http://"), "domain", F.lit("/"))
    chosen = both.select("domain", F.when(secure, F.col("https")).otherwise(F.col("http")).alias("home"), url.alias("home_url"))
    reachable = F.coalesce(F.col("home.status").between(200, 399) & F.col("home.has_html"), F.lit(False))
    return chosen.select("domain", "home_url", F.coalesce("home.final_url", "home_url").alias("final_url"), reachable.alias("reachable"), "home")


def home_pages(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """Candidates with the home page of their domain (home_url, final_url, reachable, home); each domain is looked up once."""
    return candidates.join(site_homes(candidates.select("domain").distinct(), facts), "domain", "left")


def site_targets(homes: DataFrame) -> DataFrame:
    """(domain, pos, page_url): the further pages of domains whose home page is reachable, in the order in which to look at them."""
    targets = F.when(F.col("reachable"), crawl_targets(F.col("domain"), F.concat(F.lit("https://"), "domain", F.lit("/")), F.col("final_url"), F.col("home.links")))
    return homes.select("domain", F.posexplode(targets).alias("pos", "page_url"))


def looked_up(domains: DataFrame, facts: DataFrame) -> DataFrame:
    """(domain, url), the urls on whose pages the evidence of distinct domains rests, whether or not there are such pages."""
    homes = F.explode(F.array(*(F.concat(F.lit(f"{r}://"), "domain", F.lit("/")) for r in ("https", "http"))))
    return domains.select("domain", homes.alias("url")).union(site_targets(site_homes(domains, facts)).select("domain", "page_url")).distinct()


def site_pages(homes: DataFrame, facts: DataFrame) -> DataFrame:
    """(domain, pos, url, status, title, published, codes, parse_error): the pages of ``site_targets`` that there are."""
    asked = site_targets(homes)
    seen = facts.where("has_html").select(F.col("url").alias("page_url"), F.col("final_url").alias("url"), "status", "title", "published", "codes", "parse_error")
    return one_each(asked.join(seen, "page_url").drop("page_url"), "domain", "pos", best=(F.col("status").isNotNull(),))


def with_sites(candidates: DataFrame, sites: DataFrame, each: int = 2000) -> DataFrame:
    """Candidates with what is known of their domain's pages. A domain that very many numbers name is dealt over tasks."""
    sizes = stored(candidates.groupBy("domain").agg(F.count("*").alias("__size")))
    rows = sizes.agg(F.coalesce(F.sum("__size"), F.lit(0))).first()[0]
    return dealt_join(candidates, sites.join(sizes, "domain"), "domain", "__size", rows, each)


_PAGE_TYPE = "struct<pos:int,url:string,status:int,title:string,published:array<string>,parse_error:string>"


def verify_pages(candidates: DataFrame, cards: DataFrame, facts: DataFrame) -> DataFrame:
    """Candidates with what their pages prove.

    ``facts`` (functions.html.page_facts) are short; no text is moved. Each domain's home page and, if that is reachable, its
    further pages are found once, by url, for all organisations; which of them publish a code of the organisation is a join on
    (domain, code), so codes don't travel with candidates. Further pages, in the order of the targets, count up to the first one
    with the organisation's number. A url or a number that is there twice counts once (of cards that differ always the same one).
    page_error: why one of the pages that count couldn't be parsed.
    """
    homes = stored(site_homes(candidates.select("domain").distinct(), facts))
    more = stored(site_pages(homes, facts))
    printed = homes.where("home IS NOT NULL").select("domain", F.lit(-1).alias("pos"), F.explode("home.codes").alias("c")).union(more.select("domain", "pos", F.explode("codes").alias("c")))
    own = one_each(cards.select("inn", "ogrn", "name_short", "name_full"), "inn")
    codes = F.array(F.struct(F.lit("inn").alias("kind"), F.col("inn").alias("code")), F.struct(F.lit("ogrn").alias("kind"), F.col("ogrn").alias("code")))
    wanted = candidates.select("inn", "domain").join(own, "inn").select("inn", "domain", F.explode(codes).alias("w")).select("inn", "domain", "w.kind", "w.code").distinct()
    places = wanted.join(printed.select("domain", "pos", "c.code", "c.excerpt"), ["domain", "code"]).groupBy("inn", "domain", "kind", "pos").agg(F.min("excerpt").alias("excerpt"))
    at = lambda kind: F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "excerpt")))).alias(f"{kind}_at")  # noqa: E731  six pages at most
    found = places.groupBy("inn", "domain").agg(at("inn"), at("ogrn"))
    site = more.groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("pos", "url", "status", "title", "published", "parse_error"))).alias("site"))  # five pages at most
    home = F.when(F.col("home").isNotNull(), F.struct(*(F.col(f"home.{c}").alias(c) for c in ("status", "title", "head", "published", "parked", "parse_error"))))
    sites = homes.select("domain", "final_url", "reachable", home.alias("home")).join(site, "domain", "left")

    rows = with_sites(candidates, sites).join(found, ["inn", "domain"], "left").join(own, "inn")
    no_map, no_texts = F.create_map().cast("map<int, string>"), F.array().cast("array<string>")
    rows = rows.withColumns({"inn_at": F.coalesce("inn_at", no_map), "ogrn_at": F.coalesce("ogrn_at", no_map)})
    has = lambda kind, pos: F.map_contains_key(F.col(f"{kind}_at"), pos)
    rows = rows.withColumn("stop", F.array_min(F.filter(F.map_keys("inn_at"), lambda p: p >= 0)))
    scanned = F.when(F.col("reachable") & ~has("inn", F.lit(-1)), F.filter("site", lambda s: F.col("stop").isNull() | (s["pos"] <= F.col("stop"))))
    rows = rows.withColumn("scanned", F.coalesce(scanned, F.array().cast(f"array<{_PAGE_TYPE}>")))

    def entry(pos: Column, url: Column, status: Column, title: Column, excerpt: Column) -> Column:
        return F.struct(pos.alias("pos"), url.alias("url"), status.alias("status"), has("inn", pos).alias("inn_found"), has("ogrn", pos).alias("ogrn_found"), title.alias("title"), excerpt.alias("excerpt"))

    excerpt = lambda pos: F.coalesce(F.try_element_at("inn_at", pos), F.try_element_at("ogrn_at", pos))
    home_excerpt = F.coalesce(not_empty(F.try_element_at("inn_at", F.lit(-1))), F.col("home.head"))
    none = F.array().cast("array<struct<pos:int,url:string,status:int,inn_found:boolean,ogrn_found:boolean,title:string,excerpt:string>>")
    home_page = F.when(F.col("reachable"), F.array(entry(F.lit(-1), F.col("final_url"), F.col("home.status"), F.col("home.title"), home_excerpt))).otherwise(none)
    proving = F.filter("scanned", lambda s: has("inn", s["pos"]) | has("ogrn", s["pos"]))
    rows = rows.withColumn("pages", F.concat(home_page, F.transform(proving, lambda s: entry(s["pos"], s["url"], s["status"], s["title"], excerpt(s["pos"])))))
    published = F.concat(F.coalesce("home.published", no_texts), F.flatten(F.transform("scanned", lambda s: s["published"])))
    errors = F.array_compact(F.concat(F.array(F.when(F.col("reachable"), F.col("home.parse_error"))), F.transform("scanned", lambda s: s["parse_error"])))
    rows = rows.withColumns({"redirected": registrable("final_url"), "home_title": not_empty("home.title")})
    return rows.select(
        *(F.when(F.col("home_title").isNotNull(), F.concat(F.array("home_title"), "titles")).otherwise(F.col("titles")).alias("titles") if c == "titles" else F.col(c) for c in candidates.columns),
        (F.col("reachable") & ~F.coalesce("home.parked", F.lit(False))).alias("reachable"), F.when(F.col("home").isNotNull(), F.col("final_url")).alias("final_url"),
        F.when(F.col("redirected") != F.col("domain"), F.col("redirected")).alias("redirects_to"), F.exists("pages", lambda p: p["inn_found"]).alias("inn_on_site"),
        F.exists("pages", lambda p: p["ogrn_found"]).alias("ogrn_on_site"), F.array_min(F.array_except(published, F.array("inn"))).alias("foreign_inn"), "pages",
        name_similarity(F.col("domain"), F.array(or_empty("name_short"), or_empty("name_full"))).alias("name_similarity"), F.get(errors, F.lit(0)).alias("page_error"),
    )


def published_codes(parsed: DataFrame, known: DataFrame) -> DataFrame:
    """(inn, domain, proof, confidence): which site publishes which organisation's codes, from parsed pages and known (inn, code, proof).

    Pages are scanned once; a code that a site prints on many pages is joined once. The least proof of a pair stays.
    """
    found = parsed.select(registrable(F.coalesce("final_url", "url")).alias("domain"), F.explode("codes.code").alias("code")).where("domain IS NOT NULL").distinct()
    proofs = found.join(known, "code").groupBy("inn", "domain").agg(F.min("proof").alias("proof"))
    return proofs.withColumn("confidence", F.when(F.col("proof") == "inn_on_site", 0.97).otherwise(0.93))


def redirect_candidates(verified: DataFrame) -> DataFrame:
    """New candidates that verified ones redirect to: not known to the number, not blocked, the first source's counts."""
    new = verified.where(F.col("redirects_to").isNotNull() & ~is_blocked(F.col("redirects_to"))).select("inn", F.col("redirects_to").alias("domain"), "mention_count", "best_rank", "item_no")
    new = new.join(verified.select("inn", "domain"), ["inn", "domain"], "left_anti")
    first = F.row_number().over(Window.partitionBy("inn", "domain").orderBy("item_no"))
    none = F.array().cast("array<string>")
    return new.withColumn("__n", first).where("__n = 1").select(
        "inn", "domain", none.alias("titles"), none.alias("snippets"), "mention_count", "best_rank", F.lit(0).alias("site_field_hits"), F.lit(0).alias("email_hits"), F.lit(0).alias("snippet_hits"),
        F.lit(False).alias("mentioned_by_registry"), F.lit(False).alias("requires_proof"), F.struct(F.lit(2**31 - 1).alias("hit_no"), F.col("item_no").alias("sub_no")).alias("first_seen"), (F.col("item_no") + 1000).alias("item_no"),
    )


def has_proof() -> Column:
    return F.col("inn_on_site") | F.col("ogrn_on_site")


def has_entity_evidence() -> Column:
    return has_proof() | (F.col("site_field_hits") > 0) | (F.col("email_hits") > 0)


def _weighed(name: str, condition: Column) -> Column:
    return F.when(condition, WEIGHTS[name]).otherwise(0.0)


def _zone(*names: str) -> Column:
    return F.substring_index("domain", ".", -1).isin(*names)


def score_candidates(verified: DataFrame, variants: Column | None = None) -> DataFrame:
    """With brand_in_domain, blacklisted_without_proof and score; ``variants`` is a column of verified by default."""
    w = WEIGHTS
    brand = brand_in_domain(F.col("domain"), F.col("variants") if variants is None else variants)
    rows = verified.withColumn("brand_in_domain", brand)
    score = (
        _weighed("inn_on_site", F.col("inn_on_site")) + _weighed("ogrn_on_site", F.col("ogrn_on_site")) + _weighed("site_field", F.col("site_field_hits") > 0)
        + _weighed("corporate_email", F.col("email_hits") > 0) + _weighed("registry_mention", F.col("mentioned_by_registry")) + w["snippet_mention"] * F.least("snippet_hits", F.lit(3))
        + _weighed("brand_in_domain", F.col("brand_in_domain")) + w["name_similarity"] * F.col("name_similarity") + w["mention"] * F.least("mention_count", F.lit(4))
        + F.when(F.col("best_rank") <= 10, w["rank"] * (10 - F.col("best_rank")) / 10).otherwise(0.0) + _weighed("ru_zone", _zone("ru", "su", "xn--p1ai", "рф"))
        + _weighed("foreign_inn", not_empty("foreign_inn").isNotNull() & ~has_proof()) + _weighed("unreachable", F.col("reachable").eqNullSafe(False))
    )
    blocked = F.col("requires_proof") & ~(has_proof() | F.col("brand_in_domain") | (F.col("name_similarity") >= OWN_BRAND))
    return rows.withColumn("blacklisted_without_proof", blocked).withColumn("score", F.when(blocked, w["blocked"]).otherwise(F.bround(score, 2)))


def prefer_ru_siblings(scored: DataFrame) -> DataFrame:
    """Of domains of one number that differ after the first label, those in the national zones score higher."""
    label = F.substring_index("domain", ".", 1)
    crowd = F.count("*").over(Window.partitionBy("inn", label))
    return scored.withColumn("score", F.when((crowd >= 2) & _zone("ru", "xn--p1ai", "рф"), F.bround(F.col("score") + WEIGHTS["ru_sibling"], 2)).otherwise(F.col("score")))


# What a candidate's evidence is called in the text that a model reads.
SENTENCES = {
    "domain": "domain: ",
    "title": "page title: ",
    "reachable": "reachable: ",
    "inn_on_site": "INN found on site: ",
    "foreign": ("the site publishes INN ", ", which belongs to a DIFFERENT company"),
    "ogrn_on_site": "OGRN found on site: ",
    "brand": "brand-like domain name: ",
    "similarity": "name similarity: %.2f",
    "found": "appeared in %d search result(s), best rank %d",
    "site_field": 'a directory lists this domain in the company\'s "website" field',
    "email": "the company's contact e-mail is on this domain",
    "registry": "mentioned in a business-registry page about this company",
    "snippet": "[search snippet] ",
}


def evidence_lines() -> Column:
    """A candidate's evidence in lines of text."""
    say = SENTENCES
    yes = lambda name, c: F.concat(F.lit(say[name]), F.when(F.col(c), "True").when(~F.col(c), "False").otherwise("None"))
    cut = lambda a, n: F.slice(F.coalesce(a, F.array().cast("array<string>")), 1, n)
    pages = F.transform(F.filter(F.slice("pages", 1, 3), lambda p: not_empty(p["excerpt"]).isNotNull()), lambda p: F.concat(F.lit("["), p["url"], F.lit("] "), F.substring(p["excerpt"], 1, 300)))
    lines = F.array(
        F.concat(F.lit(say["domain"]), "domain"),
        F.when(F.size("titles") > 0, F.concat(F.lit(say["title"]), F.substring(F.get("titles", F.lit(0)), 1, 160))),
        yes("reachable", "reachable"),
        yes("inn_on_site", "inn_on_site"),
        F.when(not_empty("foreign_inn").isNotNull() & ~has_proof(), F.concat(F.lit(say["foreign"][0]), "foreign_inn", F.lit(say["foreign"][1]))),
        yes("ogrn_on_site", "ogrn_on_site"),
        yes("brand", "brand_in_domain"),
        F.format_string(say["similarity"], "name_similarity"),
        F.format_string(say["found"], "mention_count", "best_rank"),
        F.when(F.col("site_field_hits") > 0, say["site_field"]),
        F.when(F.col("email_hits") > 0, say["email"]),
        F.when(F.col("mentioned_by_registry"), say["registry"]),
    )
    snippets = F.transform(cut(F.col("snippets"), 2), lambda s: F.concat(F.lit(say["snippet"]), F.substring(s, 1, 220)))
    return F.concat(F.filter(lines, lambda x: x.isNotNull()), pages, snippets)


def rendered(judged: DataFrame) -> DataFrame:
    """(inn, candidates): the numbered list of a number's judged candidates."""
    block = F.concat(F.col("item_no").cast("string"), F.lit(". "), "domain", F.lit("\n   - "), F.array_join(evidence_lines(), "\n   - "))
    rows = judged.groupBy("inn").agg(F.sort_array(F.collect_list(F.struct("item_no", block.alias("block")))).alias("rows"))
    return rows.select("inn", F.array_join(F.transform("rows", lambda r: r["block"]), "\n").alias("candidates"))


def decision_prompts(judged: DataFrame, cards: DataFrame) -> DataFrame:
    """(inn, prompt): the card and the numbered candidates."""
    part = lambda label, c: F.coalesce(F.concat(F.lit(label), not_empty(c)), F.lit(""))
    kind = F.when(is_entrepreneur("inn"), "individual entrepreneur (often has no website at all)").otherwise("legal entity")
    head = F.concat(F.lit("Company: "), display_name(), F.lit(", INN "), "inn", part(", OGRN ", "ogrn"), part(", ", "city"), F.lit("\nFull legal name: "), F.coalesce(not_empty("name_full"), F.lit("unknown")), F.lit("\nType: "), kind)
    return rendered(judged).join(cards, "inn").select("inn", F.concat(head, F.lit("\n\nCandidates:\n"), "candidates", F.lit("\n\nAnswer:")).alias("prompt"))


def check_pairs(pairs: DataFrame, cards: DataFrame, facts: DataFrame) -> DataFrame:
    """Evidence for (inn, domain) pairs that no search found, with a report in text; each pair once."""
    domain = F.coalesce(registrable("domain"), F.col("domain"))
    none = F.array().cast("array<string>")
    rows = pairs.select("inn", domain.alias("domain")).dropDuplicates(["inn", "domain"]).select(
        "inn", "domain", none.alias("titles"), none.alias("snippets"), F.lit(0).alias("mention_count"), F.lit(99).alias("best_rank"), F.lit(0).alias("site_field_hits"), F.lit(0).alias("email_hits"),
        F.lit(0).alias("snippet_hits"), F.lit(False).alias("mentioned_by_registry"), is_blocked(F.col("domain")).alias("requires_proof"), F.struct(F.lit(0).alias("hit_no"), F.lit(0).alias("sub_no")).alias("first_seen"), F.lit(1).alias("item_no"),
    )
    seen = verify_pages(rows, cards, facts).join(one_each(cards.select("inn", "ogrn", "name_short", "name_full"), "inn").select("inn", "ogrn"), "inn")
    yes = lambda c: F.when(F.col(c), "True").otherwise("False")
    with_codes = F.array_join(F.transform(F.filter("pages", lambda p: p["inn_found"] | p["ogrn_found"]), lambda p: p["url"]), ", ")
    title = F.coalesce(not_empty(F.substring(F.get("titles", F.lit(0)), 1, 120)), F.lit("-"))
    report = F.concat(
        F.lit("domain: "), "domain", F.lit("\nreachable: "), yes("reachable"), F.lit("\nINN "), "inn", F.lit(" published: "), yes("inn_on_site"), F.lit("\nOGRN "), F.coalesce(not_empty("ogrn"), F.lit("-")),
        F.lit(" published: "), yes("ogrn_on_site"), F.lit("\npages with the codes: "), F.coalesce(not_empty(with_codes), F.lit("none")), F.lit("\nsite title: "), title,
        F.when(is_blocked(F.col("domain")), "\nNOTE: a directory, market or network; it needs the codes of this very organisation").otherwise(""),
    )
    return seen.withColumn("report", report).drop("ogrn")
