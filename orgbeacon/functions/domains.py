"""Domains: lists of those that are no answer, and mining of text for candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgbeacon.functions.brands import brand_in_domain
from orgbeacon.functions.codes import let, not_empty, or_empty
from orgbeacon.functions.suffixes import registrable_each

# Directories of registry data.
AGGREGATORS = (
    "rusprofile.ru", "checko.ru", "list-org.com", "zachestnyibiznes.ru", "sbis.ru", "saby.ru", "audit-it.ru", "kartoteka.ru",
    "spark-interfax.ru", "sparkinterfax.ru", "seldon.ru", "e-ecolog.ru", "synapsenet.ru", "vypiska-nalog.com", "fbc.ru",
    "b2bpoisk.ru", "outstaff.ru", "vbankcenter.ru", "k-agent.ru", "companies.rbc.ru", "sbis.com", "delovoy-profil.ru",
    "egrul.nalog.ru", "nalog.ru", "nalog.gov.ru", "bo.nalog.ru", "pb.nalog.ru", "fedresurs.ru", "rusprofile.com", "gks.ru",
    "rosstat.gov.ru", "damia.ru", "ofdata.ru", "kontur.ru", "focus.kontur.ru", "zakupki.gov.ru", "clarspb.ru",
    "primecompany.ru", "sudact.ru", "casebook.ru", "arbitr.ru", "kad.arbitr.ru", "reformagkh.ru", "myseldon.com",
)

# Networks, markets, portals and hosts, which are no organisation's answer unless proven.
PLATFORMS = (
    "vk.com", "vk.ru", "ok.ru", "facebook.com", "instagram.com", "twitter.com", "x.com", "t.me", "telegram.me", "youtube.com",
    "rutube.ru", "dzen.ru", "zen.yandex.ru", "linkedin.com", "pinterest.com", "tiktok.com", "wa.me", "whatsapp.com", "hh.ru",
    "superjob.ru", "rabota.ru", "zarplata.ru", "avito.ru", "youla.ru", "ozon.ru", "wildberries.ru", "market.yandex.ru",
    "aliexpress.ru", "sbermegamarket.ru", "yandex.ru", "ya.ru", "google.com", "google.ru", "mail.ru", "bing.com",
    "duckduckgo.com", "2gis.ru", "yell.ru", "zoon.ru", "flamp.ru", "orgpage.ru", "spr.ru", "bizly.ru", "wikipedia.org",
    "ru.wikipedia.org", "wikimapia.org", "livejournal.com", "github.com", "gitlab.com", "medium.com", "habr.com", "vc.ru",
    "rbc.ru", "kommersant.ru", "interfax.ru", "tass.ru", "ria.ru", "forbes.ru", "cnews.ru", "cbr.ru", "gosuslugi.ru",
    "archive.org", "web.archive.org", "reg.ru", "nic.ru", "timeweb.com", "beget.com", "tilda.cc", "wixsite.com", "narod.ru",
    "ucoz.ru", "blogspot.com", "wordpress.com",
)

# Mail services.
FREE_MAIL = (
    "mail.ru", "yandex.ru", "ya.ru", "gmail.com", "bk.ru", "list.ru", "inbox.ru", "internet.ru", "rambler.ru", "outlook.com",
    "hotmail.com", "icloud.com", "yahoo.com", "protonmail.com", "vk.com", "mail.com", "narod.ru", "bigmir.net", "ukr.net",
)

# Words in the titles of registry pages.
REGISTRY_WORDS = ("инн", "огрн", "реквизит", "выписка", "егрюл", "контрагент", "проверка контрагента")

# The patterns of a website field, an e-mail address and a domain in running text.
SITE_FIELD = (
    r"(?iuU)(?:веб[-\s]?сайт|официальный\s+сайт|сайт компании|сайт|website|home\s?page)\s*[:\-–—]?\s+"
    r"((?:https?://)?(?:www\.)?[a-z0-9][a-z0-9.-]*\.[a-z]{2,})"
)
EMAIL = r"(?iu)[a-z0-9._%+-]+@([a-z0-9.-]+\.[a-z]{2,})"
TEXT_DOMAIN = (
    r"(?iuU)\b((?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+"
    r"(?:ru|рф|com|net|org|su|io|pro|info|biz|moscow|store|online|site|shop|tech|group|company|team|dev|app|me|cc|ai|by|kz))\b"
)


def is_aggregator(domain: Column) -> Column:
    return F.coalesce(domain.isin(*AGGREGATORS), F.lit(False))


def is_blocked(domain: Column) -> Column:
    return F.coalesce(domain.isin(*AGGREGATORS, *PLATFORMS), F.lit(False))


def is_free_mail(domain: Column) -> Column:
    return F.coalesce(domain.isin(*FREE_MAIL), F.lit(False))


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(or_empty(text), F.lit(pattern), F.lit(1))


def domains_in_text(text: Column) -> Column:
    """The distinct registrable domains that a text names, in order."""
    return F.array_distinct(F.array_compact(registrable_each(_matches(text, TEXT_DOMAIN))))


def mine_domains(text: Column) -> Column:
    """Array of (domain, kind): each domain once, by its strongest kind, in the order of website fields, e-mails, mentions."""
    answer = lambda d: d.isNotNull() & ~is_blocked(d)
    pair = lambda domains, kind: F.transform(domains, lambda d: F.struct(d.alias("domain"), F.lit(kind).alias("kind")))

    def strongest(found: Column, domains: Column) -> Column:
        sites, mails = F.size(found["sites"]), F.size(found["mails"])
        by_site = F.array_distinct(F.filter(F.slice(domains, F.lit(1), sites), answer))
        by_mail = F.array_distinct(F.filter(F.slice(domains, sites + 1, mails), lambda d: answer(d) & ~is_free_mail(d)))
        named = F.array_distinct(F.filter(F.slice(domains, sites + mails + 1, F.size(found["named"])), answer))
        whole = F.struct(by_site.alias("site"), by_mail.alias("mail"), named.alias("named"))
        return let(whole, lambda w: F.concat(
            pair(w["site"], "site_field"), pair(F.array_except(w["mail"], w["site"]), "email"), pair(F.array_except(w["named"], F.concat(w["site"], w["mail"])), "mention")
        ))

    found = F.struct(*(_matches(text, p).alias(n) for n, p in (("sites", SITE_FIELD), ("mails", EMAIL), ("named", TEXT_DOMAIN))))
    return let(found, lambda f: let(registrable_each(F.concat(f["sites"], f["mails"], f["named"])), lambda d: strongest(f, d)))


def mined(df: DataFrame, text: Column) -> DataFrame:
    """A row for each mined domain: the columns of df, pos (from 1), domain, kind."""
    rows = df.select("*", F.posexplode_outer(mine_domains(text)).alias("pos", "found")).where("pos IS NOT NULL")  # outer: else mining would also be done in a filter before
    return rows.select(*df.columns, (F.col("pos") + 1).alias("pos"), "found.domain", "found.kind")


def looks_like_registry_hit(url: Column, title: Column, inn: Column, ogrn: Column, variants: Column, domain: Column) -> Column:
    """A page about the organisation in a directory: its codes are in the url, or its number and a registry word in the title of a foreign domain.

    ``domain`` is the registrable domain of the url.
    """
    low_url, low_title = F.lower(or_empty(url)), F.lower(or_empty(title))
    has = lambda text, code: F.coalesce(F.contains(text, not_empty(code)), F.lit(False))
    words = F.lit(False)
    for word in REGISTRY_WORDS:
        words = words | F.contains(low_title, F.lit(word))
    own = brand_in_domain(domain, variants)
    return has(low_url, inn) | has(low_url, ogrn) | (words & has(low_title, inn) & ~own)


def is_registry(domain: Column, url: Column, title: Column, inn: Column, ogrn: Column, variants: Column) -> Column:
    return domain.isNotNull() & (is_aggregator(domain) | looks_like_registry_hit(url, title, inn, ogrn, variants, domain))
