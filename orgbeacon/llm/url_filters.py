"""URL filters: a blocked Bloom filter of the listed keys, then an exact hash join that removes its false positives.

``rules(host, path, verdict)`` fit a host and its subdomains where the url's path starts with the rule's; the longest
wins. ``listed(url_key)`` are single canonical urls (``canonical``) that are blocked where no rule fits. Both are keys of one list:

* a rule is found under its host and its path up to the last ``/``; a url asks for the suffixes of its host and the
  directories of its path that are as deep as those of some rule, and a join on the key is followed by a comparison with the
  rule's whole path;
* a listed url is found under its canonical form.

Each key that is asked for is probed once, however many urls ask for it. The filter has one row of eight 64-bit words for each
block, each key sets one bit in every word of its block, and a probe is a join on the block number. All of it is DataFrame
functions. Null urls and urls without ``://`` have an empty host and path and are judged like any other; an empty list lets
everything through; a rule that is repeated counts once, and of rules that differ only in their verdict ``block`` wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A filter, or a list, of at most so many rows is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
BITS_A_KEY = 16
_WORDS = 8


def with_host_and_path(df: DataFrame, url_col: str = "url") -> DataFrame:
    """``host`` and ``path`` of a url: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; then up to ``?`` or ``#``."""
    at = F.instr(F.col(url_col), "://")
    rest = F.when(at > 0, F.substr(F.col(url_col), at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return df.withColumns({
        "host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    })


def canonical(url: Column) -> Column:
    """A url without what doesn't change the page: scheme, user, default port, trailing dot of the host, dot segments, query, fragment.

    Letters of the scheme, the host and of percent codes are of one case; an empty path is ``/``. Null or without ``://``: null.
    """
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    scheme = lower(F.regexp_extract(url, r"^([^/?#]*?)://", 1))
    rest = F.substr(url, F.instr(url, "://") + 3)
    authority = lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@", ""))
    port = F.when(scheme == "https", r":443$").otherwise(r":80$")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r":$", ""), port, ""), r"\.+(?=:|$)", "")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    codes = F.array_join(F.transform(F.split(path, "%"), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 2)), F.substring(p, 3, 1 << 30)))), "%")
    no_texts = F.array().cast("array<string>")

    def step(done: Column, segment: Column) -> Column:
        return F.when(segment == ".", done).when(segment == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(segment)))

    pieces = F.split(F.regexp_replace(codes, r"^/", ""), "/")
    whole = F.array_join(F.aggregate(pieces, no_texts, step), "/")
    ends = F.when(F.element_at(pieces, -1).isin(".", "..") & (whole != ""), "/").otherwise("")  # a dot segment at the end names a directory
    cleaned = F.when(codes.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), whole, ends)).otherwise(codes)
    return F.when(F.instr(url, "://") > 0, F.concat(host, F.when(cleaned == "", "/").otherwise(cleaned)))


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^((?s:.*/)?)", 1)


def _hash(key: Column) -> Column:
    return F.xxhash64(key)


def _bit(hashed: Column, word: int) -> Column:
    """One bit of 64, of the six bits from place 7 * word on of a second hash."""
    return F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({hashed}, 1), {7 * word}) & 63 AS int))")


def blocked_bloom(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """The filter of a column ``key`` of which there are about ``n_keys``: (block, w0 .. w7), and its number of blocks."""
    blocks = max(1, -(-n_keys * BITS_A_KEY // (64 * _WORDS)))
    with_hash = keys.select(_hash(F.col("key")).alias("h"))
    words = [F.bit_or(_bit("h", i)).alias(f"w{i}") for i in range(_WORDS)]
    return with_hash.groupBy(F.pmod("h", F.lit(blocks)).alias("block")).agg(*words), blocks


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def listed_entries(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """One row a key and rule: key, r_host, r_path, r_verdict, is_rule."""
    own = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).dropna().groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    own = own.select(F.concat(F.lit("d "), "r_host", _directory(F.col("r_path"))).alias("key"), "r_host", "r_path", "r_verdict", F.lit(True).alias("is_rule"))
    urls = listed.select("url_key").dropna().distinct()
    return own.unionByName(urls.select(F.concat(F.lit("u "), "url_key").alias("key"), F.lit("").alias("r_host"), F.lit("").alias("r_path"), F.lit("block").alias("r_verdict"), F.lit(False).alias("is_rule")))


def looked_up(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """From distinct (host, path, __url): a row for each listed url that is hit (size -1) and for each beginning of a path, of ``size``
    characters, that a rule of its host and directory may have: host, path, __url, suffix, size.

    A directory passes the Bloom filter and an exact join once for all its rules; a page then asks for as many beginnings as its
    directories' rules have distinct lengths, however many rules these are.
    """
    of_key = entries.groupBy("key").agg(F.sort_array(F.collect_set(F.when(F.col("is_rule"), F.length("r_path")))).alias("sizes"))  # as many as a path has characters at most
    n_keys = of_key.count()
    bloom, blocks = blocked_bloom(of_key.select("key"), n_keys)

    # how many labels and directories rules have; a few numbers, as hosts have few labels
    shapes = entries.where("is_rule").select(F.size(F.split("r_host", r"\.")).alias("labels"), (F.size(F.split("r_path", "/")) - 1).alias("depth")).distinct().collect()
    labels, most = F.split("host", r"\."), max((r["depth"] for r in shapes), default=0)
    slashes = F.split("path", "/", most + 2)  # of a path of very many directories the rest is left whole
    asked = [F.when(F.col("__url").isNotNull(), F.struct(F.concat(F.lit("u "), "__url").alias("key"), F.lit("").alias("suffix")))]
    for labels_of_rule, depth in sorted((r["labels"], r["depth"]) for r in shapes):
        suffix = F.array_join(F.slice(labels, F.greatest(F.size(labels) - labels_of_rule + 1, F.lit(1)), F.lit(labels_of_rule)), ".")
        directory = F.concat(F.array_join(F.slice(slashes, 1, depth), "/"), F.lit("/" if depth else ""))
        asked.append(F.when((F.size(labels) >= labels_of_rule) & (F.size(slashes) > depth), F.struct(F.concat(F.lit("d "), suffix, directory).alias("key"), suffix.alias("suffix"))))
    asking = pages.select("host", "path", "__url", F.explode(F.array_compact(F.array(*asked))).alias("a")).select("host", "path", "__url", "a.key", "a.suffix")
    probes = asking.select("key").distinct().withColumn("h", _hash(F.col("key"))).withColumn("block", F.pmod("h", F.lit(blocks)))
    possible = probes.join(_small(bloom, blocks), "block")
    for i in range(_WORDS):
        possible = possible.where(F.col(f"w{i}").bitwiseAND(_bit("h", i)) != 0)
    found = possible.select("key").join(_small(of_key, n_keys), "key")
    sizes = F.when(F.startswith("key", F.lit("u ")), F.array(F.lit(-1))).otherwise(F.filter("sizes", lambda n: n <= F.length("path")))
    return asking.join(_small(found, n_keys), "key").select("host", "path", "__url", "suffix", F.explode(sizes).alias("size"))


def judge(urls: DataFrame, rules: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with host, path, rule (the longest that fits, host and path together) and verdict (allow or block)."""
    entries = listed_entries(rules, listed)
    own = entries.where("is_rule").select("r_host", "r_path", "r_verdict")
    pages = with_host_and_path(urls.drop("host", "path", "rule", "verdict"), url_col).withColumn("__url", canonical(F.col(url_col)))
    asked = looked_up(pages.select("host", "path", "__url").distinct(), entries)
    asked = asked.withColumn("beginning", F.when(F.col("size") >= 0, F.expr("substring(path, 1, size)")))
    hits = asked.join(_small(own, own.count()), F.expr("suffix = r_host AND beginning = r_path"), "left").where("size < 0 OR r_host IS NOT NULL")
    best = hits.groupBy("host", "path", "__url").agg(F.max(F.struct((F.col("size") >= 0).alias("is_rule"), (F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("host_size"), F.coalesce("r_verdict", F.lit("block")).alias("r_verdict"), F.concat("r_host", "r_path").alias("rule"))).alias("best"))
    best = best.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), F.col("__url").alias("b_url"), F.when(F.col("best.is_rule"), F.col("best.rule")).alias("rule"), F.col("best.r_verdict").alias("verdict"))
    out = pages.join(best, F.expr("host = b_host AND path = b_path AND __url <=> b_url"), "left").drop("b_host", "b_path", "b_url", "__url")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
