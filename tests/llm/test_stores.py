"""Packing, sharding, transport streams, url filters and the pipeline: exact round trips and brute force."""

import hashlib
import os
import posixpath
import random
import re
import zlib
from collections import Counter
from urllib.parse import urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from orgbeacon.llm import media_columns, packing, sharding, url_filters

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    texts = ["it's DON'T we'll x²½ naïve Straße ÀÉ ʼn İstanbul ﬁne éa a b\x1cc <|endoftext|>x 12ab3 日本語 😀 ªº µ × ÷ '' 's \ufeffz a\u200bb", "", "  ", "\x85a\xa0b 'Tis 'SOUL", "İ ß ẞ Ÿ e\u0301"]
    for text in texts:
        assert own.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the given tables")
def test_ids_of_all_given_documents():
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist():
        assert np.frombuffer(own.encode(text or ""), "<u4").tolist() == whole.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    rnd = random.Random(seed)
    counts = Counter(rnd.choice([rnd.randrange(1, 101), rnd.randrange(1, 30), 100, 50]) for _ in range(rnd.choice([1, 40, 3000])))
    patterns = packing.plan(dict(counts), 100)
    used = Counter()
    for pattern, times in patterns:
        assert sum(length * n for length, n in pattern) <= 100
        for length, n in pattern:
            used[length] += n * times
    assert used == counts
    bound = -(-sum(length * n for length, n in counts.items()) // 100)
    assert sum(t for _, t in patterns) <= bound * 1.02 + 2
    assert packing.plan({}, 100) == []


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL", 3)
    rnd = random.Random(7)
    texts = [" ".join(rnd.choice(["cat", "dog", "Zebra", "ünïcode", "x1"]) for _ in range(rnd.randrange(0, 60))) for _ in range(60)] + [None, "", "hot words here"] + ["hot words here"] * 20
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(0, texts[0], 5)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3), PATH, capacity=32).collect()
    own = packing.Encoder(PATH)
    want = Counter()
    for i, t, _ in rows:
        ids = own.encode(t or "") + np.array([1], "<u4").tobytes()
        for p, at in enumerate(range(0, len(ids), 128)):
            want[i, p, at // 4, len(ids[at : at + 128]) // 4, zlib.crc32(ids[at : at + 128])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    for sequence in {r.sequence_id for r in out}:
        at = 0
        for r in sorted((r for r in out if r.sequence_id == sequence), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 32
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_flow_moves_the_fewest_bytes():
    assert sharding.min_cost_flow([5, 1], [3, 3], [[0, 1], [1, 0]]) == [[3, 2], [0, 1]]
    # the cheapest way needs a flow that goes back on a first choice
    assert sharding.min_cost_flow([1, 1], [1, 1], [[0, 1], [0, 5]]) == [[0, 1], [1, 0]]
    moves = sharding.transfers([100, 0, 7], 3)
    assert sum(e - b for o, b, e, n in moves if o != n) == 64 and sum(e - b for _, b, e, _ in moves) == 107


def test_sharding(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "CELL", 7)
    rnd = random.Random(8)
    rows = [(i, "é" * rnd.randrange(0, 40) if i % 9 else None, "hot" if i % 3 else f"s{i % 5}", 1) for i in range(600)] + [(1, "é", "hot", 1), (None, "x", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(4))
    placed = sharding.reshard(docs, old, shards=4)
    out = placed.collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter((i, len((t or "").encode()) + 16) for i, t, *_ in rows)
    assert all(r.text_crc32 == zlib.crc32((rows[r.doc_id][1] or "").encode()) for r in out if r.doc_id is not None and r.doc_id != 1)
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    loads = [sum(r.size for r in out if r.shard == s) for s in range(4)]
    assert max(loads) - min(loads) <= 4 * 96
    unique = docs.where("doc_id > 1")
    again = sharding.reshard(unique, old, shards=4)
    sharding.rewrite_affected(unique, again, str(tmp_path / "shards"))
    affected = {s for r in again.collect() if r.shard != r.old_shard for s in (r.shard, r.old_shard)}
    got = spark.read.parquet(str(tmp_path / "shards"))
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in again.collect() if r.shard in affected}
    assert sharding.reshard(docs.limit(0), old).count() == 0


def test_rewritten_shards_hold_every_row_once(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 30), i % 3) for i in range(200)] + [(None, "x", 0), (None, "x", 1), (None, None, 0), (7, "other", 0), (7, "other", 0), (7, "third", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, old int").repartition(3)
    placed = sharding.reshard(docs, F.col("old"), shards=4)
    sharding.rewrite_affected(docs, placed, str(tmp_path / "all"))
    got = spark.read.parquet(str(tmp_path / "all")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, _ in rows)
    assert Counter((r.doc_id, len((r.text or "").encode()) + 16, r.shard, r.slot) for r in got) == Counter((r.doc_id, r.size, r.shard, r.slot) for r in placed.collect())
    # shard 0 loses its only row, shard 2 stays as it is
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    docs.selectExpr("*", "0L AS slot", "CAST(IF(doc_id = 1, 0, 2) AS INT) AS shard").write.partitionBy("shard").parquet(str(tmp_path / "old"))
    placed = spark.createDataFrame([(1, 17, zlib.crc32(b"a"), 0, 1, 0), (2, 17, zlib.crc32(b"b"), 2, 2, 0)], "doc_id long, size long, text_crc32 long, old_shard int, shard int, slot long")
    sharding.rewrite_affected(docs, placed, str(tmp_path / "old"))
    assert sorted((r.doc_id, r.shard) for r in spark.read.parquet(str(tmp_path / "old")).collect()) == [(1, 1), (2, 2)]


def test_resharded_rows_are_those_of_the_files(spark, monkeypatch):
    folders = []
    write = sharding.rewrite_affected
    monkeypatch.setattr(sharding, "rewrite_affected", lambda docs, placed, folder, *a: (folders.append(folder), write(docs, placed, folder, *a))[1])
    rows = [(i, "é" * (i % 40) if i % 9 else None, i % 2) for i in range(100)] + [(None, "x", 0), (1, "é", 1), (1, "é", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, old int").repartition(3)
    out = sharding.reshard_files(docs, F.col("old"), shards=4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert len(folders) == 1 and spark.read.parquet(folders[0]).count() == len(rows)
    assert sharding.reshard_files(docs.limit(0), F.col("old"), shards=4).count() == 0


def test_prefix_sums(spark):
    from orgbeacon.llm.shared import prefix_sums

    rnd = random.Random(3)
    rows = [(g, c, n, rnd.randrange(9)) for g in range(3) for c in range(2) for n in range(rnd.randrange(1, 40))]
    got = {(r.g, r.c, r.n): r.before for r in prefix_sums(spark.createDataFrame(rows, "g int, c int, n int, v long"), "g", ["c"], "n", "v", "before", chunk=7).collect()}
    assert got == {(g, c, n): sum(v for h, d, m, v in rows if h == g and (d, m) < (c, n)) for g, c, n, _ in rows}


def test_dealt_join(spark):
    from orgbeacon.llm.shared import dealt_join

    many = spark.range(3000).selectExpr("IF(id % 3 = 0, id, 0) AS k", "id AS v")
    one = many.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("most"))
    got = dealt_join(many, one, "k", "n", 3000, each=50)
    assert got.columns == ["k", "v", "most"] and Counter(map(tuple, got.collect())) == Counter(map(tuple, many.join(one.drop("n"), "k").collect()))


def test_streams(spark):
    rows = [(0, None), (1, ""), (2, "x" * 192), (3, "é" * 5000), (4, "abc"), (4, "abc"), (5, "z" * 3072 * 3), (6, "\x00\x47" * 800)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, media string")
    out = media_columns.read_streams(media_columns.store_texts(docs)).collect()
    assert len(out) == len(rows)
    for r in out:
        text = (dict(rows)[r.doc_id] or "").encode()
        payload = text.ljust(max(192, -(-len(text) // 192) * 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.media_bytes % 188 == 0 and r.continuity_errors == 0
        assert list(r.pts) == [i * media_columns.TICKS for i in range(-(-len(payload) // media_columns.FRAME))] and len(r.random_access) == len(r.pts)
    assert media_columns.read_streams(media_columns.store_texts(docs.limit(0))).count() == 0


def test_damaged_streams():
    payload = np.arange(192 * 40, dtype=np.int64).astype(np.uint8)
    media = media_columns.mux(payload)
    lost = media[: 188 * 5] + media[188 * 6 :]
    with pytest.raises(ValueError, match="not whole"):
        media_columns.demux(lost)
    flipped = bytearray(media)
    flipped[188 * 4 + 3] ^= 5
    assert media_columns.demux(bytes(flipped))["errors"] == 2
    for bad in (media[1:] + b"x", media[:-1]):
        with pytest.raises(ValueError):
            media_columns.demux(bad)
    broken = bytearray(media)
    broken[20] ^= 1
    broken[12] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        media_columns.demux(bytes(broken))
    # a packet sent twice and one without payload are legal; a packet sent three times is not
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    idle = bytes([0x47, packets[4][1] & 0xBF, packets[4][2], 0x20 | packets[4][3] & 15, 183]) + b"\x00" + b"\xff" * 182
    legal = media_columns.demux(b"".join([*packets[:5], packets[4], idle, *packets[5:]]))
    assert legal["errors"] == 0 and (legal["payload"] == payload).all()
    with pytest.raises(ValueError):
        media_columns.demux(b"".join([*packets[:5], packets[4], packets[4], *packets[5:]]))


def test_second_stream():
    import struct

    first, second = np.arange(192 * 20).astype(np.uint8), np.full(192 * 3, 7, np.uint8)
    pmt = struct.pack(">HH", 0xE101, 0xF000) + struct.pack(">BHH", 6, 0xE101, 0xF003) + b"\x05\x01x" + struct.pack(">BHH", 15, 0xE102, 0xF000)
    other = np.frombuffer(media_columns.mux(second), np.uint8).reshape(-1, 188)[2:].copy()
    other[:, 2] = 2
    media = media_columns.mux(first)[:188] + media_columns._section(0x100, 2, 1, pmt) + media_columns.mux(first)[376:] + other.tobytes()
    assert media_columns.demux(media)["streams"] == [(0x101, 6), (0x102, 15)]
    assert (media_columns.demux(media)["payload"] == first).all() and (media_columns.demux(media, 1)["payload"] == second).all()
    with pytest.raises(ValueError, match="no elementary stream"):
        media_columns.demux(media, 2)


def test_damage_stays_in_its_row(spark):
    media = media_columns.mux(np.full(192 * 40, 65, np.uint8))
    rows = [(1, 7680, media), (2, 7680, media[188:]), (3, 7680, b"x" * 188), (4, None, None), (5, 7680, b""), (6, 7680, media[: 188 * 5] + media[188 * 6 :])]
    got = {r.doc_id: r for r in media_columns.read_streams(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1].damage is None and got[1].payload_bytes == 7680 and got[1].pids == [0x101] and got[4].damage is None and got[4].media_bytes is None
    assert all(got[i].damage and got[i].payload_sha256 is None for i in (2, 3, 5, 6))


def is_canonical(url):
    """The canonical form by the standard library."""
    if "://" not in url:
        return None
    parts = urlsplit(url)
    host = (parts.hostname or "").rstrip(".") + (f":{parts.port}" if parts.port not in (None, 80, 443) else "")
    path = re.sub("%[0-9a-f]{2}", lambda m: m[0].upper(), parts.path)
    return host + (posixpath.normpath(path) + ("/" if path.endswith(("/", "/.", "/..")) and posixpath.normpath(path) != "/" else "") if path else "/")


def test_urls(spark):
    urls = ["http://EXAMPLE.com/en/x?q#f", "https://www.example.com/en/", "https://a.b.example.com/en/y", "ftp://q.net/es/", "http://net/fr/1", "http://notnet/fr/", "x.com/", None, "", "http://other.org/p/q.html?x=1", "http://other.org/p/q.htm", "http://z.com", "://h.com/a://b", "http://q.net/fr", "http://q.net/esx/", "http://r.org/abc/d", "http://r.org/abd", "http://other.org/p/q.html?x=1", "https://u:p@OTHER.org.:443/p/./z/../q.html#f", "http://other.org:81/p/q.html", "http://k.org/a%2fb/", "http://K.org:80/a%2Fb/", "http://z.com/" + "d/" * 4000, "http://k.org" + "/x/.." * 30]
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("r.org", "/abc/d", "block"), ("r.org", "/ab", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    listed = spark.createDataFrame([("http://other.org/p/q.html",), ("https://OTHER.org/p/q.html",), (None,), ("http://k.org/a%2Fb/",), ("http://k.org",)], "url string").select(url_filters.canonical(F.col("url")).alias("url_key"))
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id int, url string, rule string")
    got = {r.page_id: r for r in url_filters.judge(pages, rules, listed).collect()}
    assert len(got) == len(urls)
    plain = [r for r in rules.collect() if r.host]
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = rest.split("/")[0].split("?")[0].split("#")[0].lower()
        path = rest[len(host) :].split("?")[0].split("#")[0]
        fits = [r for r in plain if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.host + r.path), default=None)
        verdict = best.verdict if best else "block" if u and is_canonical(u) in {"other.org/p/q.html", "k.org/a%2Fb/", "k.org/"} else "allow"
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best.host + best.path if best else None, verdict), u
    assert all(r.verdict == "allow" for r in url_filters.judge(pages, rules.limit(0), listed.limit(0)).collect())
    assert url_filters.judge(pages.limit(0), rules, listed).count() == 0


@pytest.mark.parametrize("small", [True, False])
def test_rules_on_files_of_one_directory(spark, monkeypatch, small):
    """Very many rules of one directory: a page asks for as many beginnings as their paths have lengths, whatever the rules' number."""
    monkeypatch.setattr(url_filters, "BROADCAST_ROWS", 1_000_000 if small else 0)
    rnd = random.Random(3)
    files = ["".join(rnd.choices("ab", k=rnd.randint(0, 11))) for _ in range(3000)]
    rules = sorted({("h.org", f"/d/{f}", rnd.choice(["allow", "block"])) for f in files[:1500]} | {("org", "/d/a", "block"), ("h.org", "/", "allow"), ("h.org", "", "block")})
    rules = list({r[:2]: r for r in rules}.values())
    urls = [(i, f"http://{'w.' if i % 3 else ''}h.org/d/{f}{'/x' if i % 5 == 0 else ''}") for i, f in enumerate(files)] + [(9000, "http://h.org"), (9001, "http://h.org?a"), (9002, None)]
    pages, frame = spark.createDataFrame(urls, "page_id int, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")
    none = spark.createDataFrame([], "url_key string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(pages, frame, none).collect()}
    for i, url in urls:
        host, path = ("", "") if url is None else (url[7:].split("/")[0].split("?")[0], ("/" + url[7:].split("/", 1)[1]) if "/" in url[7:] else "")
        fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == ((max(fits)[2], max(fits)[3]) if fits else (None, "allow")), url
    asked = url_filters.with_host_and_path(pages, "url").withColumn("__url", F.lit(None).cast("string")).select("host", "path", "__url").distinct()
    lengths = len({len(p) for _, p, _ in rules}) + 1
    n = url_filters.looked_up(asked, url_filters.listed_entries(frame, none)).count()
    assert 0 < n <= lengths * len(urls) < 3000 * 20


def test_no_key_is_lost_by_the_filter(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    bloom, blocks = url_filters.blocked_bloom(keys, 5000)

    def passing(rows):
        probed = rows.withColumn("h", F.xxhash64("key")).withColumn("block", F.pmod("h", F.lit(blocks))).join(bloom, "block")
        for i in range(8):
            probed = probed.where(F.col(f"w{i}").bitwiseAND(url_filters._bit("h", i)) != 0)
        return probed.count()

    assert passing(keys) == 5000
    assert passing(spark.range(20000).select(F.concat(F.lit("no"), F.col("id").cast("string")).alias("key"))) < 400


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(9)
    parts = {"en": "the of and ing tion ed er th".split(), "fr": "le de et eau oi que eux la".split()}
    make = lambda lang, n: ["".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(2, 5))) for _ in range(n)]
    passage, item = make("en", 60), make("en", 25)
    texts = {i: make("en" if i % 2 else "fr", 80) for i in range(40)}
    texts[50] = list(texts[3])
    texts[51] = ["edit", *texts[3][1:]]
    texts[52], texts[53] = make("en", 50) + passage, passage + make("en", 70)
    texts[54] = make("en", 30) + item[3:20] + make("en", 30)
    rows = [(i, " ".join(t), "en" if i % 2 or i >= 50 else "fr", "s", len(" ".join(t))) for i, t in texts.items()] + [(60, "12 34 --", "en", "s", 8), (61, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    everything = {r[0] for r in rows}
    assert left["language_id"] == everything - {60, 61}
    assert left["near_dedup"] == left["language_id"] - {50, 51}
    assert left["substring_dedup"] == left["near_dedup"]
    assert left["decontamination"] == left["substring_dedup"] - {54}
    assert left["packing"] == left["decontamination"]
    cut = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "stage2")).collect()}
    assert cut[53].text == " ".join(texts[53][60:]) and cut[53].n_chars == len(cut[53].text) and cut[52].text == " ".join(texts[52])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(4)
    make = lambda n: " ".join("".join(rnd.choice("the of and ing tion ed er th".split()) for _ in range(rnd.randint(2, 5))) for _ in range(n))
    one, two, three, passage, item = make(80), make(80), make(80), make(60), make(12)
    texts = [(1, one), (1, one), (1, one), (2, one), (None, one), (3, two), (3, three), (4, three), (None, make(70)), (5, passage + " " + make(20)), (6, make(20) + " " + passage), (6, make(30)), (None, make(20) + " " + item), (7, None), (8, "")]
    names = "doc_id long, text string, lang string, score string, set_key string, text_key string, stays string, spans string, n_words string, n_chars int"
    docs = spark.createDataFrame([(i, t, "en", *["clash"] * 6, len(t or "")) for i, t in texts], names).repartition(3)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    assert kept(stages["language_id"](spark, docs, str(tmp_path))) == Counter((i, t) for i, t in texts if t)
    got = stages["near_dedup"](spark, docs, str(tmp_path))
    want = Counter((i, t) for i, t in texts) - Counter([(1, one), (1, one), (2, one), (None, one), (4, three)])
    assert kept(got) == want and got.columns == docs.columns and {r.set_key for r in got.collect()} == {"clash"}
    got = stages["substring_dedup"](spark, docs.where("doc_id IN (5, 6)"), str(tmp_path))
    assert {(r.doc_id, len(r.text.split()), r.spans) for r in got.collect()} == {(5, 80, "clash"), (6, 20, "clash"), (6, 30, "clash")}
    assert kept(stages["decontamination"](spark, docs, str(tmp_path))) == Counter((i, t) for i, t in texts if item not in (t or ""))
    assert stages["packing"](spark, docs, str(tmp_path)).count() == len(texts)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_many_ids_to_remove_are_not_broadcast(spark, monkeypatch):
    """The driver holds a map of bits, whatever the number of ids; null ids and repeated rows are met as ever."""
    import corpus_pipeline

    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.columns) or broadcast(df))
    text = F.concat(F.lit("t"), (F.col("id") % 70_000).cast("string")).alias("text")
    docs = spark.range(140_000).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("doc_id"), text)
    gone = docs.where("doc_id < 70000 OR doc_id IS NULL AND text < 't5'").select("doc_id", F.xxhash64("text").alias("text_key"))
    left = corpus_pipeline.without(docs, gone)
    assert left.columns == docs.columns
    assert sorted(left.groupBy(F.col("doc_id").isNull()).count().collect()) == sorted(docs.where("doc_id >= 70000 OR doc_id IS NULL AND text >= 't5'").groupBy(F.col("doc_id").isNull()).count().collect())
    assert sent == [["__word", "__bits"]]


def test_near_dedup_by_shuffles_gives_the_same(spark, monkeypatch):
    import corpus_pipeline

    one, two = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    texts = [(1, one), (1, one), (2, one + " x"), (None, one), (3, two), (3, one), (4, two + " y"), (None, "alone"), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id long, text string, lang string").repartition(3)
    kept = lambda: Counter((r.doc_id, r.text) for r in corpus_pipeline.one_of_near_duplicates(spark, docs, "").collect())
    want = kept()
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", -1)
    assert kept() == want and want[(1, one)] == 1 and want[(7, None)] == 1
