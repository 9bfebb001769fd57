"""The registered queries on the given tables: held-out accuracy, brute force, and the columns of their contracts."""

import hashlib
import os
import re
import zlib

import pytest
from pyspark.sql import functions as F
from test_near_and_substring import components, removed

from orgbeacon.llm import queries, quality
from orgbeacon.llm.shared import id_remainder

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_language(spark):
    out = queries.op2_language_id(spark, SF)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and out.count() == table(spark, "documents").count()
    known = out.where("held_out").join(table(spark, "documents").where("lang IS NOT NULL").select("doc_id", "lang"), "doc_id")
    n, right = known.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert right >= 0.97 * n


def test_quality(spark):
    out = queries.op1_quality(spark, SF)
    assert out.count() == table(spark, "documents").count() and out.where("p_tail < 0 OR p_tail > 1 OR expected_grade < 0 OR expected_grade > 2").isEmpty()
    grades = queries.graded(table(spark, "labels")).dropna()
    held = id_remainder("doc_id", 5) == 0
    docs = table(spark, "documents").select("doc_id", "text")
    model = quality.train(docs, grades.where(~held))
    got = quality.score(docs, model, keep=["doc_id"]).withColumnRenamed("grade", "got").join(grades.where(held), "doc_id")
    n, right = got.agg(F.count("*"), F.count_if(F.col("got") == F.col("grade"))).first()
    assert right >= 0.75 * n


def test_near_duplicates(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    out = queries.op6_near_dedup(spark, SF)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()} == components(rows, 85)


def test_contaminated(spark):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    index = {}
    for r in table(spark, "benchmark").collect():
        w = words(r.text)
        for a in range(max(1, len(w) - 9)) if w else ():
            index.setdefault(tuple(w[a : a + 10]), set()).add(str(r.item_id))
    sizes = {len(k) for k in index}
    got = {r.doc_id: r for r in queries.op4_decontamination(spark, SF).collect()}
    for r in table(spark, "documents").collect():
        w, cover, items = words(r.text), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (key := tuple(w[a : a + n])) in index:
                    cover |= set(range(a, a + n))
                    items |= index[key]
        one = got[r.doc_id]
        assert (one.n_words, one.n_hit, one.n_items, one.contaminated) == (len(w), len(cover), len(items), bool(cover))
        assert one.items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def test_repeated_passages(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    out = queries.op9_substring_dedup(spark, SF)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()} == removed(rows)


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    got, fill = {}, {}
    rows = queries.op3_packing(spark, SF)
    assert rows.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    for r in rows.collect():
        got.setdefault(r.doc_id, []).append(r)
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    docs = table(spark, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = [*encode.encode(d.text or "", add_special_tokens=False).ids, 1]
        pieces = [(n, a, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))) for n, a in enumerate(range(0, len(ids), 4096)) for part in [ids[a : a + 4096]]]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got[d.doc_id]) == pieces
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(fill) <= -(-sum(r.length for own in got.values() for r in own) // 4096) + 1


def test_media(spark):
    got = {r.doc_id: r for r in queries.op7_media_columns(spark, SF).collect()}
    docs = table(spark, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        raw, r = (d.text or "").encode(), got[d.doc_id]
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_bytes % 188 == 0 and r.media_bytes >= len(payload) and re.fullmatch(r"pes=\d+ rap=\d+ first=-?\d+ last=\d+ errors=0", r.feature)
    by_text = {}
    for d in docs:
        r = got[d.doc_id]
        assert by_text.setdefault(d.text or "", (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_sharding(spark):
    got, docs = queries.op8_sharding(spark, SF).collect(), {r.doc_id: r.text for r in table(spark, "documents").collect()}
    assert sorted(r.doc_id for r in got) == sorted(docs) and {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    load, slots = dict.fromkeys(range(40), 0), {}
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= 4 * max(len((t or "").encode()) + 16 for t in docs.values())


def test_language_model_base(spark):
    """The columns of the contract that do not depend on the model."""
    import collections
    import math

    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    docs = {r.doc_id: tokens(r.text) for r in table(spark, "documents").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    counts = collections.Counter(t for i, own in docs.items() if not held[i] for t in own)
    total, kinds = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in queries.op10_lm_scoring(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, own in docs.items():
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in own)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(own), sum(counts[t] > 0 for t in own), total)
        assert abs(r.base_score - base) <= 1e-6 * abs(base) and r.score < 0
