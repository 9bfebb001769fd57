"""Classifiers, decontamination and scoring: brute force, held-out accuracy, odd inputs."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from orgbeacon.llm import decontamination, language_id, lm_scoring, quality
from orgbeacon.llm.shared import id_remainder

LATIN = {"en": "the of and ing tion ed er th at on", "de": "der die und ung keit sch ein ge zu ver", "fr": "le de et eau tion oi que eux la en", "es": "el de y cion ado ez la os que ie"}


def prose(lang, n, rnd):
    parts = LATIN[lang].split()
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def test_language(spark):
    rnd = random.Random(1)
    rows = [(i, prose(lang, rnd.randrange(8, 60), rnd), lang, 1.0, "x") for i in range(240) for lang in [list(LATIN)[i % 4]]]
    odd = [(1000, None, "en", 1.0, "x"), (1001, "", "en", 1.0, "x"), (1002, "123 !!! \u00b2", None, 1.0, "x"), (1003, rows[0][1] * 400, None, 1.0, "x"), (1003, rows[0][1] * 400, None, 1.0, "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double, lang_pred string")
    model = language_id.train(docs.where(id_remainder("doc_id", 5) != 0), rows_per_language=50)
    assert model.members == {"germanic": ["de", "en"], "romance": ["es", "fr"]} and set(model.pair_weights) == {("de", "en"), ("es", "fr")}
    got = language_id.predict(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    out = got.collect()
    assert len(out) == len(rows + odd) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert [(r.lang_pred, r.score) for r in out if r.doc_id in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert [r.lang_pred for r in out if r.doc_id == 1003] == [rows[0][2]] * 2
    nothing = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, nothing, keep=["doc_id"]).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_quality(spark):
    rnd = random.Random(2)
    grade_of = lambda i: i % 3
    marks = {0: ["vile", "rotten"], 1: ["!!", "BUY"], 2: []}
    rows = [(i, prose("en", 60, rnd) + " " + " ".join(marks[grade_of(i)] * 2) + " " + prose("en", 30, rnd), "clash") for i in range(450)]
    docs = spark.createDataFrame([*rows, (9000, None, "c"), (9001, "", "c"), (9001, "", "c")], "doc_id long, text string, grade string")
    ratings = spark.createDataFrame([(i, grade_of(i)) for i in range(450)] + [(9000, 1), (12345, 2), (1, None)], "doc_id long, grade int")
    model = quality.train(docs, ratings.where(id_remainder("doc_id", 4) != 0), rows_per_grade=200)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    out = quality.score(docs, model).collect()
    assert len(out) == 453 and all(0 <= r.p_tail <= 1 and 0 <= r.expected_grade <= 2 for r in out)
    held = [r for r in out if r.doc_id < 450 and zlib.crc32(str(r.doc_id).encode()) % 4 == 0]
    assert sum(r.grade == grade_of(r.doc_id) for r in held) >= 0.85 * len(held)
    mean = lambda g: np.mean([r.expected_grade for r in held if grade_of(r.doc_id) == g])
    assert mean(0) < mean(1) < mean(2)
    one = quality.train(docs, ratings.limit(0))
    assert {(r.grade, r.p_lowest) for r in quality.score(docs, one, keep=["doc_id"]).collect()} == {(0, 1.0)}
    assert quality.score(docs.limit(0), model).count() == 0


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_decontamination(spark):
    rnd = random.Random(3)
    make = lambda n: [f"v{rnd.randrange(300)}" for _ in range(n)]
    items = [(i, " ".join(make(rnd.choice([1, 2, 3, 9, 10, 11, 40]) if i else 30))) for i in range(20)] + [(50, None), (51, " !! "), (52, None)]
    items += [(53, items[0][1]), (54, items[0][1].upper() + ".")]
    rows = [(i, " ".join(make(rnd.randrange(0, 80)))) for i in range(40)]
    for i in range(40, 90):
        body = items[i % 20][1].split()
        cut = body[rnd.randrange(0, max(1, len(body) - 9)) :]
        rows.append((i, ("-".join(make(4)) + ", " + "! ".join(cut).upper() + " é" + " ".join(make(5)))))
    rows += [(200, None), (201, ""), (202, items[0][1] * 2), (202, items[0][1] * 2), (None, items[0][1])]
    index, sizes = {}, set()
    for i, t in items:
        w = WORDS.findall(fold(t))
        for a in range(max(1, len(w) - 9)):
            if w:
                index.setdefault(tuple(w[a : a + 10]), set()).add(str(i))
                sizes.add(len(w[a : a + 10]))

    def judge(text):
        w = WORDS.findall(fold(text))
        cover, found = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (key := tuple(w[a : a + n])) in index:
                    cover |= set(range(a, a + n))
                    found |= index[key]
        return len(w), len(cover), sorted(found)

    want = sorted((repr(i), *judge(t)) for i, t in rows)
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, n_hit string, words string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bound in (decontamination.INDEX_SHINGLES, 40):  # shingles looked up in the scan, and joined
        got = decontamination.contaminated(docs, bench, index_shingles=bound).collect()
        assert sorted((repr(r.doc_id), r.n_words, r.n_hit, list(r.item_ids)) for r in got) == want
    assert all(r.n_hit == 0 for r in decontamination.contaminated(docs, bench.limit(0)).collect())
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0


def test_scores(spark):
    rnd = random.Random(4)
    rows = [(i, prose(list(LATIN)[i % 4], rnd.randrange(5, 120), rnd).title()) for i in range(300)] + [(900, None), (901, ""), (902, "\x00 new \U0001f600"), (903, "x"), (903, "x")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    train = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", fold(t)), None]
    counts = Counter(w for i, t in rows if train(i) for w in words(t))
    total, kinds = sum(counts.values()), len(counts)
    for few in (300_000, 3):
        lm_scoring.FREQUENT = few
        got = lm_scoring.score(docs, id_remainder("doc_id", 10) != 0).collect()
        assert len(got) == len(rows)
        by = {r.doc_id: r for r in got}
        for i, t in rows:
            r, w = by[i], words(t)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), total)
            assert math.isclose(r.base_score, sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w), rel_tol=1e-9)
            assert r.score < 0
    lm_scoring.FREQUENT = 300_000
    held = [by[i] for i, _ in rows if i < 300 and not train(i)]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_scoring.score(docs.limit(0), F.lit(True)).count() == 0
    assert all(r.score < 0 for r in lm_scoring.score(docs.where("doc_id < 3"), F.lit(False)).collect())


def test_ppm_by_hand():
    texts = [b"abab", b"abc", b"b", b""]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    text, begin = lm_scoring.padded(data, at)
    codes = lm_scoring.byte_codes(text)[lm_scoring._places(begin, np.diff(at))]
    trie = lm_scoring.Trie(*np.unique(codes, return_counts=True))
    # every context's probabilities sum to one over all bytes
    for context in (b"\0\0\0\0\0", b"\0\0\0\0a", b"zzzab", b"qqqqq", b"\0\0aba"):
        all_codes = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        got, missing = trie.top.get(all_codes)
        got = got.astype(float)
        got[missing] = trie._descend(all_codes[missing], trie.order, missing=True)
        assert abs((10**got).sum() - 1) < 1e-5
    # after five zeros a was seen twice, b once and the end once: n / t * (1 - d / (t + d)) with t = 4, d = 3
    one = trie.scores(np.frombuffer(b"b", np.uint8), np.array([0, 1]))[0]
    after_b = np.array([int.from_bytes(b"\0\0\0\0b\0", "big")], np.uint64)
    assert math.isclose(one, math.log10(1 / 4 * 4 / 7) + float(trie.top.get(after_b)[0][0]), rel_tol=1e-6)


def test_ppm_is_as_deep_at_any_size(spark, monkeypatch):
    """The scores are those of contexts of five bytes, however few leaves or hot sequences are allowed."""
    rnd = random.Random(11)
    rows = [(i, prose("en", rnd.randrange(0, 40), rnd)) for i in range(80)] + [(3, "Other TEXT"), (None, "né"), (200, None), (201, "qqq zzz 123")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learned = [(t or "").encode() for i, t in rows if i is not None and i % 4]

    def arrays(texts):
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])

    data, at = arrays(learned)
    text, begin = lm_scoring.padded(data, at)
    trie = lm_scoring.Trie(*np.unique(lm_scoring.byte_codes(text)[lm_scoring._places(begin, np.diff(at))], return_counts=True))
    want = sorted(trie.scores(*arrays([(t or "").encode() for _, t in rows])))
    for hot in (2_000_000, 300, 0):
        monkeypatch.setattr(lm_scoring, "HOT", hot, raising=False)
        got = sorted(r.score for r in lm_scoring.score(docs, F.col("doc_id") % 4 != 0).collect())
        assert np.allclose(got, want, rtol=1e-5)
