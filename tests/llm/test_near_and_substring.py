"""Near duplicates and repeated passages against brute force, with nulls, ties, repeated rows and large groups."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from orgbeacon.joins import perhaps
from orgbeacon.llm import near_dedup, substring_dedup
from orgbeacon.llm.graph import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_words string, component_id string, spans string"


def words(text):
    return WORD.findall(text or "")


def folded(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(text)]


def corpus():
    rnd = random.Random(5)
    make = lambda n: [f"w{rnd.randrange(4000)}" for _ in range(n)]
    base, passage, hub = make(160), make(70), make(200)
    texts = [" ".join(base), " ".join(base), "  ".join(base).upper(), None, "", " \t\n", "One two", "one TWO", "one two three"]
    for i in range(12):
        near = list(base)
        near[(7 * i) % 150] = f"edit{i}"
        texts.append(" ".join(near))
    for i in range(40):  # each near the hub, not all near each other
        near = list(hub)
        for at in rnd.sample(range(200), 3):
            near[at] = f"x{i}_{at}"
        texts.append(" ".join(near))
    texts.append(" ".join(hub))
    for i in range(15):
        texts.append(" ".join(make(rnd.randrange(30, 90)) + (passage if i % 2 else passage[5:60]) + make(rnd.randrange(0, 40))))
    texts += [" ".join(["same"] * 130), " ".join(["same"] * 90), "слово " * 60, "слово\x85" * 60 + " a b", " ".join(make(49)), " ".join(make(3000)) + " " + " ".join(base)]
    rows = [(i, t, "clash", "clash", "clash") for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows + [rows[0]]  # a row twice


def components(rows, percent):
    sets = {}
    for i, t, *_ in rows:
        w = folded(t)
        sets[i] = {tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 3000])
def test_components(spark, block):
    rows = corpus()
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == components(rows, 85)


def test_no_rows_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(none).count() == 0 and substring_dedup.remove_repeats(none).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = near_dedup.near_duplicates(rows).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.n_shingles, r.kept, r.stays) for r in got) == [("1", "1", 2, True, True), ("None", "1", 2, False, False), ("None", "1", 2, False, False), ("None", "None", 0, True, True)]
    two = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (5, "p q r s t u"), (6, "P q r s t u"), (None, "x y z"), (None, "x y z")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.stays) for r in near_dedup.near_duplicates(two).collect())
    assert got == [("5", "5", True)] * 3 + [("6", "5", False)] + [("None", "None", True)] * 2
    assert substring_dedup.remove_repeats(rows).count() == 4


def test_components_of_links(spark):
    links = [(1, 2), (2, 3), (9, 8), (5, 5), (8, 7), (7, 20), (None, 1)] + [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 230)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 20: 7} | {i: 100 for i in range(100, 160)} | {i: 200 for i in range(200, 231)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_pairs(n, low, high, seed):
    """(id, text) of ``n`` pairs of texts of which the shingles are alike by ``low`` to ``high``, and the pairs' exact likeness."""
    rnd, rows, likes = random.Random(seed), [], []
    while len(likes) < n:
        size = rnd.randrange(60, 160)
        one = [f"{seed}_{len(likes)}_{k}" for k in range(size)]
        two = list(one)
        for at in rnd.sample(range(size), rnd.randrange(1, 5)):
            two[at] += "x"
        a, b = ({tuple(t[i : i + 5]) for i in range(size - 4)} for t in (one, two))
        like = len(a & b) / len(a | b)
        if low <= like < high:
            rows += [(2 * len(likes), " ".join(one)), (2 * len(likes) + 1, " ".join(two))]
            likes.append(like)
    return rows


@pytest.mark.parametrize(("low", "high"), [(0.85, 0.9), (0.9, 0.95)])
def test_recall(spark, low, high):
    """Of 1000 planted pairs of each band at least 999 are found."""
    rows = spark.createDataFrame(near_pairs(1000, low, high, int(100 * low)), "doc_id long, text string").repartition(8)
    found = near_dedup.near_duplicates(rows).where("doc_id % 2 = 1 AND component_id = doc_id - 1").count()
    assert found >= 999


def test_rows_do_not_depend_on_the_block(spark):
    """Which links are looked for is the same in blobs of any size, also where tables miss some."""
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    got = [sorted(map(tuple, near_dedup.near_duplicates(docs, percent=60, block=b).select("doc_id", "component_id").collect())) for b in (near_dedup.BLOCK, 3000)]
    assert got[0] == got[1]


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    rows = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    want = sorted(map(tuple, near_dedup.near_duplicates(rows).select("doc_id", "component_id").collect()))
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, near_dedup.near_duplicates(rows).select("doc_id", "component_id").collect())) == want


def test_many_members_are_not_broadcast(spark, monkeypatch):
    """The driver holds a map of bits, whatever the number of members."""
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.columns) or broadcast(df))
    word = lambda i: F.concat(F.lit("w"), (F.col("id") * 40 + i).cast("string"))
    texts = spark.range(11_000).select("id", *(F.concat_ws(" ", F.lit(first), *(word(i) for i in range(19))).alias(first) for first in ("a", "b")))
    rows = texts.select(F.explode(F.array(F.struct((2 * F.col("id")).alias("doc_id"), F.col("a").alias("text")), F.struct((2 * F.col("id") + 1).alias("doc_id"), F.col("b").alias("text")))).alias("r")).select("r.*")
    got = near_dedup.near_duplicates(rows, shingle=1)
    assert got.where("component_id = doc_id - doc_id % 2").count() >= 21_990 and got.count() == 22_000
    assert ["__word", "__bits"] in sent and not [c for c in sent if "weight" in c]


def test_a_map_of_bits_loses_no_key(spark):
    keys = spark.range(0, 30_000, 3).select(F.xxhash64("id").alias("k"))
    found = perhaps(spark.range(30_000), F.xxhash64("id"), keys, F.col("k"))
    assert found.columns == ["id", "__perhaps"] and found.count() == 30_000
    assert found.where("__perhaps AND id % 3 = 0").count() == 10_000 and found.where("__perhaps AND id % 3 > 0").count() < 200
    assert found.where("__perhaps IS NULL").isEmpty() and perhaps(spark.range(3), F.xxhash64("id"), keys.limit(0), F.col("k")).where("__perhaps").isEmpty()


def removed(rows, window=50):
    """(n_words, n_removed, hash of what is left) of each id, window by window."""
    first, out = {}, {}
    docs = {i: words(t) for i, t, *_ in rows}
    for i in sorted(docs):
        for a in range(len(docs[i]) - window + 1):
            first.setdefault(tuple(docs[i][a : a + window]), i)
    for i, w in docs.items():
        cover = {x for a in range(len(w) - window + 1) if first[tuple(w[a : a + window])] < i for x in range(a, a + window)}
        left = " ".join(x for a, x in enumerate(w) if a not in cover)
        out[i] = (len(w), len(cover), hashlib.sha256(left.encode()).hexdigest())
    return out


def as_removed(out):
    return {r.doc_id: (r.n_words, r.n_removed, r.h) for r in out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("h")).collect()}


@pytest.mark.parametrize("big", [True, False])
def test_repeats(spark, monkeypatch, big):
    rows = corpus()
    if not big:
        monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", 0)
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert out.count() == len(rows) and as_removed(out) == removed(rows)


def test_pieces_of_one_passage(spark):
    """Documents that share different parts of a passage, between words of their own or at the text's ends."""
    rnd = random.Random(11)
    passage = [f"p{k}" for k in range(300)]
    rows = []
    for i in range(150):
        a = rnd.randrange(0, 250)
        part = passage[a : a + rnd.randrange(40, 130)]
        before, after = ([f"own{i}_{side}_{k}" for k in range(rnd.choice([0, 0, 3, 30]))] for side in "ab")
        rows.append((i, " ".join(before + part + after + (part if i % 9 == 0 else []))))
    rows += [(500 + i, " ".join(["tick", "tock"] * rnd.randrange(20, 80))) for i in range(20)]
    rnd.shuffle(rows)
    assert as_removed(substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == removed(rows)
