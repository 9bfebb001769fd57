"""Repair of conversations and periodic runs: brute force on the registered queries and on random input, odd rows, bounds that move."""

import hashlib
import heapq
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from orgbeacon.llm import conversations, periodic_runs, queries

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
BLANKS = " \t\n\x0b\x0c\r"


# ---- conversations


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(BLANKS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """The least (cost, audit) by a search over all edits, and the rows that are left."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, left = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, left
        for role in ("user", "assistant"):
            if role[0] in follows[last]:
                heapq.heappush(heap, (cost + 5, audit + "I", i, role[0], (*left, (role, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, left))
            if marks[i] in ("", "truncated"):
                more = 5 * (marks[i] == "truncated")
                if role[:1] and role[0] in follows[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*left, (role, text))))
                for other in ("user", "assistant"):
                    if other[0] in follows[last]:
                        heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, other[0], (*left, (other, text))))


def repaired(rows):
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    marks = faults(rows)
    cost, audit, left = cheapest(rows, marks)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, *(marks.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in left).encode()).hexdigest()


def compare(out, rows, ids):
    want = {i: [] for i in ids}
    for conv, *row in rows:
        want[conv].append(row)
    got = {r[0]: tuple(r)[1:] for r in out.collect()}
    assert len(got) == out.count() == len(want)
    for conv, own in want.items():
        assert got[conv] == repaired(own), (conv, own)


TEXTS = ["", "  ", "Yes.", "No", "Why?\n", "a. b", None, "ok!", "long " * 40 + "."]
SCHEMA = "conv_id long, turn long, role string, text string"


def some_rows(seed, conversations=40, most=14):
    rnd, rows = random.Random(seed), []
    for c in [None, *range(conversations)]:
        for t in range(rnd.randint(0, most)):
            turn = rnd.choice([t, t, t, t + rnd.randint(0, 3), None])
            rows += [(c, turn, rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rnd.choice(TEXTS + [f"text {t}."] * 6))] * rnd.choice([1, 1, 1, 1, 2, 5])
    return rows


@pytest.mark.parametrize("partitions", [1, 3, 37])
def test_repair(spark, partitions):
    rows = some_rows(partitions)
    rows += [(1000, t, "user" if t % 3 else "assistant", f"turn {t}" + "." * (t % 4 > 0)) for t in range(150)]  # goes over many partitions
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ids = {r[0] for r in rows} | {-5}
        known = spark.createDataFrame([(i,) for i in ids], "conv_id long")
        out = conversations.repair(spark.createDataFrame(rows, SCHEMA).repartition(3), known)
        compare(out, rows, ids)
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repair_empty_and_clashing(spark):
    assert conversations.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(1, 1, "user", "a.", "x", 7), (1, 2, "assistant", "b.", "y", 8)], SCHEMA + ", audit string, n long")
    assert [tuple(r)[6:8] for r in conversations.repair(rows).collect()] == [(0, "KK")]


def test_powers_of_transitions():
    """A run advanced by powers costs what its rows cost one by one."""
    for initial in "sua-":
        for fault in (0, 1, 2):
            after = step = conversations.ENDED
            for n in range(1, 40):
                step = conversations.costs_before(initial, fault, 1, step)
                assert conversations.costs_before(initial, fault, n, after) == step
                assert tuple(min(c + a for c, a in zip(row, after, strict=True)) for row in conversations.run_matrix(initial, fault, n)) == step


def test_many_copies(spark):
    rows = spark.range(3000).selectExpr("7L AS conv_id", "1L AS turn", "'user' AS role", "'a.' AS text")
    (r,) = conversations.repair(rows).collect()
    assert (r.duplicate, r.illegal, r.cost, r.audit) == (2999, 2999, 6000, "D" * 3000)


@needs_tables
def test_conversations_query(spark):
    rows, ids = [], set()
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        ids.add(r.conv_id)
        k, role, text = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20, r.role, r.text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        rows += [(r.conv_id, r.turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = queries.op11_conversations(spark, SF)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    compare(out, rows, ids)


# ---- periodic runs


def runs_of(words, exponent=4, length=6):
    """(start, length, period) of all runs, one period after another."""
    _, w = np.unique(np.array(words, dtype=object), return_inverse=True) if words else (0, np.zeros(0, int))
    out = []
    for q in range(1, len(w) // 2 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], w[:-q] == w[q:], [0]]).astype(int)))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            size = e + q - s
            shorter = (p for p in range(1, q) if (w[s : s + size - p] == w[s + p : s + size]).all())
            if size >= max(length, exponent * q) and not any(shorter):
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("piece", [1, 5, 64, 1 << 18])
def test_runs(piece):
    rnd = random.Random(piece)
    for _ in range(120):
        docs = []
        for _ in range(rnd.randint(1, 5)):
            words = rnd.choices(rnd.choice(["a", "ab", "abc", "abcdefgh"]), k=rnd.randint(0, 50))
            if words and rnd.random() < 0.6:
                a, p = rnd.randrange(len(words)), rnd.randint(1, 9)
                words = words[:a] + [words[min(len(words) - 1, a + (i % p))] for i in range(len(words) - a)]
            docs.append(words)
        exponent, length = rnd.choice([(2, 2), (3, 1), (4, 6)])
        texts = pa.array([rnd.choice([" ", "\n", " \t "]).join(w) for w in docs])
        (_, data, at), = periodic_runs.slices(pa.RecordBatch.from_arrays([texts], ["text"]))
        n, text, runs = periodic_runs.runs_of_texts(data, at, exponent, length, piece)
        assert n.tolist() == [len(w) for w in docs]
        found = [[] for _ in docs]
        for d, (s, e, q) in zip(text.tolist(), runs.tolist(), strict=True):
            found[d].append((s, e - s, q))
        assert found == [runs_of(w, exponent, length) for w in docs]


def test_a_sum_that_matches_by_chance_is_cut():
    caught = periodic_runs.Catchers(2)
    caught.append(np.array([3, 5, 3, 5, 3, 7, 3, 7], np.uint64), np.arange(8))
    caught.runs = np.array([[0, 8, 2]])
    assert caught.finished(2, 4).tolist() == [[0, 5, 2], [4, 8, 2]]


def test_runs_of_odd_texts(spark):
    texts = [None, "", "  \n", "a", "x " * 7, "x " * 7, "né " * 500_000]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, runs string")
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert [len(got[i].runs) for i in range(7)] == [0, 0, 0, 0, 1, 1, 1] and tuple(got[6].runs[0]) == (0, 500_000, 1)
    assert [got[i].collapsed_text for i in range(7)] == ["", "", "", "a", "x", "x", "né"]
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


@needs_tables
def test_runs_query(spark):
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    n_planted = 0
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs, drop = runs_of(words), set()
        for s, size, q in runs:
            drop |= set(range(s + q, s + size))
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        own = got[r.doc_id]
        n_planted += bool(runs)
        assert own.n_runs == len(runs) and own.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert (own.start, own.length, own.period, own.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert own.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in drop).encode()).hexdigest()
    assert n_planted > 20
