"""Language-model scoring: prediction by partial matching over bytes, beside a unigram base over words.

The model is a trie of byte contexts of up to ``ORDER`` bytes, whatever the size of the corpus, learned from all training
documents. One scan counts the sequences of one byte more. Shorter contexts count a byte once for each longer context that it
was new in (update exclusion). The probability of a byte is found in the longest context that was seen: n / (t + d) for a byte
seen n times of t with d distinct ones, else the escape d / (t + d), and the search goes on in the next shorter context without
the bytes of the longer ones (symbol exclusion), down to an even share of all bytes.

The levels of the trie are tables, worked out from the shortest context on by a join with the level below and sums over each
context; no key of these has more than 256 rows. They hold the sequences of all texts, learned or not, so that each has its
log-probability. The ``HOT`` sequences that are met most are looked up where the text is; a document's other ones go to a join,
and its code length is the sum of both.

The base needs the training count of every word. The words frequent enough for a table of ``FREQUENT`` entries are looked up
where the text is; the other words of a document go, by their hash, to a join with all counts.

Null text is scored as an empty one (its end alone). Without training text every byte has an even share. A-Z are lower-cased.
Rows that repeat are scored, and learned from, each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgbeacon.llm.shared import FOLDED, checkpoint, packed, slices, word_bounds, word_hashes

FREQUENT = 300_000
HOT = 2_000_000
ORDER = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def padded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts with ORDER zero bytes before each and at the end, and where each begins; a zero is a text's end."""
    n = len(at) - 1
    out = np.zeros(len(data) + ORDER * (n + 1), np.uint8)
    out[np.arange(len(data)) + np.repeat(ORDER * np.arange(1, n + 1), np.diff(at))] = _LOWER[data]
    return out, at[:-1] + ORDER * np.arange(1, n + 1)


def byte_codes(text: np.ndarray) -> np.ndarray:
    """Each byte of padded texts with the ORDER bytes before it, as a number."""
    out = np.zeros(len(text), np.uint64)
    for i in range(ORDER, -1, -1):
        out[ORDER:] = out[ORDER:] << np.uint64(8) | text[ORDER - i : len(text) - i]
    return out


def _places(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Every byte of the texts and the end of each."""
    lengths = sizes + 1
    return np.arange(lengths.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(where, np.concatenate(counts), len(key)).astype(np.int64)


def byte_counts(docs: DataFrame) -> DataFrame:
    """(code, n, met): how often each ORDER + 1 bytes, the last of them predicted, occur in the learned and in all texts of (text, learned)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        met: list[np.ndarray] = []

        def merge() -> None:
            key, where = np.unique(np.concatenate(keys), return_inverse=True)
            counts[:] = [np.bincount(where, np.concatenate(counts), len(key)).astype(np.int64)]
            met[:] = [np.bincount(where, np.concatenate(met), len(key)).astype(np.int64)]
            keys[:] = [key]

        def give() -> pa.RecordBatch:
            merge()
            out = pa.RecordBatch.from_arrays([pa.array(keys[0].astype(np.int64)), pa.array(counts[0]), pa.array(met[0])], ["code", "n", "met"])
            for one in (keys, counts, met):
                one.clear()
            return out

        for batch in batches:
            for rows, data, at in slices(batch):
                text, begin = padded(data, at)
                sizes = np.diff(at)
                key, where, n = np.unique(byte_codes(text)[_places(begin, sizes)], return_inverse=True, return_counts=True)
                learned = np.repeat(rows.column("learned").to_numpy(zero_copy_only=False), sizes + 1)
                keys.append(key)
                counts.append(n if learned.all() else np.bincount(where[learned], minlength=len(key)))
                met.append(n)
                if sum(map(len, keys)) > 2_000_000:
                    merge()
                    if len(keys[0]) > 1_000_000:
                        yield give()
        if keys:
            yield give()

    return docs.select("text", "learned").mapInArrow(count, "code long, n long, met long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("met").alias("met"))


def log_probabilities(counts: DataFrame) -> DataFrame:
    """(code, met, value): the log-probability (base 10) of the last byte of each code of ``byte_counts`` after the others."""
    levels = [counts.select(F.col("code").alias("key"), "n")]
    for k in range(ORDER, 0, -1):  # a byte counts once for each longer context
        levels.append(checkpoint(levels[-1].groupBy(F.expr(f"key & {256**k - 1}L").alias("key")).agg(F.count_if(F.col("n") > 0).alias("n"))))
    context = Window.partitionBy(F.shiftright("key", 8))
    seen = F.col("n") > 0
    known = None
    for k, level in enumerate(reversed(levels)):
        if known is None:
            rows = level.withColumn("shorter", F.lit(-float(np.log10(256))))
        else:
            rows = level.withColumn("suffix", F.expr(f"key & {256**k - 1}L")).join(known.select(F.col("key").alias("suffix"), F.col("value").alias("shorter")), "suffix").drop("suffix")
        rows = rows.withColumns({"total": F.sum("n").over(context), "kinds": F.count_if(seen).over(context), "used": F.coalesce(F.sum(F.when(seen, F.pow(F.lit(10.0), "shorter"))).over(context), F.lit(0.0))})
        escape = F.col("kinds") / (F.col("total") + F.col("kinds"))
        others = F.greatest(1 - F.col("used"), F.lit(1e-12))  # symbol exclusion
        value = F.when(seen, F.log10(F.col("n") / F.col("total") * (1 - escape))).when(F.col("kinds") > 0, F.log10(escape / others) + F.col("shorter")).otherwise(F.col("shorter"))
        known = rows.select("key", value.alias("value"))
    return counts.select("code", "met").join(known.select(F.col("key").alias("code"), F.col("value").cast("float").alias("value")), "code")


_NONE = np.uint64(2**64 - 1)


class Table:
    """Values by 64-bit keys, with open addressing; all keys of a query are looked up at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.shift = np.uint64(64 - max(4, (2 * len(keys)).bit_length()))
        slots = 1 << (64 - int(self.shift))
        self.keys, self.values = np.full(slots, _NONE), np.zeros(slots, np.float32)
        at = self._home(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == _NONE]
            slot, first = np.unique(at[free], return_index=True)
            self.keys[slot], self.values[slot] = keys[free[first]], values[free[first]]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (slots - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each key (0 where there is none), and which have none."""
        at = self._home(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.float32(0))
        missing = there == _NONE
        left = np.flatnonzero((there != keys) & ~missing)
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            missing[left[there == _NONE]] = True
            left = left[~hit & (there != _NONE)]
        return out, np.flatnonzero(missing)


def _suffix(codes: np.ndarray, n: int) -> np.ndarray:
    return codes & np.uint64((1 << 8 * n) - 1)


def _sorted_get(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


class Trie:
    """The model of ``log_probabilities`` in one process, for small data: log-probabilities (base 10) of bytes after contexts of up to ``order`` bytes."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int = ORDER) -> None:
        """``codes``: order + 1 bytes as a number, the last byte (the lowest) predicted."""
        self.order = order
        keys, n = _merged([codes.astype(np.uint64)], [counts])
        entries = []
        for k in range(order, -1, -1):
            entries.append((keys, n.astype(np.float64)))
            if k:
                keys, n = np.unique(_suffix(keys, k), return_counts=True)  # once for each longer context
        self.bytes_of: list[tuple[np.ndarray, np.ndarray]] = []  # of each level: context and byte, its log-probability
        self.escapes: list[tuple[np.ndarray, np.ndarray]] = []  # of each level: context, what an escape from it costs
        for k, (keys, n) in enumerate(reversed(entries)):
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(of, n, len(contexts)), np.bincount(of, minlength=len(contexts))
            shorter = 10 ** self._descend(_suffix(keys, k), k - 1)
            others = np.maximum(1 - np.bincount(of, shorter, len(contexts)), 1e-12)  # symbol exclusion
            escape = kinds / np.maximum(total + kinds, 1)
            self.bytes_of.append((keys, np.log10(n / total[of] * (1 - escape[of]))))
            self.escapes.append((contexts, np.log10(escape / others)))
        self.top = Table(*self.bytes_of[-1])
        self.bytes_of[-1] = (np.zeros(0, np.uint64), np.zeros(0))

    def _descend(self, codes: np.ndarray, level: int, missing: bool = False) -> np.ndarray:
        """Log-probabilities by contexts of at most ``level`` bytes; ``missing``: none of ``codes`` is an entry of that level."""
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        for k in range(level, -1, -1):
            wanted = _suffix(codes[left], k + 1)
            if not (missing and k == level):
                at, hit = _sorted_get(self.bytes_of[k][0], wanted)
                out[left[hit]] += self.bytes_of[k][1][at[hit]]
                left, wanted = left[~hit], wanted[~hit]
            at, hit = _sorted_get(self.escapes[k][0], wanted >> np.uint64(8))
            out[left[hit]] += self.escapes[k][1][at[hit]]
        out[left] -= np.log10(256)
        return out

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 of the probability of each text and its end."""
        text, begin = padded(data, at)
        sizes = np.diff(at)
        code = _suffix(byte_codes(text), self.order + 1)[_places(begin, sizes)]
        got, missing = self.top.get(code)
        got = got.astype(np.float64)
        got[missing] = self._descend(code[missing], self.order, missing=True)
        return np.add.reduceat(got, np.cumsum(sizes + 1) - sizes - 1) if len(sizes) else np.zeros(0)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the words of (text) by their hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def give() -> pa.RecordBatch:
            key, n = _merged(keys, counts)
            keys.clear()
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["word", "n"])

        for batch in batches:
            for _, data, at in slices(batch):
                starts, ends, _ = word_bounds(data, at, FOLDED)
                key, n = np.unique(word_hashes(data, starts, ends, FOLDED), return_counts=True)
                keys.append(key)
                counts.append(n)
                if sum(map(len, keys)) > 2_000_000:
                    yield give()
        if keys:
            yield give()

    return docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _level(column: str) -> Column:
    return F.floor(F.log2(column) * 8).cast("int")


def _lowest_level(counts: DataFrame, column: str, room: int) -> int:
    """The level from which on the rows of the largest counts are at most ``room``."""
    lowest = 1 << 30
    for level, n in sorted(((r[0], r[1]) for r in counts.groupBy(_level(column).alias("level")).count().collect()), reverse=True):  # a few hundred
        room -= n
        if room < 0:
            break
        lowest = level
    return lowest


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_tokens, n_known, train_tokens, base_score and score; ``training`` marks the rows learned from."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("learned"))
    learned = marked.where("learned").select("text")
    values = checkpoint(log_probabilities(checkpoint(byte_counts(marked))))
    coldest = _lowest_level(values, "met", HOT)
    often = values.where(_level("met") >= coldest).select("code", "value").toArrow()  # at most HOT rows
    hot = spark.sparkContext.broadcast(Table(often.column("code").to_numpy().astype(np.uint64), often.column("value").to_numpy()))
    counts = checkpoint(word_counts(learned))
    ends = learned.count()
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, kinds = tokens + ends, distinct + (ends > 0)
    lowest = _lowest_level(counts, "n", FREQUENT)
    often = counts.where(_level("n") >= lowest).toArrow()  # at most FREQUENT rows
    words, n = often.column("word").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(words)
    below = np.log10(total + 0.1 * (kinds + 1))
    frequent = spark.sparkContext.broadcast((np.append(words[order], np.uint64(2**64 - 1)), np.append(np.log10(n[order] + 0.1), 0.0), len(words)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs, n_known = frequent.value
        for batch in batches:
            for rows, data, at in slices(batch):
                starts, stops, first = word_bounds(data, at, FOLDED)
                words = word_hashes(data, starts, stops, FOLDED)
                where = np.searchsorted(known, words)
                hit = (known[where] == words) & (where < n_known)
                doc = np.repeat(np.arange(rows.num_rows), np.diff(first))
                n_words = np.diff(first)
                sums = np.bincount(doc, np.where(hit, logs[where], 0.0), rows.num_rows)
                hits = np.bincount(doc, hit, rows.num_rows).astype(np.int64)
                rare = packed(words[~hit].view(np.int64), n_words - hits, pa.int64())
                text, begin = padded(data, at)
                sizes = np.diff(at)
                codes = byte_codes(text)[_places(begin, sizes)]
                got, missing = hot.value.get(codes)
                scores = np.add.reduceat(got.astype(np.float64), np.cumsum(sizes + 1) - sizes - 1)
                cold = packed(codes[missing].astype(np.int64), np.bincount(np.repeat(np.arange(rows.num_rows), sizes + 1)[missing], minlength=rows.num_rows), pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n_words.astype(np.int64)), pa.array(hits), pa.array(sums), pa.array(scores), rare, cold], ["id", "n_words", "hits", "sums", "score", "rare", "cold"])

    scanned = own.mapInArrow(scan, f"id {kind}, n_words long, hits long, sums double, score double, rare array<long>, cold array<long>")
    scanned = checkpoint(scanned.withColumn("row", F.monotonically_increasing_id()))
    rare = scanned.select("row", F.explode("rare").alias("word")).join(counts.where(_level("n") < lowest), "word", "left")
    found = rare.groupBy("row").agg(F.count("n").alias("more"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("logs"))
    cold = scanned.select("row", F.explode("cold").alias("code")).join(values.where(_level("met") < coldest).select("code", "value"), "code")
    rows = scanned.drop("rare", "cold").join(found, "row", "left").join(cold.groupBy("row").agg(F.sum("value").alias("others")), "row", "left")
    return rows.select(
        F.col("id").alias(id_col),
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("hits") + F.coalesce("more", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("sums") + F.coalesce("logs", F.lit(0.0)) + F.lit(float(np.log10(ends + 0.1))) - (F.col("n_words") + 1) * F.lit(float(below))).alias("base_score"),
        (F.col("score") + F.coalesce("others", F.lit(0.0))).alias("score"),
    )
