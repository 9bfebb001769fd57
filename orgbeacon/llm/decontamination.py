"""Benchmark decontamination as a prefix-filtered set join.

* An item is cut into windows of ``window`` words (a shorter item is one window); windows of the same words are one.
* The shingles of a window (``shingle`` words, fewer in a shorter window) are ordered by rarity: how often all documents hold
  them, counted in a first scan. A window that occurs whole must hold each of its shingles, so the necessary prefix of that
  order is its rarest shingle alone.
* A second scan finds the prefixes' shingles in the documents, and a join on the shingle gives the candidate windows. A hit
  fixes where the window would begin and end (positional bound); one that would leave the document is out (length bound).
  What remains is compared with the window's words, which is the exact verification.

Shingles are 64-bit hashes. Up to ``INDEX_SHINGLES`` of them are sent to the scans as a sorted array, so that other shingles
are dropped where they are made; of a larger benchmark all shingles of the documents go to a join by a shuffle, with the same rows.

Words are lower-cased in A-Z and are runs of ASCII letters, digits and non-ASCII characters. Null and empty texts have none;
items without words have no window. Items that repeat are counted each by their ids; rows that repeat a document are judged
each; null items' ids are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgbeacon.llm.shared import byte_table, checkpoint, mixed, sequence_hashes, slices, word_bounds, word_hashes

WINDOW, SHINGLE = 10, 3
#: 32 MB of hashes.
INDEX_SHINGLES = 4_000_000
#: Prefixes of at most so many windows are broadcast to the join.
BROADCAST_ROWS = 500_000
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_TABLE = byte_table(bytes(c for c in range(128) if not chr(c).isalnum()), fold=True)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """From (item_id, text): (item_id, words), a row for each distinct window of an item, its words joined by spaces."""
    kind = items.schema["item_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in slices(batch):
                row, found = [], []
                for i in range(rows.num_rows):
                    words = words_of(data[at[i] : at[i + 1]].tobytes())
                    own = {b" ".join(words[p : p + window]) for p in range(max(1, len(words) - window + 1))} if words else ()
                    row += [i] * len(own)
                    found += own
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row, pa.int64())), pa.array([w.decode() for w in found], pa.string())], ["item_id", "words"])

    return items.mapInArrow(cut, f"item_id {kind}, words string")


class Scan:
    """The words of a slice of texts, and the hashed shingles of some lengths with their places (in the slice) and texts."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lengths: list[int]) -> None:
        self.data = data
        self.starts, self.ends, self.first = word_bounds(data, at, _TABLE)
        words = word_hashes(data, self.starts, self.ends, _TABLE)
        codes, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in lengths:
            grams = mixed(sequence_hashes(words, k) + np.uint64(k)).view(np.int64)
            last = np.repeat(self.first[1:], np.diff(self.first))[: len(grams)]
            where = np.flatnonzero(np.arange(len(grams)) + k <= last)  # in one text
            codes.append(grams[where])
            places.append(where)
        self.codes, self.places = np.concatenate(codes), np.concatenate(places)

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, side="right") - 1

    def around(self, place: int, text: int, window: int) -> tuple[int, str]:
        """The words that a window over ``place`` can have, and which word of the text is the first of them."""
        begin, end = max(self.first[text], place - window + 1), min(self.first[text + 1], place + window)
        words = words_of(self.data[self.starts[begin] : self.ends[end - 1]].tobytes())
        return int(begin - self.first[text]), b" ".join(words).decode()


def _found(sorted_codes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which of ``codes`` are known."""
    if not len(sorted_codes):
        return np.zeros(0, np.int64)
    return np.flatnonzero(sorted_codes[np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)] == codes)


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """From (words): (words, length, code, offset) for each shingle of each window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in slices(batch, "words"):
                for k in range(1, shingle + 1):
                    scan = Scan(data, at, [k])
                    sizes = np.diff(scan.first)
                    text = scan.text_of(scan.places)
                    own = np.flatnonzero(np.minimum(sizes, shingle)[text] == k) if len(text) else text
                    text, place = text[own], scan.places[own]
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(text)), pa.array(sizes[text].astype(np.int32)), pa.array(scan.codes[own]), pa.array((place - scan.first[text]).astype(np.int32))], ["words", "length", "code", "offset"])

    return windows.select("words").mapInArrow(cut, "words string, length int, code long, offset int")


def _index(codes: DataFrame, most: int):
    """The distinct codes as a sorted array on all executors, or None if there are more than ``most``."""
    codes = checkpoint(codes.distinct())
    if codes.count() > most:
        return None
    return codes.sparkSession.sparkContext.broadcast(np.sort(codes.toArrow().column("code").to_numpy()))


def _rarity(docs: DataFrame, index, lengths: list[int]) -> DataFrame:
    """(code, n): how often all documents hold each shingle (of the index, if there is one)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value if index is not None else None
        totals = np.zeros(len(known) if known is not None else 0, np.int64)
        for batch in batches:
            for _, data, at in slices(batch):
                codes = Scan(data, at, lengths).codes
                if known is None:
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in np.unique(codes, return_counts=True)], ["code", "n"])
                else:
                    totals += np.bincount(np.searchsorted(known, codes[_found(known, codes)]), minlength=len(known))
        if known is not None:
            there = np.flatnonzero(totals)
            yield pa.RecordBatch.from_arrays([pa.array(known[there]), pa.array(totals[there])], ["code", "n"])

    return docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


_HITS = "array<struct<code: bigint, pos: int, begin: int, around: string>>"


def _hits(docs: DataFrame, index, lengths: list[int], window: int) -> DataFrame:
    """Per row of (id, text, text_key, at): n_words and the hits with the words around them. Hits are those of the index, or, without one, those
    of the column ``at`` (code, pos)."""
    kind = docs.schema["id"].dataType.simpleString()
    kind_of = pa.list_(pa.struct([("code", pa.int64()), ("pos", pa.int32()), ("begin", pa.int32()), ("around", pa.string())]))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in slices(batch):
                scan = Scan(data, at, lengths if index is not None else [])
                found: list[list[dict]] = [[] for _ in range(rows.num_rows)]
                if index is not None:
                    own = _found(index.value, scan.codes)
                    places, codes = scan.places[own], scan.codes[own]
                    hits = zip(codes.tolist(), places.tolist(), scan.text_of(places).tolist(), strict=True)
                else:
                    given = rows.column(3).to_pylist()
                    hits = ((h["code"], int(scan.first[i]) + h["pos"], i) for i, one in enumerate(given) for h in one or ())
                for code, place, text in hits:
                    begin, around = scan.around(place, text, window)
                    found[text].append({"code": code, "pos": place - int(scan.first[text]), "begin": begin, "around": around})
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(np.diff(scan.first), pa.int64()), pa.array(found, kind_of)], ["id", "text_key", "n_words", "hits"])

    return docs.select("id", "text", "text_key", *(["at"] if index is None else [])).mapInArrow(probe, f"id {kind}, text_key long, n_words long, hits {_HITS}")


def _places(docs: DataFrame, prefixes: DataFrame, lengths: list[int]) -> DataFrame:
    """``docs`` with ``at``, where they hold a shingle of the prefixes, by a join of all their shingles."""
    kind = docs.schema["id"].dataType.simpleString()

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in slices(batch):
                scan = Scan(data, at, lengths)
                text = scan.text_of(scan.places)
                by = pa.array(text)
                yield pa.RecordBatch.from_arrays([rows.column(0).take(by), rows.column(2).take(by), pa.array(scan.codes), pa.array((scan.places - scan.first[text]).astype(np.int32))], ["id", "text_key", "code", "pos"])

    every = docs.mapInArrow(give, f"id {kind}, text_key long, code long, pos int").join(prefixes.select("code").distinct(), "code", "left_semi")
    return _left(docs, every.groupBy("id", "text_key").agg(F.collect_set(F.struct("code", "pos")).alias("at")))


def _left(rows: DataFrame, more: DataFrame) -> DataFrame:
    """Left join by the id, null or not, and the text."""
    more = more.withColumnsRenamed({"id": "m_id", "text_key": "m_text_key"})
    return rows.join(more, F.expr("text_key = m_text_key AND id <=> m_id"), "left").drop("m_id", "m_text_key")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, index_shingles: int = INDEX_SHINGLES) -> DataFrame:
    """Per row of ``docs``: the id, n_words, n_hit, item_ids (sorted as strings), hit_spans and text_key (xxhash64 of the text).

    hit_spans are the words [s0, e0, s1, e1, ..) that an occurrence of a window covers.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("text_key"))
    windows = checkpoint(item_windows(items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")), window))
    shingles = checkpoint(window_shingles(windows.select("words").distinct(), shingle))
    lengths = sorted(r[0] for r in shingles.select(F.least("length", F.lit(shingle))).distinct().collect())  # ``shingle`` at most
    rarity = _rarity(own, _index(shingles.select("code"), index_shingles), lengths)
    order = F.struct(F.coalesce("n", F.lit(0)), "code", "offset")
    prefixes = checkpoint(shingles.join(rarity, "code", "left").groupBy("words").agg(F.min_by(F.struct("code", "offset", "length"), order).alias("p")).select("words", "p.*"))
    index = _index(prefixes.select("code"), index_shingles)
    scanned = checkpoint(_hits(own if index is not None else _places(own, prefixes, lengths), index, lengths, window))

    hits = scanned.where(F.size("hits") > 0).select("id", "text_key", "n_words", F.explode("hits").alias("h")).select("id", "text_key", "n_words", "h.*")
    candidates = hits.join(F.broadcast(prefixes) if prefixes.count() <= BROADCAST_ROWS else prefixes, "code").withColumn("start", F.col("pos") - F.col("offset"))
    inside = candidates.where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words")))
    same = F.array_join(F.slice(F.split("around", " "), F.col("start") - F.col("begin") + 1, F.col("length")), " ") == F.col("words")
    verified = checkpoint(inside.where(same).select("id", "text_key", "n_words", "words", "start", "length").distinct())
    item_of = windows.select("words", F.col("item_id").cast("string").alias("item_id"))
    named = verified.select("id", "text_key", "words").distinct().join(item_of, "words").groupBy("id", "text_key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    whole = verified.groupBy("id", "text_key", "n_words").agg(F.collect_set(F.struct("start", "length")).alias("hits"))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, spans = [], []
            for n, hits in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                start, length = (f.to_numpy().astype(np.int64) for f in hits.values.flatten())
                edges = np.zeros(n + 2, np.int64)
                np.add.at(edges, start + 1, 1)
                np.add.at(edges, start + length + 1, -1)
                inside = np.cumsum(edges) > 0
                n_hit.append(int(inside.sum()))
                spans.append(np.flatnonzero(np.diff(inside.astype(np.int8))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n_hit, pa.int64()), pa.array(spans, pa.list_(pa.int32()))], ["id", "text_key", "n_hit", "hit_spans"])

    covered = whole.mapInArrow(cover, f"id {kind}, text_key long, n_hit long, hit_spans array<int>")
    joined = _left(_left(scanned.select("id", "text_key", "n_words"), covered), named)
    empty = F.array().cast("array<string>")
    return joined.select(F.col("id").alias(id_col), "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", empty).alias("item_ids"), F.coalesce("hit_spans", empty.cast("array<int>")).alias("hit_spans"))
