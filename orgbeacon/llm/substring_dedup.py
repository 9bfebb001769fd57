"""Substring dedup: seed and extend, and keep the maximal repeats of at least ``window`` words.

1. Seeds: winnowed anchors, the least hash of ``seed`` words among ``window - seed + 1`` neighbours. Two documents that share
   ``window`` words share an anchor in them, at the same place in these words. Occurrences of anchors are joined, by a shuffle, with
   the anchors that more than one document has.
2. Extend: an occurrence is extended to both sides as far as a window that holds its anchor can reach (``window - seed`` words
   each way, or to the end of the text), and compared there by hash with all occurrences of the anchor at once: those alike are a class, with
   the smallest id in it. A later member of a class repeats its whole extent. A class's first document can share
   a part of its extent only, with the first of another class; there windows decide, by the smallest id in which each starts.
   So a passage of a million documents costs a million rows, not pairs, and windows are worked out at the edges of repeats only.
3. Extents and windows of a document are merged to maximal spans and its words outside them are kept.

Extents are told apart by 128 bits of hash, windows by 96.

Null and empty texts have no words. A row's windows are compared with rows of smaller ids only, so exact copies lose their
words where a smaller id has them (if they are long enough) and rows that repeat an id don't affect each other. A row with a
null id neither loses words nor takes them from others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from orgbeacon.llm.shared import PLAIN, checkpoint, mixed, range_hashes, sequence_hashes, slices, word_bounds, word_hashes

#: Spans, or the places of occurrences, of at most so many rows and numbers are broadcast; more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_NUMBERS = 200_000, 2_000_000


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (or largest) of each ``width`` neighbours."""
    out, done, take = values, 1, np.minimum if least else np.maximum
    while done < width:
        step = min(done, width - done)
        out = take(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(grams: np.ndarray, gram_first: np.ndarray, gram_last: np.ndarray, width: int) -> np.ndarray:
    """Positions of the grams that are the least of some ``width`` neighbours of one document."""
    if len(grams) < width:
        return np.zeros(0, np.int64)
    low = _sliding(grams, width, least=True)
    inside = np.zeros(len(low) + 1, np.int32)
    begin, end = gram_first, np.maximum(gram_first, gram_last - width + 1)  # windows of one document
    np.add.at(inside, np.minimum(begin, len(low)), 1)
    np.add.at(inside, np.minimum(end, len(low)), -1)
    low[np.cumsum(inside[:-1]) == 0] = 0
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    return np.flatnonzero(_sliding(padded, width, least=False) == grams)


class Scan:
    """What the scans see of a slice: word hashes, where documents begin, and anchors with their extents."""

    def __init__(self, data: np.ndarray, at: np.ndarray, window: int, seed: int) -> None:
        starts, ends, self.first = word_bounds(data, at, PLAIN)
        self.words = word_hashes(data, starts, ends, PLAIN)
        grams = sequence_hashes(self.words, seed)
        grams |= np.uint64(1)  # never 0
        self.at = anchors(grams, self.first[:-1], np.maximum(self.first[:-1], self.first[1:] - seed + 1), window - seed + 1)
        self.anchors = grams[self.at]
        self.doc = np.searchsorted(self.first, self.at, side="right") - 1
        reach = window - seed
        self.begin = np.maximum(self.first[self.doc], self.at - reach)
        self.end = np.minimum(self.first[self.doc + 1], self.at + seed + reach)

    def extents(self) -> np.ndarray:
        """A hash of the words of each anchor's extent and of the anchor's place in it."""
        return mixed(range_hashes(self.words, self.begin, self.end) + (self.at - self.begin).astype(np.uint64))


def _ids(rows: pa.RecordBatch, doc: np.ndarray) -> pa.Array:
    return rows.column(0).take(pa.array(doc))


def _few(df: DataFrame, numbers: str) -> DataFrame:
    """``df``, as a broadcast if its rows, and the numbers in its lists, are few enough."""
    rows, n = df.agg(F.count("*"), F.coalesce(F.sum(F.size(numbers)), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and n <= BROADCAST_NUMBERS else df


def repeated_spans(docs: DataFrame, window: int = 50, seed: int = 25) -> DataFrame:
    """From (id, text): (id, text_key, spans), the words [s0, e0, s1, e1, ..) of each text that repeat a smaller id's."""
    kind = docs.schema["id"].dataType.simpleString()
    docs = docs.where(F.col("id").isNotNull()).select("id", "text", F.xxhash64("text").alias("text_key"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in slices(batch):
                s = Scan(data, at, window, seed)
                place = (s.begin - s.first[s.doc]) << 8 | (s.end - s.begin)  # an extent has 75 words at most
                yield pa.RecordBatch.from_arrays([pa.array(s.anchors.view(np.int64)), pa.array(s.extents().view(np.int64)), _ids(rows, s.doc), rows.column(2).take(pa.array(s.doc)), pa.array(place)], ["anchor", "extent", "id", "text_key", "place"])

    found = docs.mapInArrow(seeds, f"anchor long, extent long, id {kind}, text_key long, place long")
    anchors_of = found.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("extent").alias("e_low"), F.max("extent").alias("e_high"))
    shared = checkpoint(anchors_of.where("low < high").select("anchor", F.when(F.col("e_low") == F.col("e_high"), F.col("low")).alias("low"), (F.col("e_low") != F.col("e_high")).alias("several")))
    met = checkpoint(found.join(shared, "anchor").where("several OR id > low"))  # of an anchor with one class its first document repeats nothing
    # written, as lows below, so that the joins read both sides from a shuffle and a very common extent or window can be split over tasks
    classes = checkpoint(met.where("several").groupBy("anchor", "extent").agg(F.min("id").alias("first")))
    of_several = checkpoint(met.where("several").join(classes, ["anchor", "extent"]).select("id", "text_key", "place", (F.col("id") > F.col("first")).alias("later")))
    extents = met.where("NOT several").select("id", "text_key", "place").union(of_several.where("later").select("id", "text_key", "place"))
    edges = checkpoint(of_several.where("NOT later").select("id", "text_key", "place").distinct().groupBy("id", "text_key").agg(F.collect_list("place").alias("places")))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in slices(batch):
                starts, ends, first = word_bounds(data, at, PLAIN)
                words = word_hashes(data, starts, ends, PLAIN)
                lists = rows.column(3)
                places = lists.flatten().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(rows.num_rows), np.diff(lists.offsets.to_numpy()))
                begin = first[doc] + (places >> 8)
                end = begin + (places & 255) - window + 1
                marks = np.zeros(len(words) + 1, np.int32)
                good = begin < end
                np.add.at(marks, begin[good], 1)
                np.add.at(marks, end[good], -1)
                chosen = np.flatnonzero(np.cumsum(marks))
                if not len(chosen):
                    continue
                first_hash = sequence_hashes(words, window)[chosen]
                second = sequence_hashes(words ^ np.uint64(0xA5A5A5A55A5A5A5A), window)[chosen]
                doc = np.searchsorted(first, chosen, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(first_hash.view(np.int64)), pa.array((second >> np.uint64(32)).astype(np.uint32).view(np.int32)), _ids(rows, doc), rows.column(2).take(pa.array(doc)), pa.array((chosen - first[doc]).astype(np.int32))], ["h", "c", "id", "text_key", "start"])

    at_edges = docs.join(_few(edges, "places"), ["id", "text_key"]).select("id", "text", "text_key", "places")
    rows = at_edges.mapInArrow(windows, f"h long, c int, id {kind}, text_key long, start int")
    lows = checkpoint(rows.groupBy("h", "c").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").drop("high"))
    again = rows.join(lows, ["h", "c"]).where("id > low").select("id", "text_key", F.col("start").cast("long").alias("begin"), (F.col("start") + window).cast("long").alias("end"))
    begin = F.shiftright("place", 8)
    repeated = again.union(extents.select("id", "text_key", begin.alias("begin"), (begin + F.col("place").bitwiseAND(255)).alias("end")).where(F.col("end") - F.col("begin") >= window))
    by_text = repeated.distinct().groupBy("id", "text_key").agg(F.collect_list(F.shiftleft("begin", 32) + F.col("end")).alias("ranges"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for one in batch.column(2):
                both = np.sort(one.values.to_numpy())
                begin, end = both >> 32, np.maximum.accumulate(both & 0xFFFFFFFF)
                new = np.flatnonzero(begin[1:] > end[:-1]) + 1
                spans.append(np.stack([begin[np.append(0, new)], end[np.append(new - 1, len(end) - 1)]], axis=1).ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int32()))], ["id", "text_key", "spans"])

    return by_text.mapInArrow(merge, f"id {kind}, text_key long, spans array<int>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, seed: int = 25, keep: list[str] | None = None, unchanged_as_is: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with n_words, n_removed, spans and kept_text, the words left joined by one space
    (with ``unchanged_as_is`` a text that keeps all its words is left as it is).

    Columns of docs that have these names are replaced.
    """
    added = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("spans", ArrayType(IntegerType())), StructField("kept_text", StringType())]
    names = [c for c in (docs.columns if keep is None else keep) if c not in {f.name for f in added}]
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    spans = _few(checkpoint(repeated_spans(own, window, seed)), "spans")
    whole = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_key"), F.col(text_col).cast("string").alias("text"), F.struct(*names).alias("kept"))
    joined = whole.join(spans, ["id", "text_key"], "left").select("text", "spans", "kept")
    schema = StructType([*(docs.schema[c] for c in names), *added])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in slices(batch):
                spans = rows.column(1).to_pylist()
                texts, n_words, n_removed = [], [], []
                for i, own in enumerate(spans):
                    words = data[at[i] : at[i + 1]].tobytes().split()
                    n_words.append(len(words))
                    if own:
                        bounds = [0, *own, len(words)]
                        words = [w for a, b in zip(bounds[::2], bounds[1::2], strict=True) for w in words[a:b]]
                    n_removed.append(n_words[-1] - len(words))
                    whole = unchanged_as_is and not n_removed[-1]
                    texts.append((data[at[i] : at[i + 1]].tobytes() if whole else b" ".join(words)).decode())
                yield pa.RecordBatch.from_arrays([*rows.column(2).flatten(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), rows.column(1), pa.array(texts, pa.string())], names=schema.names)

    return joined.mapInArrow(cut, schema)
