"""Best-fit packing of tokenized documents into sequences, with exact complements first.

1. Each document is tokenized on the executors and cut into pieces of at most ``capacity`` ids; only longer ones are cut.
2. The counts of the lengths (at most ``capacity`` rows, whatever the size of the data) go to the driver, where the plan is
   made: for every length from the largest on, combinations of one, two or three lengths that fill its gap exactly are found
   by an index of the sums of single lengths, pairs and triples and used as often as the counts allow; what is left over is
   placed best-fit decreasing. The plan is a list of patterns with how often each is used; its size follows the number of
   lengths.
3. Every piece gets its rank among those of its length - a count over (length, salt) cells of bounded size, so a frequent
   length is no hot key - and the plan says which sequence and offset a rank has.

A null or empty text is a document of the end id alone; rows that repeat a document are packed each. Ties of rank between
pieces of one length go by a hash of the id. Output: the id column, piece, start, length, ids_crc32, sequence_id, offset.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orgbeacon.llm.shared import checkpoint, prefix_sums

CAPACITY = 4096
END_ID = 1
CELL = 128
#: Words, and pieces of words, of which a Python worker keeps the ids; some 150 MB.
CACHE_WORDS, CACHE_PIECES = 300_000, 700_000
_CONTROL = {chr(c) for c in range(0x1C, 0x20)}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """The ids of words as little-endian 32-bit integers, and of whole texts.

    The vocabulary never joins what white space parts, so texts are looked up word by word. Words of common Latin letters,
    ASCII digits and marks are cut as the vocabulary's pattern cuts them and go to its merges directly; any other word goes
    through the whole tokenizer.
    """

    plain = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
    parts = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.merges = self.whole.model
        self.letters = _byte_letters()
        self.special = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.pieces: dict[str, bytes] = {}

    def _slow(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = np.array([t.id for t in self.merges.tokenize(piece.encode().decode("latin-1").translate(self.letters))], "<u4").tobytes()
        if len(self.pieces) < CACHE_PIECES:
            self.pieces[piece] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        if self.plain.fullmatch(word) and not any(s in word for s in self.special):
            known = self.pieces
            ids = b"".join([known.get(p) or self._piece(p) for p in self.parts.findall(word.lower())])
        else:
            ids = self._slow(word)
        if len(self) < CACHE_WORDS:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not _CONTROL.isdisjoint(text):  # white space for str.split but not for the vocabulary
            return self._slow(text)
        return b"".join(map(self.__getitem__, text.split()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker and vocabulary."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """From (id, text): (id, piece, start, length, ids_crc32)."""
    kind = docs.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(vocabulary)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                row, piece, start, length, crc = [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = model.encode(text or "") + end
                    for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                        one = ids[at : at + 4 * capacity]
                        row.append(i)
                        piece.append(p)
                        start.append(at // 4)
                        length.append(len(one) // 4)
                        crc.append(zlib.crc32(one))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[tuple[tuple[int, int], ...], int]


def _complements(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Combinations that fill a sequence exactly; takes their lengths from ``left``, the count of each length."""
    out: list[Pattern] = []

    def take(*lengths: int) -> bool:
        need = {x: lengths.count(x) for x in lengths}
        times = min(int(left[x]) // n for x, n in need.items())
        if times:
            for x, n in need.items():
                left[x] -= n * times
            out.append((tuple(sorted(need.items(), reverse=True)), times))
        return times > 0

    def pair_sums() -> np.ndarray:
        there = (left > 0).astype(np.float64)
        size = 2 * len(there)
        spectrum = np.fft.rfft(there, size)
        return np.fft.irfft(spectrum * spectrum, size)[: capacity + 1] > 0.5

    pairs, since = pair_sums(), 0
    for large in range(capacity, 0, -1):
        while left[large] > 0:
            gap = capacity - large
            if gap == 0:
                take(large)
                continue
            if left[gap] > 0 and gap != large and take(large, gap) or gap == large and take(large, large):
                continue
            a = np.arange(min(gap - 1, large), (gap + 1) // 2 - 1, -1) if gap > 1 else np.zeros(0, int)
            a = a[(left[a] > 0) & (left[gap - a] > 0)] if len(a) else a
            if any(take(large, int(x), gap - int(x)) for x in a):
                continue
            found = False
            first = np.arange(min(gap - 2, large), 0, -1) if gap > 2 else np.zeros(0, int)
            for x in first[(left[first] > 0) & pairs[gap - first]] if len(first) else ():
                rest = gap - int(x)
                b = np.arange(rest - 1, (rest + 1) // 2 - 1, -1)
                b = b[(left[b] > 0) & (left[rest - b] > 0)]
                found = any(take(large, int(x), int(y), rest - int(y)) for y in b)
                if found:
                    break
            since += 1
            if since % 64 == 0:
                pairs = pair_sums()
            if not found:
                break
    return out


def _best_fit(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit, longest first, many equal pieces at a time."""
    bins: dict[int, list[Pattern]] = {}
    open_gaps = np.zeros(capacity + 1, np.int64)

    def put(pattern: tuple[tuple[int, int], ...], times: int, gap: int) -> None:
        if times:
            bins.setdefault(gap, []).append((pattern, times))
            open_gaps[gap] += times

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            fit = np.flatnonzero(open_gaps[length:])
            if len(fit):
                gap = length + int(fit[0])
                pattern, times = bins[gap].pop()
                each = min(gap // length, n)  # the same sequence stays the best fit while it has room
                used = min(times, n // each)
                open_gaps[gap] -= times
                put(pattern, times - used, gap)
                put((*pattern, (length, each)), used, gap - each * length)
                n -= used * each
            else:
                each = min(capacity // length, n)
                put(((length, each),), n // each, capacity - each * length)
                n -= n // each * each
    return [p for gap in sorted(bins) for p in bins[gap]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns ((length, how many), ..) and how often each is used; together they use every length ``counts`` times."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    return _complements(left, capacity) + _best_fit(left, capacity)


def _places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Of each length the runs of ranks, sorted: length, rank, sequence, how many of it in one sequence, offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length, each in pattern:
            rank = used.get(length, 0)
            rows.append((length, rank, sequence, each, offset))
            used[length] = rank + each * times
            offset += length * each
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "offset"), table.T, strict=True))


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The pieces of ``docs`` and their places in sequences of at most ``capacity`` ids."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    pieces = checkpoint(token_pieces(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), vocabulary, capacity))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    places = spark.sparkContext.broadcast(_places(plan(counts, capacity)))  # a few rows for each length
    salts = pieces.groupBy("length").agg(F.ceil(F.count("*") / CELL).alias("salts"))
    dealt = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), "salts")).drop("salts")
    cells = dealt.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = prefix_sums(cells, "length", [], "salt", "n", "before").drop("n")
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")) - 1).join(before, ["length", "salt"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        keys = p["length"] << 48 | p["rank"]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            number, within = np.divmod(rank - p["rank"][at], p["each"][at]) if len(at) else (rank, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(p["sequence"][at] + number), pa.array(p["offset"][at] + within * length)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)
