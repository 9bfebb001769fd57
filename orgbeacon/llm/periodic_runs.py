"""Periodic runs of words, by online dyadic square catching.

The documents of a slice are one stream of words, each followed by a word of its own that equals no other, so nothing repeats
across documents. Words are appended piece by piece:

* A catcher stands on each completed block of ``s`` words, a power of two, that begins at a multiple of ``s``. It waits for
  its words to come again at a distance ``q`` of ``2 s`` up to ``4 s`` (and, for blocks of one word, also of 1). A square of
  period ``q`` holds such a block in its first half, so no square is missed.
* An appended word completes one suffix of each size; that is compared with the two catchers (three of size one) that wait
  for it just then. All appended words of a piece advance together, as one vector operation a size.
* Where runs of four periods are wanted, a match counts with two neighbouring blocks that match at the same distance, as such a
  run holds three at least.
* A match is extended to the left and to the right, by comparing ever shorter sequences; if the words equal those ``q`` further on over
  at least ``q`` words it is a square, and squares of one start and period are one run. Matches and runs that reach the end of
  the stream are open: the next piece advances them.

Of runs with the same bounds the least period stays: the others are its multiples. Sequences are compared by sums of 64-bit
word hashes; a found run is compared word by word and, should a sum have matched by chance, cut where its words differ.

Memory is a few numbers for each word of a slice (or of its longest text). Null and empty texts have no runs; rows that repeat
are judged each for itself; columns of the results' names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from orgbeacon.llm.shared import PLAIN, mixed, slices, word_bounds, word_hashes

PIECE_WORDS = 1 << 18
_BASE = 0xD1342543DE82EF95
RUNS = ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))
_ADDED = (StructField("n_words", LongType()), StructField("runs", RUNS), StructField("collapsed_text", StringType()))


class Catchers:
    """A stream of words, given as 64-bit hashes, with the squares seen so far as runs (start, end, period).

    With an ``exponent`` over 2 only runs of so many periods are wanted; these hold ``exponent - 1`` neighbouring blocks that all match.
    """

    def __init__(self, exponent: int = 2) -> None:
        self.matches = max(1, exponent - 1)
        self.words = np.zeros(0, np.uint64)
        self.sums = np.zeros(1, np.uint64)
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)
        self.longest = 0
        self.runs = np.zeros((0, 3), np.int64)

    def append(self, words: np.ndarray, at: np.ndarray) -> None:
        """More words, with their places in their documents."""
        old, n = len(self.words), len(self.words) + len(words)
        while len(self.powers) < n + 1:
            self.powers = np.concatenate([self.powers, self.powers * (self.powers[-1:] * np.uint64(_BASE))])
            self.inverse = np.concatenate([self.inverse, self.inverse * (self.inverse[-1:] * np.uint64(pow(_BASE, -1, 1 << 64)))])
        self.words = np.concatenate([self.words, words])
        self.sums = np.concatenate([self.sums, self.sums[-1] + np.cumsum(words * self.powers[old:n])])
        self.longest = max(self.longest, int(at.max(initial=-1)) + 1)
        found = [self.runs]
        is_open = self.runs[:, 1] == old
        if is_open.any():
            grown = self.runs[is_open]
            grown[:, 1] += self._forward(grown[:, 1] - grown[:, 2], grown[:, 1])
            square = grown[:, 1] - grown[:, 0] >= 2 * grown[:, 2]
            found = [self.runs[~is_open], grown[square | (grown[:, 1] == n)]]
        size = 1
        while 2 * size <= max(2, self.longest):
            found += self._caught(size, old)
            size *= 2
        self.runs = np.unique(np.concatenate(found), axis=0)

    def _caught(self, size: int, old: int) -> Iterator[np.ndarray]:
        """New squares of the catchers on blocks of ``size`` words."""
        n, m = len(self.words), self.matches
        low = max(0, old // size - m - 1 - 3) * size  # a block's beginning, so that each row below is one block
        count = n - size + 1 - low
        if count <= 0:
            return
        suffixes = np.zeros((-(-count // size), size), np.uint64)
        suffixes.ravel()[:count] = (self.sums[low + size : n + 1] - self.sums[low : n + 1 - size]) * self.inverse[low : n + 1 - size]
        blocks = suffixes[:, :1]
        for back in (2, 3) if size > 1 else (1, 2, 3):
            same = np.zeros(suffixes.shape, bool)
            same[back:] = suffixes[back:] == blocks[:-back]
            same.ravel()[count:] = False
            enough = same.copy()  # the m-th of matching neighbours
            for i in range(1, m):
                enough[i:] &= same[:-i]
                enough[:i] = False
            enough[m:] &= ~same[:-m]
            row, place = np.nonzero(enough)
            two, one = low + row * size + place, low + (row - back) * size
            period = two - one
            left = self._backward(one, two)
            right = size + self._forward(one + size, two + size)
            keep = (left + right >= period) | (two + right == n)  # a match at the end may still become a square
            yield np.unique(np.stack([one - left, two + right, period], axis=1)[keep], axis=0)

    def _sum(self, begin: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[begin + size] - self.sums[begin]) * self.inverse[begin]

    def _forward(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """How many words from ``one`` on equal those from ``two`` on."""
        out, n = np.zeros(len(one), np.int64), len(self.words)
        for step in self._steps():
            todo = np.arange(len(one))
            while len(todo):
                a, b = one[todo] + out[todo], two[todo] + out[todo]
                fits = b + step <= n
                todo, a, b = todo[fits], a[fits], b[fits]
                todo = todo[self._sum(a, step) == self._sum(b, step)]
                out[todo] += step
        return out

    def _backward(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """How many words before ``one`` equal those before ``two``."""
        out = np.zeros(len(one), np.int64)
        for step in self._steps():
            todo = np.arange(len(one))
            while len(todo):
                a, b = one[todo] - out[todo] - step, two[todo] - out[todo] - step
                fits = a >= 0
                todo, a, b = todo[fits], a[fits], b[fits]
                todo = todo[self._sum(a, step) == self._sum(b, step)]
                out[todo] += step
        return out

    def _steps(self) -> list[int]:
        return [1 << i for i in range(max(1, self.longest).bit_length() - 1, -1, -1)]

    def _differ(self, runs: np.ndarray) -> Iterator[np.ndarray]:
        for start, end, period in runs.tolist():
            cuts = np.flatnonzero(self.words[start : end - period] != self.words[start + period : end]) + start
            edges = np.concatenate([[start - 1], cuts, [end - period]])
            parts = np.stack([edges[:-1] + 1, edges[1:] + period, np.full(len(edges) - 1, period)], axis=1)
            yield parts[parts[:, 1] - parts[:, 0] >= 2 * period]

    def finished(self, exponent: int, length: int) -> np.ndarray:
        """The runs of at least ``exponent`` periods and ``length`` words, by start and period."""
        for _ in range(2):  # the second time after runs that differ were cut
            runs = self.runs[np.lexsort((self.runs[:, 2], self.runs[:, 1], self.runs[:, 0]))]
            same = np.zeros(len(runs), bool)
            same[1:] = (runs[1:, :2] == runs[:-1, :2]).all(axis=1)
            runs = runs[~same]
            runs = runs[runs[:, 1] - runs[:, 0] >= np.maximum(length, max(2, exponent) * runs[:, 2])]
            self.runs = np.concatenate([np.zeros((0, 3), np.int64), *self._differ(runs)])
        return runs


def runs_of_texts(data: np.ndarray, at: np.ndarray, exponent: int, length: int, piece: int = PIECE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in one buffer: how many words each has, and of each run the text's number and (start, end, period) in words of the text."""
    starts, ends, first = word_bounds(data, at, PLAIN)
    n_words = np.diff(first)
    texts = np.arange(len(n_words))
    begin = first[:-1] + texts  # in the stream, where each text has one more word
    stream = np.empty(len(starts) + len(texts), np.uint64)
    ends_at = first[1:] + texts
    words = np.ones(len(stream), bool)
    words[ends_at] = False
    stream[words] = word_hashes(data, starts, ends, PLAIN) | np.uint64(1)
    stream[ends_at] = mixed(texts.astype(np.uint64) + np.uint64(1)) & ~np.uint64(1)  # even, so never a word
    place = np.arange(len(stream)) - np.repeat(begin, n_words + 1)
    caught = Catchers(exponent)
    for a in range(0, len(stream), piece):
        caught.append(stream[a : a + piece], place[a : a + piece])
    runs = caught.finished(exponent, length)
    text = np.searchsorted(begin, runs[:, 0], side="right") - 1
    return n_words, text, runs - np.where([True, True, False], begin[text][:, None], 0)


def periodic_runs(docs: DataFrame, text_col: str = "text", exponent: int = 4, length: int = 6, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all by default) with n_words, runs (start, length, period; by start and period) and collapsed_text.

    A run is a stretch of words of smallest period ``period``, with at least ``exponent`` periods (2 at least) and ``length`` words,
    that no neighbouring word extends. collapsed_text are the words, joined by one space, without those of each run after its first period.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in {f.name for f in _ADDED}]
    schema = StructType([*(docs.schema[c] for c in kept), *_ADDED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in slices(batch):
                n_words, text, runs = runs_of_texts(data, at, exponent, length)
                bounds = np.searchsorted(text, np.arange(len(n_words) + 1))
                texts = []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    words = data[at[i] : at[i + 1]].tobytes().split()
                    if b > a:
                        stay = np.ones(len(words), bool)
                        for start, end, period in runs[a:b].tolist():
                            stay[start + period : end] = False
                        words = [words[j] for j in np.flatnonzero(stay)]
                    texts.append(b" ".join(words).decode())
                items = pa.StructArray.from_arrays([pa.array(runs[:, 0]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), items)
                yield pa.RecordBatch.from_arrays([*rows.column(1).flatten(), pa.array(n_words, pa.int64()), lists, pa.array(texts, pa.string())], names=schema.names)

    return docs.select(F.col(text_col).cast("string").alias("text"), F.struct(*kept).alias("kept")).mapInArrow(run, schema)
