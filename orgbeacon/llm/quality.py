"""A quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector for all grades and ordered thresholds, so a text has an
expected grade and a tail probability P(grade >= g) to select by. x marks the hashed words that a text holds (whole text,
A-Z lower-cased, punctuation apart) and the shares of its byte values.

The regression is fitted on the driver on a bounded sample: at most about ``rows_per_grade`` labelled rows of each grade,
drawn by a hash of the id; words in fewer than ``MIN_TEXTS`` texts of the sample, or spread over the grades as by chance, have no weight. Scoring is a map over Arrow
batches, with a table of weights of fixed size.

Null and empty texts are scored with no words. Without labelled rows, or with one grade only, every text has that grade (0)
with certainty. Ratings that are null, or of ids without a text, are not used; of several ratings of an id each counts. Rows
that repeat are scored each. Columns of the results' names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from orgbeacon.llm.shared import byte_table, slices, word_bounds, word_hashes

BIN_BITS = 22
MIN_TEXTS = 3
#: Words whose share of texts differs less between grades than this, by chance mostly, have no weight.
CHI_SQUARE, CHI_SQUARE_A_ROW = 20.0, 1 / 150
_WORDS = byte_table(bytes(c for c in range(128) if not chr(c).isalnum()), fold=True)
_ADDED = ("expected_grade", "p_tail", "p_lowest", "grade")


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct word bins of each text with the text's number, in order, and each text's byte shares."""
    n = len(at) - 1
    starts, ends, first = word_bounds(data, at, _WORDS)
    bins = (word_hashes(data, starts, ends, _WORDS) >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    both = np.unique(np.repeat(np.arange(n), np.diff(first)) << BIN_BITS | bins)
    shares = np.empty((n, 256), np.float32)
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        shares[i] = np.bincount(data[a:b], minlength=256) / max(1, b - a)
    return both & ((1 << BIN_BITS) - 1), both >> BIN_BITS, shares


@dataclass
class Model:
    bins: np.ndarray  # the weight of each bin
    shares: np.ndarray
    thresholds: np.ndarray  # one fewer than grades

    def above(self, bins: np.ndarray, text: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """P(grade > k) of each text for k = 0, 1, ..: (texts, thresholds)."""
        score = np.bincount(text, self.bins[bins], len(shares)) + shares @ self.shares
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def fit(bins: np.ndarray, text: np.ndarray, shares: np.ndarray, grades: np.ndarray, steps: int = 200, decay: float = 0.01) -> Model:
    """Maximum likelihood with a penalty on the weights, grades weighted alike; thresholds are kept apart by their logarithm."""
    n_grades = int(grades.max()) + 1 if len(grades) else 1
    known, column, times = np.unique(bins, return_inverse=True, return_counts=True)
    use = times >= MIN_TEXTS
    if len(grades):  # Pearson's chi square of a word's texts by grade
        sizes = np.bincount(grades, minlength=n_grades)
        by_grade = np.stack([np.bincount(column[grades[text] == k], minlength=len(known)) for k in range(n_grades)], axis=1)
        expected = times[:, None] * sizes[None, :] / len(grades)
        use &= (np.where(expected > 0, (by_grade - expected) ** 2 / np.maximum(expected, 1e-9), 0)).sum(axis=1) >= CHI_SQUARE + CHI_SQUARE_A_ROW * len(grades)
    number = np.cumsum(use) - 1
    keep = use[column]
    column, text, d = number[column[keep]], text[keep], int(use.sum())
    weight = 1 / np.maximum(np.bincount(grades, minlength=n_grades), 1)
    weight = (weight / weight[np.unique(grades)].sum())[grades] if len(grades) else np.zeros(0)
    w = np.zeros(d + 256 + max(n_grades - 1, 0))
    if n_grades > 1:
        w[d + 256] = -0.5
        w[d + 257 :] = 0.0
    rows, scale = np.arange(len(grades)), 10.0  # shares are small numbers
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1 if n_grades > 1 else 0):
        theta = w[d + 256] + np.concatenate([[0], np.cumsum(np.exp(w[d + 257 :]))])
        score = np.bincount(text, w[column], len(grades)) + scale * (shares @ w[d : d + 256])
        below = 1 / (1 + np.exp(np.clip(score[:, None] - theta[None, :], -50, 50)))  # P(grade <= k)
        full = np.hstack([np.zeros((len(grades), 1)), below, np.ones((len(grades), 1))])
        high, low = full[rows, grades + 1], full[rows, grades]
        p = np.maximum(high - low, 1e-12)
        by_high, by_low = high * (1 - high) / p * weight, low * (1 - low) / p * weight
        to_score = by_high - by_low  # of the negative log-likelihood
        to_theta = np.zeros((len(grades), n_grades + 1))
        to_theta[rows, grades + 1] -= by_high
        to_theta[rows, grades] += by_low
        to_theta = to_theta[:, 1:-1].sum(axis=0)
        g = np.concatenate([np.bincount(column, to_score[text], d), scale * (to_score @ shares), [to_theta.sum()], np.cumsum(to_theta[::-1])[::-1][1:] * np.exp(w[d + 257 :])])
        g[: d + 256] += decay * w[: d + 256]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    table = np.zeros(1 << BIN_BITS, np.float32)
    table[known[use]] = w[:d]
    theta = w[d + 256] + np.concatenate([[0], np.cumsum(np.exp(w[d + 257 :]))]) if n_grades > 1 else np.zeros(0)
    return Model(table, scale * w[d : d + 256], theta)


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", rows_per_grade: int = 2500) -> Model:
    """Fit on ``ratings`` (id, grade from 0 on) of ``docs``."""
    rated = ratings.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade")).dropna()
    counts = {r[0]: r[1] for r in rated.groupBy("grade").count().collect()}
    share = F.lit(0.0)
    for grade, n in counts.items():
        share = F.when(F.col("grade") == grade, F.lit(min(1.0, rows_per_grade / n))).otherwise(share)
    bound = 2 * rows_per_grade * max(1, len(counts))
    drawn = rated.where(F.pmod(F.xxhash64(F.lit("quality sample"), F.col("id")), F.lit(1_000_000)) < share * 1_000_000).limit(bound)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in slices(batch):
                bins, text, shares = features(data, at)
                cuts = np.searchsorted(text, np.arange(1, rows.num_rows))
                parts = [b.astype(np.int32).tobytes() for b in np.split(bins, cuts)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(parts, pa.binary()), pa.array([s.tobytes() for s in shares], pa.binary())], ["grade", "bins", "shares"])

    rows = texts.join(F.broadcast(drawn), "id").select("grade", "text").mapInArrow(extract, "grade int, bins binary, shares binary").limit(bound).toArrow()
    if not rows.num_rows:
        return fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 256), np.float32), np.zeros(0, np.int64))
    parts = [np.frombuffer(b.as_buffer(), np.int32) for b in rows.column("bins")]
    shares = np.stack([np.frombuffer(b.as_buffer(), np.float32) for b in rows.column("shares")])
    return fit(np.concatenate(parts).astype(np.int64), np.repeat(np.arange(len(parts)), [len(p) for p in parts]), shares, rows.column("grade").to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Model, text_col: str = "text", tail: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all by default) with expected_grade, p_tail = P(grade >= tail), p_lowest = P(grade = 0) and the likeliest grade."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in _ADDED]
    schema = StructType([*(docs.schema[c] for c in kept), *(StructField(c, DoubleType()) for c in _ADDED[:3]), StructField("grade", IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BIN_BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in slices(batch):
                above = shared.value.above(*features(data, at))
                full = np.hstack([np.ones((len(above), 1)), above, np.zeros((len(above), 1))])
                each = full[:, :-1] - full[:, 1:]
                at_least = full[:, min(above.shape[1] if tail is None else tail, above.shape[1])]
                yield pa.RecordBatch.from_arrays([*rows.column(1).flatten(), pa.array(above.sum(axis=1)), pa.array(at_least), pa.array(each[:, 0]), pa.array(each.argmax(axis=1).astype(np.int32))], names=schema.names)

    return docs.select(F.col(text_col).cast("string").alias("text"), F.struct(*kept).alias("kept")).mapInArrow(run, schema)


def selected(p_tail: str | Column = "p_tail", least: float = 0.3) -> Column:
    """Rows to keep: those of which the tail's grades are likely enough."""
    return F.col(p_tail) >= least if isinstance(p_tail, str) else p_tail >= least
