"""Language identification in two steps: the family, then one-versus-one linear support vector machines within it.

Both steps see hashed sequences of one to three bytes of the whole text. The families come from a table of language codes
(a parameter); a language that is not in it is a family of its own. Each machine is fitted in a task on a bounded sample of the
labelled rows (``rows_per_language``; the sample is drawn by a hash of the id, so it is the same at every run), and only its
weights come to the driver; prediction is a map over Arrow batches without a shuffle.

A text that is null or has no letter is ``und`` with score 0, as is every text if there are no labelled rows. Rows are
judged one by one: ties between votes go to the larger sum of margins, then to the first language in alphabetical order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from orgbeacon.llm.hashed_text import damped, hashed_grams
from orgbeacon.llm.shared import slices

BINS = 4096
ORDER = 3
#: Languages by family, by their ISO 639-1 codes.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "be", "bg", "sr", "pl", "cs", "sk", "sl", "hr"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk"),
}


@dataclass
class Model:
    """Linear machines: one versus the rest for families, one versus one for the languages of a family."""

    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    family_weights: np.ndarray | None = None
    pair_weights: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    slope: float = 4.0

    def pairs(self) -> list[tuple[str, str]]:
        return [(a, b) for name in self.families for i, a in enumerate(self.members[name]) for b in self.members[name][i + 1 :]]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each row of features and a score from 0 to 1."""
        n = len(x)
        if not self.families:
            return ["und"] * n, np.zeros(n)
        with_bias = np.hstack([x, np.ones((n, 1), np.float32)])
        margins = with_bias @ self.family_weights.T
        family = margins.argmax(axis=1)
        sure = 1 / (1 + np.exp(-self.slope * margins))
        score = sure[np.arange(n), family] / sure.sum(axis=1) if len(self.families) > 1 else np.ones(n)
        out = np.empty(n, object)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            own = self.members[name]
            if not len(rows):
                continue
            votes, total = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
            for i, a in enumerate(own):
                for j in range(i + 1, len(own)):
                    m = with_bias[rows] @ self.pair_weights[a, own[j]]
                    p = 1 / (1 + np.exp(-self.slope * m))
                    votes[:, i] += m >= 0
                    votes[:, j] += m < 0
                    total[:, i] += p
                    total[:, j] += 1 - p
            best = (votes * 1e6 + total).argmax(axis=1)
            out[rows] = np.array(own, object)[best]
            score[rows] *= total[np.arange(len(rows)), best] / max(1, len(own) - 1) if len(own) > 1 else 1
        return out.tolist(), np.clip(score, 0, 1)


def fit_svm(x: np.ndarray, positive: np.ndarray, epochs: int = 12, decay: float = 1e-4) -> np.ndarray:
    """A linear machine for the squared hinge loss, classes weighted alike: Nesterov steps over all rows of ``x``, whose last column is 1."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    weight = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    seen, momentum, step = w.copy(), 1.0, 0.25
    for _ in range(epochs * 10):
        lack = np.maximum(0, 1 - y * (x @ seen))
        new = seen + step * (2 * (x.T @ (weight * lack * y)) - decay * seen)
        grown = (1 + sqrt(1 + 4 * momentum * momentum)) / 2
        seen = new + (momentum - 1) / grown * (new - w)
        w, momentum = new, grown
    return w


def _fitted(table: pa.Table) -> pa.Table:
    """One machine, of the rows (machine, positive, x) of its two sides."""
    rows = sorted(zip(table.column("positive").to_pylist(), table.column("x").to_pylist(), strict=True))  # the same at every run
    x = np.ones((len(rows), BINS + 1), np.float32)
    for i, (_, one) in enumerate(rows):
        x[i, :BINS] = np.frombuffer(one, np.float16)
    return pa.table({"machine": pa.array([table.column("machine")[0].as_py()], pa.int32()), "w": pa.array([fit_svm(x, np.array([p for p, _ in rows], bool)).astype(np.float32).tobytes()], pa.binary())})


def machines(languages: list[str], families: dict[str, tuple[str, ...]] = FAMILIES) -> tuple[Model, list[tuple[frozenset, frozenset]]]:
    """A model without weights, and the languages on the two sides of each machine: those of the families, then those of the pairs."""
    family_of = {lang: name for name, langs in families.items() for lang in langs}
    model = Model()
    for lang in sorted(languages):
        model.members.setdefault(family_of.get(lang, f"={lang}"), []).append(lang)
    model.families = sorted(model.members)
    sides = [(frozenset(model.members[name]), frozenset(languages) - frozenset(model.members[name])) for name in model.families]
    return model, sides + [(frozenset([a]), frozenset([b])) for a, b in model.pairs()]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows_per_language: int = 600) -> Model:
    """Fit on at most about ``rows_per_language`` rows of each language that have a label and a text; each machine is fitted in a task of its own."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}  # languages
    model, sides = machines(list(counts))
    if not sides:
        return model
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, rows_per_language / n))).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64(F.lit("language sample"), F.col(id_col)), F.lit(1_000_000)) < share * 1_000_000)
    drawn = drawn.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).limit(2 * rows_per_language * len(counts))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in slices(batch):
                x = [r.tobytes() for r in damped(hashed_grams(data, at, ORDER, BINS)).astype(np.float16)]
                for m, (yes, no) in enumerate(sides):  # once for each machine of the language
                    own = [(lang in yes, one) for lang, one in zip(rows.column(1).to_pylist(), x, strict=True) if lang in yes or lang in no]
                    yield pa.RecordBatch.from_arrays([pa.array([m] * len(own), pa.int32()), pa.array([p for p, _ in own], pa.bool_()), pa.array([one for _, one in own], pa.binary())], ["machine", "positive", "x"])

    fitted = drawn.mapInArrow(extract, "machine int, positive boolean, x binary").groupBy("machine").applyInArrow(_fitted, "machine int, w binary").collect()  # weights only
    weights = {r["machine"]: np.frombuffer(r["w"], np.float32) for r in fitted}
    flat = np.zeros(BINS + 1, np.float32)
    model.family_weights = np.stack([weights.get(m, flat) for m in range(len(model.families))])
    model.pair_weights = {pair: weights.get(len(model.families) + i, flat) for i, pair in enumerate(model.pairs())}
    return model


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all of them by default) with lang_pred and score; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # families, pairs and bins bound its size
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    names = [*kept, "lang_pred", "score"]
    schema = StructType([*(docs.schema[c] for c in kept), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    real = has_letter(F.col(text_col))
    others = [c for c in kept if c != text_col]  # the text goes to Python once
    own = docs.select(F.col(text_col).cast("string").alias("text"), real.alias("__real"), F.struct(F.lit(0).alias("__none"), *others).alias("__kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, limit=1 << 20):
                langs, scores = shared.value.predict(damped(hashed_grams(data, offsets, ORDER, BINS)))
                known = rows.column(1).to_pylist()
                langs = [lang if k else "und" for lang, k in zip(langs, known, strict=True)]
                scores = np.where(np.array(known, bool), scores, 0.0)
                own_columns = dict(zip(others, rows.column(2).flatten()[1:], strict=True)) | {text_col: rows.column(0)}
                yield pa.RecordBatch.from_arrays([*(own_columns[c] for c in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    return own.mapInArrow(run, schema)
