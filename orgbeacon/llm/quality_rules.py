"""Quality rules: decision lists, learned by sequential covering and written as ordered Spark conditional expressions.

1. ``statistics`` counts what texts look like (words, symbols, equal lines, repeated windows, ..) in one pass over whole texts.
2. ``train`` draws a bounded sample of labelled rows. For each class but the most common it grows a conjunction of thresholds
   on shares of these counts, one condition at a time by information gain, until it covers no other class; prunes its last
   conditions on rows that did not grow it; keeps it if it is precise enough there; takes the covered rows away; and begins anew.
   Rows count as many as they stand for, as classes are drawn at different rates.
3. ``DecisionList.verdict`` is ``CASE WHEN rule THEN class .. ELSE the most common class END``.

Words that mark a class, by a likelihood ratio over their places in the sample's texts, are counted as one more statistic for that class.

Bounds: about ``rows_per_class`` rows of a class are drawn by a hash of the id, and at most ``MOST_MARKERS`` words mark a class.
Null and empty texts have counts of 0. Ratings that are null or of ids without a text are not used, of several of an id each
counts; without ratings all texts have the verdict null, with those of one class all have that. Rows that repeat are judged each
for itself; columns of the results' names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from orgbeacon.llm.shared import PLAIN, byte_table, checkpoint, mixed, sequence_hashes, slices, word_bounds, word_hashes

WINDOW = 8
MOST_MARKERS, MARKS = 200, 40.0
MOST_RULES, MOST_CONDITIONS = 24, 4
_LINES = byte_table(b"\n", fold=False)
_TERMS = byte_table(bytes(c for c in range(128) if not chr(c).isalnum()), fold=True)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_capitals", "n_marks", "n_same_next", "n_distinct")


def _bytes(chosen: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chosen.encode())] = True
    return table


_BEGINS = (np.arange(256) & 0xC0) != 0x80  # of a character, not in the middle of one
_INSIDE = PLAIN != 0
_BY_BYTE = {
    "word_chars": _BEGINS & _INSIDE,
    "n_symbols": _bytes("#*$%&|<>"),
    "n_letters": _bytes("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "n_capitals": _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "n_marks": _bytes("!?"),
}


def _of_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the flags are set in each text."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])


def _alike(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys of texts: which are the first of their kind in their text, and how many of the kind there are."""
    both = mixed(keys + mixed(text.astype(np.uint64) + np.uint64(1)))
    _, first, kind, times = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(keys), bool)
    is_first[first] = True
    return is_first, times[kind]


def counts_of(data: np.ndarray, at: np.ndarray, markers: list[np.ndarray]) -> dict[str, np.ndarray]:
    """The counts of each text, and how many of its words are among each of ``markers`` (sorted hashes)."""
    out = {name: _of_text(table[data], at) for name, table in _BY_BYTE.items()}
    starts, ends, first = word_bounds(data, at, PLAIN)
    words = word_hashes(data, starts, ends, PLAIN)
    texts = np.arange(len(at) - 1)
    text = np.repeat(texts, np.diff(first))
    out["n_words"] = np.diff(first)
    out["n_distinct"] = np.bincount(text[_alike(words, text)[0]], minlength=len(texts))
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    out["n_same_next"] = _of_text(same, first)

    windows = sequence_hashes(words, WINDOW)
    whole = np.flatnonzero(text[: len(windows)] == text[WINDOW - 1 :]) if len(windows) else np.zeros(0, np.int64)
    again = whole[_alike(windows[whole], text[whole])[1] > 1]
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + WINDOW, -1)
    out["n_repeat_words"] = _of_text(np.cumsum(edges[:-1]) > 0, first)

    begin, end, line_first = word_bounds(data, at, _LINES)
    inside = np.concatenate([[0], np.cumsum(_INSIDE[data])])
    full = inside[end] > inside[begin]
    line_text = np.repeat(texts, np.diff(line_first))[full]
    lines = word_hashes(data, begin, end, _LINES)[full]
    out["n_lines"] = np.bincount(line_text, minlength=len(texts))
    out["n_dup_lines"] = np.bincount(line_text[~_alike(lines, line_text)[0]], minlength=len(texts))

    if markers:
        a, b, term_first = word_bounds(data, at, _TERMS)
        terms = word_hashes(data, a, b, _TERMS)
        for i, known in enumerate(markers):
            out[f"n_markers_{i}"] = _of_text(np.isin(terms, known), term_first)
    return out


def statistics(docs: DataFrame, text_col: str = "text", markers: list[list[str]] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all by default) with COUNTS and n_markers_0, ..: how many words are among each list of markers."""
    known = []
    for words in markers or []:
        data = " ".join(words).encode()
        a, b, _ = word_bounds(np.frombuffer(data, np.uint8), np.array([0, len(data)]), _TERMS)
        known.append(np.sort(word_hashes(np.frombuffer(data, np.uint8), a, b, _TERMS)))
    names = [*COUNTS, *(f"n_markers_{i}" for i in range(len(known)))]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    schema = StructType([*(docs.schema[c] for c in kept), *(StructField(c, LongType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in slices(batch):
                counts = counts_of(data, at, known)
                yield pa.RecordBatch.from_arrays([*rows.column(1).flatten(), *(pa.array(counts[c], pa.int64()) for c in names)], names=schema.names)

    return docs.select(F.col(text_col).cast("string").alias("text"), F.struct(*kept).alias("kept")).mapInArrow(run, schema)


def shares(n_markers: int) -> dict[str, Column]:
    """What conditions are on: counts as shares of the words, lines or letters of a text."""
    of = lambda part, whole: F.col(part) / F.greatest(F.col(whole), F.lit(1))
    out = {
        "words": F.col("n_words").cast("double"), "word_length": of("word_chars", "n_words"), "symbols": of("n_symbols", "n_words"), "dup_lines": of("n_dup_lines", "n_lines"), "repeat_words": of("n_repeat_words", "n_words"),
        "capitals": of("n_capitals", "n_letters"), "marks": of("n_marks", "n_words"), "same_next": of("n_same_next", "n_words"), "distinct": of("n_distinct", "n_words"),
    }
    for i in range(n_markers):
        out |= {f"markers_{i}": F.col(f"n_markers_{i}").cast("double"), f"marker_share_{i}": of(f"n_markers_{i}", "n_words")}
    return out


Condition = tuple[str, str, float]


@dataclass
class DecisionList:
    """Ordered rules, each a class and its conditions (share, ``>=`` or ``<``, threshold); ``default`` where none fits."""

    rules: list[tuple[str, list[Condition]]] = field(default_factory=list)
    default: str | None = None
    markers: list[list[str]] = field(default_factory=list)

    def verdict(self) -> Column:
        """The class of a row of ``statistics``."""
        columns = shares(len(self.markers))
        out = None
        for name, conditions in self.rules:
            rule = F.lit(True)
            for share, sign, bound in conditions:
                rule = rule & (columns[share] >= bound if sign == ">=" else columns[share] < bound)
            out = F.when(rule, name) if out is None else out.when(rule, name)
        default = F.lit(self.default).cast("string")
        return default if out is None else out.otherwise(default)

    def __str__(self) -> str:
        lines = [" AND ".join(f"{c} {s} {b:.6g}" for c, s, b in conditions) + f" -> {name}" for name, conditions in self.rules]
        return "\n".join([*lines, f"else -> {self.default}"])


def _fits(x: dict[str, np.ndarray], conditions: list[Condition], rows: np.ndarray) -> np.ndarray:
    out = rows.copy()
    for share, sign, bound in conditions:
        out &= x[share] >= bound if sign == ">=" else x[share] < bound
    return out


def _best_condition(x: dict[str, np.ndarray], positive: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> tuple[float, Condition | None]:
    """The condition of the largest information gain on ``rows``."""
    best: tuple[float, Condition | None] = (1e-9, None)
    p0, n0 = weight[rows & positive].sum(), weight[rows & ~positive].sum()
    before = np.log2(p0 / (p0 + n0))
    for share, values in x.items():
        own = values[rows]
        order = np.argsort(own, kind="stable")
        own, w, pos = own[order], weight[rows][order], positive[rows][order]
        cuts = np.flatnonzero(own[1:] > own[:-1]) + 1
        if not len(cuts):
            continue
        low_p, low_n = np.cumsum(w * pos)[cuts - 1], np.cumsum(w * ~pos)[cuts - 1]
        for sign, p, n in (("<", low_p, low_n), (">=", p0 - low_p, n0 - low_n)):
            p = np.maximum(p, 0)
            gain = np.where(p > 1e-9, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1e-9)) - before), 0)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                bound = float((own[cuts[i] - 1] + own[cuts[i]]) / 2)
                best = (float(gain[i]), (share, sign, bound))
    return best


def cover(x: dict[str, np.ndarray], classes: np.ndarray, weight: np.ndarray, grows: np.ndarray, precision: float, least: int) -> DecisionList:
    """Sequential covering, the rarest class first; ``grows``: rows that grow rules, the others prune them."""
    names, totals = np.unique(classes, return_inverse=True)
    sizes = np.bincount(totals, weight)
    order = [str(names[i]) for i in np.argsort(sizes, kind="stable")]
    out, left = DecisionList(default=order[-1]), np.ones(len(classes), bool)
    for name in order[:-1]:
        positive, given_up = classes == name, np.zeros(len(classes), bool)
        for _ in range(MOST_RULES):
            conditions: list[Condition] = []
            rows = left & grows & ~given_up
            while (rows & positive).sum() >= least and (rows & ~positive).any() and len(conditions) < MOST_CONDITIONS:
                _, condition = _best_condition(x, positive, weight, rows)
                if condition is None:
                    break
                conditions.append(condition)
                rows = _fits(x, [condition], rows)
            values = []
            for k in range(1, len(conditions) + 1):
                rows = _fits(x, conditions[:k], left & ~grows)
                p, n = weight[rows & positive].sum(), weight[rows & ~positive].sum()
                values.append(((p - n) / max(p + n, 1e-9), -k, p / max(p + n, 1e-9), (rows & positive).sum()))
            if not values:
                break
            _, k, sure, hits = max(values)
            if sure < precision or hits < max(1, least // 2):
                given_up |= _fits(x, conditions, left & positive)  # not by this rule: others may still cover what is left
                continue
            conditions = conditions[:-k]
            out.rules.append((name, conditions))
            left &= ~_fits(x, conditions, left)
    return out


def _markers(sample: DataFrame, classes: list[str]) -> list[list[str]]:
    """For each class the words that stand in more places of its texts than by chance, by twice the logarithm of the likelihood ratio.

    Places after the same word count once, so a passage that many texts share counts no more than one text.
    """
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    sizes = {r[0]: r[1] for r in sample.groupBy("class").count().collect()}
    rows = sample.select("class", words.alias("w")).select("class", F.explode(F.transform("w", lambda x, i: F.struct(x.alias("word"), F.get("w", i - 1).alias("before")))).alias("p"))
    places = rows.groupBy("p").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    by_class = places.groupBy("p.word").agg(F.count("*").alias("n"), *(F.count_if((F.col("low") == c) & (F.col("high") == c)).alias(f"n{i}") for i, c in enumerate(classes)))
    by_class = checkpoint(by_class.where(" OR ".join([f"n{i} > 0.9 * n" for i in range(len(classes))] or ["false"])))  # words of a bounded sample
    out, total = [], sum(sizes.values())
    for i, c in enumerate(classes):
        share = sizes.get(c, 0) / max(1, total)
        a, b = F.col(f"n{i}"), F.col("n") - F.col(f"n{i}")
        part = lambda k, rate: F.when(k > 0, k * F.log(k / (F.col("n") * rate))).otherwise(0.0)
        ratio = 2 * (part(a, share) + part(b, 1 - share))
        found = by_class.where(a > 0.9 * F.col("n")).withColumn("g", ratio).where(F.col("g") >= MARKS).orderBy(F.desc("g"), "word").limit(MOST_MARKERS).collect() if 0 < share < 1 else []
        out.append(sorted(r["word"] for r in found))
    return out


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", class_col: str = "class", rows_per_class: int = 2500, precision: float = 0.9, least: int = 6) -> DecisionList:
    """A decision list from ``ratings`` (id, class) of ``docs``; ``precision``: the least share of a rule's rows, in those that pruned it, that are of its class."""
    rated = ratings.select(F.col(id_col).alias("id"), F.col(class_col).cast("string").alias("class")).dropna()
    sizes = {r[0]: r[1] for r in rated.groupBy("class").count().collect()}
    if not sizes:
        return DecisionList()
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("class") == name, F.lit(min(1.0, rows_per_class / n))).otherwise(share)
    bound = 2 * rows_per_class * len(sizes)
    drawn = rated.where(F.pmod(F.xxhash64(F.lit("rules sample"), F.col("id")), F.lit(1_000_000)) < share * 1_000_000).limit(bound)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    sample = checkpoint(texts.join(F.broadcast(drawn), "id").limit(bound).repartition("id"))
    common = max(sizes, key=lambda c: (sizes[c], c))
    markers = _markers(sample, sorted(c for c in sizes if c != common))
    columns = shares(len(markers))
    grows = (F.pmod(F.xxhash64(F.lit("grow"), F.col("id")), F.lit(3)) > 0).alias("grows")
    table = statistics(sample, markers=markers, keep=["id", "class"]).select("class", grows, *(c.alias(n) for n, c in columns.items())).toPandas()
    if not len(table):
        return DecisionList(default=common)
    classes = table["class"].to_numpy().astype(str)
    found = {c: int((classes == c).sum()) for c in sizes}
    weight = np.array([sizes[c] / found[c] for c in classes])
    out = cover({n: table[n].to_numpy() for n in columns}, classes, weight, table["grows"].to_numpy(), precision, least)
    out.default, out.markers = common, markers
    return out


def judge(docs: DataFrame, rules: DecisionList, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``statistics`` of docs with the verdict of the rules."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != "verdict"]
    return statistics(docs, text_col, rules.markers, kept).withColumn("verdict", rules.verdict())
