"""Repair of the structure of conversations, by a run-length dynamic program, with the least edits.

A conversation is the rows of one ``conv_id``, in the order of turn (nulls first), role and text. A row's symbol is the initial
of its role (system, user, assistant or another) and its fault: it is blank or a duplicate, which has to go, truncated, or sound.
Edits: K(eep) 0, R(erole) to user or assistant 1, D(elete) 2, I(nsert) an empty user or assistant row 5; a truncated row that
is not deleted costs 5 more. The cheapest edits are chosen that leave roles ``(s?(ua)+)?``, of equally cheap ones the least in ASCII order.

* Rows alike are counted before any shuffle, and which texts come again is worked out on digests, so a group of copies is a number.
* Rows are sorted over all tasks by range; a conversation that is longer than a partition goes over several. The transition of
  a symbol is a matrix of the costs from each state of the roles' automaton to each other (min, plus), which includes inserts
  before it. Equal consecutive symbols are a run; a run of n is advanced by the cached binary powers of its matrix. Where
  a conversation crosses partitions, each part gives the matrix of all its runs; from these few numbers follow the costs after each part.
* Then the costs are carried back through the runs, and choices unrolled from the front: the least letter that keeps to the least cost.
* The parts of a conversation that crosses partitions are hashed and audited as one stream of rows in order, in constant memory but for
  the audit itself, as the hash of one text can't be divided. All other conversations end where they were sorted.

Null roles and texts read as one space, and a null conv_id is a conversation of its own; an empty table gives no rows. An id of
``ids`` without rows has counts of 0, an empty audit and the hash of an empty text. Further columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from orgbeacon.llm.shared import checkpoint

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
_FAR = 1 << 40
#: States of the roles' automaton: nothing yet, after system, after user, after assistant. An added role goes where NEXT says.
NEXT = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
#: What a conversation costs when its rows have ended, by state: inserts up to an end that is allowed.
ENDED = (0, 2 * INSERT, INSERT, 0)
SOUND, TRUNCATED, DUPLICATE, BLANK = 0, 1, 2, 3
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_LEGAL = {"su", "ua", "au"}
Matrix = tuple[tuple[int, ...], ...]


def _kept(state: int, initial: str) -> int | None:
    """The state after a row that is kept."""
    if initial == "s":
        return 1 if state == 0 else None
    return NEXT[state] if ROLES[NEXT[state]][0] == initial else None


def product(one: Matrix, two: Matrix) -> Matrix:
    return tuple(tuple(min(a + two[k][j] for k, a in enumerate(row)) for j in range(4)) for row in one)


@cache
def power(initial: str, fault: int, exponent: int) -> Matrix:
    """The transition of 2 ** ``exponent`` rows of a symbol."""
    if exponent:
        half = power(initial, fault, exponent - 1)
        return product(half, half)
    out = []
    for state in range(4):
        costs, at, paid = [_FAR] * 4, state, 0
        for _ in range(4):  # after at most three inserts all states are reached
            costs[at] = min(costs[at], paid + DELETE)
            if fault < DUPLICATE:
                extra = CUT if fault == TRUNCATED else 0
                to = _kept(at, initial)
                if to is not None:
                    costs[to] = min(costs[to], paid + KEEP + extra)
                costs[NEXT[at]] = min(costs[NEXT[at]], paid + REROLE + extra)
            at, paid = NEXT[at], paid + INSERT
        out.append(tuple(costs))
    return tuple(out)


def run_matrix(initial: str, fault: int, n: int) -> Matrix:
    """The transition of a run of ``n`` equal symbols."""
    out = None
    for i in range(n.bit_length()):
        if n >> i & 1:
            out = power(initial, fault, i) if out is None else product(out, power(initial, fault, i))
    return out


@cache
def _before(initial: str, fault: int, exponent: int, after: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(c + a for c, a in zip(row, after, strict=True)) for row in power(initial, fault, exponent))


def costs_before(initial: str, fault: int, n: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The costs by state before a run of ``n`` equal symbols, from those after it."""
    low = min(after)
    after = tuple(a - low for a in after)  # few differ then, so most steps are known
    for i in range(n.bit_length()):
        if n >> i & 1:
            after = _before(initial, fault, i, after)
    return tuple(a + low for a in after)


def symbol(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "-"


class Walk:
    """The choices and counts of one conversation, row by row from its beginning."""

    def __init__(self) -> None:
        self.state, self.rows = 0, 0
        self.audit: list[str] = []
        self.hash, self.any = hashlib.sha256(), False
        self.counts = dict.fromkeys(COUNTS, 0)
        self.initial: str | None = None
        self.turns: list[int] | None = None  # first, last, distinct

    def _emit(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any = True

    def _added(self) -> None:
        self.state = NEXT[self.state]
        self.audit.append("I")
        self._emit(ROLES[self.state], "")

    def see(self, turn: int | None, role: str, fault: int, n: int) -> None:
        """Counts of ``n`` rows alike."""
        if turn is not None:
            self.turns = [turn, turn, 1] if self.turns is None else [self.turns[0], turn, self.turns[2] + (turn != self.turns[1])]
        if fault:
            self.counts[("truncated", "duplicate", "blank")[fault - 1]] += n
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in _LEGAL:
            self.counts["illegal"] += 1
        self.counts["illegal"] += n - 1
        self.initial = initial

    def step(self, role: str, text: str, fault: int, after: tuple[int, ...]) -> None:
        """The choice for one row; ``after``: the costs by state after it. The letters are tried in their order: D, I, K, R."""
        initial = symbol(role)
        here = costs_before(initial, fault, 1, after)
        if not self.audit and not self.any:
            self.counts["cost"] = here[0]
        extra = CUT if fault == TRUNCATED else 0
        while True:
            cost, state = here[self.state], self.state
            if DELETE + after[state] == cost:
                self.audit.append("D")
                return
            if INSERT + here[NEXT[state]] == cost:
                self._added()
                continue
            to = _kept(state, initial)
            if to is not None and KEEP + extra + after[to] == cost:
                self.audit.append("K")
                self._emit(role, text)
            else:
                to = NEXT[state]
                self.audit.append("R")
                self._emit(ROLES[to], text)
            self.state = to
            return

    def run(self, role: str, text: str, fault: int, n: int, after: tuple[int, ...]) -> None:
        """``n`` rows alike: the costs after each of them, from the last on, then the choices from the first on."""
        while n:
            part = min(n, 1024)  # a very long run goes by parts, so that few costs are held
            each = [costs_before(symbol(role), fault, n - part, after)]
            for _ in range(part - 1):
                each.append(costs_before(symbol(role), fault, 1, each[-1]))
            for one in reversed(each):
                self.step(role, text, fault, one)
            n -= part

    def end(self) -> tuple:
        while ENDED[self.state]:
            self._added()
        if self.turns:
            self.counts["gaps"] = self.turns[1] - self.turns[0] + 1 - self.turns[2]
        return (*(self.counts[c] for c in COUNTS), "".join(self.audit), self.hash.hexdigest())


def _symbols(rows: list[tuple]) -> Iterator[tuple[str, int, int]]:
    """Runs of equal consecutive symbols: (initial, fault, n)."""
    last: list | None = None
    for _, role, _, fault, n in rows:
        key = (symbol(role), min(fault, DUPLICATE))
        if last and (last[0], last[1]) == key:
            last[2] += n
        else:
            if last:
                yield tuple(last)
            last = [*key, n]
    if last:
        yield tuple(last)


def _costs(rows: list[tuple], after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The costs after each row, from those after the last: run by run, then within each run."""
    ends, at = [], after
    for initial, fault, n in reversed(list(_symbols(rows))):
        ends.append(at)
        at = costs_before(initial, fault, n, at)
    out, here, key = [], after, None
    for _, role, _, fault, n in reversed(rows):
        own = (symbol(role), min(fault, DUPLICATE))
        if own != key:
            here, key = ends.pop(0), own
        out.append(here)
        here = costs_before(*own, n, here)
    return out[::-1]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Each conversation of a sorted partition: its id and its rows (turn, role, text, fault, n, ..)."""
    key, rows = None, []
    for batch in batches:
        for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and conv != key:
                yield key, rows
                rows = []
            key = conv
            rows.append(tuple(row))
    if rows:
        yield key, rows


def _identity() -> Matrix:
    return tuple(tuple(0 if i == j else _FAR for j in range(4)) for i in range(4))


def damaged_order(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows (conv, turn, role, text, fault, n), counted, in the order of conversations over all partitions; ``fault`` is the first that fits."""
    kind = rows.schema[conv].dataType.simpleString()
    own = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    place = lambda c: F.struct(F.col(c).isNotNull().alias("set"), F.col(c).alias("turn"))
    digest = F.struct("role", F.xxhash64("text").alias("h"), F.xxhash64(F.lit("again"), "text").alias("g")).alias("digest")
    seen = own.select("conv", digest, place("turn").alias("at")).groupBy("conv", "digest").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    again = seen.where("first < last").select(F.col("conv").alias("a_conv"), F.col("digest").alias("a_digest"), "first")
    alike = own.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))
    marked = alike.withColumn("digest", digest).join(again, F.expr("conv <=> a_conv AND digest = a_digest"), "left")
    later = F.coalesce(place("turn") > F.col("first"), F.lit(False))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, BLANK).when(later, DUPLICATE).when(cut, TRUNCATED).otherwise(SOUND)
    # of rows alike the first is judged by its text, the others are duplicates
    parts = F.when(blank | later | (F.col("n") == 1), F.array(F.struct(fault.alias("fault"), F.col("n").alias("n")))).otherwise(
        F.array(F.struct(fault.alias("fault"), F.lit(1).cast("long").alias("n")), F.struct(F.lit(DUPLICATE).alias("fault"), (F.col("n") - 1).alias("n")))
    )
    out = marked.select(F.col("conv").cast(kind), "turn", "role", "text", F.explode(parts).alias("p")).select("conv", "turn", "role", "text", "p.fault", "p.n")
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "fault"]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


def repair(rows: DataFrame, ids: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation of ``ids`` (those of rows by default): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    gaps: turns that are missing between the least and the largest; illegal: neighbours whose roles' initials are not su, ua or au.
    """
    kind = rows.schema[conv_col].dataType
    ordered = checkpoint(damaged_order(rows, conv_col, turn_col, role_col, text_col))
    fields = [*(StructField(c, LongType()) for c in COUNTS), StructField("audit", StringType()), StructField("repaired_sha256", StringType())]
    schema = StructType([StructField("conv", kind), *fields])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The transitions of the first and the last conversation of a partition, which may cross its bounds."""
        key, run, matrix, part, n_found, begun = None, None, _identity(), None, 0, False
        found: list[tuple] = []

        def close() -> None:
            whole = matrix if run is None else product(matrix, run_matrix(*run))
            found[1 if found else 0 :] = [(part, n_found, key, [c for row in whole for c in row])]  # the first and the last so far

        for batch in batches:
            for p, conv, role, fault, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begun and conv != key:
                    close()
                    n_found, run, matrix = n_found + 1, None, _identity()
                key, part, begun = conv, p, True
                own = (symbol(role), min(fault, DUPLICATE))
                if run and run[:2] == own:
                    run = (*own, run[2] + n)
                else:
                    matrix = matrix if run is None else product(matrix, run_matrix(*run))
                    run = (*own, n)
        if begun:
            close()
            names = ["part", "number", "conv", "matrix"]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), conv_type, pa.list_(pa.int64())))], names)

    conv_type = to_arrow_type(kind)
    parts = ordered.select(F.spark_partition_id().cast("long").alias("part"), "conv", "role", "fault", "n").mapInArrow(ends, StructType([StructField("part", LongType()), StructField("number", LongType()), StructField("conv", kind), *StructType.fromDDL("matrix array<bigint>").fields]))

    def suffixes(table: pa.Table) -> pa.Table:
        """The costs after each part of a conversation, from its last part on: a row for each partition at most."""
        table = table.sort_by([("part", "descending")])
        after, out = ENDED, []
        for flat in table.column("matrix").to_pylist():
            out.append(after)
            after = tuple(min(c + a for c, a in zip(flat[4 * i : 4 * i + 4], after, strict=True)) for i in range(4))
        return pa.table([table.column("part"), table.column("conv"), pa.array(out, pa.list_(pa.int64()))], names=["part", "conv", "after"])

    crossing = checkpoint(parts.withColumn("key", F.xxhash64("conv")))  # two rows a partition at most
    several = crossing.groupBy("key").agg(F.count("*").alias("parts")).where("parts > 1").select("key")
    tails = crossing.join(several, "key", "left_semi").drop("key").groupBy("conv").applyInArrow(suffixes, StructType([StructField("part", LongType()), StructField("conv", kind), *StructType.fromDDL("after array<bigint>").fields]))
    tails = checkpoint(tails)  # a row for each partition that a conversation crosses into
    marks = tails.select(F.col("part").alias("t_part"), F.col("conv").alias("t_conv"), "after")
    placed = ordered.select("*", F.spark_partition_id().cast("long").alias("part"))
    columns = ["conv", "turn", "role", "text", "fault", "n"]

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv, rows in _conversations(batches):
            walk = Walk()
            for (turn, role, text, fault, n), after in zip(rows, _costs(rows, ENDED), strict=True):
                walk.see(turn, role, fault, n)
                walk.run(role, text, min(fault, DUPLICATE), n, after)
            out.append((conv, *walk.end()))
            if len(out) >= 1000:
                yield _batch(out, schema, conv_type)
                out = []
        yield _batch(out, schema, conv_type)

    def costed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of parts with the costs after each."""
        names = ["part", "seq", *columns, "costs"]
        types = [pa.int64(), pa.int64(), conv_type, pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        for conv, rows in _conversations(batches):
            part, after = rows[0][5], tuple(rows[0][6])
            rows = [r[:5] for r in rows]
            costs = _costs(rows, after)
            for a in range(0, len(rows), 4096):
                each = [(part, a + i, conv, *r, list(c)) for i, (r, c) in enumerate(zip(rows[a : a + 4096], costs[a : a + 4096], strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in each], t) for i, t in enumerate(types)], names)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, key, begun = Walk(), None, False
        for batch in batches:
            for conv, turn, role, text, fault, n, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begun and conv != key:
                    yield _batch([(key, *walk.end())], schema, conv_type)
                    walk = Walk()
                key, begun = conv, True
                walk.see(turn, role, fault, n)
                walk.run(role, text, min(fault, DUPLICATE), n, tuple(after))
        if begun:
            yield _batch([(key, *walk.end())], schema, conv_type)

    crossers = F.broadcast(marks)  # two rows a partition at most
    whole = placed.join(crossers, F.expr("conv <=> t_conv AND part = t_part"), "left_anti").select(columns).mapInArrow(inside, schema)
    cut = placed.join(crossers, F.expr("conv <=> t_conv AND part = t_part")).select(*columns, "part", "after")
    costed_schema = StructType([StructField("part", LongType()), StructField("seq", LongType()), StructField("conv", kind), *StructType.fromDDL("turn bigint, role string, text string, fault int, n bigint, costs array<bigint>").fields])
    stream = cut.mapInArrow(costed, costed_schema).repartition(F.xxhash64("conv")).sortWithinPartitions("conv", "part", "seq")
    done = whole.union(stream.select(*columns, "costs").mapInArrow(streamed, schema))
    ids = (rows if ids is None else ids).select(F.col(conv_col).alias("__id")).distinct()
    none = hashlib.sha256(b"").hexdigest()
    out = ids.join(done, F.expr("__id <=> conv"), "left")
    return out.select(F.col("__id").alias(conv_col), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))


def _batch(rows: list[tuple], schema: StructType, conv_type: pa.DataType) -> pa.RecordBatch:
    types = [conv_type, *(pa.int64() for _ in COUNTS), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=schema.names)


def damaged(conversations: DataFrame, remainder: Column) -> DataFrame:
    """Conversations with planted faults, by ``remainder``: 0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it the user's."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), remainder.alias("r")).where("r != 0")
    text = F.when(F.col("r") == 1, "").when(F.col("r") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("r") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("r") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.drop("col")
