"""What several operators share: checkpoints, slices of Arrow batches, vectorised word and word-sequence hashes.

Words are found in the UTF-8 bytes that Spark hands over in Arrow buffers, a slice of some megabytes at a time,
so no Python string is made for a word and memory stays bounded by the slice and the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orgbeacon.joins import dealt_join as dealt_join
from orgbeacon.stored import stored

SLICE_BYTES = 2 << 20
_PIECE = 1 << 20
_MASK = (1 << 64) - 1
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xC2B2AE3D27D4EB4F
_SPACES = bytes([0x20, *range(0x09, 0x0E)])


checkpoint = stored


def prefix_sums(cells: DataFrame, group: str, order: list[str], number: str, value: str, out: str, chunk: int = 1000) -> DataFrame:
    """``cells`` with ``out``: the sum of ``value`` over the cells before it in its group, by ``order`` and then ``number`` (from 0).

    Cells are summed by chunks of ``chunk`` numbers first, so no task sorts more than a chunk, or a thousandth of a group's cells.
    """
    keys = [group, *order, "__chunk"]
    dealt = cells.withColumn("__chunk", F.floor(F.col(number) / chunk))
    chunks = dealt.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    before = chunks.select(*keys, (F.sum("__sum").over(Window.partitionBy(group).orderBy(*order, "__chunk")) - F.col("__sum")).alias("__before"))
    within = F.sum(value).over(Window.partitionBy(*keys).orderBy(number)) - F.col(value)
    return dealt.withColumn("__within", within).join(before, keys).withColumn(out, F.col("__within") + F.col("__before")).drop("__chunk", "__within", "__before")


def id_remainder(column: str, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins (one offset more than texts); null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``limit`` bytes of text (or one longer row), each with its text buffers."""
    data, at = text_buffers(batch.column(text))
    row, rows = 0, batch.num_rows
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield batch.slice(row, end - row), data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def byte_table(separators: bytes, fold: bool) -> np.ndarray:
    """A random value for each byte, 0 for separators; with ``fold`` A-Z have the values of a-z."""
    table = np.random.default_rng(20240521).integers(1, _MASK, 256, dtype=np.uint64)
    if fold:
        table[0x41:0x5B] = table[0x61:0x7B]
    table[list(separators)] = 0
    return table


#: Words of ``[^\\x20\\x09-\\x0D]+``, as they are and with A-Z lower-cased.
PLAIN = byte_table(_SPACES, fold=False)
FOLDED = byte_table(_SPACES, fold=True)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    out = values ^ (values >> np.uint64(32))
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base and of its inverse, modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known[0]) <= n:
        size = max(_PIECE, 2 * n) + 1
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        known = _powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return known


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word in ``data``, and for every text the index of its first word (one index more than texts)."""
    inside = (table != 0)[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), np.uint64)
    w = 0
    while w < len(starts):
        stop = max(w + 1, int(np.searchsorted(starts, starts[w] + _PIECE)))
        low = starts[w]
        piece = table[data[low : ends[stop - 1]]]
        up, down = _tables(_BYTE_BASE, len(piece))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * up[: len(piece)], out=sums[1:])
        a, b = starts[w:stop] - low, ends[w:stop] - low
        out[w:stop] = (sums[b] - sums[a]) * down[a]
        w = stop
    return mixed(out)


def sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k words from each word on; the last k - 1 words have none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, w = np.empty(n, np.uint64), 0
    while w < n:
        stop = min(n, w + _PIECE)
        piece = words[w : stop + k - 1]
        up, down = _tables(_WORD_BASE, len(piece))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * up[: len(piece)], out=sums[1:])
        m = stop - w
        out[w:stop] = (sums[k : k + m] - sums[:m]) * down[:m]
        w = stop
    return mixed(out)


def range_hashes(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words of each range; ``begin`` is in order."""
    out, w = np.empty(len(begin), np.uint64), 0
    while w < len(begin):
        stop = max(w + 1, int(np.searchsorted(begin, begin[w] + _PIECE)))
        low = begin[w]
        piece = words[low : end[w:stop].max()]
        up, down = _tables(_WORD_BASE, len(piece))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * up[: len(piece)], out=sums[1:])
        a, b = begin[w:stop] - low, end[w:stop] - low
        out[w:stop] = (sums[b] - sums[a]) * down[a]
        w = stop
    return mixed(out)


def packed(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    at = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))
