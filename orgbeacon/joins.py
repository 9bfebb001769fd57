"""Joins on keys of very many rows, and one row of several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the map by which ``perhaps`` looks keys up: 131,072 words, some MB as a broadcast, however many keys there are.
MAP_BITS = 1 << 23


def perhaps(many: DataFrame, key: Column, keys: DataFrame, other: Column) -> DataFrame:
    """``many`` with ``__perhaps``, false where the hash ``key`` is certainly none of the hashes ``other`` of ``keys``.

    Rows of which it is true are still to be joined: keys share bits, the more the more keys there are.
    """
    word = lambda c: F.floor(F.pmod(c, F.lit(MAP_BITS)) / 64).cast("long")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(c, F.lit(64)).cast("int"))
    words = keys.select(word(other).alias("__word"), bit(other).alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    found = many.withColumn("__word", word(key)).join(F.broadcast(words), "__word", "left")
    return found.withColumn("__perhaps", F.coalesce(F.col("__bits").bitwiseAND(bit(key)) != 0, F.lit(False))).select(*many.columns, "__perhaps")


def dealt_join(many: DataFrame, one: DataFrame, key: str, size: str, rows: int, each: int = 2000) -> DataFrame:
    """``many`` joined with ``one`` on ``key``; a key of very many rows is dealt over several tasks.

    ``one`` has a row for each key; its column ``size`` says about how many rows of ``many`` have it, ``rows`` how many these
    are in all. Keys of more than ``each`` rows, and of more than a 50,000th of all (so these are 50,000 keys at most and are
    broadcast), have their row of ``one`` repeated once for each share.
    """
    each = max(each, rows // 50_000)
    crowds = F.broadcast(one.where(F.col(size) > each).select(key, F.ceil(F.col(size) / each).alias("__shares")))
    share = F.coalesce(F.pmod(F.xxhash64(*(c for c in many.columns)), F.col("__shares")), F.lit(0))
    dealt = many.join(crowds, key, "left").withColumn("__share", share).drop("__shares")
    shares = F.when(F.col(size) > each, F.ceil(F.col(size) / each)).otherwise(1)
    repeated = one.withColumn("__share", F.explode(F.sequence(F.lit(0).cast("long"), shares.cast("long") - 1)))
    return dealt.join(repeated.drop(size), [key, "__share"]).drop("__share")


def one_each(df: DataFrame, *keys: str, best: tuple[Column, ...] = ()) -> DataFrame:
    """One row of each key, whatever the order of rows: the largest by ``best``, of equal ones always the same."""
    rest = [c for c in df.columns if c not in keys]
    last = F.to_json(F.struct(*rest))
    row = F.max_by(F.struct(*rest), F.struct(*(c.alias(f"b{i}") for i, c in enumerate(best)), last.alias("last")))
    return df.groupBy(*keys).agg(row.alias("__row")).select(*keys, "__row.*")
