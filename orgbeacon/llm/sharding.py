"""Resharding by minimum-cost flow: from old shard sizes and new capacities, the block transfers that move the fewest bytes.

The flow network has the old shards and the new ones, at most ``shards`` of each, so it is solved on the driver whatever the
data: a byte that stays costs nothing, one that moves costs 1. The flow is turned into documents by their place in the old
shard: documents lie in cells of bounded size (largest size classes first, so that what is at the end of a shard and moves is
small), cells have running sums, and each transfer takes an interval of bytes; what stays comes first.

A null text has the size of an empty one, a null id or layout key is a value like any other. Rows that repeat are placed each.
Ties within a cell go by the id. No rows: no rows.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgbeacon.llm.shared import checkpoint, prefix_sums

SHARDS = 40
OVERHEAD = 16
CELL = 250
FILE_BYTES = 64 << 20


def min_cost_flow(old: list[int], new: list[int], cost: list[list[int]]) -> list[list[int]]:
    """The flow of least cost that empties ``old`` into ``new`` (sums alike): successive shortest paths."""
    n, m = len(old), len(new)
    left, room = list(old), list(new)
    flow = [[0] * m for _ in range(n)]
    while any(left):
        # distances from the sources that have bytes left; old nodes 0 .. n - 1, new nodes n .. n + m - 1
        dist = [0 if left[i] else float("inf") for i in range(n)] + [float("inf")] * m
        come: list[int] = [-1] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if dist[i] + cost[i][j] < dist[n + j]:
                        dist[n + j], come[n + j], changed = dist[i] + cost[i][j], i, True
                    if flow[i][j] and dist[n + j] - cost[i][j] < dist[i]:
                        dist[i], come[i], changed = dist[n + j] - cost[i][j], n + j, True
        end = min((n + j for j in range(m) if room[j]), key=lambda v: dist[v])
        path, v = [], end
        while come[v] >= 0:
            path.append((come[v], v))
            v = come[v]
        push = min([left[v], room[end - n], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += push
            else:
                flow[b][a - n] -= push
        left[v] -= push
        room[end - n] -= push
    return flow


def transfers(old: list[int], shards: int) -> list[tuple[int, int, int, int]]:
    """Byte intervals of the old shards and where they go, (old, begin, end, new); what stays is first."""
    total = sum(old)
    new = [total // shards + (j < total % shards) for j in range(shards)]
    flow = min_cost_flow(old, new, [[int(i != j) for j in range(shards)] for i in range(len(old))])
    out = []
    for i, row in enumerate(flow):
        at = 0
        for j in sorted(range(shards), key=lambda j: (j != i, j)):
            if row[j]:
                out.append((i, at, at + row[j], j))
                at += row[j]
    return out


def reshard(docs: DataFrame, old_shard: Column, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """Per row: the id, size, text_crc32, old_shard, shard, slot (gapless from 0 in each shard)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), old_shard.cast("int").alias("old_shard"))
    sized = checkpoint(sized.withColumn("class", -F.floor(F.log2("size")).cast("int")))
    sums = sized.groupBy("old_shard", "class").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    old = [0] * shards
    for row in sums.collect():  # shards x size classes
        old[row["old_shard"]] += row["bytes"]
    moves = transfers(old, shards)
    spark = docs.sparkSession
    plan = spark.createDataFrame(pa.table({k: pa.array([m[i] for m in moves], pa.int64()) for i, k in enumerate(("o", "begin", "end", "shard"))}))

    cell = ["old_shard", "class", "salt"]
    dealt = sized.join(F.broadcast(sums.select("old_shard", "class", F.ceil(F.col("n") / CELL).alias("salts"))), ["old_shard", "class"]).withColumn("salt", F.pmod(F.xxhash64("id", "text_crc32"), "salts"))
    cells = dealt.groupBy(*cell).agg(F.sum("size").alias("bytes"))
    before = prefix_sums(cells, "old_shard", ["class"], "salt", "bytes", "before").drop("bytes")
    inside = F.sum("size").over(Window.partitionBy(*cell).orderBy(F.desc("size"), "id", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = dealt.withColumn("inside", inside).join(before, cell).withColumn("at", F.col("inside") + F.col("before"))
    moved = placed.join(F.broadcast(plan), (F.col("old_shard") == F.col("o")) & (F.col("at") >= F.col("begin")) & (F.col("at") < F.col("end")))
    moved = checkpoint(moved.select("id", "size", "text_crc32", *cell, F.col("shard").cast("int").alias("shard")))
    counts = moved.groupBy("shard", *cell).agg(F.count("*").alias("n"))
    first = prefix_sums(counts, "shard", ["old_shard", "class"], "salt", "n", "first").drop("n")
    rank = F.row_number().over(Window.partitionBy("shard", *cell).orderBy("id", "text_crc32")) - 1
    out = moved.withColumn("rank", rank).join(first, ["shard", *cell])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "old_shard", "shard", (F.col("first") + F.col("rank")).alias("slot"))


def _blocks(rows: DataFrame, cuts: DataFrame, block: int) -> DataFrame:
    """``rows`` (old, class, id_hash) with ``block``, the number of the ``block`` bytes of their old shard in which they lie, as near as their cell tells."""
    share = F.pmod("id_hash", "salts") / F.col("salts")
    found = rows.join(F.broadcast(cuts), ["old", "class"], "left")  # shards x size classes
    return found.withColumn("block", F.floor((F.col("start") + share * F.col("bytes")) / block)).drop("class", "id_hash", "salts", "start", "bytes").repartition("old", "block")


def rewrite_affected(docs: DataFrame, placed: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", old_shard: Column | None = None) -> list[int]:
    """Write the shards that gain or lose a document under ``folder``/shard=N, by slots, the others stay as they are; the shards written.

    ``docs`` must not be read from ``folder``. Rows meet their places by the id, null or not, and the text; rows alike in both
    have their places in turn, so that each row is written once. The folder of a shard that has lost all its rows goes.
    Texts are shuffled once, by the blocks of their old shard (``old_shard``, if ``docs`` tells it): most of a block stays
    together, so a task writes few files, of ``FILE_BYTES`` each where the data are large.
    """
    spark = docs.sparkSession
    old = F.lit(0) if old_shard is None else old_shard.cast("int")
    klass = -F.floor(F.log2("size")).cast("int")
    known = placed.withColumns({"old": F.lit(0) if old_shard is None else F.col("old_shard"), "class": klass})
    flows = known.groupBy("old", "class", "old_shard", "shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # pairs of shards x size classes
    affected = sorted({s for row in flows if row["old_shard"] != row["shard"] for s in (row["old_shard"], row["shard"])})
    sums: dict[tuple[int, int], list[int]] = {}
    for row in flows:
        one = sums.setdefault((row["old"], row["class"]), [0, 0])
        one[0] += row["bytes"]
        one[1] += row["n"]
    cuts, start = [], {}
    for (shard, size_class), (size, n) in sorted(sums.items()):
        cuts.append((shard, size_class, -(-n // CELL), start.get(shard, 0), size))
        start[shard] = start.get(shard, 0) + size
    cuts = spark.createDataFrame(cuts, "old int, class int, salts long, start long, bytes long")
    block = min(FILE_BYTES, sum(start.values()) // 200 + 1)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    facts = lambda size, crc: {"size": size, "id_hash": F.xxhash64(id_col, crc), "row_key": F.xxhash64(id_col, size, crc)}
    turn = lambda *by: F.row_number().over(Window.partitionBy("old", "block", "row_key").orderBy(*by))
    places = known.withColumns(facts(F.col("size"), F.col("text_crc32"))).select("old", "class", "id_hash", "row_key", "shard", "slot")
    places = _blocks(places, cuts, block).withColumn("turn", turn("shard", "slot"))
    own = docs.select(F.struct(*(c for c in docs.columns if c not in ("shard", "slot"))).alias("own"), F.col(id_col), old.alias("old"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    own = own.withColumn("class", klass).withColumns(facts(F.col("size"), F.col("crc"))).select("old", "class", "id_hash", "row_key", "own")
    own = _blocks(own, cuts, block).withColumn("turn", turn("row_key"))
    rows = own.join(places, ["old", "block", "row_key", "turn"]).where(F.col("shard").isin(affected)).select("own.*", "slot", "shard")
    one_key = "spark.sql.requireAllClusterKeysForCoPartition"  # rows are joined where the blocks put them
    before = spark.conf.get(one_key)
    spark.conf.set(one_key, "false")
    try:
        rows.sortWithinPartitions("shard", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(folder)
    finally:
        spark.conf.set(one_key, before)
    for shard in set(affected) - {row["shard"] for row in flows}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/shard={shard}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return affected


def reshard_files(docs: DataFrame, old_shard: Column, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """``reshard`` with the affected shards rewritten in the shared folder; their rows are those of the files read back."""
    spark = docs.sparkSession
    placed = checkpoint(reshard(docs, old_shard, id_col, text_col, shards))
    own = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col), old_shard.cast("int").alias("old_shard"))
    folder = f"{spark.sparkContext.getCheckpointDir()}/shards-{uuid.uuid4().hex}"
    affected = rewrite_affected(own, placed, folder, id_col, text_col, F.col("old_shard"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", slot long, shard int"
    text = F.coalesce(F.col(text_col), F.lit(""))
    columns = [id_col, "size", "text_crc32", "old_shard", "shard", "slot"]
    read = spark.read.schema(schema).parquet(folder).withColumns({"size": (F.octet_length(text) + OVERHEAD).cast("long"), "text_crc32": F.crc32(text.cast("binary"))})
    return read.select(columns).union(placed.where(~F.col("shard").isin(affected)).select(columns))
