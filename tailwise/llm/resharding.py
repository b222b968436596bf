"""Minimum-cost-flow resharding: which blocks of old shards move so that the fewest bytes do.

Old shards with their sizes on one side, new shards with their capacities on the other; a byte that stays in its
shard costs nothing, one that moves costs one. The flow says how many bytes go from which shard to which. A
shard's rows are laid out in a fixed order and its byte range is cut into blocks, the staying one first; a row
belongs to the block that holds its middle byte. rewrite_shards then writes the shards whose rows change, texts
and all, and leaves the others alone; what reshard returns of the written ones is read back from their files.

Defined cases: a null text has no bytes and its own 8 bytes of overhead; rows with a null shard key are of old
shard 0; equal texts, repeated ids and repeated rows are placed and written one by one; an empty table gives an
empty result; further columns are carried along.
"""

from __future__ import annotations

import heapq
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tailwise.llm.common import shared_dir, staged

SHARDS = 24
OVERHEAD = 8
#: Rows whose places are counted together.
BUCKET_ROWS = 5_000
#: Of rows in a bucket; rows that tie have the same size.
ORDER = ["doc_id", "size", "text_crc32"]


def min_cost_flow(supply: list[int], room: list[int], cost) -> dict[tuple[int, int], int]:
    """Units from each source to each sink, all of supply, at least total cost: successive shortest paths with
    potentials. The graph has a node per shard, so it doesn't grow with the rows."""
    if sum(supply) > sum(room):
        raise ValueError("capacities are too small")
    n, m = len(supply), len(room)
    s, t = n + m, n + m + 1
    to: list[int] = []
    left: list[int] = []
    price: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, units: int, each: int) -> None:
        out[a].append(len(to))
        to.append(b), left.append(units), price.append(each)
        out[b].append(len(to))
        to.append(a), left.append(0), price.append(-each)

    for i, units in enumerate(supply):
        edge(s, i, units, 0)
    for j, units in enumerate(room):
        edge(n + j, t, units, 0)
    first = len(to)
    for i in range(n):
        for j in range(m):
            edge(i, n + j, supply[i], cost(i, j))
    potential, needed = [0] * (n + m + 2), sum(supply)
    while needed:
        best, via = [float("inf")] * (n + m + 2), [-1] * (n + m + 2)
        best[s] = 0
        heap = [(0, s)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > best[a]:
                continue
            for e in out[a]:
                b = to[e]
                if left[e] and d + price[e] + potential[a] - potential[b] < best[b]:
                    best[b], via[b] = d + price[e] + potential[a] - potential[b], e
                    heapq.heappush(heap, (best[b], b))
        for v, d in enumerate(best):
            if d < float("inf"):
                potential[v] += d
        push, b = needed, t
        while b != s:
            push, b = min(push, left[via[b]]), to[via[b] ^ 1]
        b = t
        while b != s:
            left[via[b]] -= push
            left[via[b] ^ 1] += push
            b = to[via[b] ^ 1]
        needed -= push
    return {(i, j): left[first + 2 * (i * m + j) + 1] for i in range(n) for j in range(m) if left[first + 2 * (i * m + j) + 1]}


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def blocks(sizes: dict[int, int], shards: int) -> list[tuple[int, int, int, int]]:
    """(old, from, to, new) for each block: bytes from .. to of an old shard go to a new one. What stays is first."""
    old = sorted(sizes)
    flow = min_cost_flow([sizes[o] for o in old], equal_capacities(sum(sizes.values()), shards), lambda i, j: int(old[i] != j))
    out, at = [], defaultdict(int)
    for (i, j), units in sorted(flow.items(), key=lambda x: (x[0][0], old[x[0][0]] != x[0][1], x[0][1])):
        out.append((old[i], at[i], at[i] + units, j))
        at[i] += units
    return out


def _running(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with the sum of value over the rows before, within keys, in the order of _bucket and order. Buckets
    are summed first, so a large key is many tasks' work."""
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(base, [*keys, "_bucket"]).withColumn(name, F.col("_base") + F.col("_in")).drop("_base", "_in")


def _sizes(old_shard, id_col: str, text_col: str) -> dict[str, Column]:
    """The columns by which rows are placed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return {
        "doc_id": F.col(id_col).cast("long"),
        "size": (F.octet_length(text) + OVERHEAD).cast("long"),
        "text_crc32": F.crc32(text.cast("binary")),
        "old_shard": F.coalesce(old_shard, F.lit(0)).cast("int"),
    }


def _bucket(buckets: int, doc_id) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


def place(docs: DataFrame, old_shard, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """doc_id, size, text_crc32, old_shard, _bucket, _at, shard, slot for each row, from the sizes alone, and the number of
    buckets. old_shard is a Column of 0 .. shards - 1, where the rows are now."""
    rows = docs.select(*(c.alias(k) for k, c in _sizes(old_shard, id_col, text_col).items()))
    rows = staged(rows, "sizes")
    found = rows.groupBy("old_shard").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row per shard
    moves = blocks({r["old_shard"]: r["size"] for r in found}, shards)
    spark = docs.sparkSession
    buckets = max(1, -(-max((r["n"] for r in found), default=0) // BUCKET_ROWS))
    rows = rows.withColumn("_bucket", _bucket(buckets, F.col("doc_id")))
    rows = _running(rows, ["old_shard"], ORDER, "size", "_at")
    if moves:
        table = spark.createDataFrame([(o, (o << 48) + a, (o << 48) + b, n) for o, a, b, n in moves], "o int, _from long, _to long, shard int").select(F.array_sort(F.collect_list(F.struct("_from", "_to", "shard")).over(Window.partitionBy("o"))).alias("b"), "o").distinct()
    else:
        table = spark.createDataFrame([], "b array<struct<_from:long,_to:long,shard:int>>, o int")
    # A row per old shard: its blocks. The row's middle byte picks one.
    rows = rows.join(F.broadcast(table), F.col("old_shard") == F.col("o"))
    rows = rows.withColumn("shard", F.expr("element_at(filter(b, x -> x._to > (cast(old_shard as long) << 48) + _at + size div 2), 1).shard")).drop("b", "o")
    rows = _running(rows.withColumn("_one", F.lit(1).cast("long")), ["shard", "old_shard"], ORDER, "_one", "_slot")
    counts = {(r["shard"], r["old_shard"]): r["n"] for r in rows.groupBy("shard", "old_shard").agg(F.count("*").alias("n")).collect()}  # shards * shards rows at most
    starts, total = [], defaultdict(int)
    for (new, old), n in sorted(counts.items()):
        starts.append((new, old, total[new]))
        total[new] += n
    base = spark.createDataFrame(starts, "shard int, old_shard int, _start long")
    rows = rows.join(F.broadcast(base), ["shard", "old_shard"])
    return rows.select("doc_id", "size", "text_crc32", "old_shard", "_bucket", "_at", "shard", (F.col("_start") + F.col("_slot")).alias("slot")), buckets


def rewrite_shards(docs: DataFrame, old_shard, placed: DataFrame, buckets: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """Write the rows of the affected shards (those that gain or lose rows), with all columns of docs under row, to
    path/shard=k, and return these shards. placed and buckets are from place().

    A bucket's rows of one new shard follow each other in the bucket's order and in the shard, so a row's number in
    its bucket says where it goes: texts are dealt once, by bucket, and repeated rows stay single."""
    spark = docs.sparkSession
    affected = sorted(r[0] for r in placed.where("old_shard <> shard").select(F.explode(F.array("old_shard", "shard"))).distinct().collect())  # shard numbers
    if not affected:
        return affected
    runs = placed.where(F.col("old_shard").isin(affected)).groupBy("old_shard", "_bucket", "shard").agg(F.min("_at").alias("_at"), F.count("*").alias("n"), F.min("slot").alias("slot"))
    before = Window.partitionBy("old_shard", "_bucket").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    runs = staged(runs.groupBy("old_shard", "_bucket").agg(F.array_sort(F.collect_list(F.struct("_first", "slot", "shard"))).alias("_runs")), "runs")
    # A row of an affected old shard stays in it or moves, so it goes to an affected shard.
    rows = docs.select(*(c.alias(k) for k, c in _sizes(old_shard, id_col, text_col).items()), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.where(F.col("old_shard").isin(affected)).withColumn("_bucket", _bucket(buckets, F.col("doc_id")))
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy("old_shard", "_bucket").orderBy(*ORDER)).cast("long") - 1)
    rows = rows.join(runs, ["old_shard", "_bucket"]).withColumn("_run", F.expr("element_at(filter(_runs, x -> x._first <= _i), -1)"))
    rows = rows.select("row", "old_shard", (F.col("_run.slot") + F.col("_i") - F.col("_run._first")).alias("slot"), F.col("_run.shard").alias("shard"))
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return affected


def reshard(docs: DataFrame, old_shard, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, old_shard, shard, slot, grown_shard for each row: of the affected shards as
    read back from their new files, of the others as they are. The files are in path; without one they are in the
    shared folder and go when the driver ends."""
    spark = docs.sparkSession
    placed, buckets = place(docs, old_shard, shards, id_col, text_col)
    placed = staged(placed, "placed")
    path = path or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    affected = rewrite_shards(docs, old_shard, placed, buckets, path, id_col, text_col)
    columns = ["doc_id", "size", "text_crc32", "old_shard", "shard", "slot"]
    found = placed.where(~F.col("old_shard").isin(affected)).select(columns)
    if affected:
        kind = StructType([StructField("row", docs.schema), StructField("old_shard", IntegerType()), StructField("slot", LongType()), StructField("shard", IntegerType())])
        new = spark.read.schema(kind).parquet(path)
        if new.count() != placed.where(F.col("old_shard").isin(affected)).count():
            raise RuntimeError("the new files have other rows than were placed: the input changed between two reads")
        of_row = _sizes(F.col("old_shard"), f"row.`{id_col}`", f"row.`{text_col}`")
        found = found.unionByName(new.select(*(c.alias(k) for k, c in of_row.items()), "shard", "slot"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "old_shard", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
