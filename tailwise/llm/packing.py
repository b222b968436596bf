"""Best-fit-decreasing packing of token pieces into sequences of a fixed capacity.

Lengths are at most the capacity, so best fit decreasing needs only the histogram of lengths: equal pieces are
placed in bulk, and open bins are held by remaining capacity under a segment tree that finds the tightest fit
in logarithmic time. The plan says, for the k-th piece of each length, its bin and offset; its size depends on
the capacity, not on the rows. Pieces get their number within their length by counting in buckets of bounded
size, so no length, however common, is one task's work.

Defined cases: a null or empty text is the end id alone; equal texts and repeated rows are packed one by one;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailwise.llm.common import id_text, staged
from tailwise.llm.tokens import library_encoder

CAPACITY = 1024
END_ID = 2
#: Pieces of one length that are numbered together.
BUCKET_ROWS = 50_000
#: Documents of a batch that are encoded together: what a Python worker holds at once, beside the encoder's tables.
ENCODED_ROWS = 250
#: Bound of the encoder's tables of chunks, below its own: two workers share an executor's memory with a full heap.
TABLE_CHUNKS = 300_000


class CapacityTree:
    """Numbers of open bins by remaining capacity; finds the least capacity of at least some length."""

    def __init__(self, capacity: int):
        self.width = 1 << (capacity + 1).bit_length()
        self.sums = [0] * (2 * self.width)

    def add(self, remaining: int, bins: int) -> None:
        at = self.width + remaining
        while at:
            self.sums[at] += bins
            at //= 2

    def tightest(self, length: int) -> int | None:
        at = self.width + length
        if self.sums[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.sums[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.sums[2 * at] else 2 * at + 1
                return at - self.width
            at //= 2
        return None


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first, count, bin, per_bin, offset): pieces first to first + count of a length go, per_bin
    at a time, to bins from bin on, the first of each bin at offset."""
    tree, open_bins, rows, bins = CapacityTree(capacity), defaultdict(list), [], 0

    def put(remaining: int, start: int, count: int) -> None:
        if remaining and count:
            open_bins[remaining].append((start, count))
            tree.add(remaining, count)

    for length in sorted(histogram, reverse=True):
        left, k = histogram[length], 0
        while left:
            r = tree.tightest(length)
            if r is None:
                fresh = -(-left // (capacity // length))
                put(capacity, bins, fresh)
                bins += fresh
                continue
            start, count = open_bins[r].pop()
            tree.add(r, -count)
            q = r // length
            used = min(count, left // q)
            if not used:
                used, q = 1, left
            rows.append((length, k, used * q, start, q, capacity - r))
            put(r - q * length, start, used)
            put(r, start + used, count - used)
            k += used * q
            left -= used * q
    return np.array(rows, dtype=np.int64).reshape(-1, 6)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Token pieces of each document, the end id included. Documents longer than the capacity are cut so that
    all pieces but the first are full."""
    end = np.array([end_id], dtype="<u4")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        encoder.bound = TABLE_CHUNKS
        for batch in (b.slice(at, ENCODED_ROWS) for b in batches for at in range(0, b.num_rows, ENCODED_ROWS)):
            cols: list[list] = [[], [], [], [], [], []]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.ids(batch.column(1).to_pylist()), strict=True):
                ids = np.concatenate((ids.astype("<u4"), end)).tobytes()
                n = len(ids) // 4
                stop, start, piece = n % capacity or capacity, 0, 0
                while start < n:
                    own = ids[4 * start : 4 * stop]
                    for c, v in zip(cols, (doc_id, piece, start, stop - start, zlib.crc32(own), own), strict=True):
                        c.append(v)
                    start, stop, piece = stop, stop + capacity, piece + 1
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(cols[5], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return id_text(docs).mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def numbered(rows: DataFrame, key: str, tie: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rows with nth: 0, 1, ... within each key. A key with many rows is numbered in buckets of bounded size."""
    counts = rows.groupBy(key).count().withColumn("_buckets", F.ceil(F.col("count") / bucket_rows)).select(key, "_buckets")
    dealt = rows.join(F.broadcast(counts), key).withColumn("_bucket", F.pmod(F.xxhash64(*tie), "_buckets"))
    sums = dealt.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*tie)
    return dealt.withColumn("_row", F.row_number().over(inside)).join(base, [key, "_bucket"]).withColumn("nth", F.col("_base") + F.col("_row") - 1).drop("_buckets", "_bucket", "_row", "_base")


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (doc_id, piece, length <= capacity, ...) with sequence_id and offset. The histogram of lengths has at
    most capacity rows. rows is read three times and should be stored."""
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    table = plan(histogram, capacity)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    sent = rows.sparkSession.sparkContext.broadcast(table)
    keyed = numbered(rows, "length", ["doc_id", "piece"])
    at_length, at_nth = keyed.columns.index("length"), keyed.columns.index("nth")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        key = (t[:, 0] << 44) + t[:, 1]
        for batch in batches:
            length = batch.column(at_length).to_numpy(zero_copy_only=False)
            nth = batch.column(at_nth).to_numpy(zero_copy_only=False)
            row = t[np.searchsorted(key, (length << 44) + nth, side="right") - 1]
            j = nth - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [c for i, c in enumerate(batch.columns) if i != at_nth] + [pa.array(row[:, 3] + j // row[:, 4]), pa.array(row[:, 5] + j % row[:, 4] * length)],
                [n for i, n in enumerate(batch.schema.names) if i != at_nth] + ["sequence_id", "offset"],
            )

    fields = ", ".join(f"`{n}` {t}" for n, t in keyed.dtypes if n != "nth")
    return keyed.mapInArrow(place, fields + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    placed = pack(staged(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves from placed pieces with ids: sequence_id, ids (little-endian 32-bit)."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    return placed.groupBy("sequence_id").agg(F.unhex(F.array_join(parts, "")).alias("ids"))
