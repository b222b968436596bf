"""Periodic runs of words: stretches that repeat themselves, found by bit-parallel comparison of a text with itself.

The words of a text are numbered; bit b of all numbers is one big integer, its plane b. A plane XOR itself shifted by q
marks the places where words q apart differ in that bit, so the OR over the planes marks all that differ; ANDing the
complement with itself shifted by 1, 2, 4, ... leaves a bit where a long enough stretch without a difference starts.
Each lag costs a few operations on whole integers, whatever the words.

A run is a stretch of consecutive words with smallest period q and at least max(SHORTEST, REPEATS * q) words that no
neighbouring word extends with that period. Stretches of a multiple of q that a run of q covers are the same stretch
(two periods that fit twice into a stretch have a common divisor that is a period), so each is kept at its least lag.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; texts shorter than SHORTEST words
have no runs; repeated rows are judged one by one; rows with a null id keep it, and are never planted with repeats; an
empty table gives an empty result; further columns are ignored. Texts are read whole; the cost of one grows with the
square of its words over the bits of an integer's digit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailwise.llm.common import WORD_SPLIT, id_text

#: Words of a run at least, and how often its period must fit.
SHORTEST = 24
REPEATS = 3
#: Planes that are compared before a lag without a long stretch is left.
FIRST_PLANES = 3
#: Texts that are Python objects at a time.
SLICE = 256
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def bit_planes(ids: np.ndarray) -> list[int]:
    """Bit b of all ids as one integer, the first id lowest, for each b that some id has."""
    width = int(ids.max(initial=0)).bit_length()
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(width)]


def long_stretches(same: int, need: int) -> int:
    """Bits where need or more set bits in a row start: AND with itself, shifted by doubling steps."""
    have = 1
    while same and have < need:
        step = min(have, need - have)
        same &= same >> step
        have += step
    return same


def stretches(starts: int, need: int) -> list[tuple[int, int]]:
    """First bit and number of bits of each maximal stretch, from the starts that long_stretches leaves."""
    raw = starts.to_bytes(starts.bit_length() // 8 + 1, "little")
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
    edge = np.flatnonzero(np.diff(bits, prepend=0, append=0))
    return [(a, b - a + need - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def find_runs(ids: np.ndarray, shortest: int = SHORTEST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """start, length, period of each run of a text's numbered words, by start, then period."""
    if repeats < 2:
        raise ValueError("a period must fit twice at least")
    n = len(ids)
    if n < shortest:
        return []
    planes, whole = bit_planes(ids), (1 << n) - 1
    first, rest = planes[:FIRST_PLANES], planes[FIRST_PLANES:]
    found: dict[tuple[int, int], int] = {}
    for q in range(1, n // repeats + 1):
        need, inside, differ = max(shortest, repeats * q) - q, whole >> q, 0
        for plane in first:
            differ |= plane ^ plane >> q
        starts = long_stretches(differ & inside ^ inside, need)
        if starts and rest:
            for plane in rest:
                differ |= plane ^ plane >> q
            starts = long_stretches(differ & inside ^ inside, need)
        if starts:
            for start, size in stretches(starts, need):
                found.setdefault((start, size + q), q)
    return sorted((start, length, q) for (start, length), q in found.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run keeps its first period alone."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def collapse(docs: DataFrame, shortest: int = SHORTEST, repeats: int = REPEATS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period) and collapsed: the words that are in no run, or
    among the first period of every run they are in, joined by one space."""

    def one(text: str) -> tuple[int, list[tuple[int, int, int]], str]:
        words = text.encode().split()  # at the same six bytes as WORD_SPLIT
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
        runs = find_runs(ids, shortest, repeats)
        if runs:
            words = [w for w, stays in zip(words, kept_words(len(words), runs).tolist(), strict=True) if stays]
        return len(ids), runs, b" ".join(words).decode()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = [one(t) for t in part.column(1).to_pylist()]
                flat = np.array([r for _, runs, _ in rows for r in runs], dtype=np.int64).reshape(-1, 3)
                ends = np.cumsum([0] + [len(runs) for _, runs, _ in rows])
                items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _, _ in rows], pa.int64()), listed, pa.array([c for _, _, c in rows], pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return id_text(docs).mapInArrow(scan, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, one id in ten with repeats planted: with h the id's CRC and g = h div 10, h divisible by 10, word
    i >= a of the text's n becomes word a + (i - a) % p, where a = g % n and p = 1 + (n - a) div (3 + g % 8)."""
    rows = id_text(docs)
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", WORD_SPLIT), lambda w: w != "")

    def again(own: Column) -> Column:
        n, g = F.size(own), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(own, lambda w, i: F.when(i < a, w).otherwise(F.get(own, (a + (i - a) % p).cast("int")))), " ")

    # A one-element array binds the words to a name, so they are split once a text and not once a word.
    text = F.get(F.transform(F.array(words), lambda own: F.when(F.size(own) > 0, again(own)).otherwise(F.lit(""))), F.lit(0))
    return rows.select("doc_id", F.when(h % 10 == 0, text).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with the greatest length / period (ties: first start, then period) and its ratio in
    thousandths, and digests of the runs and of the collapsed text."""
    best = F.aggregate("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))
    printed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = found.withColumn("_best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{k}").alias(k) for k in ("start", "length", "period")],
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(printed, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
