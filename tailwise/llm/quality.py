"""Quality rules: fixed text rules, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word uni- and bigrams are estimated: one from trusted documents (labelled
quality 1 and not toxic), one from the whole raw corpus. A document's score is its mean log ratio per n-gram;
documents below a fixed threshold are rejected, so the decision depends on nothing but the two tables.

Defined cases: a null or empty text has no words and fails the base rules; without any trusted document the
ratio is not defined and the base rules alone decide (score 0); equal texts get equal verdicts; repeated rows
are judged one by one; an empty table gives an empty result; further columns are ignored by the scorer and
passed through by keep_documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailwise.llm.common import id_text, keep_tables

BUCKETS = 65_536
#: Values of a batch that are Python objects at a time; an idle worker keeps the memory for a minute.
SLICE = 256
#: Bound of the labelled sample that the trusted multinomial is fitted on.
TARGET_DOCS = 20_000
SMOOTHING = 1.0
#: Nats per n-gram.
THRESHOLD = -0.15
MIN_WORDS = 50
MULTIPLIER = 1_000_003
SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
CACHE = 400_000

_hashes: dict[bytes, int] = {}


def _each(column: pa.Array) -> Iterator:
    """The column's values, SLICE of them in memory at a time."""
    for k in range(0, len(column), SLICE):
        yield from column.slice(k, SLICE).to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The first 32 bits of each word's MD5."""
    if len(_hashes) > CACHE:
        _hashes.clear()
    try:
        return np.array(list(map(_hashes.__getitem__, words)), dtype=np.int64)
    except KeyError:
        for w in words:
            if w not in _hashes:
                _hashes[w] = int.from_bytes(hashlib.md5(w).digest()[:4], "big")
        return np.array(list(map(_hashes.__getitem__, words)), dtype=np.int64)


def local_ids(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Each word's number in order of first appearance, and the distinct words."""
    first: dict[bytes, int] = {}
    number = first.setdefault
    ids = np.array([number(w, len(first)) for w in words], dtype=np.int64)
    return ids, list(first)


def ngram_buckets(ids: np.ndarray, distinct: list[bytes], buckets: int) -> np.ndarray:
    h = word_hashes(distinct)[ids]
    return np.concatenate([h % buckets, (h[:-1] * MULTIPLIER + h[1:]) % buckets])


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside a 3-word window that the text has twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    if distinct < 1 << 20:
        key = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:
        pair = np.unique(ids[:-2] * distinct + ids[1:-1], return_inverse=True)[1]
        key = pair.astype(np.int64) * distinct + ids[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    again = np.zeros(n - 2, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(n, dtype=bool)
    cover[:-2] |= again
    cover[1:-1] |= again
    cover[2:] |= again
    return int(cover.sum())


def duplicate_lines(text: str) -> int:
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    seen: set[str] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += 1
        elif line.strip(SPACES):
            seen.add(line)
    return n


def base_stats(text: str, ids: np.ndarray, distinct: int) -> tuple[int, int, int, int, int, bool]:
    n = len(ids)
    chars = len(text) - sum(map(text.count, SPACES))
    repeats = repeated_words(ids, distinct)
    failed = n < MIN_WORDS or 100 * repeats > 50 * n
    return n, chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeats, failed


def trusted_ids(labels: DataFrame, bound: int = TARGET_DOCS) -> DataFrame:
    """Ids of trusted documents, at most bound of them, chosen by hash. Contradicting labels disqualify."""
    return (
        labels.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
        .where("q = 1 and t = 0")
        .select(F.col("doc_id").cast("long").alias("trusted_id"))
        .orderBy(F.xxhash64("trusted_id"), "trusted_id")
        .limit(bound)
    )


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log ratio of the trusted to the raw multinomial for each bucket; zeros if nothing is trusted.

    Raw counts cover every document. The table has a fixed number of buckets, so collecting it is bounded.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_tables("quality", _hashes.clear)
        total = np.zeros((2, buckets), dtype=np.int64)
        held: list[list[np.ndarray]] = [[], []]
        size = 0
        for batch in batches:
            for text, trusted in zip(_each(batch.column(0)), _each(batch.column(1)), strict=True):
                words = text.encode().split()
                if not words:
                    continue
                b = ngram_buckets(*local_ids(words), buckets)
                held[0].append(b)
                if trusted:
                    held[1].append(b)
                size += len(b)
                if size > 1_000_000:
                    for k in (0, 1):
                        if held[k]:
                            total[k] += np.bincount(np.concatenate(held[k]), minlength=buckets)
                    held, size = [[], []], 0
        for k in (0, 1):
            if held[k]:
                total[k] += np.bincount(np.concatenate(held[k]), minlength=buckets)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[0][some]), pa.array(total[1][some])], ["bucket", "raw", "trusted"])

    marked = (
        id_text(docs)
        .join(F.broadcast(trusted_ids(labels)), F.col("doc_id") == F.col("trusted_id"), "left")
        .select("text", F.col("trusted_id").isNotNull().alias("trusted"))
    )
    rows = marked.mapInArrow(count, "bucket int, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).collect()
    counts = np.zeros((2, buckets))
    for r in rows:
        counts[:, r["bucket"]] = r["raw"], r["trusted"]
    if not counts[1].any():
        return np.zeros(buckets)
    p = (counts + smoothing) / (counts.sum(axis=1, keepdims=True) + smoothing * buckets)
    return np.log(p[1]) - np.log(p[0])


def _judge(text: str, weights: np.ndarray, threshold: float) -> tuple:
    ids, distinct = local_ids(text.encode().split())
    stats = base_stats(text, ids, len(distinct))
    llr = 0.0
    if len(ids):
        llr = float(weights[ngram_buckets(ids, distinct, len(weights))].mean())
    return (*stats, not stats[-1] and llr >= threshold, llr)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, verdict and score of each document."""
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_tables("quality", _hashes.clear)
        w = sent.value
        for batch in batches:
            rows = [_judge(t, w, threshold) for t in _each(batch.column(1))]
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"])

    return id_text(docs).mapInArrow(judge, schema)


def keep_documents(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_tables("quality", _hashes.clear)
        w = sent.value
        for batch in batches:
            yield batch.filter(pa.array([_judge(t or "", w, threshold)[-2] for t in _each(batch.column(at))], pa.bool_()))

    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # names with dots can't be passed
    return plain.mapInArrow(judge, plain.schema).toDF(*docs.columns)
