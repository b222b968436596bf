"""Languages of a text as a mixture: expectation-maximisation over n-gram likelihoods, with a penalised choice of the set.

A language's model is an interpolated chain of characters: the chance of a letter after the two before it, backed off to
the one before and to none, from counts in a hashed table of fixed size; a word's likelihood is the product over its
letters and its end. A text's words are drawn from a mixture of languages. Expectation-maximisation over all languages
ranks them by proportion; then sets of the first 1, 2, ... are fitted, as long as the log-likelihood gains more than the
penalty for one more proportion. The prediction is the largest proportion of the chosen set, which is the score too.

Learned are counts of all texts with a language, apart from held-out ones; with more than MAX_LANGUAGES values of lang,
those with the most texts (ties by name): that bounds the model that is sent to all tasks.

Defined cases: a text that is null or has no letter is `und`, score 0, no languages; with nothing learned every text is;
a null id is never learned from and counts as held out; repeated rows are judged one by one, but each counts in the
learning; an empty table gives an empty result; further columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: letters with the marks on them.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Cells of a language's hashed table.
BUCKETS = 65_536
#: Weight of the shorter context in counts.
BACKOFF = 5.0
#: Characters that share what no count covers.
ALPHABET = 1024
#: Languages learned at most: the model takes 4 * BUCKETS bytes each.
MAX_LANGUAGES = 256
#: One id in HELD_OUT is never learned from.
HELD_OUT = 5
#: Half logarithms of the number of words that one more language must gain.
PENALTY = 2.0
#: Natural logarithm of the largest ratio between languages that one word can give.
CLIP = 30.0
STEPS = 30
TOLERANCE = 1e-3
UNKNOWN = "und"
#: Texts that are Python objects at a time, and cells of the matrices of a slice and of the words kept.
SLICE = 256
CELLS = 2_000_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT == 0, F.lit(True))


def counted(text: str | None) -> dict[str, int]:
    """How often each word is in the text, in lower case."""
    out: dict[str, int] = {}
    for token, n in Counter((text or "").lower().split()).items():  # no white space is in a word
        for w in (token,) if token.isalpha() else WORD.findall(token):
            out[w] = out.get(w, 0) + n
    return out


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Five buckets of each letter and end of the words (its trigram, the trigram's context, its bigram, the bigram's
    context, itself) and the word's place."""
    sizes = np.array([len(w) for w in words]) + 1
    s = np.frombuffer("".join(["\0\0" + w + "\0" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    own = np.ones(len(s), dtype=bool)
    starts = np.cumsum(sizes + 2) - sizes - 2
    own[starts] = own[starts + 1] = False
    at = np.flatnonzero(own)
    c, b, a = s[at], s[at - 1], s[at - 2]
    step = np.uint64(1_000_003)
    pair = a * step + b
    keys = [pair * step + c, pair, b * step + c, b, c]
    out = np.array([(k * np.uint64(8) + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48) for kind, k in enumerate(keys)], dtype=np.int64)
    return out, np.repeat(np.arange(len(words)), sizes)


def learn(docs: DataFrame, lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """The learned languages in order, and their tables of counts (a row each)."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col(lang_col).cast("string").alias("lang"), "text")
    most = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    names = sorted(r["lang"] for r in most)
    number = {n: k for k, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        held: dict[int, Counter] = {}

        def settle() -> None:
            for k, words in held.items():
                found, place = grams(list(words))
                weight = np.fromiter(words.values(), np.float64, len(words))[place]
                own = total.setdefault(k, np.zeros(BUCKETS))
                for b in found:
                    own += np.bincount(b, weight, BUCKETS)
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if lang in number:
                        held.setdefault(number[lang], Counter()).update(counted(text))
                if sum(map(len, held.values())) > 200_000:
                    settle()
        settle()
        for k, own in total.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), pa.array(own[some].astype(np.int64))], ["k", "bucket", "n"])

    table = np.zeros((len(names), BUCKETS), dtype=np.float32)
    if names:
        sums = rows.mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toPandas()  # a fixed number of cells a language
        table[sums["k"], sums["bucket"]] = sums["n"]
    return names, table


def word_likelihoods(words: list[str], table: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word (a row) in each language. sizes: letters and ends counted in each language."""
    (tri, context, bi, before, uni), place = grams(words)
    p = (table[:, uni] + 1.0) / (sizes[:, None] + ALPHABET)
    p = (table[:, bi] + BACKOFF * p) / (table[:, before] + BACKOFF)
    p = (table[:, tri] + BACKOFF * p) / (table[:, context] + BACKOFF)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return np.add.reduceat(np.log(np.minimum(p, 1.0)), first, axis=1).T


def mixtures(likely: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the languages (columns of likely) and log-likelihood of each text by expectation-maximisation. likely
    and counts have a row for each of a text's distinct words, starts each text's first row."""
    sizes = np.add.reduceat(counts, starts)
    owner = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(counts)))
    share = np.full((len(starts), likely.shape[1]), 1.0 / likely.shape[1])
    for _ in range(STEPS):
        joint = likely * share[owner]
        whole = joint.sum(axis=1)
        new = np.add.reduceat(joint * (counts / whole)[:, None], starts) / sizes[:, None]
        moved = np.abs(new - share).max()
        share = new
        if moved < TOLERANCE:
            break
    return share, np.add.reduceat(counts * np.log((likely * share[owner]).sum(axis=1)), starts)


def choose(likely: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Proportions of each text's chosen languages; others have 0."""
    n, d = len(starts), likely.shape[1]
    every, _ = mixtures(likely, counts, starts)
    order = np.argsort(-every, axis=1, kind="stable")
    sizes = np.diff(starts, append=len(counts))
    owner = np.repeat(np.arange(n), sizes)
    cost = PENALTY * 0.5 * np.log(np.maximum(np.add.reduceat(counts, starts), 1))
    best = np.zeros((n, d))
    best[np.arange(n), order[:, 0]] = 1.0
    value = np.add.reduceat(counts * np.log(likely[np.arange(len(owner)), order[owner, 0]]), starts)
    tried = np.arange(n)
    for k in range(2, d + 1):
        if not len(tried):
            break
        rows = np.flatnonzero(np.isin(owner, tried))
        own, first = sizes[tried], order[tried, :k]
        share, found = mixtures(np.take_along_axis(likely[rows], np.repeat(first, own, axis=0), axis=1), counts[rows], np.cumsum(own) - own)
        found -= cost[tried] * (k - 1)
        better = found > value[tried]
        tried, share, first = tried[better], share[better], first[better]
        value[tried] = found[better]
        best[tried] = 0.0
        best[tried[:, None], first] = share
    return best


class Judge:
    """Predictions by one model; keeps the likelihoods of words met before."""

    def __init__(self, names: list[str], table: np.ndarray):
        self.names, self.table = names, table
        whole, _ = grams([""])
        self.sizes = table.sum(axis=1, dtype=np.float64) / len(whole)
        self.place: dict[str, int] = {}
        self.known = np.zeros((0, len(names)), dtype=np.float32)

    def _look_up(self, words: list[list[str]]) -> None:
        met = set().union(*words)
        new = list(met - self.place.keys())
        if len(self.place) and (len(self.place) + len(new)) * len(self.names) > CELLS:
            self.place, self.known = {}, self.known[:0]
            new = list(met)
        parts = [self.known]
        for at in range(0, len(new), 5000):
            parts.append(word_likelihoods(new[at : at + 5000], self.table, self.sizes).astype(np.float32))
        self.place |= {w: len(self.place) + k for k, w in enumerate(new)}
        self.known = np.concatenate(parts)

    def shares(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Proportions of each text's languages; None for texts without a letter."""
        found = [counted(t) for t in texts]
        out: list[np.ndarray | None] = [None] * len(texts)
        if not self.names:
            return out
        group: list[int] = []
        cells = 0
        for k, c in enumerate(found):
            if c:
                group.append(k)
                cells += len(c) * len(self.names)
            if group and (k + 1 == len(found) or cells > CELLS):
                self._group(group, found, out)
                group, cells = [], 0
        return out

    def _group(self, group: list[int], found: list[dict[str, int]], out: list) -> None:
        words = [list(found[g]) for g in group]
        self._look_up(words)
        rows = np.array([r for own in words for r in map(self.place.__getitem__, own)])
        logs = self.known[rows].astype(np.float64)
        likely = np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -CLIP))
        counts = np.array([n for g in group for n in found[g].values()], dtype=np.float64)
        sizes = np.array([len(own) for own in words])
        for g, share in zip(group, choose(likely, counts, np.cumsum(sizes) - sizes), strict=True):
            out[g] = share


def predict(docs: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages (the chosen set, largest proportion first) and shares."""
    sent = docs.sparkSession.sparkContext.broadcast((names, table))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Judge(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                listed, shares = [], []
                for share in own.shares(part.column(2).to_pylist()):
                    order = [] if share is None else [k for k in np.argsort(-share, kind="stable").tolist() if share[k] > 0]
                    listed.append([own.names[k] for k in order])
                    shares.append([min(1.0, float(share[k])) for k in order])
                top = [(n[0], s[0]) if n else (UNKNOWN, 0.0) for n, s in zip(listed, shares, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([n for n, _ in top], pa.string()), pa.array([s for _, s in top], pa.float64()), pa.array(listed, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], ["doc_id", "held_out", "lang_pred", "score", "languages", "shares"])

    return rows.mapInArrow(judge, "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>")
