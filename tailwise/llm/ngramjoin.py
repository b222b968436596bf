"""N-gram Jaccard join by prefix trees, exact, with the connected groups of near copies as its result.

Words are lower-cased (A-Z), a document's set is its distinct 5-word shingles as 64-bit hashes. Documents with
equal sets form a class, and one stands for it. Sets are ordered globally, rare shingles first. Two sets that reach
the threshold share a shingle of their prefixes; of prefixes that are longer by so many places they share so many.
A set whose long prefix meets fewer shingles of other sets than that is linked with nothing and goes. Sorting the
prefix shingles of the rest brings candidates together; those whose sizes are compatible and whose parity bitmaps
(which bound the symmetric difference from below) don't rule the pair out are connected to clusters, outside which
there are no links. Within a cluster the sets are stored in a trie; each set walks it once, sharing the overlap of
common paths, and leaves subtrees that are too short to reach the threshold or whose sets it is already connected
with.

A large cluster is dealt into chunks, each with some sets that all chunks have. What one round doesn't connect with
the cluster's largest component then meets the whole cluster, chunk by chunk, so a large group of near copies costs
in proportion to its size.

The global order needs frequent shingles only: every task counts its own and reports those it meets often, the
most frequent are sent to all. The order decides the speed, never the result.

Defined cases: a null or empty text has no shingles and is linked with nothing, its component is its doc_id;
fewer words than five are one shingle; equal texts are in one component; repeated rows count as equal texts, of
which keep_first keeps one; a null doc_id stands for its class only if no other does; a component without ids has a
null component_id, and keep_first keeps one of its rows; an empty table gives an
empty result; further columns are ignored by join and passed through by keep_first.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailwise.llm.common import discard, free_name, staged
from tailwise.llm.components import components

WORDS = 5
#: Jaccard similarity of 3 / 4: links when 4 * intersection >= 3 * union.
NUMERATOR, DENOMINATOR = 3, 4
#: A task reports shingles that it has counted this often among so many.
OFTEN, COUNTED = 3, 2_000_000
#: Frequent shingles sent to all tasks, at most; more would only be faster.
FREQUENT = 1 << 20
#: The long prefix has a place more for so many shingles of the set.
MORE = 12
#: Bits of a set's size in a posting; larger sizes count as the largest. One more bit says whether the shingle is in
#: the short prefix, the others are of its hash.
SIZE_BITS = 21
MOST = (1 << SIZE_BITS) - 1
LOW_BITS = SIZE_BITS + 1
#: Bits of a parity bitmap.
PARITY = 1024
#: Sets of more shingles have a longer bitmap besides, for the pairs that the short one lets pass.
BIG, BIG_PARITY = 1400, 16_384
#: Members of a run that are compared side by side with those next to them; longer runs are joined by groups.
NEAR = 32
#: Members from which a run is joined unseen: a larger cluster, never a lost link.
LONG = 20_000
#: Members whose groups a task remembers.
KNOWN = 200_000
#: Sets of a chunk, their shingles, and sets that all chunks of a cluster have.
CHUNK, CHUNK_SHINGLES, PIVOTS = 1000, 500_000, 50
#: Bytes of text that a task works on at once.
SLICE = 1_000_000
#: Rows of cluster members that are broadcast at most (32 bytes each).
BROADCAST_ROWS = 1_000_000
#: Lots in which classes without ids are numbered.
LOTS = 1024

U = np.uint64
_rng = np.random.default_rng(20_240_607)
LETTER = _rng.integers(0, 1 << 63, 256).astype(U) * U(2) + U(1)
BASE = U(int(_rng.integers(1 << 62, 1 << 63)) | 1)
PLACES = [U(int(_rng.integers(1 << 62, 1 << 63)) | 1) for _ in range(WORDS)]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xA0761D6478BD642F)
    return h ^ (h >> U(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the number of words up to its end."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    space = SPACE[data]
    start = np.flatnonzero(~space & np.r_[True, space[:-1]])
    ends = np.cumsum([len(t) + 1 for t in texts])
    if not len(start):
        return np.zeros(0, U), np.zeros(len(texts), np.int64)
    length = np.diff(np.r_[start, len(data)])
    place = np.arange(start[0], len(data)) - np.repeat(start, length)
    power = np.ones(int(place.max()) + 1, U)
    with np.errstate(over="ignore"):
        np.cumprod(np.full(len(power) - 1, BASE, U), out=power[1:])
        value = np.where(space[start[0] :], U(0), LETTER[data[start[0] :]] * power[place])
        return mixed(np.add.reduceat(value, start - start[0])), np.searchsorted(start, ends)


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        own, size = [], 0
        while at + len(own) < len(texts) and size < SLICE:
            own.append(texts[at + len(own)].encode().lower())
            size += len(own[-1])
        h, ends = word_hashes(own)
        with np.errstate(over="ignore"):
            n = max(0, len(h) - words + 1)
            g = np.zeros(n, U)
            for k in range(words):
                g = (g ^ h[k : k + n]) * PLACES[k]
            g = mixed(g)
            first = 0
            for last in ends.tolist():
                if last - first >= words:
                    out.append(np.unique(g[first : last - words + 1]))
                elif last > first:
                    few = U(last - first)
                    for x in h[first:last]:
                        few = (few ^ x) * PLACES[0]
                    out.append(mixed(np.array([few], U)))
                else:
                    out.append(np.zeros(0, U))
                first = last
        at += len(own)
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    """96 bits of the set's hash: 64 and 32."""
    d = hashlib.blake2b(s.tobytes(), digest_size=12).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little")


def parity(s: np.ndarray, classes: int = PARITY) -> bytes:
    """Which of the classes hold an odd number of shingles. Two sets differ in at least as many shingles as
    their bitmaps do in bits."""
    return np.packbits(np.bincount((s % U(classes)).astype(np.int64), minlength=classes) & 1 == 1).tobytes()


def prefix_length(n: int, shared: int = 1) -> int:
    """Least number of shingles, first in the order, of which two linked sets share as many as shared."""
    return n - -(-NUMERATOR * n // DENOMINATOR) + shared


def in_long_prefix(n: int) -> int:
    """How many shingles of the long prefix of a set of n two linked sets of n or more share."""
    return 1 + n // MORE


def slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Place of the first, and the texts, of runs of up to SLICE bytes (or one longer text)."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (int(ends[a - 1]) if a else 0) + SLICE, side="right")))
        yield a, texts.slice(a, b - a).to_pylist()
        a = b


def _scan(docs: DataFrame) -> DataFrame:
    """Rows of documents (n_shingles, key of the set) and of shingles that a task has met often, in one table."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        known: set[tuple[int, int]] = set()
        size = 0
        names = ["doc_id", "text_hash", "s1", "s2", "n", "often", "bits", "more"]

        def often() -> pa.RecordBatch:
            value, count = np.unique(np.concatenate(held) if held else np.zeros(0, U), return_counts=True)
            some = count >= OFTEN
            void = pa.nulls(int(some.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([void, void, pa.array(value[some].view(np.int64)), void, void, pa.array(count[some]), pa.nulls(int(some.sum()), pa.binary()), pa.nulls(int(some.sum()), pa.binary())], names)

        for batch in batches:
            for at, texts in slices(batch.column(2)):
                sets = shingle_sets(texts)
                keys = [signature(x) if len(x) else (None, None) for x in sets]
                columns = [batch.column(0).slice(at, len(sets)), batch.column(1).slice(at, len(sets)), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())]
                columns += [pa.array([len(x) for x in sets], pa.int64()), pa.nulls(len(sets), pa.int64())]
                columns += [pa.array([parity(x) if len(x) else None for x in sets], pa.binary()), pa.array([parity(x, BIG_PARITY) if len(x) > BIG else None for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)
                for x, key in zip(sets, keys, strict=True):
                    if len(x) and key not in known:
                        known.add(key)
                        held.append(x)
                        size += len(x)
                if size >= COUNTED:
                    yield often()
                    held.clear()
                    known.clear()
                    size = 0
        yield often()

    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return staged(rows.mapInArrow(read, "doc_id long, text_hash long, s1 long, s2 long, n long, often long, bits binary, more binary"), "shingles")


def frequent_order(scan: DataFrame, bound: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles in order of value, and the logarithm of the count of each. At most bound of them."""
    rows = scan.where("often is not null").groupBy("s1").agg(F.sum("often").alias("n")).orderBy(F.desc("n"), "s1").limit(bound).toPandas()
    value = rows["s1"].to_numpy(dtype=np.int64).view(U)
    order = np.argsort(value)
    return value[order], np.log2(rows["n"].to_numpy(dtype=np.float64)[order]).astype(np.int64)


def in_order(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The set in the global order: by how frequent, then by value."""
    value, level = frequent
    if not len(value):
        return s
    at = np.minimum(np.searchsorted(value, s), len(value) - 1)
    return s[np.argsort(np.where(value[at] == s, level[at], 0), kind="stable")]


def _postings(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(t, s1) for each shingle of the long prefix of each set; t is the shingle's hash, then the set's size, then
    whether the shingle is in the short prefix too."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                ts, keys, done = [np.zeros(0, U)], [np.zeros(0, np.int64)], set()
                for s in shingle_sets(texts):
                    n = len(s)
                    if n:
                        key = signature(s)
                        if key not in done:
                            done.add(key)
                            own = in_order(s, sent.value)[: prefix_length(n, in_long_prefix(n))] >> U(LOW_BITS) << U(LOW_BITS) | U(min(n, MOST) << 1)
                            own[: prefix_length(n)] |= U(1)
                            ts.append(own)
                            keys.append(np.full(len(own), key[0]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ts).view(np.int64)), pa.array(np.concatenate(keys))], ["t", "s1"])

    return docs.select("text").mapInArrow(read, "t long, s1 long")


def unpacked(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and size of postings."""
    return t >> LOW_BITS, (t >> 1) & MOST


def _shared(postings: DataFrame) -> DataFrame:
    """The postings whose shingle another set of compatible size has in its long prefix."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 2  # the last row so far, and whether it has been sent
        sent = False
        for batch in batches:
            t, s = (np.concatenate((x, y.to_numpy())) for x, y in zip(held, batch.columns, strict=True))
            if not len(t):
                continue
            run, n = unpacked(t)
            link = (run[:-1] == run[1:]) & (s[:-1] != s[1:]) & ((n[:-1] * DENOMINATOR >= n[1:] * NUMERATOR) | (n[1:] == MOST))
            some = np.r_[link, False] | np.r_[False, link]
            last = bool(some[-1])
            # Equal rows of two tasks count once.
            some[1:] &= ~((t[1:] == t[:-1]) & (s[1:] == s[:-1]) & some[:-1])
            if sent:
                some[0] = False
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (t, s)], ["t", "s1"])
            sent = last or (sent and len(t) == 1)
            held = [t[-1:], s[-1:]]

    return postings.repartition(F.shiftright("t", LOW_BITS)).sortWithinPartitions("t", "s1").mapInArrow(read, "t long, s1 long")


def apart(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Whether sizes (nx <= ny) or bitmaps rule out a link."""
    d = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    # Links have 7 |difference| <= |x| + |y| for a threshold of 3 / 4.
    return (nx * DENOMINATOR < ny * NUMERATOR) | (d * (DENOMINATOR + NUMERATOR) > (DENOMINATOR - NUMERATOR) * (nx + ny))


def distinct(pairs: np.ndarray) -> np.ndarray:
    """The distinct rows, sorted."""
    pairs = pairs[np.lexsort(pairs.T[::-1])]
    return pairs[np.r_[True, (pairs[1:] != pairs[:-1]).any(axis=1)]] if len(pairs) else pairs


class Joiner:
    """Edges that connect, within runs of equal shingles (sizes ascending), all pairs not ruled out. An edge that is not
    firm stands for its own pair only; firm ones stand for others too, and what they connect is remembered."""

    def __init__(self) -> None:
        self.number: dict[int, int] = {}
        self.groups = Groups(0)

    def _numbers(self, rep: np.ndarray) -> list[int]:
        if len(self.number) > KNOWN:
            self.number.clear()
            self.groups = Groups(0)
        out = []
        for r in rep.tolist():
            k = self.number.get(r)
            if k is None:
                k = self.number[r] = len(self.groups.up)
                self.groups.up.append(k)
            out.append(k)
        return out

    def _long(self, n: np.ndarray, rep: np.ndarray, bits: np.ndarray) -> list[tuple[int, int, int]]:
        top, own, found = self.groups.top, self._numbers(rep), []
        group = np.array([top(x) for x in own])
        if (group == group[0]).all():
            return []
        single = len(rep) <= 8 * NEAR  # big sets meet the longer bitmaps pair by pair
        least = np.searchsorted(n * DENOMINATOR, n * NUMERATOR)
        for k in range(1, len(rep)):
            for start, stop in ((max(0, k - NEAR), k), (int(least[k]), k)):  # those next to it settle most
                other = start + np.flatnonzero(group[start:stop] != group[k])
                if not len(other):
                    continue
                ok = other[~apart(bits[other], bits[k], n[other], n[k])]
                if single and n[k] > BIG:
                    big = n[ok] > BIG
                    found += [(rep[y], rep[k], 0) for y in ok[big]]
                    ok = ok[~big]
                for g, at in zip(*np.unique(group[ok], return_index=True), strict=True):
                    found.append((rep[ok[at]], rep[k], 1))
                    self.groups.up[top(int(g))] = top(own[k])
                    group[group == g] = group[k]
        return found

    def edges(self, run: np.ndarray, n: np.ndarray, rep: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Rows (a, b, firm) of reps."""
        pairs = [np.zeros((0, 3), np.int64)]
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        ends = np.r_[starts[1:], len(run)]
        short = np.repeat(ends - starts <= NEAR, ends - starts)
        for d in range(1, min(NEAR, len(run))):
            same = np.flatnonzero((run[:-d] == run[d:]) & short[d:])
            if not len(same):
                break
            ok = same[~apart(bits[same], bits[same + d], n[same], n[same + d])]
            pairs.append(np.stack([rep[ok], rep[ok + d], np.zeros(len(ok), np.int64)], axis=1))
            if d % 8 == 0:
                pairs = [distinct(np.concatenate(pairs))]
        for a, b in zip(starts[ends - starts > NEAR].tolist(), ends[ends - starts > NEAR].tolist(), strict=True):
            pairs.append(np.array(self._long(n[a:b], rep[a:b], bits[a:b]), np.int64).reshape(-1, 3))
        return distinct(np.concatenate(pairs))


def _connected(shared: DataFrame) -> DataFrame:
    """(t, n, rep, bits) to edges (a, b, firm) between reps that may be linked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner = Joiner()

        def sent(pairs: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in range(3)], ["a", "b", "firm"])

        def chain(n: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
            ok = n[:-1] * DENOMINATOR >= n[1:] * NUMERATOR
            return sent(np.stack([rep[:-1][ok], rep[1:][ok], np.ones(int(ok.sum()), np.int64)], axis=1))

        held: list[np.ndarray] | None = None
        chained = False  # the held row is the last of a long run so far
        for batch in batches:
            bits = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(-1, PARITY // 64)
            own = [batch.column(0).to_numpy() >> LOW_BITS, *(batch.column(k).to_numpy() for k in (1, 2)), bits]
            own = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
            if not len(own[0]):
                continue
            if chained:
                stop = int(np.searchsorted(own[0], own[0][0], side="right"))
                yield chain(own[1][:stop], own[2][:stop])
                chained = stop == len(own[0])
                own = [x[-1:] if chained else x[stop:] for x in own]
            cut = int(np.searchsorted(own[0], own[0][-1]))  # the last run may go on
            held = [x[cut:] for x in own]
            if cut:
                yield sent(joiner.edges(*(x[:cut] for x in own)))
            if len(held[0]) > LONG:
                yield chain(held[1], held[2])
                held, chained = [x[-1:] for x in held], True
        if held is not None and len(held[0]):
            yield sent(joiner.edges(*held))

    dealt = shared.repartition(F.shiftright("t", LOW_BITS)).sortWithinPartitions(F.shiftright("t", LOW_BITS), "n", "rep")
    return dealt.mapInArrow(read, "a long, b long, firm long").distinct()


def _sifted(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """edges without those of two big sets that are not firm and that the longer bitmaps rule out."""
    big = classes.where("more is not null and rep is not null").select("rep", "n", "more")
    for side in "ab":
        edges = edges.join(big.select(F.col("rep").alias(side), F.col("n").alias(f"n{side}"), F.col("more").alias(f"more{side}")), side, "left")
    both = F.col("morea").isNotNull() & F.col("moreb").isNotNull() & (F.col("firm") == 0)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (np.array(batch.column(k).to_pylist(), np.int64) for k in (2, 4))
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, BIG_PARITY // 64) for k in (3, 5))
            ok = ~apart(x, y, np.minimum(na, nb), np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], ["a", "b"])

    soft = edges.where(both).select("a", "b", "na", "morea", "nb", "moreb").mapInArrow(read, "a long, b long")
    return soft.unionByName(edges.where(~both).select("a", "b"))


class Groups:
    """Union-find over 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x


class Node:
    """Tokens first to last of one set, the sets that end here, and bounds of what is below."""

    __slots__ = ("at", "children", "ends", "first", "last", "least", "longest", "one")

    def __init__(self, at: int, first: int, last: int):
        self.at, self.first, self.last = at, first, last
        self.children: dict[int, Node] = {}
        self.ends: list[int] = []
        self.least, self.longest = 1 << 62, 0  # smallest set below; most tokens after this node
        self.one = -1  # a set below if all sets below are in its group, else -1


def trie_links(sets: list[np.ndarray], joined: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect the same sets as all links do; those joined are taken as connected with each other."""
    sizes = [len(s) for s in sets]
    value, count = np.unique(np.concatenate(sets), return_counts=True)
    # Shingles of a single set add to no overlap; frequent ones come first, so that paths are shared.
    rank = np.full(len(value), -1)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(value))
    rank[count < 2] = -1
    tokens = []
    for s in sets:
        r = rank[np.searchsorted(value, s)]
        tokens.append(np.sort(r[r >= 0]))
    groups, links = Groups(len(sets)), []
    for x in joined or []:
        groups.up[x] = joined[0]
    root, mark = Node(0, 0, 0), np.zeros(len(value), bool)

    def need(a: int, b: int) -> int:
        return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))

    def walk(x: int) -> None:
        own, nx, size = tokens[x], len(tokens[x]), sizes[x]
        stack = [(root, 0, 0)]
        while stack:
            node, overlap, used = stack.pop()
            if node.one >= 0 and groups.top(node.one) == groups.top(x):
                continue
            least = max(node.least, -(-NUMERATOR * size // DENOMINATOR))
            if overlap + min(nx - used, node.last - node.first + node.longest) < need(size, least):
                continue
            if node.last > node.first:
                label = tokens[node.at][node.first : node.last]
                overlap += int(np.count_nonzero(mark[label]))
                used = int(np.searchsorted(own, label[-1], side="right"))
                if overlap + min(nx - used, node.longest) < need(size, least):
                    continue
            for y in node.ends:
                if groups.top(x) != groups.top(y) and DENOMINATOR * overlap >= NUMERATOR * (size + sizes[y] - overlap):
                    groups.up[groups.top(y)] = groups.top(x)
                    links.append((x, y))
            below = sorted(node.children.items(), key=lambda c: (bool(mark[c[0]]), -c[0]))
            stack += [(child, overlap, used) for _, child in below]

    def insert(x: int) -> None:
        own, at, node, top = tokens[x], 0, root, groups.top(x)
        while True:
            node.one = x if node.one < 0 and node.least == 1 << 62 or node.one >= 0 and groups.top(node.one) == top else -1
            node.least = min(node.least, sizes[x])
            node.longest = max(node.longest, len(own) - at)
            if at == len(own):
                node.ends.append(x)
                return
            child = node.children.get(int(own[at]))
            if child is None:
                child = Node(x, at, len(own))
                child.least, child.one = sizes[x], x
                child.ends.append(x)
                node.children[int(own[at])] = child
                return
            label = tokens[child.at][child.first : child.last]
            n = min(len(label), len(own) - at)
            differ = np.flatnonzero(label[:n] != own[at : at + n])
            same = int(differ[0]) if len(differ) else n
            if same < len(label):
                upper = Node(child.at, child.first, child.first + same)
                upper.least, upper.longest, upper.one = child.least, len(label) - same + child.longest, child.one
                child.first += same
                upper.children[int(label[same])] = child
                node.children[int(own[at])] = upper
                child = upper
            node, at = child, at + same

    for x in sorted(range(len(sets)), key=lambda k: (sizes[k], k)):
        mark[tokens[x]] = True
        walk(x)
        mark[tokens[x]] = False
        insert(x)
    return links


def _linked(dealt: DataFrame) -> DataFrame:
    """(cluster, i, j, rep, joined, text) to links (a, b) between reps, in each (cluster, i, j). Those joined are
    connected already. Repeated rows of a rep count once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reps, sets, joined = None, [], [], []

        def linked() -> pa.RecordBatch:
            found = trie_links(sets, joined) if len(reps) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([reps[p[k]] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for at, texts in slices(batch.column(5)):
                rows = zip(*(c.slice(at, len(texts)).to_pylist() for c in batch.columns[:5]), shingle_sets(texts), strict=True)
                for c, i, j, rep, same, own in rows:
                    if (c, i, j) != key:
                        if reps:
                            yield linked()
                        key, reps, sets, joined = (c, i, j), [], [], []
                    elif rep == reps[-1]:
                        continue
                    if same:
                        joined.append(len(reps))
                    reps.append(rep)
                    sets.append(own)
        if reps:
            yield linked()

    return dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "rep").select("cluster", "i", "j", "rep", "joined", "text").mapInArrow(read, "a long, b long")


def _chunks(n: Column, size: Column) -> Column:
    """Chunks for n sets of size shingles together."""
    return F.greatest(F.ceil(n / CHUNK), F.ceil(size / CHUNK_SHINGLES), F.lit(1)).cast("int")


def _number(chunks: Column) -> Column:
    return F.pmod(F.xxhash64("rep"), chunks).cast("int")


def _verified(texts: Callable[[DataFrame], DataFrame], wanted: DataFrame) -> DataFrame:
    """Links (a, b) between reps. wanted: rep, cluster, n and the key of the row that stands for it, one row for each
    rep; texts gives, for a table with such keys, its rows with their texts, more for repeated rows."""
    size = wanted.groupBy("cluster").agg(_chunks(F.count("*"), F.sum("n")).alias("k"), F.count("*").alias("sets"))
    size = staged(size, "sizes")
    all_chunks = F.sequence(F.lit(0), F.col("k") - 1)
    # In a cluster of several chunks some sets, taken by hash, are in all of them.
    pivot = F.pmod(F.xxhash64("rep", F.lit(1)), F.greatest(F.floor(F.col("sets") / PIVOTS), F.lit(1))) == 0
    dealt = wanted.join(size, "cluster").withColumn("i", F.explode(F.when((F.col("k") > 1) & pivot, all_chunks).otherwise(F.array(_number(F.col("k")))))).drop("k", "sets")
    first = staged(_linked(texts(dealt).withColumns({"j": F.col("i"), "joined": F.lit(False)})), "links")
    if size.where("k > 1").isEmpty():
        return first
    # Second round: what isn't of the largest component meets all sets of its cluster.
    several = wanted.join(size.where("k > 1").select("cluster"), "cluster")
    found = components(first).withColumnRenamed("node", "rep")
    several = staged(several.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "several")
    parts = several.groupBy("cluster", "component").agg(F.count("*").alias("sets"), F.sum("n").alias("size"))
    parts = parts.groupBy("cluster").agg(F.max(F.struct("sets", "size", "component")).alias("most"), F.sum("sets").alias("sets"), F.sum("size").alias("size")).where("most.sets < sets")
    parts = parts.select("cluster", F.col("most.component").alias("largest"), _chunks(F.col("most.sets"), F.col("most.size")).alias("a"), _chunks(F.col("sets") - F.col("most.sets"), F.col("size") - F.col("most.size")).alias("b"))
    dealt = several.join(parts, "cluster").withColumn("joined", F.col("component") == F.col("largest"))
    # Chunks 0 .. b - 1 are of the rest, b .. b + a - 1 of the largest component.
    dealt = dealt.withColumn("own", F.when(F.col("joined"), F.col("b") + _number(F.col("a"))).otherwise(_number(F.col("b"))))
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("joined"), F.sequence(F.lit(0), F.col("b") - 1)).otherwise(F.sequence(F.lit(0), F.col("a") + F.col("b") - 1))))
    dealt = dealt.where("own <> other").withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("component", "largest", "a", "b", "own", "other")
    return first.unionByName(staged(_linked(texts(dealt)), "links"))


def _named(classes: DataFrame) -> tuple[DataFrame, int | None]:
    """classes with rep: the class's least id, or where it has null ids only, a number above all these; and the bound
    from which numbers are no ids, if there are such classes."""
    found = classes.agg(F.max("rep_id").alias("most"), F.count("*").alias("n"), F.count("rep_id").alias("known")).first()
    if found["n"] == found["known"]:
        return classes.withColumn("rep", F.col("rep_id")), None
    bound = (-1 if found["most"] is None else found["most"]) + 1
    lot = F.pmod("s1", F.lit(LOTS))
    number = (F.row_number().over(Window.partitionBy(lot).orderBy("s1", "s2")).cast("long") - 1) * LOTS + lot + F.lit(bound)
    return classes.where("rep_id is not null").withColumn("rep", F.col("rep_id")).unionByName(classes.where("rep_id is null").withColumn("rep", number)), bound


def _members(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, first of each row of docs (doc_id, text not null). component_id is
    null where links reach null ids only; first says whether the row stands for its component."""
    scan = _scan(docs)
    rows = scan.where("often is null")
    own = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash")))
    classes = rows.where("s1 is not null").groupBy("s1", "s2").agg(own["doc_id"].alias("rep_id"), F.coalesce(own["text_hash"], F.min("text_hash")).alias("rep_hash"), F.max("n").alias("n"), F.first("bits").alias("bits"), F.first("more").alias("more"))
    classes, bound = _named(staged(classes, "classes"))
    shared = staged(_shared(_postings(docs, frequent_order(scan))), "shared")
    met = shared.groupBy("s1").agg(F.count("*").alias("met"))
    # A linked set has a partner of 3/4 of its size or more.
    need = F.expr(f"1 + (({NUMERATOR} * n + {DENOMINATOR - 1}) div {DENOMINATOR}) div {MORE}")
    keyed = classes.join(met, "s1").where(F.col("met") >= need).select("s1", "rep", "n", "bits")
    near = shared.where("t & 1 = 1").join(keyed, "s1").where(f"shiftright(t, 1) & {MOST} = least(n, {MOST})")
    pairs = staged(_connected(near.select("t", "n", "rep", "bits")), "pairs")
    discard(shared)
    clusters = components(_sifted(pairs, classes))
    wanted = clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    wanted = staged(wanted.join(classes.select("rep", "rep_id", "rep_hash", "n"), "rep"), "wanted")
    discard(pairs)
    same = (F.col("text_hash") == F.col("rep_hash")) & (F.col("doc_id").eqNullSafe(F.col("rep_id")) if bound is not None else F.col("doc_id") == F.col("rep_id"))
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))

    def texts(rows: DataFrame) -> DataFrame:
        # Some numbers a row; sent to all tasks up to a bound, beyond it joined by shuffling the texts.
        rows = staged(rows, "dealt")
        held = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
        return own.join(held, same).drop("doc_id", "text_hash", "rep_id", "rep_hash")

    found = components(_verified(texts, wanted))
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select("s1", "s2", "rep", "rep_hash", F.coalesce("component", "rep").alias("component"))
    members = rows.join(named, ["s1", "s2"], "left")
    component, first = F.coalesce("component", "doc_id"), F.col("doc_id").eqNullSafe(F.coalesce("component", "doc_id"))
    if bound is not None:
        no_id = F.coalesce(F.col("component") >= bound, F.lit(False))
        component = F.when(~no_id, component)
        first = F.when(no_id, (F.col("component") == F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))).otherwise(first)
    return members.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), first.alias("first"))


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that links reach) for each row."""
    return _members(_read(docs, id_col, text_col)).drop("text_hash", "first")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those linked, over any path, with a row of lesser doc_id; of repeated rows one,
    and one of rows without ids that links reach no id from."""
    h, own, copies, size, d, t = (free_name(docs.columns, x) for x in ("_text_hash", "_own", "_copies", "_size", "_d", "_t"))
    first = _members(_read(docs, id_col, text_col)).where("first")
    first = first.groupBy(F.col("doc_id").alias(d), F.col("text_hash").alias(t)).agg(F.max("n_shingles").alias(size), F.count("*").alias(copies))
    rows = docs.withColumn(h, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    kept = rows.join(first, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(d)) & (F.col(h) == F.col(t)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = kept.where((F.col(copies) == 1) | (F.col(size) == 0)).select(*columns)
    # Rows that share id and text are few; only they need an order among themselves.
    again = kept.where((F.col(copies) > 1) & (F.col(size) > 0)).withColumn(own, F.row_number().over(Window.partitionBy(d, t).orderBy(F.lit(1))))
    return single.unionByName(again.where(F.col(own) == 1).select(*columns))


def brute_force(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """doc_id to (n_shingles, component_id) by comparing all pairs; for tests."""
    table = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().translate(table).split()
        sets[k] = {tuple(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)} if len(w) >= WORDS else {tuple(w)} if w else set()
    ids = sorted(texts)
    groups, meet = Groups(len(ids)), Counter()
    where: dict[tuple, list[int]] = {}
    for k, d in enumerate(ids):
        for s in sets[d]:
            for other in where.setdefault(s, []):
                meet[other, k] += 1
            where[s].append(k)
    for (a, b), n in meet.items():
        if DENOMINATOR * n >= NUMERATOR * (len(sets[ids[a]]) + len(sets[ids[b]]) - n):
            x, y = sorted((groups.top(a), groups.top(b)))
            groups.up[y] = x
    return {d: (len(sets[d]), ids[groups.top(k)]) for k, d in enumerate(ids)}
