"""Order MinHash fingerprints in DataFrame functions alone.

A text's k-mers are runs of K words (white space apart). Its elements are (k-mer, occurrence): the occurrences of a
k-mer are numbered in text order and hashed together with their number. An element's hash deals it to one of BINS
sketches and orders it there, so that one hash does for all sketches. The two least elements of a sketch are
selected; where it has one, the least of the next filled sketch joins it, so that short texts keep their order too.
The pair is put in text order and hashed: the sketch's entry. Two fingerprints are alike in the share of equal
entries among sketches that either fills. Moving text about changes pairs even where the set of k-mers stays, so the
signature follows edit distance.

Everything about a text happens within its row; the next document comes over a window of bounded buckets of
consecutive ids, and the first row of each bucket is handed to the bucket before it. Buckets are bounded by quantiles
of the ids, and beyond BUCKETS of them each is divided evenly.

Defined cases: a null or empty text has the empty fingerprint; fewer words than K are one k-mer; two empty
fingerprints are alike (1), an empty and another are not (0); rows with equal doc_id follow each other in order
of their texts' hashes; a null doc_id is last; a single row is its own next; equal texts have equal fingerprints; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailwise.llm.common import WORD_SPLIT

K = 2
#: A packed element: 6 bits of sketch, 27 of its order there, 30 of its position (a text has fewer words than that).
SKETCH_BITS, ORDER_BITS, PLACE_BITS = 6, 27, 30
BINS = 1 << SKETCH_BITS
HASH_BITS = SKETCH_BITS + ORDER_BITS
#: Rows of a bucket of consecutive ids, about, and quantiles that bound buckets at most.
BUCKET_ROWS, BUCKETS = 250, 10_000
#: Buckets (three numbers each) that are sent to all tasks at most; beyond, the texts are shuffled once more.
BROADCAST_BUCKETS = 500_000


def _packed(words: str) -> str:
    """SQL for the k-mers of an array of words, packed as hash, position."""
    mask = f"{(1 << HASH_BITS) - 1}L"
    kmer = f"xxhash64({', '.join(f'{words}[i + {k}]' for k in range(K))})"
    pack = f"shiftleft({kmer} & {mask}, {PLACE_BITS}) | i"
    whole = f"array(shiftleft(xxhash64(array_join({words}, ' ')) & {mask}, {PLACE_BITS}))"
    return f"case when size({words}) >= {K} then transform(sequence(0, size({words}) - {K}), i -> {pack}) when size({words}) > 0 then {whole} else cast(array() as array<bigint>) end"


def _elements(kmers: str) -> str:
    """SQL for the packed elements of sorted packed k-mers. The first occurrence keeps the k-mer's hash, the others
    are hashed with their number: how many places back the k-mer's first one is."""
    same = lambda k: f"(i >= {k} and shiftright({kmers}[i - {k}], {PLACE_BITS}) = shiftright(x, {PLACE_BITS}))"
    steps = ", ".join(str(1 << k) for k in reversed(range(PLACE_BITS)))
    base = f"shiftleft(shiftright(x, {PLACE_BITS}), {PLACE_BITS})"
    # The number of k-mers below, by halving.
    first = f"aggregate(array({steps}), 0, (a, s) -> if(a + s <= size({kmers}) and {kmers}[least(a + s, size({kmers})) - 1] < {base}, a + s, a))"
    number = f"cast(case when not {same(2)} then 1 when not {same(3)} then 2 else i - {first} end as bigint)"
    hashed = f"xxhash64(shiftright(x, {PLACE_BITS}), {number}) & {(1 << HASH_BITS) - 1}L"
    return f"transform({kmers}, (x, i) -> if({same(1)}, shiftleft({hashed}, {PLACE_BITS}) | (x & {(1 << PLACE_BITS) - 1}L), x))"


def signature(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with a column name: the entries of the filled sketches, (sketch << 32) + pair hash, in order. text is not
    null."""
    work = f"_w_{name}"
    sketch = PLACE_BITS + ORDER_BITS
    df = df.withColumn(work, F.filter(F.split(F.col(text), WORD_SPLIT), lambda w: w != ""))
    df = df.withColumn(work, F.sort_array(F.expr(_packed(work))))
    df = df.withColumn(work, F.sort_array(F.expr(_elements(work))))
    # What heads a sketch, and what follows it there or else heads the next one; of the last, the first.
    after = f"coalesce(get({work}, i + 1), {work}[0])"
    place = lambda x: f"({x} & {(1 << PLACE_BITS) - 1}L)"
    order = lambda x: f"shiftright({x}, {PLACE_BITS})"
    pair = f"transform(array({after}), y -> if({place('x')} <= {place('y')}, xxhash64({order('x')}, {order('y')}), xxhash64({order('y')}, {order('x')})))[0]"
    entry = f"shiftleft(shiftright(x, {sketch}), 32) | ({pair} & 4294967295L)"
    heads = f"i = 0 or shiftright({work}[i - 1], {sketch}) <> shiftright(x, {sketch})"
    second = f"i = 1 or i > 1 and shiftright({work}[i - 2], {sketch}) <> shiftright(x, {sketch})"
    df = df.withColumn(work, F.expr(f"filter({work}, (x, i) -> {heads} or {second})"))
    df = df.withColumn(name, F.expr(f"filter(transform({work}, (x, i) -> if({heads}, {entry}, -1L)), x -> x >= 0)"))
    return df.drop(work)


def alike(a: str, b: str) -> Column:
    """Share of equal entries among the sketches that either fills."""
    both = f"size(array_intersect({a}, {b}))"
    either = f"size(array_union(transform({a}, x -> shiftright(x, 32)), transform({b}, x -> shiftright(x, 32))))"
    return F.expr(f"if({either} = 0, 1D, cast({both} as double) / greatest({either}, 1))")


def printed(a: str) -> Column:
    """The fingerprint as text: sketch and hash of each entry in hexadecimal."""
    return F.expr(f"array_join(transform({a}, x -> lower(hex(x))), ',')")


def _below(array: str, n: int) -> str:
    """SQL for how many elements of a sorted array literal are less than doc_id: a fold over the halving steps."""
    if not n:
        return "0"
    steps, step = [], 1
    while step <= n:
        steps.append(step)
        step *= 2
    steps.reverse()
    return f"aggregate(array({', '.join(map(str, steps))}), 0, (a, s) -> if(a + s <= {n} and get({array}, a + s - 1) < doc_id, a + s, a))"


def _bucketed(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows (doc_id, text_hash) with _b and _s, buckets that ascend with doc_id, and how many there are at most. Rows of null ids are dealt, after all
    others, by the hash that orders them."""
    found = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("known"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).first()
    n, known = found["n"], found["known"]
    buckets = max(1, min(BUCKETS, known // BUCKET_ROWS))
    bounds = []
    if buckets > 1:
        at = [k / buckets for k in range(1, buckets)]
        bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", at, 10 * buckets)).first()[0] or []))
    literal = f"cast(split('{','.join(map(str, bounds))}', ',') as array<bigint>)" if bounds else "cast(array() as array<bigint>)"
    df = rows.withColumn("_b", F.expr(f"if(doc_id is null, -1, {_below(literal, len(bounds))})"))
    parts, of_null = -(-known // (buckets * BUCKET_ROWS)), -(-(n - known) // BUCKET_ROWS)
    low, high = (f"coalesce(get({literal}, _b{k}), {v}L)" for k, v in ((" - 1", (found["least"] or 0) - 1), ("", found["most"] or 0)))
    part = f"least({parts - 1}L, cast((doc_id - {low} - 1) / greatest({high} - {low}, 1L) * {parts} as bigint))" if parts > 1 else "0L"
    # Hashes ascend where ids descend.
    null_part = f"-cast((shiftright(text_hash, 1) / 9223372036854775808D + 0.5D) * {of_null} as bigint)" if of_null > 1 else "0L"
    return df.withColumn("_s", F.expr(f"if(doc_id is null, {null_part}, {part})")), (len(bounds) + 1) * parts + of_null + 1


def with_next(rows: DataFrame, carried: list[str]) -> DataFrame:
    """rows (doc_id, text, text_hash, carried; only doc_id may be null) with next_<c> for each carried column: that of
    the next row by descending doc_id, after the last of the first. For the last row of a bucket these are null, and
    head_text has the next one's text; elsewhere head_text means nothing."""
    rows, buckets = _bucketed(rows)
    order = [F.col("doc_id").desc_nulls_last(), F.col("text_hash"), F.col("text")]
    inside = Window.partitionBy("_b", "_s").orderBy(*order)
    df = rows
    for c in carried:
        df = df.withColumn(f"next_{c}", F.lead(c).over(inside))
    # The first row of each bucket, for the bucket above it; that of the top bucket for the lowest.
    ids = rows.groupBy("_b", "_s").agg(F.max("doc_id").alias("_top"))
    tops = ids.select(F.col("_b").alias("_hb"), F.col("_s").alias("_hs"), "_top")
    tops = F.broadcast(tops) if buckets <= BROADCAST_BUCKETS else tops
    heads = rows.select("_b", "_s", "doc_id", "text_hash", "text").join(tops, (F.col("_b") == F.col("_hb")) & (F.col("_s") == F.col("_hs")) & F.col("doc_id").eqNullSafe(F.col("_top")))
    heads = heads.groupBy("_b", "_s").agg(F.min(F.struct("text_hash", "text"))["text"].alias("head_text"))
    tops = ids.groupBy("_b").agg(F.max("_s").alias("_first"))  # BUCKETS rows at most
    round_b = Window.orderBy(F.desc("_b"))
    every = Window.partitionBy(F.lit(0))
    tops = tops.select("_b", *(F.coalesce(F.lead(c).over(round_b), F.max(F.struct("_b", "_first")).over(every)[c]).alias(n) for c, n in (("_b", "_nb"), ("_first", "_ns"))))
    after = ids.select("_b", F.col("_s"), F.lead("_s").over(Window.partitionBy("_b").orderBy(F.desc("_s"))).alias("_below")).join(F.broadcast(tops), "_b")
    after = after.select(F.col("_b").alias("_of_b"), F.col("_s").alias("_of_s"), F.when(F.col("_below").isNull(), F.col("_nb")).otherwise(F.col("_b")).alias("_b"), F.coalesce("_below", "_ns").alias("_s"))
    heads = after.join(heads, ["_b", "_s"]).select("_of_b", "_of_s", "head_text")
    df = df.join(heads, (F.col("_b") == F.col("_of_b")) & (F.col("_s") == F.col("_of_s")), "left")
    return df.drop("_b", "_s", "_of_b", "_of_s")


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (printed) and its entries for each row."""
    return signature(_read(docs, id_col, text_col), "text", "entries").select("doc_id", printed("entries").alias("fingerprint"), "entries")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of the text whose last half gives way to the next one's beginning."""
    rows = signature(_read(docs, id_col, text_col), "text", "own")
    df = with_next(rows, ["text", "own"]).withColumn("n_chars", F.char_length("text").cast("long"))
    # A bucket's last row has no next one there; only the head's text is at hand.
    df = signature(df.withColumn("head_text", F.when(F.col("next_text").isNull(), F.col("head_text")).otherwise("")), "head_text", "head_own")
    df = df.withColumns({"following": F.coalesce("next_own", "head_own"), "next_text": F.coalesce("next_text", "head_text")})
    df = df.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next_text, 1, cast(n_chars div 2 as int)))"))
    df = signature(df, "edited", "other")
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed("own").alias("fingerprint"),
        printed("other").alias("edited_fingerprint"),
        alike("own", "other").alias("near_edited"),
        alike("own", "following").alias("near_next"),
    )


def brute_force(text: str | None) -> dict[int, int]:
    """Sketch to pair hash of a text in plain Python; for tests."""
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    number = lambda v, seed: xxhash.xxh64_intdigest((v & ((1 << 64) - 1)).to_bytes(8, "little"), seed)
    words, seen, sketches = (text or "").encode().split(), {}, {}
    if not words:
        return {}
    for at in range(max(1, len(words) - K + 1)):
        own = words[at : at + K] if len(words) >= K else [b" ".join(words)]
        h = 42
        for w in own:
            h = xxhash.xxh64_intdigest(w, h)
        h &= (1 << HASH_BITS) - 1
        k = seen[h] = seen.get(h, -1) + 1
        if k:
            h = number(k, number(h, 42)) & ((1 << HASH_BITS) - 1)
        sketches.setdefault(h >> ORDER_BITS, []).append((h, at))
    filled = sorted(sketches)
    out = {}
    for i, b in enumerate(filled):
        own = sorted(sketches[b])
        x, y = own[0], own[1] if len(own) > 1 else min(sketches[filled[(i + 1) % len(filled)]])
        first, last = sorted((x, y), key=lambda e: e[1])
        out[b] = signed(number(last[0], number(first[0], 42))) & 0xFFFFFFFF
    return out
