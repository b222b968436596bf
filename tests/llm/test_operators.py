"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tailwise.llm import bytebpe, idcoder, idfile, linededup, ngramjoin, orderminhash, packing, quality, resharding, revisits, tokens
from tailwise.llm.queries import tokenizer_file

RNG = random.Random(11)
WORDS = ["the", "of", "And", "thion", "ré", "straße", "x1", "%%%", "don't", "ering", "hat", "lyth", "oned", "anst", "wh"]
EXTRA = "doc_id long, text string, lang string, kept boolean, _text_hash long, n_chars long"


def prose(n):
    return " ".join(RNG.choice(WORDS) + RNG.choice(["", "", "", ".", ",", "\n" + RNG.choice(WORDS)]) for _ in range(n))


def sample():
    base = [prose(RNG.randint(30, 120)) for _ in range(12)]
    near = [b + " tail" + str(k) for k, b in enumerate(base[:6]) for _ in range(2)]
    special = [None, "", " ", "\n\n", "one", "a b", base[0], base[0], "word " * 3000, "x" * 20_000, "\t tab  double nbsp　wide \n x", "<|endoftext|> end", "a<|endoftext|>  <|endoftext|>b"]
    texts = base + near + special
    RNG.shuffle(texts)
    return [(3 * k + 1, t) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return sample()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", True, 5, len(t) if t else 0) for d, t in rows], EXTRA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EXTRA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality_base_counts(spark, docs, rows, none):
    labels = spark.createDataFrame([(d, k % 2, 0) for k, (d, _) in enumerate(rows)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    weights = quality.fit(docs, labels)
    got = by_id(quality.score(docs, weights))
    assert len(got) == len(rows)
    for d, t in rows:
        t = t or ""
        w = t.encode().split()
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if line.strip(" \t\n\r\x0b\x0c"):
                dup += line in seen
                seen.add(line)
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), dup, len(cover))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r["kept"] and r["base_failed"])
    kept = quality.keep_documents(docs, weights)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if r["kept"]}
    assert not quality.fit(docs, labels.limit(0)).any() and quality.score(none, weights).count() == 0


def test_bpe_equals_tiktoken(docs, rows, none):
    import public_tokenizers
    import tiktoken

    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})
    got = by_id(bytebpe.code_documents(docs, path, public_tokenizers.PATTERN, with_ids=True))
    for d, t in rows:
        ids = enc.encode_ordinary(t or "")
        raw = np.array(ids, "<u4").tobytes()
        assert bytes(got[d]["ids"]) == raw and got[d]["n_tokens"] == len(ids) and got[d]["ids_sha256"] == hashlib.sha256(raw).hexdigest()
        assert bytes(got[d]["decoded"]).decode() == (t or "") and got[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bytebpe.code_documents(none, path, public_tokenizers.PATTERN).count() == 0


def library_ids(texts):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    return [e.ids for e in tk.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        room = [(b, i) for i, b in enumerate(bins) if b >= n]
        if room:
            bins[min(room)[1]] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


def test_packing(docs, rows, none):
    got = defaultdict(list)
    for r in packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json")).collect():
        got[r["doc_id"]].append(r)
    bins = defaultdict(list)
    for (d, _), ids in zip(rows, library_ids([t for _, t in rows]), strict=True):
        ids = np.array([*ids, packing.END_ID], "<u4")
        own = sorted(got[d], key=lambda r: r["piece"])
        assert sum(r["length"] for r in own) == len(ids) and all(r["length"] == 1024 for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
    free = []
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        free.append(1024 - at)
    assert sorted(free) == best_fit([r["length"] for own in got.values() for r in own], 1024)
    assert packing.pack_documents(none, tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_id_files(docs, rows, none):
    got = by_id(idfile.round_trip(docs, tokenizer_file("byte_bpe_50k.json")))
    at = 0
    for (d, _), ids in zip(rows, library_ids([t for _, t in rows]), strict=True):
        raw = np.array([*ids, 0], "<u4").tobytes()
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(raw) // 4, zlib.crc32(raw))
        at += len(raw) // 4
    assert idfile.round_trip(none, tokenizer_file("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 4095, 4096, 4097, 9000])
def test_id_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 1 << 32, n), rng.zipf(1.3, n) % 65_536, np.full(n, 65_535), np.arange(n) % 3):
        segment = idcoder.encode_segment(ids)
        assert np.array_equal(idcoder.decode_segment(segment), ids)
    if n:
        prior, at = idcoder.Prior.unpack(segment)
        blocks = idcoder.split_blocks(segment[at:])
        alone = idcoder.decode_blocks(prior, blocks[-1:])  # a block needs no other
        assert np.array_equal(alone[0], ids[-len(alone[0]) :])
        for place, what in ((at + 8, "checksum"), (12, "checksum"), (0, "segment")):
            bad = bytearray(segment)
            bad[place] ^= 1
            with pytest.raises(ValueError, match=what):
                idcoder.decode_segment(bytes(bad))
        with pytest.raises(ValueError):
            idcoder.decode_segment(segment[:-1])
    with pytest.raises(ValueError):
        idcoder.encode_segment(np.array([1 << 32]))


def test_id_coder_mixes_orders():
    rng = np.random.default_rng(1)
    ids = np.tile(rng.integers(0, 5000, 500), 40)
    noise = rng.random(len(ids)) < 0.1
    ids[noise] = rng.integers(0, 5000, int(noise.sum()))
    p = np.bincount(ids) / len(ids)
    order0 = -(p[p > 0] * np.log2(p[p > 0])).sum()
    assert 8 * len(idcoder.encode_segment(ids)) / len(ids) < 0.8 * order0


def test_id_coder_keeps_to_its_size():
    """Prose-like ids: mixing beats the order-0 table, and a step writes one word at most."""
    rng = np.random.default_rng(3)
    ids = np.where(np.arange(60_000) % 3 > 0, rng.zipf(1.2, 60_000) % 4000, np.arange(60_000) % 7)
    segment = idcoder.encode_segment(ids, 500)
    assert idcoder.decode_segment(segment).tolist() == ids.tolist()
    for some in ([0], [1, 1], [(1 << 32) - 1, 0] * 300, list(range(20_000)) * 2):  # over 2**14 ids: wider entries
        assert idcoder.decode_segment(idcoder.encode_segment(np.array(some), 1000)).tolist() == some
    # Blocks of different lengths, out of order and without the others.
    prior, at = idcoder.Prior.unpack(segment)
    blocks = idcoder.split_blocks(segment[at:])
    got = idcoder.decode_blocks(prior, [blocks[-1], blocks[7], blocks[0]])
    assert [x.tolist() for x in got] == [ids[-500:].tolist(), ids[3500:4000].tolist(), ids[:500].tolist()]


def test_id_coder_steps_are_few(monkeypatch):
    """Shares are mixed once for many ids of a block, not at each."""
    calls = []
    learn = idcoder.Model.learn
    monkeypatch.setattr(idcoder.Model, "learn", lambda self, log: calls.append(1) or learn(self, log))
    ids = np.arange(8192) % 300
    assert np.array_equal(idcoder.decode_segment(idcoder.encode_segment(ids)), ids)
    assert 0 < len(calls) < 100


def test_words_go_to_the_model_alone():
    """Words of one pre-token need only the model; ids are the library's for these and for whatever else."""
    rng = random.Random(5)
    letters = "abcXYZzäßéÿÀØ×÷ªµºœŁжλ名\u0301'’0123_-.,=\n"
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 24))) for _ in range(200)) for _ in range(30)]
    encoder = tokens.library_encoder(tokenizer_file("byte_bpe_50k.json"))
    for _ in range(2):  # learnt, and known
        for got, want in zip(encoder.ids(texts), library_ids(texts), strict=True):
            assert got.tolist() == list(want)
    words = ["dieß", " Straße", "x", " ÿ", " of", "a×b", " 12", "\nthe", "the\n", "it's"]
    ids, sizes = encoder.encode(words)
    want = library_ids(words)
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert [w for w in words if tokens.ONE_WORD.fullmatch(w)] == words[:5]


def test_chunks_met_again_are_not_encoded_again():
    """A full table of chunks gives way to a new one, which takes over what is met again."""
    asked = []

    def encode(chunks):
        asked.extend(chunks)
        own = [list(c.encode()) for c in chunks]
        return np.array([i for o in own for i in o], np.uint32), np.array([len(o) for o in own], np.int64)

    encoder = tokens.BulkEncoder(encode, chunks=20)
    common = "the of and a-longer-common-chunk another-longer-common-chunk-beyond-16"
    for k in range(30):
        text = f"{common} n{k} {k}-chunks-of-its-own x"
        (got,) = encoder.ids([text])
        assert got.tolist() == list(text.encode())
    # As the first chunk of a text, and with a space: each once, though the table has been full several times.
    assert all(asked.count(c) == 1 for c in ("the", *(" " + w for w in common.split()[1:])))
    assert len(encoder.short) + len(encoder.long) < 40


def test_chunks_on_the_same_row(monkeypatch):
    """Chunks that fall on one row of the tables asked first are told apart by their bytes."""
    monkeypatch.setattr(tokens, "ROW_BITS", 1)
    encoder = tokens.BulkEncoder(lambda chunks: (np.array([i for c in chunks for i in c.encode()], np.uint32), np.array([len(c.encode()) for c in chunks])))
    rng = random.Random(8)
    for _ in range(5):
        texts = [" ".join("".join(rng.choice("abß") for _ in range(rng.randint(1, 20))) for _ in range(100)) for _ in range(3)]
        assert [x.tolist() for x in encoder.ids(texts)] == [list(t.encode()) for t in texts]


def test_resharding(spark, docs, rows, none):
    from pyspark.sql import functions as F

    old = F.when(F.col("doc_id") % 3 == 0, F.lit(0)).otherwise((F.col("doc_id") % 4).cast("int"))
    df = resharding.reshard(docs, old, shards=4)
    got = by_id(df)
    slots = defaultdict(list)
    for d, t in rows:
        raw = (t or "").encode()
        assert (got[d]["size"], got[d]["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        slots[got[d]["shard"]].append(got[d]["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert resharding.reshard(none, F.lit(0)).count() == 0


def test_resharding_writes_shards(spark, rows, monkeypatch, tmp_path):
    from pyspark.sql import functions as F

    monkeypatch.setattr(resharding, "shared_dir", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(resharding, "BUCKET_ROWS", 7)
    many = [(d, t, d % 3, "s") for d, t in rows] + [(1, "other text", 0, "s"), (1, "other text", 0, "s"), (1, None, 2, "s"), (None, "no id", 1, "s"), (None, "no id", None, "s")]
    docs = spark.createDataFrame(many, "doc_id long, text string, slot int, `old.shard` string")
    got = [tuple(r) for r in resharding.reshard(docs, F.col("slot"), shards=5).select("doc_id", "size", "text_crc32", "old_shard", "shard", "slot").collect()]
    files = spark.read.parquet(*map(str, tmp_path.glob("shards-*"))).collect()
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)
    assert sorted((tuple(r["row"]) for r in files), key=lambda r: str(r)) == sorted(many, key=lambda r: str(r))
    raw = lambda t: (t or "").encode()
    want = [(r["row"]["doc_id"], len(raw(r["row"]["text"])) + 8, zlib.crc32(raw(r["row"]["text"])), r["row"]["slot"] or 0, r["shard"], r["slot"]) for r in files]
    assert sorted(got, key=key) == sorted(want, key=key)
    slots = defaultdict(list)
    for r in got:
        slots[r[4]].append(r[5])
    assert len(slots) == 5 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    # The plan of the sizes says the same.
    plan = resharding.place(docs, F.col("slot"), shards=5)[0].select("doc_id", "size", "text_crc32", "old_shard", "shard", "slot")
    assert sorted((tuple(r) for r in plan.collect()), key=key) == sorted(got, key=key)


def test_resharding_leaves_even_shards(spark, monkeypatch, tmp_path):
    from pyspark.sql import functions as F

    monkeypatch.setattr(resharding, "shared_dir", lambda _: f"file://{tmp_path}")
    docs = spark.createDataFrame([(k, "x" * 10, 0 if k < 2 else 1 if k < 8 else 2 if k < 12 else 3) for k in range(16)], "doc_id long, text string, s int")
    got = resharding.reshard(docs, F.col("s"), shards=4).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(16))
    assert {p.name for p in tmp_path.glob("shards-*/shard=*")} == {"shard=0", "shard=1"}
    assert all(r["shard"] == r["old_shard"] for r in got if r["old_shard"] > 1)


def test_flow_moves_least():
    for _ in range(50):
        sizes = {k: RNG.randint(0, 500) for k in range(6)}
        total = sum(sizes.values())
        want = resharding.equal_capacities(total, 6)
        moved = sum(b - a for old, a, b, new in resharding.blocks(sizes, 6) if old != new)
        assert moved == sum(max(0, sizes[k] - want[k]) for k in range(6))


def test_line_dedup(spark, docs, rows, none):
    got = {d: list(r["removed"]) for d, r in by_id(linededup.join(docs)).items()}
    want = linededup.brute_force(rows)
    assert got == want and sum(map(len, want.values()))
    out = by_id(linededup.dedup_documents(docs))
    for d, t in rows:
        assert out[d]["text"] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[d]))
    assert linededup.dedup_documents(docs).columns == docs.columns and linededup.join(none).count() == 0 and linededup.dedup_documents(none).count() == 0


@pytest.mark.parametrize("common", [[], list(range(linededup.SLOTS - 1, -1, -131))])
def test_line_dedup_does_not_depend_on_sampled_counts(spark, monkeypatch, common):
    """The tokens' order alone comes from the counts: without any, or with every 131st slot put last, the same lines go."""
    rng = np.random.default_rng(9)
    lines = [[f"w{k}" for k in rng.integers(0, 300, rng.integers(1, 40))] for _ in range(25)]
    rows = []
    for d in range(40):
        own = []
        for k in rng.integers(0, 25, 3):
            line = list(lines[k])
            line[rng.integers(0, len(line))] = f"v{rng.integers(0, 50)}"
            own.append(" ".join(line if d % 3 else lines[k]))
        rows.append((d, "\n".join(own)))
    monkeypatch.setattr(linededup, "common_slots", lambda docs: common)
    got = {r["doc_id"]: list(r["removed"]) for r in linededup.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = linededup.brute_force(rows)
    assert got == want and 10 < sum(map(len, want.values())) < 120


def test_line_dedup_of_copies(spark):
    line, other = "a line that is in every single document of this small table", "b line that is in no more than one document of the table"
    near = lambda k: " ".join([f"n{i}" for i in range(40)] + [f"k{k}"])
    rows = [(k, f"{line}\n{near(k)}\nown words of number {k} are here to stay w{k} x{k} y{k}") for k in range(300)]
    rows += [(3, rows[3][1]), (4, f"{other}\n{line}"), (None, other), (None, None), (5, None)]
    docs = spark.createDataFrame(rows, "`doc.id` long, text string").withColumn("removed", linededup.F.lit(1))
    got = [(r["doc_id"], r["n_lines"], r["removed"]) for r in linededup.join(docs, "doc.id").collect()]
    # A null id is first; rows of one id are in order of text; a row that is there twice counts once.
    want, seen = [], [None]
    for d, t in rows:
        gone = []
        if t == rows[0][1]:
            gone = []
        elif d is not None and t:
            for k, x in enumerate(t.split("\n")):
                if x == line or x.startswith("n0 ") or x == other:
                    gone.append(k)
        want.append((d, len(t.split("\n")) if t else 0, gone))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    out = linededup.dedup_documents(docs, "doc.id")
    assert out.columns == docs.columns and out.count() == len(rows)


def test_line_dedup_of_long_and_near_lines(spark, monkeypatch):
    rng = random.Random(17)
    base = [[f"v{rng.randrange(400)}" for _ in range(rng.choice([4, 5, 6, 9, 20, 60, 150]))] for _ in range(25)]
    rows = []
    for k in range(60):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((k, "\n".join([" ".join(words), " ".join(rng.choice(base))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = linededup.brute_force(rows)
    assert {r["doc_id"]: list(r["removed"]) for r in linededup.join(docs).collect()} == want and sum(map(len, want.values())) > 20
    # Sizes and places beyond what a posting holds.
    for name, value in (("MOST", 15), ("LAST_PLACE", 7)):
        monkeypatch.setattr(linededup, name, value)
    assert {r["doc_id"]: list(r["removed"]) for r in linededup.join(docs).collect()} == want


def test_ngram_join(spark, docs, rows, none):
    got = {d: (r["n_shingles"], r["component_id"]) for d, r in by_id(ngramjoin.join(docs)).items()}
    want = ngramjoin.brute_force(dict(rows))
    assert got == want and len({c for _, c in want.values()}) < len(want)
    kept = ngramjoin.keep_first(docs.unionByName(docs.where("doc_id = 1")))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([d for d, (_, c) in want.items() if d == c] + [1] * (want[1][0] == 0))
    assert ngramjoin.join(none).count() == 0 and ngramjoin.keep_first(none).count() == 0


def test_ngram_join_links_null_ids(spark):
    words = lambda k: [f"w{k}x{i}" for i in range(60)]
    a, b, c = (" ".join(words(k)) for k in range(3))
    rows = [(7, a), (None, a.upper()), (None, a.replace(" ", "  ")), (9, a + " more"), (None, b), (None, b.upper()), (None, b), (None, b + " tail"), (None, b + " tail"), (None, c), (-4, "on its own"), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngramjoin.join(docs).collect()), key=str)
    assert got == sorted([(7, 7), (None, 7), (None, 7), (9, 7), (-4, -4)] + [(None, None)] * 8, key=str)
    kept = [tuple(r) for r in ngramjoin.keep_first(docs).collect()]
    of_b = [t for d, t in kept if t and t.lower().startswith("w1x")]
    assert len(of_b) == 1
    assert sorted(((d, t) for d, t in kept if t not in of_b), key=str) == sorted([(7, a), (None, c), (-4, "on its own"), (None, ""), (None, None)], key=str)


def test_trie_links_connect_as_all_pairs_do():
    for _ in range(150):
        base = np.arange(RNG.randint(3, 40)).astype(np.uint64)
        sets = []
        for _ in range(RNG.randint(2, 25)):
            drop = RNG.sample(range(len(base)), RNG.randint(0, max(1, len(base) // 4)))
            more = [RNG.randint(100, 130) for _ in range(RNG.randint(0, 4))]
            sets.append(np.unique(np.concatenate([np.delete(base, drop), np.array(more, np.uint64)])))
        a, b = ngramjoin.Groups(len(sets)), ngramjoin.Groups(len(sets))
        for x, y in ngramjoin.trie_links(sets):
            n = len(np.intersect1d(sets[x], sets[y]))
            assert 4 * n >= 3 * (len(sets[x]) + len(sets[y]) - n)
            a.up[a.top(x)] = a.top(y)
        for x in range(len(sets)):
            for y in range(x):
                n = len(np.intersect1d(sets[x], sets[y]))
                if 4 * n >= 3 * (len(sets[x]) + len(sets[y]) - n):
                    b.up[b.top(x)] = b.top(y)
        same = lambda g: [[g.top(x) == g.top(y) for x in range(len(sets))] for y in range(len(sets))]
        assert same(a) == same(b)


def test_order_minhash(spark, docs, rows, none):
    got = by_id(orderminhash.compare_edited(docs))
    order = sorted(rows, reverse=True)
    for k, (d, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    prints = defaultdict(set)
    for d, t in rows:
        prints[t or ""].add(got[d]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    moved = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(300))), (2, " ".join(f"w{k}" for k in [*range(150, 300), *range(150)]))], "doc_id long, text string")
    assert by_id(orderminhash.compare_edited(moved))[1]["near_next"] < 0.9
    assert orderminhash.compare_edited(none).count() == 0


def test_order_minhash_equals_brute_force(spark, docs, rows, monkeypatch):
    more = ["a b " * 100, "a b " * 3, "a b", "a", "b a b a b a c", " ".join(RNG.choice(WORDS) for _ in range(20_000))]
    texts = [t for _, t in rows] + more
    table = spark.createDataFrame([(k if k % 5 else None, t) for k, t in enumerate(texts)] + [(7, texts[7]), (7, "again"), (8, None)], "`the.id` long, text string")
    got = defaultdict(set)
    for r in orderminhash.fingerprints(table.withColumn("t", orderminhash.F.col("text")).select("t", "`the.id`"), "the.id", "t").collect():
        got[r["doc_id"]].add(tuple((e >> 32, e & 0xFFFFFFFF) for e in r["entries"]))
    for k, t in enumerate(texts):
        assert tuple(sorted(orderminhash.brute_force(t).items())) in got[k if k % 5 else None]
    few, many = orderminhash.brute_force("a b " * 3), orderminhash.brute_force("a b " * 100)
    assert sum(few[b] == many.get(b) for b in few) < len(many) and few != many
    # The next row, with null and repeated ids, in buckets of a row or two and divided ones.
    want = None
    for size, most in ((1000, 10), (2, 10), (1, 3), (1, 1)):
        monkeypatch.setattr(orderminhash, "BUCKET_ROWS", size)
        monkeypatch.setattr(orderminhash, "BUCKETS", most)
        found = sorted((tuple(r) for r in orderminhash.compare_edited(table, "the.id").collect()), key=repr)
        want = want or found
        assert found == want and len(found) == len(texts) + 3
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    order = sorted(((r["the.id"], r["text"] or "") for r in table.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest(r[1].encode(), 42)), r[1]))
    alike = lambda a, b: sum(a.get(k) == v for k, v in b.items()) / len(a | b) if a or b else 1.0
    likeness = sorted(alike(orderminhash.brute_force(t), orderminhash.brute_force(order[(k + 1) % len(order)][1])) for k, (_, t) in enumerate(order))
    assert np.allclose(likeness, sorted(r[6] for r in want))


def test_revisits(spark):
    h = lambda **k: {n.replace("_", "-"): v for n, v in k.items()}
    rows = [
        (1, "response", "http://WWW.a.com:80/x/?b=2&a=1#f", 10, "d1", h(etag='"1"', content_length="5", expires="e")),
        (2, "response", "https://a.com/x?a=1&b=2", 20, "d2", h(etag='"2"', content_length="6")),
        (3, "revisit", "a.com/x?a=1&b=2", 15, "d1", h(etag='W/"1"', date="now", content_length="0")),
        (4, "revisit", "http://a.com/x?b=2&a=1", 25, "d2", h(etag='"1"')),
        (5, "revisit", "http://a.com/x?b=2&a=1", 5, "d1", h()),
        (6, "revisit", None, 5, "d1", h()),
        (7, "revisit", "http://a.com/x?b=2&a=1", 30, "d2", h()),
    ]
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, ts long, digest string, headers map<string,string>")
    for size in (1000, 1):
        got = {r["record_id"]: r for r in revisits.resolve(df, size).collect()}
        assert {k: (r["response_id"], r["status"]) for k, r in got.items()} == {3: (1, "resolved"), 4: (2, "validator_mismatch"), 5: (None, "no_response"), 6: (None, "no_response"), 7: (2, "resolved")}
        assert got[3]["headers"] == {"etag": 'W/"1"', "date": "now", "content-length": "5", "expires": "e"}
    assert revisits.resolve(df.limit(0)).count() == 0


def connected(n, edges):
    g = ngramjoin.Groups(n)
    for x, y in edges:
        g.up[g.top(x)] = g.top(y)
    return lambda x, y: g.top(x) == g.top(y)


def linked_pairs(sets):
    for y in range(len(sets)):
        for x in range(y):
            n = len(np.intersect1d(sets[x], sets[y]))
            if 4 * n >= 3 * (len(sets[x]) + len(sets[y]) - n):
                yield x, y


def near_sets(groups, members, size=60):
    """Sorted by size; most sets of a group are linked."""
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(groups):
        base = rng.integers(0, 1 << 63, size).astype(np.uint64)
        for _ in range(members):
            more = rng.integers(0, 1 << 63, int(rng.integers(0, 8))).astype(np.uint64)
            sets.append(np.unique(np.concatenate([base[rng.random(size) > 0.08], more])))
    return sorted(sets, key=len)


@pytest.mark.parametrize("groups, members", [(1, 20), (5, 6), (3, 150), (120, 2)])
def test_runs_connect_all_links(groups, members):
    sets = near_sets(groups, members)
    n, rep = np.array([len(s) for s in sets]), np.arange(len(sets))
    bits = np.frombuffer(b"".join(map(ngramjoin.parity, sets)), np.uint64).reshape(-1, ngramjoin.PARITY // 64)
    joiner, edges = ngramjoin.Joiner(), []
    for run in (7, 8):  # again: what is known needs no edges
        edges += joiner.edges(np.full(len(sets), run), n, rep, bits)[:, :2].tolist()
    same = connected(len(sets), edges)
    assert all(same(x, y) for x, y in linked_pairs(sets))


def test_long_prefixes_share_enough():
    for _ in range(300):
        n = RNG.randint(1, 300)
        x = np.array(sorted(RNG.sample(range(2 * n), n)))
        y = np.unique(np.concatenate([np.array(sorted(RNG.sample(x.tolist(), n - n // RNG.randint(8, 30))), int), np.array(RNG.sample(range(2 * n), n // 12), int)]))
        for a, b in linked_pairs([x, y]):
            a, b = (x, y)
            shared = [p[: ngramjoin.prefix_length(len(p), ngramjoin.in_long_prefix(len(p)))] for p in (a, b)]
            least = ngramjoin.in_long_prefix(-(-3 * len(a) // 4)), ngramjoin.in_long_prefix(-(-3 * len(b) // 4))
            assert len(np.intersect1d(*shared)) >= max(least)
            assert len(np.intersect1d(*(p[: ngramjoin.prefix_length(len(p))] for p in (a, b))))


def test_ngram_join_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "CHUNK", 4)
    monkeypatch.setattr(ngramjoin, "PIVOTS", 1)
    rng = random.Random(3)
    base = [[f"b{g}w{k}" for k in range(80)] for g in range(3)]
    rows = []
    for k in range(45):
        words = list(base[k % 3])
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words[: rng.choice([80, 80, 60, 55])])))
    docs = spark.createDataFrame([*rows, rows[5], rows[6]], "doc_id long, `a.text` string").withColumn("x.y", ngramjoin.F.lit(1))
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngramjoin.join(docs, text_col="a.text").collect()}
    want = ngramjoin.brute_force(dict(rows))
    assert got == {(d, *v) for d, v in want.items()}
    kept = ngramjoin.keep_first(docs, text_col="a.text")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, (_, c) in want.items() if c == d)


def test_revisits_of_odd_records(spark):
    url, many = "http://a.com/x", "http://b.com/"
    rows = [
        (1, "response", url, 10, "d1", {"etag": "e", "server": "s"}),
        (1, "response", url, 10, "d1", {"etag": "e", "server": "s"}),
        (2, "revisit", url, 20, "d1", {"date": "x"}),
        (2, "revisit", url, 20, "d1", {"date": "x"}),
        (3, "response", "http://a.com/y", 10, "d2", None),
        (4, "revisit", "http://a.com/y", 11, "d2", None),
        (5, "revisit", url, 12, "d1", None),
        (None, "revisit", url, 30, "d1", {"etag": "e"}),
        (6, "revisit", url, None, "d1", {}),
        (8, "revisit", url, 10, None, {}),
        (0, "revisit", url, 10, "d1", {}),
        (None, "response", "http://c.com/", None, "d3", {"etag": "n"}),
        (7, "revisit", "http://c.com/", None, "d3", {}),
    ]
    rows += [(100 + k, "response" if k % 3 else "revisit", many, [None, 5, 5][k // 20], "d", {}) for k in range(60)]
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, ts long, digest string, headers map<string,string>").withColumn("old", revisits.F.lit(1))
    before = lambda r, x: ((r[3] is not None, r[3] or 0, r[0] is not None, r[0] or 0) < (x[3] is not None, x[3] or 0, x[0] is not None, x[0] or 0))
    want = []
    for x in (r for r in rows if r[1] == "revisit"):
        had = [r for r in rows if r[1] == "response" and r[2] == x[2] and before(r, x)]
        best = max(had, key=lambda r: (r[3] is not None, r[3] or 0, r[0] or 0), default=None)
        ok = best and ((best[5] or {}).get("etag") == x[5]["etag"] if "etag" in (x[5] or {}) and "etag" in (best[5] or {}) else best[4] == x[4])
        status = "no_response" if best is None else "resolved" if ok else "validator_mismatch"
        want.append((x[0], x[3], best[0] if best else None, status, {**(best[5] or {}), **(x[5] or {})} if ok else x[5] or {}))
    for size in (1000, 7, 1):
        got = [(r["record_id"], r["ts"], r["response_id"], r["status"], r["headers"]) for r in revisits.resolve(df, size).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_line_dedup_shuffles_only_what_loses_lines(spark, docs, rows, monkeypatch):
    want = linededup.brute_force(rows)
    keys = spark.createDataFrame([(d,) for d in want if want[d]], "doc_id long").select(linededup.F.xxhash64("doc_id"))
    ids = docs.select("doc_id")
    may, rest = linededup._split(ids, linededup.F.xxhash64("doc_id"), keys)
    may, rest = ({r["doc_id"] for r in x.collect()} for x in (may, rest))
    assert may >= {d for d in want if want[d]} and may | rest == set(want) and not may & rest and len(rest) > 0.9 * sum(not g for g in want.values())
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", 1)  # the documents that lose lines are joined by shuffling, by a bitmap of one word
    out = by_id(linededup.dedup_documents(docs))
    assert out.keys() == want.keys() and linededup.dedup_documents(docs).columns == docs.columns
    for d, t in rows:
        assert out[d]["text"] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[d]))


def test_line_dedup_of_a_common_phrase(spark, monkeypatch):
    # More than four lines a group: only the second round meets the earlier match of the later ones.
    phrase = " ".join(f"p{k}" for k in range(12))
    rows = [(k, f"{phrase} " + " ".join(f"x{k % 9}y{i}" for i in range(10 + k % 3))) for k in range(40)]
    docs = spark.createDataFrame([(d, t + f" z{d}") for d, t in rows], "doc_id long, text string")
    want = linededup.brute_force([(d, t + f" z{d}") for d, t in rows])
    for sample in (1, linededup.SAMPLE, 1 << 40):  # what is counted decides the order of tokens, not the result
        monkeypatch.setattr(linededup, "SAMPLE", sample)
        assert {r["doc_id"]: list(r["removed"]) for r in linededup.join(docs).collect()} == want and 20 < sum(map(len, want.values())) < 40


def test_line_dedup_puts_common_tokens_last(spark, monkeypatch):
    # Only lines with a common token among their least hashes are put in order; all others keep the order by hash.
    rng = random.Random(5)
    phrase = [f"p{k}" for k in range(12)]
    rows = [(k, " ".join(phrase + [f"w{rng.randrange(10**6)}" for _ in range(30)] if k % 2 else [f"w{rng.randrange(10**6)}" for _ in range(42)])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(linededup, "SAMPLE", 1)
    common = linededup.common_slots(docs)
    got = linededup.with_prefix(linededup.with_tokens(docs, "text"), common).collect()
    shared = set.intersection(*(set(r["tokens"]) for r in got if r["doc_id"] % 2))
    assert len(shared) == 8 and {t % linededup.SLOTS for t in shared} == set(common)
    for r in got:
        want = sorted(r["tokens"], key=lambda t: (common.index(t % linededup.SLOTS) if t % linededup.SLOTS in common else -1, t))
        n = len(want)
        assert r["tokens"] == sorted(want) and r["prefix"] == want[: n // 4 + 1 + n // linededup.MORE] and not shared & set(r["prefix"])


def test_batches_are_encoded_in_parts(monkeypatch):
    """However many documents a batch has, a worker holds the ids of ENCODED_ROWS of them."""
    held, made = [], []

    class Encoder:
        def ids(self, texts):
            held.append(len(texts))
            return [np.arange(len(t), dtype=np.uint32) for t in texts]

    class Docs:
        def mapInArrow(self, encode, schema):
            made.append(encode)

    monkeypatch.setattr(packing, "id_text", lambda docs: Docs())
    monkeypatch.setattr(packing, "library_encoder", lambda path: Encoder())
    packing.pieces(None, "", 10)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1300)), "text": ["abc"] * 1300})
    out = pa.Table.from_batches(made[0](iter([batch, batch.slice(0, 0)])))
    assert max(held) <= packing.ENCODED_ROWS and out.column("doc_id").to_pylist() == list(range(1300)) and set(out.column("length").to_pylist()) == {4}


def test_a_worker_keeps_the_tables_of_one_operator():
    """The tables that quality fills go when the encoder's are filled, and the other way round."""
    made = []

    class Docs:
        class sparkSession:
            class sparkContext:
                @staticmethod
                def broadcast(value):
                    return type("Sent", (), {"value": value})

        columns = ["doc_id", "text"]
        schema = None

        def toDF(self, *names):
            return self

        def mapInArrow(self, judge, schema):
            made.append(judge)
            return self

    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some few words"]})
    quality.keep_documents(Docs(), np.zeros(64))
    path = tokenizer_file("byte_bpe_50k.json")
    tokens.library_encoder(path)
    list(made[0](iter([batch])))
    assert quality._hashes and not tokens._encoders
    tokens.library_encoder(path)
    assert tokens._encoders and not quality._hashes


def test_packing_bounds_the_encoders_tables(monkeypatch):
    """However many distinct words a worker meets, packing's encoder keeps TABLE_CHUNKS of them at most (but for two
    parts), and gives back the memory of those that go."""
    made, given = [], []

    class Docs:
        def mapInArrow(self, encode, schema):
            made.append(encode)

    path = tokenizer_file("byte_bpe_50k.json")
    monkeypatch.setattr(packing, "id_text", lambda docs: Docs())
    monkeypatch.setattr(tokens, "give_back", lambda: given.append(1), raising=False)
    packing.pieces(None, path)
    tokens._encoders.clear()
    texts = [" ".join(f"w{k}" for k in range(at, at + 1250)) for at in range(0, 450_000, 1250)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(360)), "text": texts})
    out = pa.Table.from_batches(made[0](batch.slice(k, 10) for k in range(0, 360, 10)))
    (encoder,) = tokens._encoders.values()
    tables = (encoder.short, encoder.long, *(encoder.before[:2] if encoder.before else ()))
    assert sum(map(len, tables)) <= 300_000 and len(given) == 2
    assert sum(out.column("length").to_pylist()) == sum(map(len, encoder.ids(texts))) + 360
