"""Periodic runs, language mixtures and importance resampling against plain Python, on tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tailwise.llm import languages, periodic, resampling

KIND = "doc_id long, text string, lang string, kept boolean, runs string, n_words long, `a.b` int"
SPACES = r"[^\x20\x09-\x0D]+"


def rows_of(texts, ids=None):
    ids = ids or range(1, len(texts) + 1)
    return [(d, t, "en", True, "r", 5, 1) for d, t in zip(ids, texts, strict=True)]


def slow_runs(w, shortest=24, repeats=3):
    n, out = len(w), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            size, s = j - i + q, w[i : j + q]
            if j > i and size >= max(shortest, repeats * q) and not any(s[p:] == s[:-p] for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out)


def repetitive(r, n):
    w = [r.randrange(r.choice([1, 2, 3, 6, 40])) for _ in range(n)]
    for _ in range(r.randint(0, 3)):
        if n > 30:
            a, p = r.randrange(n), r.randint(1, 20)
            for i in range(a + p, min(n, a + r.randint(10, 120))):
                w[i] = w[i - p]
    return w


def test_find_runs_brute_force():
    r, met = random.Random(5), 0
    for _ in range(400):
        w = repetitive(r, r.randint(0, 150))
        got = periodic.find_runs(np.array(w, dtype=np.int64))
        assert got == slow_runs(w)
        met += len(got)
    assert met > 100
    assert periodic.find_runs(np.array([1, 2] * 5), 4, 2) == slow_runs([1, 2] * 5, 4, 2) == [(0, 10, 2)]
    with pytest.raises(ValueError, match="twice"):
        periodic.find_runs(np.zeros(30, dtype=np.int64), 24, 1)


def planted_words(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@pytest.fixture(scope="module")
def odd_texts():
    r = random.Random(7)
    made = [" ".join(f"w{k}" for k in repetitive(r, r.randint(1, 200))) for _ in range(60)]
    return [*made, None, "", " \n\t", "one", "a b " * 3000, "x" * 50_000, "ab\x0bcd\x0cef nbsp in é\n" * 12, made[0], made[0]]


def test_periodic_query(spark, odd_texts):
    ids = [*range(1, len(odd_texts) - 2), None, 7, 7]
    got = periodic.digests(periodic.collapse(periodic.planted(spark.createDataFrame(rows_of(odd_texts, ids), KIND)))).collect()
    assert len(got) == len(odd_texts)
    want = []
    for d, t in zip(ids, odd_texts, strict=True):
        w = planted_words(d, re.findall(SPACES, t or ""))
        runs = slow_runs(w)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        printed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        want.append((d, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(printed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(w[1] > 0 for w in want) > 20
    none = spark.createDataFrame([], KIND)
    assert periodic.digests(periodic.collapse(periodic.planted(none))).collect() == []


def prose(r, letters, n):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


TONGUES = {"aa": "abcdeeei", "bb": "fghijoou", "cc": "abgklmnü"}


@pytest.fixture(scope="module")
def tongues(spark):
    r = random.Random(3)
    rows = []
    for d in range(300):
        lang = r.choice(list(TONGUES))
        rows.append((d, prose(r, TONGUES[lang], r.randint(5, 60)), lang, True, "", 1, 1))
    rows += [(400, None, "aa", True, "", 1, 1), (401, "12 %% \n", "bb", True, "", 1, 1), (402, "", "cc", True, "", 1, 1), (None, "fooj", None, True, "", 1, 1), (7, "Éa ça", None, True, "", 1, 1), (404, prose(r, TONGUES["aa"], 60) + " " + prose(r, TONGUES["bb"], 40), None, True, "", 1, 1), (405, prose(r, TONGUES["bb"], 30_000), None, True, "", 1, 1)]
    return spark.createDataFrame(rows, KIND), rows


def test_language_held_out_accuracy(spark, tongues):
    docs, rows = tongues
    got = languages.predict(docs, *languages.learn(docs)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 7}
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[0] != 7]
    assert held and all(by[r[0]]["held_out"] for r in held)
    assert sum(by[r[0]]["lang_pred"] == r[2] for r in held) >= 0.95 * len(held)
    for d in (400, 401, 402):
        assert by[d]["lang_pred"] == "und" and by[d]["score"] == 0 and by[d]["languages"] == []
    assert by[None]["held_out"] and by[None]["lang_pred"] in TONGUES
    assert by[404]["languages"] == ["aa", "bb"] and abs(by[404]["shares"][0] - 0.6) < 0.1
    assert by[405]["languages"] == ["bb"] and all(0 <= r["score"] <= 1 for r in got)


def test_language_learning_is_of_the_rest_only(spark, tongues):
    docs, rows = tongues
    names, table = languages.learn(docs)
    assert names == sorted(TONGUES)
    want = np.zeros_like(table)
    for d, text, lang, *_ in rows:
        if lang and text and d is not None and zlib.crc32(str(d).encode()) % 5:
            words = list(languages.counted(text).items())
            if words:
                found, place = languages.grams([w for w, _ in words])
                for b in found:
                    np.add.at(want[names.index(lang)], b, np.array([n for _, n in words])[place])
    assert (table == want).all()
    nothing = languages.learn(docs.where("lang = 'zz'"))
    assert {r["lang_pred"] for r in languages.predict(docs, *nothing).collect()} == {"und"}
    assert languages.predict(docs.limit(0), names, table).collect() == []


def slow_mixture(likely, counts, steps=languages.STEPS):
    share = np.full(likely.shape[1], 1 / likely.shape[1])
    for _ in range(steps):
        new = np.zeros(len(share))
        for p, c in zip(likely, counts, strict=True):
            new += c * p * share / (p * share).sum()
        new /= counts.sum()
        moved, share = abs(new - share).max(), new
        if moved < languages.TOLERANCE:
            break
    return share, sum(c * math.log((p * share).sum()) for p, c in zip(likely, counts, strict=True))


def test_language_mixture_brute_force():
    r = np.random.default_rng(2)
    for _ in range(30):
        n, d = int(r.integers(1, 30)), int(r.integers(1, 6))
        likely, counts = np.exp(-3 * r.random((n, d)) * (r.random((n, d)) < 0.6)), r.integers(1, 9, n).astype(float)
        got = languages.choose(likely, counts, np.array([0]))[0]
        order = np.argsort(-slow_mixture(likely, counts)[0], kind="stable")
        best, value = [0], slow_mixture(likely[:, order[:1]], counts)[1]
        for k in range(2, d + 1):
            found = slow_mixture(likely[:, order[:k]], counts)[1] - languages.PENALTY * 0.5 * math.log(counts.sum()) * (k - 1)
            if found <= value:
                break
            best, value = range(k), found
        want = np.zeros(d)
        want[order[list(best)]] = slow_mixture(likely[:, order[list(best)]], counts)[0]
        assert np.allclose(got, want, atol=1e-9)


def test_language_batches_do_not_matter():
    """A text's word likelihoods, taken alone or in a batch, are the same, also for marks and letters beyond 16 bits."""
    texts = ["déjà vu 𝒜𝒷 straße", "vu", "½² Ⅷ 3", "İstanbul ǅ"]
    assert [sorted(languages.counted(t)) for t in texts] == [sorted(["déjà", "vu", "𝒜𝒷", "straße"]), ["vu"], [], sorted(["i̇stanbul", "ǆ"])]
    table = np.random.default_rng(1).integers(0, 50, (2, languages.BUCKETS)).astype(np.float32)
    words = ["vu", "straße", "a"]
    sizes = np.array([1e5, 1e5])
    together = languages.word_likelihoods(words, table, sizes)
    assert np.allclose(together, np.concatenate([languages.word_likelihoods([w], table, sizes) for w in words]))


def slow_resample(rows, target, ngram):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return w, [" ".join(w[i : i + k]) for k in range(1, ngram + 1) for i in range(len(w) - k + 1)]

    n = resampling.BUCKETS
    count = lambda texts: Counter(zlib.crc32(f.encode()) % n for t in texts for f in features(t)[1])
    s, t = count(x for _, x in rows), count(target)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + n) / ((s[b] + 1) * (sum(t.values()) + n))))
    out, able = [], []
    for d, text in rows:
        w, f = features(text)
        weight = sum(gain(zlib.crc32(x.encode()) % n) for x in f)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        own = [d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        out.append(own)
        if len(w) >= 20:
            able.append(own)
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, own in enumerate(able[: len(able) * 10 // 100]):
        own[4] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("ngram", [1, 2, 3])
def test_resampling_brute_force(spark, ngram):
    r = random.Random(ngram)
    words = ["the", "Of", "STRASSE", "straße", "x1", "a_b", "don't", "é e", "12", "~", "\x7f", "Ünder"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(150)] + [None, "", "~~ ,", "word " * 4000]
    ids = [*range(150), None, 7, 7, 3]
    target = [" ".join(r.choice(words[:4]) for _ in range(30)) for _ in range(5)] + [None]
    docs = spark.createDataFrame(rows_of(texts, ids), KIND).repartition(7)
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id int, text string")
    got = resampling.resample(docs, goal, ngram)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == slow_resample(list(zip(ids, texts, strict=True)), target, ngram)


def test_resampling_empty_and_ties(spark):
    none, goal = spark.createDataFrame([], KIND), spark.createDataFrame([], "text string")
    assert resampling.resample(none, goal).collect() == []
    same = " ".join(["same"] * 25)
    docs = spark.createDataFrame(rows_of([same] * 40, [5] * 40), KIND)
    got = [r["rank"] for r in resampling.resample(docs, goal).collect()]
    assert sorted(x for x in got if x) == [1, 2, 3, 4] and len(got) == 40
