import hashlib
import math
import random
import re

from tailwise.llm import secrets as S

ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token)|(?i:api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def brute(text):
    """All spans by direct counting of every window."""
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    more = []
    for m in re.finditer(r"[0-9A-Za-z+/_=-]{20,}", text):
        s = m[0]
        if re.search(S.ALLOWED, s) or any(b[0] < m.end() and m.start() < b[2] for b in base):
            continue
        bits = next(b for p, b in S.CLASSES if re.search(p, s))
        hot = []
        for i in range(len(s) - 19):
            w = s[i : i + 20]
            h = -sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w))
            if h >= bits - 1e-7:
                hot.append(i)
        if hot:
            more.append((m.start() + hot[0], 3, m.start() + hot[-1] + 20))
    put = lambda x: ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(x))
    return [sum(b[1] == k for b in base) for k in range(3)] + [hashlib.sha256(put(base).encode()).hexdigest(), put(base + more)]


def texts():
    rng = random.Random(5)
    key = lambda n, a=S.ALPHABET: "".join(rng.choice(a) for _ in range(n))
    out = [None, "", "password=abc", "secret=token:abcdef12", "Token: 'abcdef.x' api_key=\"zzzzzz\"", "AKIA" + "A" * 16, "AKIA" + "Z" * 15, "é " + key(40), "a" * 50, key(30) + "EXAMPLE", "0123456789" * 4]
    out += ["ſecret=abcdefgh", "apiKey : =abcdefg", "x" * 5000 + key(3000), "12345678-1234-1234-1234-123456789012"]
    for _ in range(150):
        parts = [rng.choice(["wörd ", "und ", "\n", "password=", "token = ", "SECRET:", key(rng.randint(1, 60)) + " ", key(30, "0123456789abcdef"), "AKIA" + key(16, "ABCDEFGH0123"), "", "thanandthewithforandthe ", '"']) for _ in range(rng.randint(1, 12))]
        out.append("".join(parts))
    return out


def test_scan_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    got = {r["doc_id"]: r for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        r = got[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]] == brute(t), t


def test_redaction_keeps_columns_and_clean_rows(spark):
    rows = [(1, "clean text", 10, "a"), (2, None, None, "b"), (2, "x password=abcdef12 y", 21, "c"), (None, "token=secret=abcdefgh!", 22, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, _found string")
    out = S.redact_documents(docs)
    assert out.columns == docs.columns
    got = {r["_found"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {"a": ("clean text", 10), "b": (None, None), "c": ("x [SECRET] y", 12), "d": ("[SECRET]!", 9)}
    assert S.redact_documents(docs.limit(0)).count() == 0


def test_redaction_masks_what_patterns_leave(spark):
    rng = random.Random(8)
    key = lambda n, a=S.ALPHABET[:62]: "".join(rng.choice(a) for _ in range(n))
    access, hexa = "AKIA" + key(16, "ABCDEFGH0123"), key(30, "0123456789abcdef")
    one, two, three = (key(40) for _ in range(3))
    texts = [f"{access}/{one} x", f"a {hexa}_{one}", f"{one}/{hexa}/{two}/{access}/{three} é", f"{access}/short", f"{one} {two}", f"{hexa}_{key(30)}EXAMPLE", f"é password={one} {two}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in S.redact_documents(docs, length_col=None).collect()}
    for i in (0, 1, 2, 4, 6):
        assert not any(x[8:-8] in got[i] for x in (one, two, three, access, hexa)), got[i]
    assert got[3] == "[SECRET]/short" and got[5].startswith("[SECRET]_") and got[5].endswith("EXAMPLE")
