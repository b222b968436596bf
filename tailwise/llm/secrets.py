"""Secret scans in DataFrame functions alone: pattern kinds, then sliding-window entropy.

Three kinds of secrets are matched by pattern. Beside them, runs of key characters are candidates of one
character class (hex, upper or base64); a window of WINDOW characters slides over each, with character counts
and the sum of count * log2(count) updated from the character that enters and the one that leaves. Windows whose
Shannon entropy reaches the class's threshold are hot; a candidate's span reaches from its first hot window to
the end of its last. Allow-listed candidates add nothing. Of a candidate that touches a pattern's span, scan takes
nothing more; redact_documents scans what the spans leave of it, so that a second secret is masked too. Sums are
integers in units of 2**-20 bit, so every engine finds the same windows.

Defined cases: a null or empty text has no spans; offsets count code points; equal texts get equal spans;
repeated rows are scanned one by one; an empty table gives an empty result; scan ignores further columns,
redact_documents passes them through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailwise.llm.common import free_name

#: The patterns of the kinds and the least length of the part that counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN_LENGTH = 6

WINDOW = 20
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
CANDIDATE = r"[0-9A-Za-z+/_=-]{%d,}"
#: Classes in order: pattern of the whole candidate, entropy in bits from which a window is hot.
CLASSES = [(r"^[0-9]+$", 99.0), (r"^[A-Za-z]+$", 4.1), (r"^[0-9a-fA-F]+$", 3.0), (r"^[A-Z0-9]+$", 3.5), (r"^", 3.9)]
#: Candidates that are no secrets: placeholders, alphabets, UUIDs.
ALLOWED = r"(?i)example|placeholder|xxxxxx|0123456789|abcdefghij|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
UNIT = 1 << 20
#: Marks around matches; where a text has them itself, a character that no pattern matches stands for them.
OPEN, CLOSE, OTHER = "", "", ""
MASK = "[SECRET]"

_SPANS = "array<struct<start:int,kind:int,end:int,own:string>>"


def _quoted(s: str) -> str:
    """A SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, pattern: str, kind: int, test: str = "true") -> str:
    """SQL for the leftmost non-overlapping matches of pattern in the column text, as spans. test is SQL on the
    matched string x. Matches are marked, the marked text is split, and lengths are summed."""
    parts = f"split(regexp_replace({text}, {_quoted(pattern)}, '{OPEN}$0{CLOSE}'), '[{OPEN}{CLOSE}]', -1)"
    return f"""case when {text} rlike {_quoted(pattern)} then aggregate({parts},
        named_struct('p', 0, 'i', 0, 's', cast(array() as {_SPANS})),
        (a, x) -> named_struct('p', a.p + char_length(x), 'i', a.i + 1, 's',
            if(a.i % 2 = 1 and {test}, concat(a.s, array(named_struct('start', a.p, 'kind', {kind}, 'end', a.p + char_length(x), 'own', x))), a.s)),
        a -> a.s) else cast(array() as {_SPANS}) end"""


def _limit(bits: float, window: int) -> int:
    """Largest sum of count * log2(count) of a hot window, in units."""
    return math.floor((math.log2(window) - bits) * window * UNIT)


def hot_part(s: str, window: int = WINDOW) -> str:
    """SQL for (first, last): start of the first and end of the last hot window of the candidate s; first is -1
    if none is hot. Counts are updated by the entering and the leaving character only."""
    table = "array(" + ", ".join(f"{round(c * math.log2(c) * UNIT) if c else 0}L" for c in range(window + 2)) + ")"
    limit = "case " + " ".join(f"when {s} rlike {_quoted(p)} then {_limit(b, window)}L" for p, b in CLASSES) + " end"
    codes = f"transform(split({s}, ''), c -> instr({_quoted(ALPHABET)}, c) - 1)"
    state = "named_struct('n', array_repeat(0, %d), 'z', 0L, 'first', -1, 'last', -1)" % len(ALPHABET)
    # At i: the entering code is k[i], the leaving one g = k[i - window], or -1 while the window fills.
    steps = f"transform(q.k, (c, i) -> named_struct('i', i, 'c', c, 'g', if(i >= {window}, q.k[i - {window}], -1)))"
    z = f"a.z + if(x.c = x.g, 0L, {table}[a.n[x.c] + 1] - {table}[a.n[x.c]] + if(x.g < 0, 0L, {table}[a.n[x.g] - 1] - {table}[a.n[x.g]]))"
    hot = f"(x.i >= {window - 1} and {z} <= q.m)"
    merged = f"""named_struct('n', if(x.c = x.g, a.n, transform(a.n, (v, j) -> v + if(j = x.c, 1, 0) - if(j = x.g, 1, 0))), 'z', {z},
        'first', if({hot} and a.first < 0, x.i - {window - 1}, a.first), 'last', if({hot}, x.i + 1, a.last))"""
    return f"transform(array(named_struct('k', {codes}, 'm', {limit})), q -> aggregate({steps}, {state}, (a, x) -> {merged}, a -> named_struct('first', a.first, 'last', a.last)))[0]"


def spans(text: str, rest: bool = False) -> dict[str, str]:
    """SQL for the base spans, then for all spans, of a column of non-null texts without marks of their own."""
    base = ", ".join(
        (
            matches(text, ASSIGN, 0, f"char_length(regexp_extract(x, {_quoted(ASSIGN)}, 2)) >= {ASSIGN_LENGTH}"),
            matches(text, ACCESS, 1),
            matches(text, HEX, 2),
        )
    )
    # Pieces of a candidate are looked up in the allow list one by one.
    candidates = matches(text, CANDIDATE % WINDOW, 3, "true" if rest else f"not x rlike {_quoted(ALLOWED)}")
    return {"base": f"array_sort(concat({base}))", "candidates": candidates}


def _pieces(cand: str, base: str) -> str:
    """SQL for the parts of WINDOW or more characters that the sorted base spans leave of the candidates."""
    piece = lambda to: f"named_struct('start', a.p, 'kind', 3, 'end', {to}, 'own', substring(c.own, a.p - c.start + 1, {to} - a.p))"
    with_piece = lambda to: f"if({to} - a.p >= {WINDOW}, concat(a.s, array({piece(to)})), a.s)"
    cut = f"""aggregate(filter(`{base}`, b -> b.start < c.end and c.start < b.end), named_struct('p', c.start, 's', cast(array() as {_SPANS})),
        (a, b) -> named_struct('p', greatest(a.p, b.end), 's', {with_piece("b.start")}), a -> {with_piece("c.end")})"""
    return f"flatten(transform(`{cand}`, c -> {cut}))"


def scanned(df: DataFrame, text_col: str, name: str, rest: bool = False) -> DataFrame:
    """df with a column name: struct of base and all (arrays of start, kind, end, own), in order of start, kind. With
    rest, what base spans leave of a candidate is scanned too; else a candidate that touches one adds nothing."""
    taken = [*df.columns, name]
    clean = free_name(taken, "_clean")
    base, cand, hot = (free_name([*taken, clean], n) for n in ("_base", "_candidates", "_hot"))
    sql = spans(f"`{clean}`", rest)
    df = df.withColumn(clean, F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), OPEN + CLOSE, OTHER + OTHER))
    df = df.withColumn(base, F.expr(sql["base"])).withColumn(cand, F.expr(sql["candidates"]))
    df = df.withColumn(cand, F.expr(f"filter({_pieces(cand, base)}, c -> not c.own rlike {_quoted(ALLOWED)})" if rest else f"filter(`{cand}`, c -> not exists(`{base}`, b -> b.start < c.end and c.start < b.end))"))
    df = df.withColumn(
        hot,
        F.expr(
            f"""transform(filter(transform(`{cand}`, c -> named_struct('c', c, 'h', {hot_part("c.own")})), y -> y.h.first >= 0),
            y -> named_struct('start', y.c.start + y.h.first, 'kind', 3, 'end', y.c.start + y.h.last, 'own', substring(y.c.own, y.h.first + 1, y.h.last - y.h.first)))"""
        ),
    )
    whole = F.struct(F.col(base).alias("base"), F.array_sort(F.concat(base, hot)).alias("all"))
    return df.withColumn(name, whole).drop(clean, base, cand, hot)


def written(column: str) -> Column:
    """kind:start:end, comma-joined."""
    kinds = "array(" + ", ".join(map(_quoted, KINDS)) + ")"
    return F.expr(f"array_join(transform({column}, s -> concat({kinds}[s.kind], ':', s.start, ':', s.end)), ',')")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, found (the spans with their strings)."""
    df = scanned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "found")
    count = lambda k: F.expr(f"cast(size(filter(found.base, s -> s.kind = {k})) as long)")
    return df.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written("found.base"), 256).alias("base_sha256"),
        written("found.all").alias("spans"),
        F.col("found.all").alias("found"),
    )


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every span replaced by MASK (overlapping spans by one). Null texts stay null. length_col, if the
    table has it, is set to the new number of code points where the text has changed."""
    name = free_name(docs.columns, "_found")
    df = scanned(docs, text_col, name, rest=True)
    text = f"`{text_col}`"
    masked = f"""aggregate(`{name}`.all, named_struct('p', 0, 's', ''),
        (a, x) -> if(x.start >= a.p, named_struct('p', x.end, 's', concat(a.s, substring({text}, a.p + 1, x.start - a.p), '{MASK}')), named_struct('p', greatest(a.p, x.end), 's', a.s)),
        a -> concat(a.s, substring({text}, a.p + 1)))"""
    changed = f"{text} is not null and size(`{name}`.all) > 0"
    df = df.withColumn(text_col, F.expr(f"if({changed}, {masked}, {text})"))
    if length_col in docs.columns:
        kind = dict(docs.dtypes)[length_col]
        df = df.withColumn(length_col, F.expr(f"if({changed}, cast(char_length({text}) as {kind}), `{length_col}`)"))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])
