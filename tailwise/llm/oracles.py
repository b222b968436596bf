"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from tailwise.llm import quality, resampling

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _shingles(w: str) -> str:
    return f"case when len({w}) >= 5 then list_distinct(list_transform(range(1, len({w}) - 3), lambda i: array_to_string({w}[i:i + 4], ' '))) when len({w}) > 0 then [array_to_string({w}, ' ')] else [] end"


OP9 = f"""with recursive d as (select doc_id, {_words(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} as w from documents),
s as (select doc_id, unnest({_shingles('w')}) as g from d),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
e as (select a, b from l union select b, a from l),
r(doc, c) as (select doc_id, doc_id from documents union select e.b, r.c from r join e on e.a = r.doc where r.c < e.b),
m as (select doc, min(c) as c from r group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.c as component_id from d left join n using (doc_id) join m on m.doc = d.doc_id"""

OP4 = f"""with l as (select doc_id, line, {_words('own')} as w from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as own, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as line from documents)),
k as (select doc_id, line, {_shingles('w')} as t from l where len(w) > 0),
s as (select doc_id, line, len(t) as n, unnest(t) as g from k),
p as (select b.doc_id, b.line, a.doc_id as ad, a.line as al, count(*) as c, any_value(a.n) as x, any_value(b.n) as y from s a join s b on a.g = b.g and (a.doc_id < b.doc_id or a.doc_id = b.doc_id and a.line < b.line) group by 1, 2, 3, 4),
r as (select distinct doc_id, line from p where 4 * c >= 3 * (x + y - c)),
g as (select doc_id, count(*) as c, string_agg(line::varchar, ',' order by line) as removed from r group by 1),
m as (select doc_id, count(*) as c from k group by 1)
select d.doc_id, coalesce(m.c, 0)::bigint as n_lines, coalesce(g.c, 0)::bigint as n_removed, coalesce(g.removed, '') as removed from documents d left join m using (doc_id) left join g using (doc_id)"""

_B, _M = quality.BUCKETS, quality.MULTIPLIER
OP1 = f"""with d as (select doc_id, coalesce(text, '') as text, {_words("coalesce(text, '')")} as w from documents),
u as (select doc_id, generate_subscripts(w, 1) as i, unnest(w) as x from d),
v as (select x, ('0x' || substr(md5(x), 1, 8))::bigint as h from (select distinct x from u)),
q as (select doc_id, i, x, h, lead(h) over o as h2, lead(x) over o as x2, lead(x, 2) over o as x3 from u join v using (x) window o as (partition by doc_id order by i)),
b as (select doc_id, h % {_B} as b from q union all select doc_id, (h * {_M} + h2) % {_B} from q where h2 is not null),
t as (select doc_id from labels group by 1 having min(quality) = 1 and max(coalesce(toxic, 0)) = 0),
c as (select b, count(*) as raw, count(t.doc_id) as good from b left join t using (doc_id) group by 1),
z as (select sum(raw) as raw, sum(good) as good from c),
f as (select b, ln((c.good + 1) / (z.good + {_B})::double) - ln((c.raw + 1) / (z.raw + {_B})::double) as f from c, z),
s as (select doc_id, avg(f) as llr from b join f using (b) group by 1),
w3 as (select doc_id, i, count(*) over (partition by doc_id, x, x2, x3) as k from q where x3 is not null),
rep as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from w3 where k > 1) group by 1),
ln as (select doc_id, sum(k - 1) as n from (select doc_id, own, count(*) as k from (select doc_id, unnest(string_split(text, chr(10))) as own from d) where regexp_matches(own, '[^\\x20\\x09-\\x0D]') group by 1, 2) group by 1),
r as (select doc_id, len(w)::bigint as n_words, list_sum(list_transform(w, lambda x: length(x))) as word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols, coalesce(ln.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words from d left join ln using (doc_id) left join rep using (doc_id))
select doc_id, n_words, coalesce(word_chars, 0)::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and coalesce(llr, 0) >= {quality.THRESHOLD} as kept, round(coalesce(llr, 0), 6) as llr from r left join s using (doc_id)"""

_BARE = "regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
OP8 = f"""with p as (select page_id, url, sha256(html) as d, {_BARE} as rest from pages),
c as (select page_id, d, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), ':(80|443)$', ''), '^(www|m)\\.', '') || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') || case when regexp_extract(rest, '\\?(.*)$', 1) <> '' then '?' || array_to_string(list_sort(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&')), '&') else '' end as canonical from p),
a as (select v.page_id, v.canonical, v.d, arg_max(r.page_id, r.page_id) as old, arg_max(r.d, r.page_id) as od from c v left join c r on r.canonical = v.canonical and r.page_id < v.page_id + 500000 group by 1, 2, 3),
s as (select *, case when page_id % 7 = 0 then od = d when page_id % 5 = 0 then false else od[1:16] = d[1:16] end as ok from a)
select page_id * 2 + 1 as record_id, canonical, page_id + 500000 as ts, old * 2 as response_id, case when ok then 'resolved' else 'validator_mismatch' end as status,
'content-length=' || case when ok then od[1:4] || ';content-type=text/html' else '0' end || ';date=' || (page_id + 500000) || case when page_id % 7 = 0 then case when ok then ';etag="' || od[1:16] || '"' else '' end when page_id % 5 = 0 then ';etag="changed"' else ';etag=W/"' || d[1:16] || '"' end || ';expires=never' as headers from s"""


#: The 256 entries of the CRC's table, by its rule, and the CRC of a string by them.
_CRC_TABLE = "crc as (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as t)"


def _crc(text: str) -> str:
    octets = f"list_transform(range(length(hex({text})) // 2), lambda k: ('0x' || substr(hex({text}), 2 * k + 1, 2))::bigint)"
    return f"xor(list_reduce({octets}, lambda c, o: xor(c >> 8, t[(xor(c, o) & 255) + 1]), 4294967295), 4294967295)"


OP11 = f"""with {_CRC_TABLE},
d as (select doc_id, {_words("coalesce(text, '')")} as w, {_crc('doc_id::varchar')} as h from documents, crc),
f as (select doc_id, w, h, len(w) as n, case when len(w) > 0 then (h // 10) % len(w) end as a, h // 10 as g from d),
e as (select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] end) else w end as w from f),
p as (select doc_id, n, unnest(w) as x, unnest(range(n)) as i from e),
m as (select a.doc_id, b.i - a.i as q, a.i from p a join p b on a.doc_id = b.doc_id and a.x = b.x and b.i > a.i and b.i - a.i <= a.n // 3),
g as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as part from m),
s as (select doc_id, min(i) as start, count(*) + q as length, q from g group by doc_id, q, part having count(*) + q >= greatest(24, 3 * q)),
r as (select doc_id, start, length, min(q) as period from s group by 1, 2, 3),
l as (select doc_id, count(*) as c, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as printed, first(struct_pack(start := start, length := length, period := period) order by length::double / period desc, start, period) as best from r group by 1),
k as (select doc_id, string_agg(x, ' ' order by i) as kept from p where not exists (select 1 from r where r.doc_id = p.doc_id and p.i >= r.start + r.period and p.i < r.start + r.length) group by 1)
select d.doc_id, coalesce(c, 0)::bigint as n_runs, best.start as start, best.length as length, best.period as period, (1000 * best.length // best.period)::bigint as exponent_milli, sha256(coalesce(printed, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256 from d left join l using (doc_id) left join k using (doc_id)"""

_N = resampling.BUCKETS


def _features(table: str) -> str:
    between = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    return f"list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{between}'), lambda x: x <> '') as w from {table}"


OP13 = f"""with {_CRC_TABLE},
d as (select doc_id, {_features('documents')}), b as (select {_features('benchmark')}),
v as (select x, {_crc('x')} % {_N} as k from (select distinct unnest(w) as x from (select w from d union all select w from b)), crc),
u as (select doc_id, k from (select doc_id, unnest(w) as x from d) join v using (x)),
s as (select k, count(*) as s from u group by 1), t as (select k, count(*) as t from (select unnest(w) as x from b) join v using (x) group by 1),
g as (select k, floor(1000 * ln((coalesce(t, 0) + 1::double) * ((select coalesce(sum(s), 0) from s)::double + {_N}) / ((coalesce(s, 0) + 1::double) * ((select coalesce(sum(t), 0) from t)::double + {_N}))))::bigint as gain from s left join t using (k)),
w as (select doc_id, sum(gain)::bigint as weight from u join g using (k) group by 1),
r as (select d.doc_id, len(w)::bigint as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score from d left join w using (doc_id)),
o as (select *, row_number() over (partition by n_features >= {resampling.MIN_WORDS} order by score desc, doc_id) as place, count(*) filter (n_features >= {resampling.MIN_WORDS}) over () as n from r)
select doc_id, n_features, weight, score, case when n_features >= {resampling.MIN_WORDS} and place <= n * {resampling.PERCENT} // 100 then place end as rank from o"""


def oracles() -> dict[str, str]:
    return {"op1_quality_rules": OP1, "op4_line_dedup": OP4, "op8_warc_revisits": OP8, "op9_ngram_jaccard_join": OP9, "op11_periodic_runs": OP11, "op13_importance_resampling": OP13}
