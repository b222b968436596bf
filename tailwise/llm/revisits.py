"""WARC not-modified revisits: each takes its body from the latest earlier full response of its canonical URL.

Records are responses and revisits with a time. URLs are made canonical (scheme and host in lower case, scheme,
default port, www. and m. labels, fragment and trailing slash dropped, query parameters sorted). A revisit is
resolved if a full response precedes it and their validators agree: strong or weak ETags if both have one, else
Last-Modified, else the payload digest. The resolved record has the response's headers, with those that a
not-modified answer may renew taken from the revisit.

The as-of join is two windows of bounded groups instead of one per URL: records are dealt into time slices of a
URL, each slice looks back within itself, and where nothing precedes, the last full response of the latest
earlier slice that has one is used. A URL with a third of all records is many slices. Only times and ids go
through the windows; headers are joined afterwards by record id.

Defined cases: a null URL is resolved with nothing; a null time comes first; a response at the same time counts
as earlier if its record id is less, and a null record id is less than any; null headers are none; repeated
revisits are resolved one by one; of responses with one record id (repeated rows, or null ids) the least by digest
counts; revisits without an earlier response or with other validators have status no_response or
validator_mismatch and their own headers; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a 304 answer may renew.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified", "server"]
#: Records of a slice, about.
SLICE_ROWS = 1000


def canonical_url(url: Column) -> Column:
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), ":(80|443)$", ""), "^(www|m)\\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&"), lambda p: p != "")), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _etag(tag: Column) -> Column:
    """Weak comparison: the opaque part."""
    return F.regexp_replace(tag, "^W/", "")


def validators_agree(a: dict[str, Column], b: dict[str, Column]) -> Column:
    both = lambda k: a[k].isNotNull() & b[k].isNotNull()
    return F.when(both("etag"), _etag(a["etag"]) == _etag(b["etag"])).when(both("modified"), a["modified"] == b["modified"]).otherwise(F.coalesce(a["digest"] == b["digest"], F.lit(False)))


def resolve(records: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """records: record_id long, kind ('response' or 'revisit'), url, ts long, digest, headers map<string,string>
    with lower-case names. One row per revisit: record_id, url, ts, response_id, status, headers."""
    records = records.select("record_id", "kind", "url", "ts", "digest", F.coalesce("headers", F.expr("cast(map() as map<string,string>)")).alias("headers"), canonical_url(F.col("url")).alias("c"))
    # A record id is one place in the order, however many rows share it.
    rows = records.where("kind in ('response', 'revisit') and c is not null").select("record_id", "kind", "ts", "c").distinct()
    per_url = rows.groupBy("c").agg(F.count("*").alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    # Slices of a URL divide its time span; one slice for most URLs. A slice with too many rows of one time is divided
    # by record id, which is the order there.
    width = F.greatest(F.ceil((F.col("t1") - F.col("t0") + 1) / F.ceil(F.col("n") / slice_rows)), F.lit(1)).cast("long")
    crowded = per_url.where(F.col("n") > slice_rows).select(F.col("c").alias("cc"), "t0", width.alias("width"))
    # At most one URL in slice_rows records is crowded.
    dealt = rows.join(crowded, rows["c"] == crowded["cc"], "left").withColumn("slice", F.when(F.col("ts").isNull(), -1).otherwise(F.coalesce(F.floor((F.col("ts") - F.col("t0")) / F.col("width")), F.lit(0))).cast("long")).drop("cc", "t0", "width")
    dealt = dealt.withColumn("t", F.when(F.col("slice") < 0, 0).otherwise(F.col("ts")))
    full_slices = dealt.groupBy("c", "slice").agg(F.count("*").alias("m"), F.min("t").alias("a"), F.max("t").alias("z"), F.min("record_id").alias("r0"), F.max("record_id").alias("r1"))
    one_time = full_slices.where((F.col("m") > slice_rows) & (F.col("a") == F.col("z")))
    one_time = one_time.select(F.col("c").alias("cc"), F.col("slice").alias("cs"), "r0", F.greatest(F.ceil((F.col("r1") - F.col("r0") + 1) / F.ceil(F.col("m") / slice_rows)), F.lit(1)).cast("long").alias("step"))
    dealt = dealt.join(one_time, (F.col("c") == F.col("cc")) & (F.col("slice") == F.col("cs")), "left")
    dealt = dealt.withColumn("part", F.coalesce(F.floor((F.col("record_id") - F.col("r0")) / F.col("step")), F.when(F.col("record_id").isNull() & F.col("cc").isNotNull(), -1).otherwise(0)).cast("long")).drop("cc", "cs", "r0", "step", "t")
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id"))
    inside = Window.partitionBy("c", "slice", "part").orderBy(F.col("ts").asc_nulls_first(), F.col("record_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("earlier", F.last(full, ignorenulls=True).over(inside))
    lasts = dealt.groupBy("c", "slice", "part").agg(F.max(full).alias("last"))
    before = Window.partitionBy("c").orderBy("slice", "part").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select("c", "slice", "part", F.last("last", ignorenulls=True).over(before).alias("carried")).where("carried is not null")
    asof = dealt.where("kind = 'revisit'").join(lasts, ["c", "slice", "part"], "left")
    found = F.coalesce("earlier", "carried")
    asof = asof.select(F.col("record_id").alias("r"), F.col("ts").alias("t"), F.col("c").alias("canonical"), found.isNotNull().alias("has"), found["record_id"].alias("response_id"), found["ts"].alias("response_ts"))
    own = records.where("kind = 'revisit'").select("record_id", "url", "ts", "digest", "headers", "c")
    old = records.where("kind = 'response'").groupBy(F.col("record_id").alias("old_id"), F.col("ts").alias("old_ts"), F.col("c").alias("old_c")).agg(F.min(F.struct("digest", F.array_sort(F.map_entries("headers")).alias("h"))).alias("o"))
    old = old.select("old_id", "old_ts", "old_c", F.col("o.digest").alias("old_digest"), F.map_from_entries("o.h").alias("old"))
    df = own.join(asof, F.col("record_id").eqNullSafe(F.col("r")) & F.col("ts").eqNullSafe(F.col("t")) & (F.col("c") == F.col("canonical")), "left")
    df = df.join(old, F.col("has") & F.col("response_id").eqNullSafe(F.col("old_id")) & F.col("response_ts").eqNullSafe(F.col("old_ts")) & (F.col("canonical") == F.col("old_c")), "left")
    part = lambda h, d: {"etag": F.col(h)["etag"], "modified": F.col(h)["last-modified"], "digest": F.col(d)}
    status = F.when(~F.coalesce("has", F.lit(False)), "no_response").when(validators_agree(part("headers", "digest"), part("old", "old_digest")), "resolved").otherwise("validator_mismatch")
    df = df.withColumn("status", status)
    renewed = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter("old", lambda k, _: ~F.array_contains(F.map_keys(F.map_filter("headers", lambda n, _: n.isin(PERMITTED))), k)), renewed)
    headers = F.when(F.col("status") == "resolved", merged).otherwise(F.col("headers"))
    return df.select("record_id", F.col("c").alias("canonical"), "ts", "response_id", "status", headers.alias("headers"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Records made of the pages table: each page is a response at its own time, and half a million ticks later a
    revisit of the same URL by another spelling. Every fifth revisit has another ETag, every seventh no ETag."""
    p = pages.select("page_id", "url", F.sha2(F.col("html"), 256).alias("digest"))
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    base = {"date": F.col("page_id").cast("string"), "content-type": F.lit("text/html"), "content-length": F.substring("digest", 1, 4)}
    put = lambda d: F.map_from_arrays(F.array(*[F.lit(k) for k in d]), F.array(*d.values()))
    first = p.select((F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", F.col("page_id").alias("ts"), "digest", put(base | {"etag": tag}).alias("headers"))
    other = F.when(F.col("page_id") % 5 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag))
    again = {"date": (F.col("page_id") + 500_000).cast("string"), "content-length": F.lit("0"), "expires": F.lit("never")}
    second = p.select(
        (F.col("page_id") * 2 + 1).alias("record_id"),
        F.lit("revisit").alias("kind"),
        F.concat(F.regexp_replace("url", "^https?://", "HTTP://"), F.lit("#again")).alias("url"),
        (F.col("page_id") + 500_000).alias("ts"),
        "digest",
        F.when(F.col("page_id") % 7 == 0, put(again)).otherwise(put(again | {"etag": other})).alias("headers"),
    )
    return first.unionByName(second)


def printed(headers: Column) -> Column:
    """name=value in order of name, one string."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
