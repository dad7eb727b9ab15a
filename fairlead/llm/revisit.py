"""Not-modified revisits of a web archive, resolved to the response they stand for.

A revisit record (status 304) holds no content: it says that the page is as it was. It is joined as of its date
to the latest earlier full response for the same canonical URL. Validators (entity tag, modification date,
payload digest) that both records have must agree. Headers that a 304 may update replace the response's.

The as-of join looks back per URL and time slice, with one summary row per slice carried over, so that one URL
with a third of all records is spread over as many tasks as there are slices.

Defined results: a revisit without earlier response is ``unmatched``; with a validator that differs
``mismatch``; with none in common ``unchecked``; else ``resolved``. A response of the same date is not earlier;
of responses with one date, the largest record id is the latest. A record with a null URL or date is unmatched.
Null headers are no headers. Other columns are not needed, whatever their names. An empty log gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.operators.scan import scan, settle

SLICES = 64
# The headers that a 304 response updates.
UPDATED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
VALIDATORS = ("etag", "last-modified")


def canonical(url: Column) -> Column:
    """Host in lower case without ``www`` and default port, path and query as they are; no scheme, no fragment."""
    rest = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)", 1), r"^[^/?@]*@", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"^www\d*\.", "")
    tail = F.regexp_extract(rest, r"^[^/?]*([\s\S]*)$", 1)
    tail = F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))
    return F.when(host != "", F.concat(host, tail))


def _tag(headers: Column, name: str) -> Column:
    value = headers[name]
    return F.regexp_replace(value, r"^W/", "") if name == "etag" else value


def resolve(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """One row per revisit: record_id, url_key, ref_id (record_id of the response), outcome, headers (merged),
    payload_digest (the response's).

    ``records``: record_id bigint, kind (response or revisit), url, date bigint, headers map<string,string> with
    lower-case names, payload_digest string.
    """
    no_headers = F.create_map().cast("map<string,string>")
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", "kind", canonical(F.col("url").cast("string")).alias("url_key"), F.col("date").cast("bigint").alias("date"), F.coalesce("headers", no_headers).alias("headers"), "payload_digest"
    )
    rows = settle(rows)
    lost = F.col("url_key").isNull() | F.col("date").isNull()
    # Slices hold about equally many records; their borders are at most ``slices`` numbers.
    borders = rows.agg(F.percentile_approx("date", [i / slices for i in range(1, slices)], 1000)).first()[0] or []
    borders = sorted(set(borders))
    at = F.array(*[F.lit(b).cast("bigint") for b in borders]) if borders else F.array().cast("array<bigint>")
    # At one date revisits come first: a response of that date is not earlier.
    known = rows.where(~lost).withColumn("slice", F.size(F.filter(at, lambda b: b < F.col("date")))).withColumn("late", (F.col("kind") == "response").cast("int"))
    full = F.when(F.col("late") == 1, F.struct("record_id", "headers", "payload_digest"))
    seen = scan(known, ["url_key"], "slice", ["date", "late", "record_id"], fill_before={"ref": full}).where(F.col("late") == 0)
    blank = F.lit(None).cast(seen.schema["ref"].dataType)
    columns = ["record_id", "url_key", "headers", "payload_digest", "ref"]
    both = seen.select(*columns).unionByName(rows.where(lost & (F.col("kind") == "revisit")).withColumn("ref", blank).select(*columns))

    old, new = F.col("ref.headers"), F.col("headers")
    pairs = [(_tag(old, v), _tag(new, v)) for v in VALIDATORS] + [(F.col("ref.payload_digest"), F.col("payload_digest"))]
    differ, equal = F.lit(False), F.lit(False)
    for a, b in pairs:
        differ = differ | F.coalesce(a != b, F.lit(False))
        equal = equal | F.coalesce(a == b, F.lit(False))
    outcome = F.when(F.col("ref").isNull(), "unmatched").when(differ, "mismatch").when(equal, "resolved").otherwise("unchecked")
    update = F.map_filter(new, lambda k, _: k.isin(*UPDATED))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(update), k)), update)
    good = F.col("outcome").isin("resolved", "unchecked")
    return both.withColumn("outcome", outcome).select(
        "record_id", "url_key", F.col("ref.record_id").alias("ref_id"), "outcome", F.when(good, merged).otherwise(new).alias("headers"), F.when(good, F.col("ref.payload_digest")).otherwise(F.col("payload_digest")).alias("payload_digest")
    )
