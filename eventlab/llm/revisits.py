"""Resolves not-modified revisit records of web archives.

A revisit says that a page had not changed since an earlier capture. It is joined to the latest
earlier full response of the same canonical URL; if the validators agree, the response's body
is returned with those headers replaced that such an answer may update.

The as-of join sorts all records by URL and time over the cluster. Each part of the sort carries
its last response forward inside itself; one summary row per URL and part carries it into later
parts. A URL that fills many parts is never one task's work. Bodies are joined afterwards, by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordering import sort_rows

#: Headers that a not-modified answer may update, and query parameters of trackers.
UPDATABLE = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
TRACKING = "utm_[a-z]+|gclid|fbclid|ref"


def canonical_url(url: Column) -> Column:
    """Host and path that captures of one page share.

    Scheme, "www.", default port, fragment, tracking parameters, an index page, a ".html" ending and
    a closing slash go; the host is lower-cased; other parameters are sorted.
    """
    whole = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(whole, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    before = F.regexp_extract(rest, "^[^?]*", 0)
    host = F.lower(F.regexp_extract(before, "^[^/]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(before, "^[^/]*(.*)$", 1), "(/index)?[.]html?$", "")
    path = F.regexp_replace(path, "/+$", "")
    query = F.regexp_extract(rest, "[?](.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(f"^({TRACKING})(=|$)")))
    joined = F.array_join(F.array_sort(kept), "&")
    return F.when(url.isNull(), F.lit(None)).otherwise(F.concat(host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")))


def header(headers: Column, name: str) -> Column:
    """A header's value; names are lower case."""
    return F.element_at(headers, name)


def weak(etag: Column) -> Column:
    """An entity tag as it is compared for not-modified answers."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


def validators(revisit: Column, response: Column) -> Column:
    """``match``, ``mismatch``, or ``unchecked`` where both lack a common validator.

    Entity tags decide if both sides have one, else the modification dates.
    """
    tags = [weak(header(h, "etag")) for h in (revisit, response)]
    dates = [F.trim(header(h, "last-modified")) for h in (revisit, response)]
    by_tag = F.when(tags[0] == tags[1], "match").otherwise("mismatch")
    by_date = F.when(dates[0] == dates[1], "match").otherwise("mismatch")
    return (
        F.when(tags[0].isNotNull() & tags[1].isNotNull(), by_tag)
        .when(dates[0].isNotNull() & dates[1].isNotNull(), by_date)
        .otherwise("unchecked")
    )


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, with what the revisit may update."""
    update = F.map_filter(revisit, lambda k, v: k.isin(UPDATABLE) & v.isNotNull())
    kept = F.map_filter(response, lambda k, v: ~F.map_contains_key(update, k))
    return F.map_concat(kept, update)


def resolve(records: DataFrame) -> DataFrame:
    """``record_id, url_key, response_id, status, headers, body``, one row per revisit.

    ``records`` has ``record_id, url, at`` (any sortable time), ``kind`` (``response`` or ``revisit``),
    ``headers`` (a map with lower-case names) and ``body``. Earlier means a smaller time, and for equal times a
    smaller id. ``status`` is ``resolved``, ``mismatch`` (headers and body are null), or ``no_response`` where
    nothing earlier has the URL or it is missing. Agreement that nothing can check counts as resolved.
    Rows of another kind, or without a time, are ignored.
    """
    used = records.where(F.col("kind").isin("response", "revisit") & F.col("at").isNotNull())
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    narrow = used.select(
        canonical_url(F.col("url")).alias("url_key"),
        "at",
        "record_id",
        (F.col("kind") == "response").alias("full"),
        F.coalesce("headers", empty).alias("headers"),
    )
    # Rows without a URL match nothing; a key of their own each spreads them.
    known = F.coalesce(F.concat(F.lit("u"), F.col("url_key")), F.concat(F.lit("-"), F.col("record_id").cast("string")))
    placed = sort_rows(narrow.withColumn("key", known), ["key"], ["at", "record_id"])
    response = F.struct(F.col("record_id").alias("id"), F.col("headers").alias("headers"))
    here = F.when(F.col("full"), response)
    inside = W.partitionBy("key", "_part").orderBy("_pos").rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy("key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    last = F.max_by(here, F.when(F.col("full"), F.col("_pos"))).alias("last")
    parts = placed.groupBy("key", "_part").agg(last).withColumn("carried", F.last("last", ignorenulls=True).over(across))
    cut = placed.repartition("key", "_part").withColumn("own", F.last(here, ignorenulls=True).over(inside))
    asked = cut.where("NOT full").join(parts.select("key", "_part", "carried"), ["key", "_part"], "left")
    found = asked.withColumn("found", F.when(F.col("url_key").isNotNull(), F.coalesce("own", "carried")))
    verdict = validators(F.col("headers"), F.col("found.headers"))
    status = F.when(F.col("found").isNull(), "no_response").when(verdict == "mismatch", "mismatch").otherwise("resolved")
    judged = found.withColumn("status", status).select(
        "record_id",
        "url_key",
        F.col("found.id").alias("response_id"),
        "status",
        F.when(F.col("status") == "resolved", merged_headers(F.col("found.headers"), F.col("headers"))).alias("headers"),
    )
    bodies = used.where("kind = 'response'").select(F.col("record_id").alias("body_id"), "body")
    wanted = F.when(F.col("status") == "resolved", F.col("response_id"))
    return judged.withColumn("wanted", wanted).join(bodies, F.col("wanted") == F.col("body_id"), "left").drop("wanted", "body_id")


def capture_records(pages: DataFrame) -> DataFrame:
    """Archive records as a crawl of the pages would have left them.

    Every page is captured as a response at ten times its id, and asked for again some time later by
    its own URL, when other captures of the same page may have come between. Every fifth
    server sends no entity tag, every seventh page no validator at all.
    """
    digest = F.md5(F.coalesce("html", F.lit("")))
    size = F.coalesce(F.length("html"), F.lit(0))
    tag = F.when((size % 5 != 0) & (size % 7 != 0), F.concat(F.lit('"'), digest, F.lit('"')))
    date = F.when(size % 7 != 0, F.concat(F.lit("day "), (size % 365).cast("string")))
    at = F.col("page_id").cast("bigint") * 10

    def headers(**values: Column) -> Column:
        pairs = F.map_from_arrays(F.array(*[F.lit(k.replace("_", "-")) for k in values]), F.array(*values.values()))
        return F.map_filter(pairs, lambda k, v: v.isNotNull())

    first = headers(
        etag=tag,
        last_modified=date,
        content_type=F.lit("text/html"),
        content_length=size.cast("string"),
        date=at.cast("string"),
        cache_control=F.lit("max-age=60"),
    )
    later = at + 5 + (size % 1000) * 200
    again = headers(
        etag=F.when(size % 2 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag),
        last_modified=date,
        content_length=F.lit("0"),
        date=later.cast("string"),
        expires=F.when(size % 3 == 0, (later + 3600).cast("string")),
    )
    responses = pages.select((F.col("page_id") * 2).alias("record_id"), "url", at.alias("at"), F.lit("response").alias("kind"), first.alias("headers"), F.col("html").alias("body"))
    revisits = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", later.alias("at"), F.lit("revisit").alias("kind"), again.alias("headers"), F.lit(None).cast("string").alias("body"))
    return responses.unionByName(revisits)


def digest(resolved: DataFrame) -> DataFrame:
    """Flat columns: headers as sorted ``name: value`` lines, the body by length and MD5."""
    pairs = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return resolved.select(
        "record_id",
        "url_key",
        "response_id",
        "status",
        F.array_join(pairs, "\n").alias("headers"),
        F.coalesce(F.length("body"), F.lit(0)).cast("bigint").alias("body_chars"),
        F.md5("body").alias("body_md5"),
    )
