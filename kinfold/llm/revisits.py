"""WARC: resolving not-modified revisits.

A capture with status 304 has no body. It is resolved by the latest earlier full response (status 200) of the same
canonical URL: an as-of join. Then its validators are checked, and its permitted headers are merged over those
of the full response.

The as-of join is made for hot URLs. Captures (without bodies) are range-partitioned by (canonical URL, time), so one URL may
span many partitions; within a partition a window carries the last full response forward, and across partitions one
row per (URL, partition) does. The join that fetches the full responses' headers is a plain one, skewed on the side of the
revisits only, and Spark splits it.

Outcomes: ``resolved`` (a validator agrees and none differs), ``changed`` (one differs), ``unchecked`` (nothing to compare),
``orphan`` (no earlier full response). Validators: ETags, compared weakly, and Last-Modified as text; each counts if both
sides have it. Only ``resolved`` and ``unchecked`` get merged headers and the body's source.

Canonical URL: scheme, a leading ``www.`` and the fragment go; the host is lower-cased; tracking parameters go and the
others are sorted; a trailing ``/`` of the path goes. A null URL is its own canonical form and matches nothing.

Defined cases: earlier means a smaller time; of full responses at one time the one with the largest record id is taken;
captures without a time are orphans and never a source. Null headers are empty; header names are lower-cased, of names that
clash by case the last stays. Repeated rows are resolved alike. Other statuses pass by and are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.sources.scratch import materialize

# Headers that a 304 response may renew.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary"]
# Query parameters that do not select content.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|session)="


def canonical_url(url: Column) -> Column:
    rest = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*(/[^?]*)?", 1), r"/$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def lowered(headers: Column) -> Column:
    """Header names in lower case; the last of clashing names stays."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    named = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.aggregate(
        named,
        F.create_map().cast("map<string,string>"),
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))),
    )


def latest_full(captures: DataFrame) -> DataFrame:
    """(record_id, time, canonical, source_id): the source of each revisit, null if there is none."""
    full = F.when(F.col("status") == 200, F.struct("time", "record_id"))
    narrow = captures.filter(F.col("status").isin(200, 304) & F.col("canonical").isNotNull() & F.col("time").isNotNull())
    ranged = materialize(
        narrow.select("record_id", "canonical", "time", "status")
        .repartitionByRange("canonical", "time")
        .withColumn("part", F.spark_partition_id()),
        "captures",
    ).withColumn("full", full)
    inside = Window.partitionBy("canonical", "part").orderBy("time").rangeBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn("here", F.max("full").over(inside)).filter("status = 304")
    # One row per URL and partition: as many for one URL as there are partitions.
    across = Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = materialize(
        ranged.groupBy("canonical", "part").agg(F.max("full").alias("last")).withColumn("before", F.max("last").over(across))
        .filter("before IS NOT NULL").select("canonical", "part", "before"),
        "carried",
    )
    return rows.join(carried, ["canonical", "part"], "left").select(
        "record_id", "time", "canonical", F.coalesce("here", "before")["record_id"].alias("source_id")
    )


def _etag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], "^W/", "")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """One row per revisit row: record_id, canonical, source_id, outcome, headers (map).

    ``captures`` has record_id, url, time, status and headers (a map); record_id tells captures apart.
    """
    known = captures.select(
        "record_id", "time", "status", canonical_url(F.col("url")).alias("canonical"), lowered(F.col("headers")).alias("headers")
    )
    sources = latest_full(known).select("record_id", "source_id").distinct()
    # A record that was captured twice under one id keeps one set of headers: the least.
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("headers"))))
    full = known.filter("status = 200").groupBy(F.col("record_id").alias("source_id")).agg(
        F.min_by("headers", text).alias("source_headers")
    )
    revisits = known.filter("status = 304").join(sources, "record_id", "left")
    joined = revisits.join(materialize(full, "full-headers"), "source_id", "left")
    pairs = [
        (_etag(F.col("headers")), _etag(F.col("source_headers"))),
        (F.col("headers")["last-modified"], F.col("source_headers")["last-modified"]),
    ]
    agree = [F.coalesce(a == b, F.lit(False)) for a, b in pairs]
    differ = [F.coalesce(a != b, F.lit(False)) for a, b in pairs]
    outcome = (
        F.when(F.col("source_id").isNull(), "orphan")
        .when(differ[0] | differ[1], "changed")
        .when(agree[0] | agree[1], "resolved")
        .otherwise("unchecked")
    )
    renewed = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    kept = F.map_filter("source_headers", lambda k, _: ~F.map_contains_key(renewed, k))
    merged = F.when(outcome.isin("resolved", "unchecked"), F.map_concat(kept, renewed))
    return joined.select("record_id", "canonical", "source_id", outcome.alias("outcome"), merged.alias("headers"))


def header_text(headers: Column) -> Column:
    """``name: value`` lines in order of the names."""
    lines = F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.array_join(F.array_sort(lines), "\n")


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Captures made from ``pages``: each page once in full, and three later visits that were answered with 304.

    Visits differ in validators, in headers and in how the URL is written; some come before any full response, and a
    page that shares its canonical URL with an earlier one is a later full response of it.
    """
    p = F.col("page_id")
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    day = F.concat(F.lit("day "), (p % 365).cast("string"))

    def headers(*pairs: tuple[str, Column]) -> Column:
        return F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v for _, v in pairs]))

    full = pages.select(
        (p * 4).alias("record_id"), "url", (p * 10).alias("time"), F.lit(200).alias("status"),
        headers(("ETag", tag), ("Last-Modified", day), ("Content-Type", F.lit("text/html")), ("Date", F.concat(F.lit("t"), (p * 10).cast("string")))).alias("headers"),
    )
    visits = []
    for k in (1, 2, 3):
        when = p * 10 + F.when((p + k) % 13 == 0, -5).otherwise(k * 1000)
        url = F.when((p + k) % 2 == 0, F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#part"))).otherwise(F.col("url"))
        etag = F.when((p + k) % 5 == 0, F.lit('"old"')).when((p + k) % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("W/"), tag))
        changed = F.when((p + k) % 7 == 0, F.lit(None)).otherwise(day)
        visits.append(
            pages.select(
                (p * 4 + k).alias("record_id"), url.alias("url"), when.alias("time"), F.lit(304).alias("status"),
                F.map_filter(
                    headers(("etag", etag), ("last-modified", changed), ("Date", F.concat(F.lit("t"), when.cast("string"))), ("X-Cache", F.lit("hit"))),
                    lambda _, v: v.isNotNull(),
                ).alias("headers"),
            )
        )
    out = full
    for more in visits:
        out = out.unionByName(more)
    return out


def revisit_report(pages: DataFrame) -> DataFrame:
    """record_id, canonical, source_id, outcome, headers (text) for the revisits made from ``pages``."""
    resolved = resolve_revisits(captures_of_pages(pages))
    return resolved.withColumn("headers", header_text(F.col("headers")))
