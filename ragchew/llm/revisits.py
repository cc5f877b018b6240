"""Resolving "not modified" revisit records of a web archive.

A revisit says that a page had not changed when it was fetched again. It is joined
as of its time, by canonical URL, to the latest earlier full response. Its
validators are checked against that response, and the header of the resolved record is the response's,
updated by those fields that a 304 answer may change.

The as-of join is an ordered window over (canonical URL, span of time). A URL with a
great share of all records is split by time: each span starts from the latest
response of the spans before it, which a second window finds among one row per
URL and span. No payload moves: records carry the id of the response that holds it.

Edge cases: a null or empty URL resolves to nothing (``no_url``); a null time is never
before anything (``no_time``); header names have no case (``lower_names``); records of the same time are ordered by id, null first, and a
response at the very time of a revisit counts as earlier only if its id is smaller; repeated rows
each give a row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ragchew.llm.common import let

# The fields that a 304 answer carries for updating a stored
# response (RFC 9110, section 15.4.5), and Age (RFC 9111).
PERMITTED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
# Query fields that only track where a visitor came from.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def canonical_url(url: Column) -> Column:
    """Lower-case host without ``www.`` or ``m.``, no scheme, user, default port, fragment, tracking
    fields, index file or closing slash; the other query fields in order of their text."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(u, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)$", ""),
                            r"^(www|m)\.", "")
    path = F.regexp_extract(u, r"^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"/index\.html?$", "/"), r"/+$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    fields = F.array_sort(F.filter(F.split(query, "&"),
                                   lambda f: (f != "") & ~f.rlike(f"^({TRACKING})(=|$)")))
    query = F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise(F.lit(""))
    return F.when(host != "", F.concat(host, path, query))


def lower_names(headers: Column) -> Column:
    """A header with its names in lower case. Of names that differ in case only, the one that comes first in code point
    order (so capitals first) gives the value."""
    def of(fields: Column) -> Column:
        names = F.array_distinct(F.transform(fields, lambda e: F.lower(e["key"])))
        return F.map_from_arrays(names, F.transform(names, lambda n: F.filter(fields, lambda e: F.lower(e["key"]) == n)[0]["value"]))
    return F.when(headers.isNotNull(), let(F.array_sort(F.map_entries(headers)), of))


def merge_headers(old: Column, new: Column, permitted=PERMITTED) -> Column:
    """The response's header updated by the permitted fields of the revisit; names in lower case (``lower_names``)."""
    keep = F.map_filter(new, lambda k, v: k.isin(permitted) & v.isNotNull())
    return F.map_zip_with(old, keep, lambda _, a, b: F.coalesce(b, a))


def validators_agree(revisit: Column, response: Column) -> Column:
    """Entity tags by weak comparison where the revisit has one, else the
    modification date, else the payload digest; false where it has none of them."""
    def tag(r: Column) -> Column:
        return F.regexp_replace(F.element_at(r["headers"], "etag"), "^W/", "")

    def modified(r: Column) -> Column:
        return F.element_at(r["headers"], "last-modified")
    return F.coalesce(
        F.when(tag(revisit).isNotNull(), tag(revisit) == tag(response))
        .when(modified(revisit).isNotNull(), modified(revisit) == modified(response))
        .when(revisit["digest"].isNotNull(), revisit["digest"] == response["digest"]), F.lit(False))


def resolve_revisits(records: DataFrame, span: int = 3600) -> DataFrame:
    """Resolve the revisits among ``records`` (record_id, url, fetched as a timestamp, kind
    ``response`` or ``revisit``, status, headers, digest).

    A full response has kind ``response`` and status 200. Returns a row per
    revisit: record_id, canonical, resolved_id, outcome (``resolved``, ``validator_mismatch``,
    ``no_response``, ``no_url``, ``no_time``) and the merged headers of resolved ones. ``span``
    is the length of the spans of time in seconds; it does not change results.
    """
    r = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), "fetched", "kind",
                       "status", lower_names(F.col("headers")).alias("headers"), "digest")
    r = r.where((F.col("kind") == "revisit") | ((F.col("kind") == "response") & (F.col("status") == 200)))
    lost = r.where((F.col("kind") == "revisit") & (F.col("canonical").isNull() | F.col("fetched").isNull()))
    r = r.where(F.col("canonical").isNotNull() & F.col("fetched").isNotNull()).withColumn(
        "span", F.floor(F.unix_timestamp("fetched") / span))
    full = F.when(F.col("kind") == "response", F.struct("fetched", "record_id", "headers", "digest"))
    latest = r.groupBy("canonical", "span").agg(
        F.max(F.when(F.col("kind") == "response", F.struct("fetched", "record_id"))).alias("at"))
    # one row per URL and span: the latest response of all spans before
    before = W.partitionBy("canonical").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    carried = latest.select("canonical", "span", F.last("at", ignorenulls=True).over(before).alias("at"))
    carried = carried.where(F.col("at").isNotNull()).select(
        "canonical", "span", F.col("at.fetched").alias("c_fetched"), F.col("at.record_id").alias("c_id"))
    # the carried response itself, by its key (repeated rows are alike in it: any of them)
    bodies = r.where(F.col("kind") == "response").groupBy(
        "canonical", F.col("fetched").alias("c_fetched"), F.col("record_id").alias("c_id")).agg(
        F.max_by(F.struct("headers", "digest"), F.struct(F.to_json("headers"), "digest")).alias("body"))
    carried = carried.join(bodies, on=(
        (carried["canonical"] == bodies["canonical"]) & (carried["c_fetched"] == bodies["c_fetched"])
        & carried["c_id"].eqNullSafe(bodies["c_id"])), how="inner").select(
        carried["canonical"], carried["span"],
        F.struct(carried["c_fetched"].alias("fetched"), carried["c_id"].alias("record_id"),
                 F.col("body.headers").alias("headers"), F.col("body.digest").alias("digest")).alias("carried"))
    inside = W.partitionBy("canonical", "span").orderBy(
        "fetched", F.col("record_id").asc_nulls_first(), "kind", F.to_json("headers"), "digest").rowsBetween(
        W.unboundedPreceding, -1)
    near = r.withColumn("near", F.last(full, ignorenulls=True).over(inside)).where(F.col("kind") == "revisit")
    found = near.join(carried, ["canonical", "span"], "left").withColumn(
        "to", F.coalesce("near", "carried")).withColumn("own", F.struct("headers", "digest"))
    agree = validators_agree(F.col("own"), F.col("to"))
    outcome = F.when(F.col("to").isNull(), "no_response").when(agree, "resolved").otherwise("validator_mismatch")
    none = F.lit(None)
    kinds = dict(r.dtypes)
    done = found.withColumn("outcome", outcome).select(
        "record_id", "canonical",
        F.when(F.col("outcome") == "resolved", F.col("to.record_id")).alias("resolved_id"), "outcome",
        F.when(F.col("outcome") == "resolved", merge_headers(F.col("to.headers"), F.col("headers"))).alias("headers"))
    return done.unionByName(lost.select(
        "record_id", "canonical", none.cast(kinds["record_id"]).alias("resolved_id"),
        F.when(F.col("canonical").isNull(), "no_url").otherwise("no_time").alias("outcome"),
        none.cast(kinds["headers"]).alias("headers")))


def header_text(headers: Column) -> Column:
    """A header as one text: ``name: value`` lines in order of the names."""
    lines = F.array_sort(F.transform(F.map_entries(headers),
                                     lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))))
    return F.array_join(lines, "\n")
