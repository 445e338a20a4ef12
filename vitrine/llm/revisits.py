"""Not-modified answers of an archive, resolved to the response they refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.scale import broadcast_if_small, skew_join, stored

NOT_MODIFIED = 304
FULL = 200
# Header fields that a not-modified answer may not change in a stored response.
FIXED_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
OWN = ("canonical_url", "refers_to", "outcome", "merged_headers")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, a path at least."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    site = F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    rest = F.substring(bare, F.length(site) + 1, F.length(bare))
    host = F.regexp_replace(F.regexp_replace(F.lower(site), "^(http://.*):80$", "$1"), "^(https://.*):443$", "$1")
    return F.concat(host, F.when((rest == "") | rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest))


def _lower_names(headers: Column) -> Column:
    """The header map with lower-cased names; of names that differ in case only the last in order counts."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    named = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    later = lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda o: o["key"] == e["key"])
    return F.map_from_entries(F.filter(named, later))


def _tag(headers: Column) -> Column:
    """The entity tag for weak comparison."""
    return F.regexp_replace(F.trim(headers["etag"]), "^W/", "")


def merge_headers(response: Column, answer: Column) -> Column:
    """The stored response's headers, replaced by those of the answer that may change."""
    allowed = F.map_filter(answer, lambda k, _: ~k.isin(*FIXED_HEADERS))
    return F.map_concat(F.map_filter(response, lambda k, _: ~F.map_contains_key(allowed, k)), allowed)


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """All input columns plus canonical_url, refers_to, outcome, merged_headers.

    `captures` holds item_id, original_url, downloaded_at, status (200 a full response, 304 not
    modified, others neither) and headers (map of strings). A 304 refers to the latest full
    response of the same canonical URL that is strictly earlier (of one instant, the largest
    item_id). outcome is `full`; `resolved` if the validators agree: equal entity tags, compared
    weakly, or where one side has none, equal Last-Modified; `mismatch` if they differ;
    `unverified` if no validator is on both sides; `no_response` if nothing is earlier; `other`
    for other statuses. merged_headers are lower-cased: a full response's own, and for a resolved
    one the response's with the fields a 304 may change; else null.

    A URL may hold most of all captures, so no URL is put in one task: rows are range partitioned
    by URL and time and stored once, the latest response is carried forward inside a part, and
    between parts by a table of the URLs that lie in several, never more than there are parts.

    A null URL or time is never resolved (`no_response`) and never referred to; null headers are
    none, a null status is `other`. Repeated rows are resolved each. Input columns named like a
    result are replaced. The project downloads by URL and records when; it keeps no archive of
    its requests, so status and headers come from the caller.
    """
    kept = captures.drop(*OWN)
    full = (F.col("status") == FULL) & F.col("canonical_url").isNotNull() & F.col("downloaded_at").isNotNull()
    response = F.struct("item_id", "downloaded_at", F.col("_headers").alias("headers"))
    rows = kept.withColumns({"canonical_url": canonical_url(F.col("original_url")), "_headers": _lower_names(F.col("headers"))})
    rows = rows.withColumn("_response", F.when(full, response))
    # of one instant, answers come before responses
    keys = [F.col(c) for c in ("canonical_url", "downloaded_at")] + [F.col("_response").isNotNull(), F.col("item_id")]
    ordered = stored(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_seq", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_seq", 33))
    inside = Window.partitionBy("canonical_url", "_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    known = ordered.where("canonical_url IS NOT NULL")
    parts = known.groupBy("canonical_url", "_part").agg(F.max_by("_response", F.when(full, F.col("_seq"))).alias("_last"))
    across = Window.partitionBy("canonical_url")
    before = across.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("_n", F.count("*").over(across)).where("_n > 1")
    carried = carried.select("canonical_url", "_part", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    placed = ordered.withColumn("_own", F.last("_response", ignorenulls=True).over(inside))
    placed = placed.join(broadcast_if_small(stored(carried)), ["canonical_url", "_part"], "left")
    known_url = F.col("canonical_url").isNotNull() & F.col("downloaded_at").isNotNull()
    found = placed.withColumn("_found", F.when(known_url & (F.col("status") == NOT_MODIFIED), F.coalesce("_own", "_carried")))
    theirs, mine = F.col("_found.headers"), F.col("_headers")
    tags = _tag(theirs) == _tag(mine)
    times = F.trim(theirs["last-modified"]) == F.trim(mine["last-modified"])
    agree = F.coalesce(tags, times)
    outcome = (
        F.when(F.col("status") == FULL, "full")
        .when(F.coalesce(F.col("status") != NOT_MODIFIED, F.lit(True)), "other")
        .when(F.col("_found").isNull(), "no_response")
        .when(agree.isNull(), "unverified")
        .when(agree, "resolved")
        .otherwise("mismatch")
    )
    merged = F.when(F.col("outcome") == "full", mine).when(F.col("outcome") == "resolved", merge_headers(theirs, mine))
    out = found.withColumn("outcome", outcome).withColumn("merged_headers", merged)
    refers = F.when(F.col("outcome").isin("resolved"), F.col("_found.item_id")).alias("refers_to")
    return out.select(*[F.col(f"`{c}`") for c in kept.columns], "canonical_url", refers, "outcome", "merged_headers")


def with_content(resolved: DataFrame, responses: DataFrame) -> DataFrame:
    """`resolved` plus content: of full responses their own, of resolved ones the response's they refer to.

    `responses` holds item_id and content of the full responses. Many answers may refer to one
    response; such keys are salted.
    """
    key = F.when(F.col("outcome") == "full", F.col("item_id")).otherwise(F.col("refers_to"))
    texts = responses.select(F.col("item_id").alias("_key"), "content")
    return skew_join(resolved.drop("content").withColumn("_key", key), texts, ["_key"], "left", ["item_id", "downloaded_at"]).drop("_key")
