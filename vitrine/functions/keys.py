"""Keys, dates and URLs derived from stored columns; all expressions stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine import values as V


def project_public(df: DataFrame, key: str = "_id") -> DataFrame:
    """Drop private columns, expose the key as text `id`, write timestamps as ISO 8601."""
    out = df.drop(*V.PRIVATE_COLUMNS).withColumnRenamed(key, "id").withColumn("id", F.col("id").cast("string"))
    return out.select(*[_public(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in out.schema.fields])


def _public(c: Column, t: T.DataType) -> Column:
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_public(c[f.name], f.dataType).alias("id" if f.name == "_id" else f.name) for f in t.fields]))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _public(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(c, lambda _, v: _public(v, t.valueType))
    return c


def resolve_path(df: DataFrame, path: str, checked: bool = True) -> Column:
    """Column for a dotted path through structs and maps; only sortable paths pass the check.

    A struct path is pruned and pushed into the scan, a map path reads the whole map.
    """
    if checked and not (re.fullmatch(V.INFERENCE_PATH, path) or re.fullmatch(V.TAG_PROB_PATH, path)):
        raise ValueError(f"not a sortable path: {path}")
    parts = path.split(".") if not checked else path.split(".", 2)
    column, kind = F.col(parts[0]), df.schema[parts[0]].dataType
    for part in parts[1:]:
        if isinstance(kind, T.MapType):
            column, kind = F.try_element_at(column, F.lit(part)), kind.valueType
        else:
            column, kind = column[part], kind[part].dataType
    return column


def extension(url: Column) -> Column:
    """Extension of the last path segment with its dot, '' if none; case is kept."""
    name = F.regexp_extract(url, r"([^/]*)/*$", 1)
    return F.regexp_extract(name, r"^.+?(\.[^.]*)$", 1)


def https(url: Column) -> Column:
    return F.regexp_replace(url, r"^http:", "https:")


def item_key(provider: str, post_id: Column, url: Column) -> Column:
    """`provider/id.ext`, null unless the extension is allowed; sankaku ignores the query part.

    A pixiv post has a file per page, so its key is the file's own name, whatever the extension.
    """
    if provider == "pixiv":
        return F.concat(F.lit("pixiv/"), F.nullif(F.regexp_extract(url, r"([^/]*)/*$", 1), F.lit("")))
    loose = provider == "sankaku"
    ext = extension(F.parse_url(https(url), F.lit("PATH")) if loose else url)
    allowed = V.POST_EXTENSIONS_WEBP if loose else V.POST_EXTENSIONS
    return F.when(ext.isin(allowed), F.concat(F.lit(provider + "/"), post_id.cast("string"), ext))


def bucket_date(ts: Column, zone: str = V.ZONE) -> Column:
    """Calendar date of a UTC instant in `zone`, as text. Epoch seconds go through `timestamp_seconds`."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")


def target_date(now: Column, days: int, hours: int = 0, zone: str = V.ZONE) -> Column:
    """The date a crawl asks for: `now` in `zone`, less hours, less days."""
    local = F.from_utc_timestamp(now, zone) - F.expr(f"INTERVAL {int(hours)} HOURS")
    return F.date_format(F.date_sub(F.to_date(local), days), "yyyy-MM-dd")


def ranking_key(date: Column, mode: Column, post_id: Column) -> Column:
    """Key of a post within one day's ranking."""
    return F.concat_ws("-", date, mode, post_id.cast("string"))


def _inside(path: Column, root: str) -> Column:
    """Path below `root`, null outside it."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path)))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=[^.])\.[^.]*$", "")


def path_to_id(path: Column, root: str, prefix: str) -> Column:
    """`prefix + source/stem` below the root, else the stem."""
    parts = F.split(_inside(path, root), "/")
    deep = F.size(parts) >= 2
    return F.when(deep, F.concat(F.lit(prefix), parts[0], F.lit("/"), stem(path))).otherwise(stem(path))


def path_to_source(path: Column, root: str) -> Column:
    return F.coalesce(F.split(_inside(path, root), "/")[0], F.lit("unknown"))


def artwork_id(name: Column) -> Column:
    """Artwork of a `123_p4` stem, else null."""
    return F.nullif(F.regexp_extract(name, r"^(\d+)_p\d+$", 1), F.lit(""))


def escape_key(key: Column) -> Column:
    """Percent first, so that nothing is escaped twice."""
    return F.replace(F.replace(F.replace(key, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F")), F.lit("."), F.lit("%2E"))


def sanitize_key(key: Column) -> Column:
    """Field names may hold neither dot nor dollar."""
    return F.translate(key, ".$", "__")


def quote_key(key: Column) -> Column:
    """Percent-encode all but letters, digits and `_.-~`."""
    plus = F.replace(F.url_encode(key), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(plus, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def uuid5(name: Column, namespace: str = V.OID_NAMESPACE) -> Column:
    """Version 5 UUID (RFC 4122) of `name`."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.conv(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8).cast("string"), 10, 16))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def canonical_source_url(source: Column) -> Column:
    """Image URLs of one provider become the page of their artwork."""
    pattern = r"pximg\.net/.*/(\d+)_p\d+"
    page = F.format_string(V.PAGE_URLS["pixiv"], F.regexp_extract(source, pattern, 1))
    return F.when(source.rlike(pattern), page).otherwise(source)


def provider_page_url(key: Column, tweet_id: Column) -> Column:
    """Page of an item from its key `provider/name.ext`; null for other keys."""
    provider, name = F.split(key, "/")[0], stem(key)
    post = {
        "pixiv": F.regexp_replace(name, r"(-[0-9a-f]{32})?_p\d+$", ""),
        "twitter": F.nullif(tweet_id, F.lit("")),
    }
    url = F.lit(None).cast("string")
    for p, template in V.PAGE_URLS.items():
        value = post.get(p, name)
        url = F.when((provider == p) & value.isNotNull(), F.format_string(template, value)).otherwise(url)
    return F.when(F.contains(key, F.lit("/")), url)


def media_id_from_url(url: Column) -> Column:
    """Last path segment of a URL; null for an empty one."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.nullif(F.element_at(F.split(path, "/"), -1), F.lit(""))


def media_id_from_key(key: Column) -> Column:
    """Second segment of `a/b`, null without one."""
    return F.get(F.split(key, "/"), F.lit(1))
