"""Readers for landed API pages, exported collections, labels, archives and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine import values as V
from vitrine.functions.keys import bucket_date
from vitrine.operators.scale import matching_if_small

# `date` and `mode` are what a ranking page was asked for.
PAGE_SCHEMA = "page INT, status INT, body STRING, date STRING, mode STRING"

# Where each provider keeps its posts, and the fields read from a post.
PAGE_LAYOUT = {
    "danbooru": ("$", "$.id", "$.file_url", "$.created_at"),
    "gelbooru": ("$.post", "$.id", "$.file_url", "$.created_at"),
    "sankaku": ("$.data", "$.id", "$.file_url", "$.created_at.s"),
    "pixiv": ("$.contents", "$.illust_id", "$.url", "$.date"),
}
# Providers dated by the ranking asked for, and those whose posts have several files.
RANKED = ("danbooru", "pixiv")
PAGED = ("pixiv",)
PAGE_COUNT = "$.illust_page_count"


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one landed page each: number, HTTP status and body text."""
    return spark.read.schema(PAGE_SCHEMA).json(path)


def posts_of_pages(pages: DataFrame, provider: str) -> DataFrame:
    """One row per post with page number and position; failed and empty pages give none.

    `asked` and `mode` are the day and kind of the ranking, null where the page tells neither.
    """
    where, key, url, created = PAGE_LAYOUT[provider]
    body = F.col("body") if where == "$" else F.get_json_object("body", where)
    given = lambda c: F.col(c) if c in pages.columns else F.lit(None).cast("string")
    asked = given("date") if where == "$" else F.coalesce(F.get_json_object("body", "$.date"), given("date"))
    posts = F.from_json(body, "array<string>")
    field = lambda p: F.get_json_object("post", p)
    return (
        # what a page tells is read before its posts are, or else Spark reads the whole page again for each of them
        pages.where("status = 200")
        .select("page", asked.alias("asked"), given("mode").alias("mode"), posts.alias("posts"))
        .select("page", "asked", "mode", F.posexplode("posts").alias("index", "post"))
        .select(
            F.lit(provider).alias("type"),
            field(key).cast("long").alias("post_id"),
            field(url).alias("url"),
            field(created).alias("created_at"),
            "page",
            "index",
            "asked",
            "mode",
            "post",
        )
    )


def post_date(provider: str, asked: Column, created: Column) -> Column:
    """Calendar date of a post as text: the ranking's day, or the day it was made in the provider's zone."""
    if provider in RANKED:
        return F.date_format(F.coalesce(F.try_to_timestamp(asked, F.lit("yyyyMMdd")), asked.try_cast("timestamp")), "yyyy-MM-dd")
    if provider == "sankaku":
        return bucket_date(F.timestamp_seconds(created.try_cast("long")))
    # a text with its weekday first, or any form Spark casts
    named = F.try_to_timestamp(F.regexp_replace(created, r"^\p{L}{3} ", ""), F.lit("MMM dd HH:mm:ss Z yyyy"))
    return bucket_date(F.coalesce(named, created.try_cast("timestamp")))


def expand_pages(posts: DataFrame, artworks: DataFrame) -> DataFrame:
    """One row per file of posts with several: `artwork_page` from 0 and its own `url`.

    `artworks` holds post_id and pages (array of {urls: {original}}), one row per post. As many
    rows come as the post says it has files, one at least; a file the pages do not name has a
    null url.
    """
    count = F.greatest(F.coalesce(F.get_json_object("post", PAGE_COUNT).try_cast("int"), F.lit(1)), F.lit(1))
    known = matching_if_small(artworks.select("post_id", "pages"), posts, ["post_id"])
    rows = posts.join(known, "post_id", "left").withColumn("artwork_page", F.explode(F.sequence(F.lit(0), count - 1)))
    return rows.withColumn("url", F.get("pages", F.col("artwork_page"))["urls"]["original"]).drop("pages")


def rejected_pages(pages: DataFrame, provider: str) -> DataFrame:
    """Pages that are not usable: bad status, no JSON or no posts."""
    where = PAGE_LAYOUT[provider][0]
    body = F.col("body") if where == "$" else F.get_json_object("body", where)
    count = F.coalesce(F.size(F.from_json(body, "array<string>")), F.lit(0))
    return pages.where((F.coalesce("status", F.lit(0)) != 200) | (count < 1))


def read_posts(spark: SparkSession, path: str, provider: str) -> DataFrame:
    return posts_of_pages(landed_pages(spark, path), provider)


def media_files(listing: DataFrame, prefix: str, bare_names: bool = False, extensions=V.MEDIA_EXTENSIONS) -> DataFrame:
    """Media among listed files (`path`, ...): extension allowed in any case, id `prefix/stem`."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"[^.](\.[^.]*)$", 1))
    wanted = ext.isin(list(extensions)) | ((ext == "") if bare_names else F.lit(False))
    return listing.where(wanted).withColumn(
        "item_id", F.concat(F.lit(prefix + "/"), F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", ""))
    )


def scan_media(
    spark: SparkSession, folder: str, prefix: str, bare_names: bool = False, extensions=V.MEDIA_EXTENSIONS
) -> DataFrame:
    """Files below `folder`; contents are read only if `content` is selected later."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return media_files(files, prefix, bare_names, extensions)


def manual_labels(texts: DataFrame, column: str = "value", valid: list[str] | None = None) -> DataFrame:
    """path, label, rating from JSON maps whose values are a label or {label, rating}."""
    entry = F.explode(F.from_json(column, "map<string,string>")).alias("path", "entry")
    field = lambda p: F.get_json_object("entry", p)
    is_object = F.col("entry").startswith("{")
    return (
        texts.select(entry)
        .select(
            "path",
            F.when(is_object, field("$.label")).otherwise(F.col("entry")).alias("label"),
            F.when(is_object, field("$.rating").cast("int")).alias("rating"),
        )
        .where(F.col("label").isin(valid or V.VALID_LABELS))
    )


def read_manual_labels(spark: SparkSession, path: str, valid: list[str] | None = None) -> DataFrame:
    return manual_labels(spark.read.text(path, wholetext=True), "value", valid)


def feature_rows(store: DataFrame, feature: str) -> DataFrame:
    """(item_id, vec) of one feature; on a store partitioned by feature only its files are read."""
    return store.where(F.col("feature_name") == feature).select(
        "item_id", F.col("vec").cast("array<float>").alias("vec")
    )


def read_feature_store(spark: SparkSession, path: str, feature: str) -> DataFrame:
    return feature_rows(spark.read.parquet(path), feature)


def _is_time(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and set(t.fieldNames()) == {"seconds", "nanoseconds"}


def _with_times(c: Column, t: T.DataType) -> Column:
    if _is_time(t):
        micros = c["seconds"] * 1_000_000 + F.floor(c["nanoseconds"] / 1000)
        return F.timestamp_micros(micros)
    if isinstance(t, T.StructType):
        inner = F.struct(*[_with_times(c[f.name], f.dataType).alias(f.name) for f in t.fields])
        return F.when(c.isNotNull(), inner)
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _with_times(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(c, lambda _, v: _with_times(v, t.valueType))
    return c


def import_collection(df: DataFrame) -> DataFrame:
    """Turn every {seconds, nanoseconds} struct, at any depth, into a timestamp."""
    return df.select(*[_with_times(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


_USER = "M struct<screen_name:struct<S:string>,name:struct<S:string>,id_str:struct<S:string>>"
_MEDIA = (
    "struct<M:struct<media:struct<L:array<struct<M:struct<"
    "media_url_https:struct<S:string>,media_url:struct<S:string>>>>>>>"
)
ARCHIVE_SCHEMA = (
    "id_str struct<S:string>, full_text struct<S:string>, text struct<S:string>, created_at struct<S:string>,"
    f" user struct<{_USER.replace(' ', ':', 1)}>, user_id_str struct<S:string>,"
    f" extended_entities {_MEDIA}, entities {_MEDIA}, is_quote_status struct<BOOL:boolean>,"
    " retweeted_status struct<M:struct<id_str:struct<S:string>,"
    f"user:struct<{_USER.replace(' ', ':', 1)}>>>"
)


def media_entries(archive: DataFrame) -> DataFrame:
    """Flatten the typed attribute values of an archive export (schema `ARCHIVE_SCHEMA`)."""
    urls = lambda c: F.transform(
        F.col(f"{c}.M.media.L"),
        lambda m: F.struct(
            m["M"]["media_url_https"]["S"].alias("media_url_https"), m["M"]["media_url"]["S"].alias("media_url")
        ),
    )
    user = lambda c, *names: F.struct(*[F.col(f"{c}.M.{n}.S").alias(n) for n in names])
    return archive.select(
        F.col("id_str.S").alias("id_str"),
        F.col("full_text.S").alias("full_text"),
        F.col("text.S").alias("text"),
        F.col("created_at.S").alias("created_at"),
        F.when(F.col("user.M").isNotNull(), user("user", "screen_name", "name", "id_str")).alias("user"),
        F.col("user_id_str.S").alias("user_id_str"),
        urls("extended_entities").alias("extended_media"),
        urls("entities").alias("media"),
        F.col("is_quote_status.BOOL").alias("is_quote_status"),
        F.when(
            F.col("retweeted_status.M.user.M").isNotNull(),
            F.struct(
                F.col("retweeted_status.M.id_str.S").alias("id_str"),
                user("retweeted_status.M.user", "screen_name", "name").alias("user"),
            ),
        ).alias("retweeted_status"),
    )


def read_media_entries(spark: SparkSession, path: str) -> DataFrame:
    return media_entries(spark.read.schema(ARCHIVE_SCHEMA).json(path))


def tag_vocabulary(texts: DataFrame, feature_count: int, column: str = "value") -> DataFrame:
    """idx, tag, kind from JSON maps name to index; an index below `feature_count` is a feature."""
    return texts.select(F.explode(F.from_json(column, "map<string,int>")).alias("tag", "idx")).select(
        "idx", "tag", F.when(F.col("idx") < feature_count, "feature").otherwise("character").alias("kind")
    )


def char_ip_map(texts: DataFrame, column: str = "value") -> DataFrame:
    """tag, ip pairs from JSON maps character to list of IPs."""
    pairs = texts.select(F.explode(F.from_json(column, "map<string,array<string>>")).alias("tag", "ips"))
    return pairs.select("tag", F.explode("ips").alias("ip"))


def read_tag_vocabulary(spark: SparkSession, path: str, feature_count: int) -> DataFrame:
    return tag_vocabulary(spark.read.text(path, wholetext=True), feature_count)


def read_char_ip_map(spark: SparkSession, path: str) -> DataFrame:
    return char_ip_map(spark.read.text(path, wholetext=True))


def parse_model_key(
    df: DataFrame, column: str = "model", features=None, labels=None, methods=None
) -> DataFrame:
    """Add feature, model_label, method of `feature_label_method` keys; other keys are dropped.

    The arguments narrow the known names to those wanted.
    """
    lists = [V.FEATURES, V.POSITIVE_LABELS, V.METHODS]
    pattern = "^" + "_".join("(" + "|".join(names) + ")" for names in lists) + "$"
    out = df.where(F.col(column).rlike(pattern))
    for i, (name, wanted) in enumerate(
        [("feature", features), ("model_label", labels), ("method", methods)], start=1
    ):
        out = out.withColumn(name, F.regexp_extract(column, pattern, i))
        if wanted:
            out = out.where(F.col(name).isin(list(wanted)))
    return out
