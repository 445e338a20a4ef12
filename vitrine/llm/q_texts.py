"""Queries of the operators that read whole texts or vectors with user code."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm import graph_index, language, main_text, near_copies, packing, token_counts
from vitrine.llm.q_native import captions
from vitrine.plans.fixtures import Registry, table

R = Registry()


@R.add("op8_near_copies")
def op8(spark, d):
    found = near_copies.near_copies(captions(spark, d), keep=["item_id"])
    return found.select(found.item_id.alias("doc_id"), "fingerprint", "component_id")


def held_out(id: str):
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 3 == 1, F.lit(False))


@R.add("op5_detect_language")
def op5(spark, d):
    texts = captions(spark, d)
    model = language.fit_languages(texts.where(~held_out("item_id")).select("caption", "lang"))
    found = language.detect_language(texts.select("item_id", "caption"), model)
    return found.select(found.item_id.alias("doc_id"), held_out("item_id").alias("held_out"), "lang_pred", "score", "second", "ambiguous")


def packed(texts: DataFrame) -> DataFrame:
    """The pieces of captions under the names of the given tables, with the digest of their ids."""
    pieces = packing.pack_captions(texts, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        pieces.item_id.alias("doc_id"), "start", "length", F.crc32("token_ids").alias("ids_crc32"),
        F.col("caption_tokens").alias("doc_tokens"), "sequence_id", "offset",
    )


@R.add("op3_pack_captions")
def op3(spark, d):
    return packed(captions(spark, d))


@R.add("op1_near_items")
def op1(spark, d):
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    found = graph_index.near_items(points, points.where("item_id % 100 = 0"))
    return found.select("query_id", "rank", found.item_id.alias("vec_id"), found.distance.alias("score"))


@R.add("op2_main_text")
def op2(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", "html")
    return main_text.main_text(pages, main_text.fit_weights(pages)).select("page_id", "url", "text", "n_chars")


@R.add("op10_count_tokens")
def op10(spark, d):
    texts = captions(spark, d).select("item_id", "caption")
    counted = token_counts.count_tokens(texts, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select(counted.item_id.alias("doc_id"), "n_tokens")
