"""The scoring job: pick pending items, extract, score, set the status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine import values as V
from vitrine.functions.udfs import extract_features
from vitrine.learning.models import LinearScorer, score_batch
from vitrine.operators.filters import pending
from vitrine.operators.nested import important_tag_probs
from vitrine.operators.scale import broadcast_if_small, stored


def inference_job(
    items: DataFrame,
    files: DataFrame,
    extract: Callable,
    outputs: dict[str, str],
    models: list[LinearScorer],
    vectors: dict[str, str],
    important: dict[str, list[tuple[str, int]]] | None = None,
    batch: int = 64,
) -> DataFrame:
    """item_id, status, inferences, important_tag_probs, vectors, error of every pending item.

    Items whose batch fails become `error` and the rest goes on. Vectors are stored once, as
    both the scores and the vector table are made from them.
    """
    todo = pending(items).select("item_id", "local_path")
    # a small backlog is broadcast, so contents move only to be scored
    contents = files.select(F.col("path").alias("local_path"), "content").join(broadcast_if_small(todo), "local_path")
    found = stored(extract_features(contents, extract, outputs, batch))
    good = F.col("error").isNull()
    scored = score_batch(found, models, vectors)
    probs = F.create_map(
        *[x for f, picked in (important or {}).items() for x in (F.lit(f), important_tag_probs(F.col(vectors[f]), picked))]
    ) if important else F.lit(None).cast("map<string,map<string,double>>")
    return scored.select(
        "item_id",
        F.when(good, V.INFERRED).otherwise(V.ERROR).alias("status"),
        F.when(good, F.col("inferences")).alias("inferences"),
        F.when(good, probs).alias("important_tag_probs"),
        *outputs,
        "error",
    )
