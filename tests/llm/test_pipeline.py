"""The pipeline's stages against slow versions on the smallest table."""

import pandas as pd
from conftest import SMALL
from test_native import slow_counts

import __spark_entry__
import corpus_pipeline as P
from vitrine.llm.near_copies import simhash


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    frames = [docs]
    for _, stage in P.STAGES[:-1]:
        frames.append(spark.createDataFrame(stage(spark, frames[-1], SMALL).toPandas(), docs.schema))
        assert frames[-1].columns == docs.columns
    raw, good, told, single, mixed = (f.toPandas() for f in frames)
    base = raw[[c[0] >= 10 and 100 * c[4] <= 20 * c[0] for c in map(slow_counts, raw.text)]]
    assert set(good.doc_id) <= set(base.doc_id) and len(good) > 0.8 * len(base)
    labels = pd.read_parquet(f"{SMALL}/labels.parquet")
    clean = set(labels[labels.quality == 1].doc_id) & set(base.doc_id)
    assert clean <= set(good.doc_id)
    assert len(told) > 0.99 * len(good)
    marks = {i: simhash(t.encode()) for i, t in zip(single.doc_id, single.text, strict=True)}
    ids = sorted(marks)
    assert all((marks[a] ^ marks[b]).bit_count() > 4 for n, a in enumerate(ids) for b in ids[:n])
    assert set(mixed.doc_id) <= set(single.doc_id) and abs(len(mixed) - len(single)) < 0.35 * len(single)
    pieces = P.STAGES[-1][1](spark, frames[-1], SMALL).toPandas()
    assert set(pieces.doc_id) == set(mixed.doc_id)


def test_registered(spark):
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
    assert __spark_entry__.queries()["pipeline"](spark, SMALL).count() > 0
    assert P.ORACLE_SQL is None


def test_stages_on_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "7 8 9", None, None, 3), (2, "7 8 9", None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        assert stage(spark, docs, SMALL).count() >= 0
        assert stage(spark, docs.limit(0), SMALL).count() == 0
