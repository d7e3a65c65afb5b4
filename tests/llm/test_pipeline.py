import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from test_models import brute_near, check_bins
from test_scans import brute_overlaps

import corpus_pipeline
from crossfade.llm.quality_knn import fit_quality, held_out, score_quality
from crossfade.llm.secret_scan import find_secrets


def test_run_is_its_brute_force(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in pd.read_parquet(f"{sf}/benchmark.parquet").itertuples()]
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit_quality(table, spark.read.parquet(f"{sf}/labels.parquet").where(~held_out(F.col("doc_id"))))
    good = {r.doc_id for r in score_quality(table, model).collect() if r.score >= 0.3}
    rows = [(r.doc_id, r.text) for r in docs.itertuples() if r.doc_id in good]
    near = brute_near(rows)
    rows = [(i, t) for i, t in rows if near[i][1] == i]
    rows = [(i, t) for i, t in rows if not brute_overlaps(t, bench)[4]]
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == {i for i, _ in rows}
    check_bins(out, 1024)
    size = {i: 0 for i, _ in rows}
    for r in out:
        size[r.doc_id] += r.n_words
    for i, t in rows:
        if not find_secrets(t):
            assert size[i] == len(re.findall(r"[^\x20\x09-\x0D]+", t))


def test_stages_keep_the_columns_and_clean_documents(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").withColumn("kept", F.lit("clash"))
    odd = spark.createDataFrame([(10**6, None, None, None, None, "k"), (10**6 + 1, "", "en", "s", 0, "k"), (None, "null id here", "en", "s", 3, "k"), (10**6 + 2, "twice the same row", "en", "s", 18, "k")] + [(10**6 + 2, "twice the same row", "en", "s", 18, "k")], table.schema)
    docs = table.union(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns and got.dtypes == docs.dtypes, name
        ids = got.select("doc_id", "text").toPandas()
        if name == "near_dedup":
            assert (ids.doc_id == 10**6 + 2).sum() == 1 and ids.doc_id.isna().sum() == 1
        else:
            assert {10**6, 10**6 + 1} <= set(ids.doc_id.dropna().astype(np.int64)), name
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0


def test_stages_are_those_of_the_pipeline():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "benchmark_decontamination", "secrets", "packing"]
