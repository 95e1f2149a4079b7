"""The corpus pipeline against a brute-force version of its stages, and the registry of queries."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from provisio.llm import toxicity
from provisio.llm.common import in_fold

from .test_decontaminate import brute as brute_leak
from .test_mixing import _check
from .test_simhash import brute_components, brute_print


def test_pipeline_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    scored = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~in_fold(F.col("doc_id"), 0)).select("doc_id", "text", "__toxic").collect()
    left = {r.doc_id: r.text or "" for r in scored if r["__toxic"] < 0.5}
    groups = {}
    for d, t in left.items():
        groups.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest(), []).append(d)
    left = {d: left[d] for g in groups.values() for d in [min(g, key=lambda d: (-len(left[d]), d))]}
    ids = sorted(left)
    roots = brute_components([brute_print(left[d]) for d in ids], ids)
    left = {d: left[d] for d, r in zip(ids, roots, strict=True) if d == r}
    left = {d: t for d, t in left.items() if not brute_leak(t, items)[4]}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(left)
    assert all(r.size == len(left[r.doc_id].encode().split()) for r in got)
    _check(got, 16)


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_and_survive_odd_rows(spark, sf_dir, k):
    rows = [(1, None, None, "s", None), (2, "", "en", None, 0), (3, "clean words stay here in this text", "en", "s", 3), (3, "clean words stay here in this text", "en", "s", 3), (4, "w " * 60_000, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.STAGES[k][1](spark, docs, sf_dir)
    assert out.columns == docs.columns and 3 in {r.doc_id for r in out.collect()}
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), sf_dir).count() == 0


def test_all_eleven_are_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stage_of_exact_copies_does_without_the_warehouse(spark, sf_dir, monkeypatch):
    """Stage 2 reads and writes nothing outside the shared folder, so a warehouse that a cluster doesn't share is no error."""
    from provisio.llm import exact_dedup

    def refuse(session):
        raise ValueError("set spark.sql.warehouse.dir to a folder that driver and executors share")

    monkeypatch.setattr(exact_dedup, "shared_warehouse", refuse)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.drop_copies(spark, docs, sf_dir)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
