"""Exact deduplication against brute force, and the index over batches."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict

from provisio.llm import exact_dedup as X

ROWS = [(1, "a b", "s", 1), (2, "a  b", "s", 2), (3, None, "s", 3), (4, " \t\n", "t", 4), (5, "x" * 300_000, "t", 5), (5, "x" * 300_000, "t", 5), (None, "ab", "u", 6), (6, "é b", "u", 7), (7, "ab ", None, 8)]
SCHEMA = "doc_id long, text string, source string, kept int"


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()].append((d, t or ""))
    out = []
    for sha, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        first = True
        for d, t in members:
            mine = first and d == best[0] and len(t) == len(best[1])
            first = first and not mine
            out.append((d, best[0], len(members), mine, sha))
    return sorted(out, key=str)


def _index(spark):
    return X.DigestIndex(spark, f"index_{uuid.uuid4().hex}", 4)


def _rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert _rows(X.op10_exact_dedup(spark, sf_dir)) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_edge_cases(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert _rows(_index(spark).add(docs)) == brute([r[:2] for r in ROWS])
    assert _index(spark).add(docs.limit(0)).count() == 0


def test_second_batch_is_held_against_the_first(spark):
    index = _index(spark)
    index.add(spark.createDataFrame(ROWS, SCHEMA))
    later = {r.doc_id: r for r in index.add(spark.createDataFrame([(20, "a        b"), (21, "new"), (22, "n ew")], "doc_id long, text string")).collect()}
    assert (later[20].keep_id, later[20].kept) == (2, False)
    assert [(later[d].keep_id, later[d].kept) for d in (21, 22)] == [(22, False), (22, True)]
    assert {r.doc_id for r in index.compact().add(spark.createDataFrame([(30, "new")], "doc_id long, text string")).filter("kept").collect()} == set()


def test_index_side_is_not_shuffled(spark):
    index = _index(spark)
    index.add(spark.createDataFrame(ROWS, SCHEMA))
    known = spark.table(index.name).select("text_sha256")
    plan = spark.createDataFrame([("x",)], "text_sha256 string").join(known.hint("merge"), "text_sha256", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_keep_distinct_leaves_columns_alone(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = X.keep_distinct(docs, _index(spark))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.kept) for r in kept.collect()) == [(2, 2), (4, 4), (5, 5), (6, 7)]


def test_two_batches_against_the_index(spark):
    """Long texts first: any border gives the result of one batch, and the second batch is held against the index."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for border in (1, 3, 100, 10**9):
        assert _rows(X.longest_first(_index(spark), docs, border)) == brute([r[:2] for r in ROWS])
    index = _index(spark)
    index.append(X.digests(docs))
    later = X.digests(spark.createDataFrame([(40, "a b"), (41, "fresh")], "doc_id long, text string"))
    missing = index.missing(later)
    plan = missing._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan
    assert [r.doc_id for r in missing.collect()] == [41]


def test_ids_of_any_type_and_dropped_index(spark):
    index = _index(spark)
    found = index.add(spark.createDataFrame([("x", "a b"), ("w", "ab "), (None, "ab "), ("v", "c")], "doc_id string, text string"))
    index.drop()
    assert index.rows() is None
    assert sorted((r.doc_id or "", r.keep_id, r.kept) for r in found.collect()) == [("", "w", False), ("v", "v", True), ("w", "w", True), ("x", "w", False)]


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", 7, 8), (2, "a", 7, 8), (3, "b", 7, 8)], "doc_id long, text string, __id int, __own_sha int")
    kept = X.keep_distinct(docs, _index(spark))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_query_and_stage_do_without_the_warehouse(spark, sf_dir, monkeypatch):
    """A cluster session may have a warehouse of its own machine only; the index stands in the shared folder then."""

    def refuse(session):
        raise ValueError("set spark.sql.warehouse.dir to a folder that driver and executors share")

    monkeypatch.setattr(X, "shared_warehouse", refuse)
    docs = spark.createDataFrame(ROWS, SCHEMA)
    with X.temporary_index(spark, docs) as index:
        kept = X.keep_distinct(docs, index)
        files = index.rows().inputFiles()
        assert files and all(X.shared_dir(spark).removeprefix("file:") in f for f in files)
        assert index.compact().rows().count() == index.rows().count()
    assert index.rows() is None and sorted((r.doc_id or 0, r.kept) for r in kept.collect()) == [(2, 2), (4, 4), (5, 5), (6, 7)]
    assert X.op10_exact_dedup(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
