"""Operators on small frames made by hand."""

from __future__ import annotations

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from provisio.functions import locators as L
from provisio.functions import text as T
from provisio.operators import diff as D
from provisio.operators import history as H
from provisio.operators import lint as Q
from provisio.operators import matching as M
from provisio.operators import pages as G
from provisio.operators import propositions as P
from provisio.operators import review as R
from provisio.operators import scopes as S
from provisio.operators import splitting as X
from provisio.plans.text_queries import LINEAGE_CASES
from provisio.streaming import job_events as J


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_text_rules(spark):
    s = "Article 5a. The keeper shall notify the competent authority, unless exempt, before moving."
    assert one(spark, T.subject(F.col("s")), s=s) == "keeper"
    assert one(spark, T.action(F.col("s")), s=s).startswith("notify the competent authority, unless exempt")
    assert [c.split()[0] for c in one(spark, T.conditions(F.col("s")), s=s)] == ["before", "unless"]
    assert one(spark, T.subject(F.col("s")), s="Section 3: Zebras graze.") == "zebras"
    assert one(spark, T.is_normative(F.col("s")), s="The mayor spoke.") is True
    assert one(spark, T.slug(F.col("s")), s=" --Ä b/C ") == "b-c" and one(spark, T.slug(F.col("s")), s="§§") == "item"
    assert one(spark, T.sentences(F.col("s")), s="A must. (b) shall; Then no.  lower. case") == ["A must.", "(b) shall", "Then no. lower. case"]
    assert one(spark, T.redact(F.col("s")), s="x-api-key: abc, api_key=def") == "x-api-key: [REDACTED], api_key=[REDACTED]"
    assert one(spark, T.evidence_match(F.col("e"), F.col("s")), e="the “Name”", s="(a) The \"name\"") == "plain"
    assert one(spark, T.evidence_match(F.col("e"), F.col("s")), e="one two", s="1) one\n2) two") == "list_marker"
    assert one(spark, P.repair_class(F.col("s")), s="HTTP 429") == "rate_limit"


def test_locators(spark):
    for locator, key in LINEAGE_CASES:
        assert one(spark, L.lineage_key(F.col("s")), s=locator) == key
    assert one(spark, L.list_label(F.col("s")), s="article:109:list:1-d-i") == "Art 109 §1(d)(i)"
    assert one(spark, L.cluster_heading(L.cluster_key(F.col("s"), F.col("a"))), s="document:full", a="Art. 7a") == "Article 7a"


def test_top_k_over_many_blocks(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(100, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    by = lambda d: sorted(tuple(r) for r in d.collect())
    assert by(M.top_k(df, df, 3, -1.0, block=7)) == by(M.top_k(df, df, 3, -1.0))
    assert {(r.query_id, r.item_id) for r in M.top_k(df, df, 1, 0.9).collect() if r.query_id != 100} >= {(i, i) for i in range(60)}


def test_review(spark):
    rows = [("d1", "a", "approved", "2024-01-01", ""), ("d2", "a", "rejected", "2024-01-02", "d1"), ("d3", "a", "approved", "2024-01-03", ""), ("d4", "a", "deferred", "2024-01-04", "d3"), ("d5", "b", "overridden", "2024-01-01", "d4")]
    current = {r.artifact_id: r.id for r in R.current_decisions(spark.createDataFrame(rows, "id string, artifact_id string, decision string, reviewed_at string, supersedes string"), ["artifact_id"]).collect()}
    assert current == {"a": "d2", "b": "d5"}
    steps = spark.createDataFrame([(1, "proposed"), (2, "accepted"), (3, "rejected"), (4, "superseded")], "n int, status string").withColumn("k", F.lit(1))
    assert [r.allowed for r in R.transitions(steps, "k", ["n"], "status").orderBy("n").collect()] == [True, True, False, True]


def test_history(spark):
    rows = spark.createDataFrame([(1, "t", None), (2, "t", None), (3, "u", None), (4, "u", 5), (5, "v", None)], "n int, t string, m int").withColumn("k", F.lit("a"))
    got = [r.change for r in H.with_changes(rows, ["k"], ["n"], "t", ["m"]).orderBy("n").collect()]
    assert got == ["initial", "no_change", "text_only", "metadata_only", "text_and_metadata"]
    drafts = spark.createDataFrame([(i, b) for i, b in enumerate("aaaabbc")], "n int, b string").withColumn("k", F.lit(1))
    assert [r.n for r in H.round_robin(drafts, ["k"], "b", ["n"], 5).orderBy("place").collect()] == [0, 4, 6, 1, 5]


def test_diff_and_pairs(spark):
    b = spark.createDataFrame([("k1", "s1", 1), ("k2", "s2", 1), ("k3", "s1", 1)], "k string, s string, v int")
    c = spark.createDataFrame([("k1", "s1", 2), ("k4", "s1", 1)], "k string, s string, v int")
    changes = D.run_diff(b, c, "k", ["v"])
    assert {r.k: r.change for r in changes.collect()} == {"k1": "changed", "k2": "removed", "k3": "removed", "k4": "added"}
    lost = D.unexplained_removals(b, c, "k", ["s"])
    assert [r.k for r in lost.collect()] == ["k3"] and D.verdict(changes, lost).first().verdict == "regression"
    left = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y"), (4, "")], "id int, instrument string")
    right = spark.createDataFrame([(1, "z"), (7, "y"), (8, None)], "id int, instrument string")
    assert {(r.id_b, r.id_c, r.how) for r in M.two_pass_pairs(left, right).collect()} == {(1, 1, "id"), (2, 7, "instrument"), (4, None, "removed"), (None, 8, "added")}


def test_scopes(spark):
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", None)], "n string, p string")
    assert {tuple(r) for r in S.closure(tree, "n", "p").collect()} == {("a", "a", 0), ("b", "b", 0), ("c", "c", 0), ("d", "d", 0), ("a", "b", 1), ("b", "c", 1), ("a", "c", 2)}


def test_all_rules_run_on_an_empty_bundle(spark):
    """Each rule finds nothing in rows that are in order and reports a broken one."""
    codes = [c.code for c in Q.RUN_CHECKS]
    assert len(codes) == len(set(codes))
    links = spark.createDataFrame([("l1", "s", "p", "magic", "far", "odd", "none", "", None), ("l2", "gone", "zz", "fallback", "direct", "explicit", "low", "", None)], "id string, scope_id string, proposition_id string, method string, relevance string, inheritance string, confidence string, reason string, evidence array<string>")
    tables = {"scope_links": links, "scopes": spark.createDataFrame([("s", "deprecated")], "id string, status string"), "propositions": spark.createDataFrame([("p",)], "id string")}
    found = {(r.code, r.id) for r in Q.lint(tables, [c for c in Q.RUN_CHECKS if c.gate == "scopes"]).collect()}
    assert found == {("L78", "l2"), ("L79", "l2"), ("L80", "l1"), ("L81", "l1"), ("L82", "l1"), ("L83", "l1"), ("L84", "l1"), ("L85", "l2"), ("L86", "l2"), ("L87", "l2")}


def test_splitting():
    text = "\n\n".join(f"paragraph {i} " + "x" * (i * 7 % 40) for i in range(30))
    for size, overlap in itertools.product((60, 90, 300), (0, 10)):
        chunks = X.paragraph_chunks(text, size, overlap)
        assert all(len(c) <= size + (overlap + 2 if overlap else 0) for c in chunks)  # a tail may come on top
        assert all(f"paragraph {i}" in "\n".join(chunks) for i in range(30))
    assert X.paragraph_chunks("", 10, 2) == [] and X.paragraph_chunks("a\r\n\r\nb\n\n\n\nc", 10, 0) == ["a\n\nb\n\nc"]
    assert X.paragraph_chunks("aaaa bbbb\n\ncccc dddd\n\nee", 16, 4) == ["aaaa bbbb", "bbbb\n\ncccc dddd", "dddd\n\nee"]
    assert X.paragraph_chunks("short one\n\n" + "y" * 700 + "\n\nend", 300, 4) == ["short one", "y" * 300, "y" * 300, "y" * 108, "one\n\nend"]
    assert X.paragraph_chunks("short one\n\n" + "y" * 301, 300, 3) == ["short one", "y" * 300, "y" * 4, "one"]
    began = time.perf_counter()
    assert len(X.paragraph_chunks("word " * 4_000_000, 2_000, 1_999)) > 70_000 and len(X.paragraph_chunks("ab\n\n" * 2_000_000, 2_000_000, 5)) == 5
    assert time.perf_counter() - began < 30
    assert X.list_drafts("1. It shall hold:\n(a) x;\n(b) y.", "article:1") == [("article:1:list:1-a", "It shall hold x"), ("article:1:list:1-b", "It shall hold y.")]
    assert X.list_drafts("(a) only one", "l") == []


def test_slice_plans(spark):
    long = "\n\n".join(f"para {i} " + "z" * 900 for i in range(5))
    rows = [
        (1, "<doc><Article n='4'>One</Article><article>Two</article>", "document:full"), (2, "Intro\nArticle 1\nkeep\nARTICLE 2a Scope\nmove\n", "x"), (3, "Section 3: a\nb\nsection 4.\nc", ""),
        (4, "Article 1 alone", " act:1 "), (5, long, "full"), (6, " \n", "x"), (7, None, "x"), (8, "Article 1\n" + long + "\nArticle 2\nshort", "x"),
    ]
    got = X.plan_slices(spark.createDataFrame(rows, "id long, body string, loc string"), "id", "body", "loc", 100, 0).orderBy("id", "part", "nth").collect()
    by = {i: [(r.locator, r.piece, r.strategy) for r in got if r.id == i] for i in range(1, 9)}
    assert by[1] == [("article:1", "<doc>", "article_xml"), ("article:4", "<Article n='4'>One</Article>", "article_xml"), ("article:3", "<article>Two</article>", "article_xml")]
    assert by[2] == [("article:1", "Article 1\nkeep", "article_plain"), ("article:2a", "ARTICLE 2a Scope\nmove", "article_plain")]
    assert by[3] == [("section:3:", "Section 3: a\nb", "section_plain"), ("section:4.", "section 4.\nc", "section_plain")]
    assert by[4] == [("act:1", "Article 1 alone", "monolith")] and by[6] == by[7] == []
    assert [(r[0], r[2]) for r in by[5]] == [(f"document:full|chunk:00{k}", "monolith|chunk") for k in range(3)]
    assert [(r[0], r[2]) for r in by[8]] == [*((f"article:1|chunk:00{k}", "article_plain|chunk") for k in range(3)), ("article:2", "article_plain")]
    items = lambda s: one(spark, X.split_list_items(F.col("s")), s=s)
    assert items("intro:\n(a) x\n(ii) y\n3) z") == ["intro:", "(a) x", "(ii) y", "3) z"] and items(" one (a) two ") == ["one (a) two"] and items(" ") == []
    parts = spark.createDataFrame([("f1", "Src A", "full", long), ("f2", "Src A", "article:1", "short")], "id string, source_record_id string, locator string, fragment_text string")
    assert [(r.id, r.parent_id, r.locator) for r in X.expand_fragments(parts, 2048).orderBy("id").collect()] == [("f2", None, "article:1"), *((f"frag-src-a-00{k + 1}", "f1", f"document:full|chunk:00{k}") for k in range(3))]


def test_deep_xml_cycles_and_definition_names(spark):
    from provisio.operators import extraction as Y
    from provisio.sources import ingest as I

    deep = "<P1 id='p'>" * 1 + "<b>" * 20_000 + "must hold" + "</b>" * 20_000 + "</P1>"
    got = I.legislation_provisions(spark.createDataFrame([(1, deep)], "id long, xml string"), "id", "xml").collect()
    assert [tuple(r) for r in got] == [(1, 0, "xml:p", "must hold")]
    ring = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b")], "n string, p string")
    assert {tuple(r) for r in S.closure(ring, "n", "p").collect()} == {(x, y, d) for x, y, d in (("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("b", "b", 0), ("b", "c", 1), ("b", "a", 2), ("c", "c", 0), ("c", "a", 1), ("c", "b", 2))}
    text = "'Holding' or 'holding' or 'Keeper' means any place."
    assert [r.term for r in Y.definitions(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").collect()] == ["Holding / Keeper"]


def test_scope_links_meet_terms_of_many_words(spark):
    props = spark.createDataFrame([(1, "The Official   Veterinarians act.", ["horse-box"]), (2, "unofficial veterinarian", None), (3, None, ["HORSES"])], "id long, proposition_text string, conditions array<string>")
    scopes = spark.createDataFrame([("vet", ["official veterinarian", "official"]), ("equine", ["horse", "horse box"])], "scope_id string, terms array<string>")
    got = {(r.id, r.scope_id): (r.field, r.term, r.confidence) for r in S.link_scopes(props, scopes).collect()}
    assert got == {(1, "vet"): ("proposition_text", "official veterinarian", "high"), (1, "equine"): ("conditions", "horse box", "medium"), (3, "equine"): ("conditions", "horse", "medium")}


def test_html_lines(spark):
    html = "<nav><p>no</p></nav><aside><p>not this</p></aside><script>var t='</p>';</script><p>before</p><h2 id='s1'>Head</h2><ul><li>One &amp; two</li><li> </li></ul><p>open"
    got = [tuple(r) for r in G.html_lines(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).collect()]
    assert got == [(1, 0, "", "p", "before"), (1, 1, "s1", "h2", "Head"), (1, 2, "s1", "li", "One & two"), (1, 3, "s1", "p", "open")]


def test_stream_gives_the_batch_result_for_closed_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.filter("event_id % 2 = 0").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    got = {tuple(r) for r in J.run_available(spark, J.event_counts(stream), str(tmp_path)).collect()}
    want = {tuple(r) for r in J.event_counts(events.filter("event_id % 2 = 0")).collect()}
    assert got and got <= want


def test_case_files_runs_and_xml(spark, tmp_path):
    import json

    from provisio.sources import ingest as I
    from provisio.sources import runs as N

    case = {"topic": {"name": "T"}, "sources": [{"id": "S 1", "title": "A", "jurisdiction": "EU", "text": "Article 1 must hold.", "fragment_locator": "article:1"}, {"title": "B", "jurisdiction": "UK law", "text": ""}]}
    (tmp_path / "case.json").write_text(json.dumps(case, indent=1))
    bundle = I.ingest(I.case_sources(I.read_cases(spark, str(tmp_path / "case.json"))))
    assert [(r.id, r.current_snapshot_id) for r in bundle["sources"].orderBy("id").collect()] == [("S 1", "snap-s-1-v1"), ("src-uk-law-002", "snap-src-uk-law-002-v1")]
    assert {r.fragment_type for r in bundle["fragments"].collect()} == {"article", "document"}
    for run in ("r1", "r2", "r1"):
        N.write_run(bundle, str(tmp_path / "store"), run)
    assert [(r.run_id, r.n) for r in N.list_runs(spark, str(tmp_path / "store")).collect()] == [("r2", 2), ("r1", 2)]
    assert N.read_relation(spark, str(tmp_path / "store"), "fragments", "r1").count() == 2
    N.export_csv(bundle["reviews"], str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    xml = "<A><P1 id='x'>Section 2 shall <b>apply</b>.</P1><P1 id='x'>again</P1><Contents><P1 id='c'>list</P1></Contents></A>"
    got = I.legislation_provisions(spark.createDataFrame([(1, xml), (2, "<broken"), (3, None)], "id long, xml string"), "id", "xml").collect()
    assert [tuple(r) for r in got] == [(1, 0, "xml:x", "Section 2 shall apply.")]
    assert one(spark, I.locator_of(F.col("s")), s="under Section 9 and article 3a") == "article:3a"


def test_top_k_of_ragged_vectors(spark):
    """Products over the common length of a pair, norms over whole vectors; an empty, short or null one changes no other pair."""
    vectors = {1: [1.0, 2.0, 3.0, 4.0], 2: [4.0, -1.0, 3.0, 4.0], 3: [1.0], 4: [], 5: [3.0, 2.0, -3.0]}
    df = spark.createDataFrame([*vectors.items(), (9, None)], "id long, vector array<double>")

    def cosine(a, b):
        norm = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=False)) / norm, 6) if norm else 0.0

    got = {(r.query_id, r.item_id): r.score for r in M.top_k(df, df, 5, -1.0).collect()}
    assert got == {(i, j): cosine(a, b) for i, a in vectors.items() for j, b in vectors.items()}


def test_extraction_by_rules(spark, sf_dir):
    """Items of lists first, by turns over their letters, then sentences of the best tier that the items don't say."""
    import re
    from collections import defaultdict

    from provisio.plans import extraction_queries as Q

    pieces = defaultdict(list)
    for r in sorted(Q.fragments(spark, sf_dir).collect()):
        pieces[r.source_record_id].append((r.locator, r.fragment_text or ""))
    got = defaultdict(list)
    for r in sorted(Q.rule_extraction(spark, sf_dir).collect(), key=lambda r: r.seq):
        assert r.id == f"prop-{r.source_record_id.lower().replace(' ', '-')}-{r.seq:03d}"
        got[r.source_record_id].append(r.proposition_text)
    assert set(got) == set(pieces)
    low = lambda x: " ".join(x.lower().split())
    normative = lambda x: any(w in x.lower() for w in ("must", "shall", "may", "required", "prohibited"))
    for source, parts in pieces.items():
        lists = defaultdict(list)
        for locator, text in parts:
            for where, clause in X.list_drafts(text, locator):
                lists[where.split("-")[1]].append(clause)
        drafts = [c for letter in lists.values() for c in letter]
        if len(drafts) > Q.LIMIT:
            drafts = [letter[k] for k in range(9) for letter in lists.values() if k < len(letter)][: Q.LIMIT]
        said = {low(c) for c in drafts}
        tiers = [[], [], []]
        for locator, text in parts:
            for s in re.split(r"(?<=[.!?;])\s+(?=(?:\(?[a-z0-9ivx]+\)|[A-Z]))", " ".join(text.split())):
                s = " ".join(s.strip(" ;").split())
                if s and low(s) not in said:
                    tiers[0 if normative(s) and locator.startswith("article") else 1 if normative(s) else 2].append(s)
        rest = tiers[0] or tiers[1] or tiers[2] or ["No source text provided."]
        assert got[source] == (drafts + rest)[: Q.LIMIT], source


@pytest.mark.parametrize("threshold", [-1.0, 0.2, 0.6])
def test_best_pairs_by_bounds_are_those_of_all_pairs(threshold):
    """Products in single precision only leave pairs out: over several tiles, with ties, zeros, no numbers and infinities."""
    import numpy as np

    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(300, 5)), np.round(rng.normal(size=(4500, 4)), 1)
    a[3], b[5], a[7, 0], b[9, 0], b[11, 0] = 0, 0, np.nan, np.nan, np.inf
    starts = np.concatenate([[0], np.cumsum(rng.integers(1, 4, len(b)))])
    ids = rng.permutation(starts[-1])
    wide = np.pad(b, ((0, 0), (0, 1)))
    with np.errstate(all="ignore"):
        norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)
        scores = np.round(np.divide(a @ wide.T, norms, out=np.zeros(norms.shape), where=norms > 0), 6)
        row, item, score = M._best_pairs(a, b, ids, starts, 5, threshold)
    of = np.repeat(np.arange(len(b)), np.diff(starts))
    for r in range(len(a)):
        own = scores[r][of]
        want = sorted((-s, i) for s, i in zip(own[own >= threshold].tolist(), ids[own >= threshold].tolist(), strict=True))[:5]
        assert sorted(zip((-score[row == r]).tolist(), item[row == r].tolist(), strict=True)) == want


def test_top_k_compares_copies_once(spark):
    """Copies of a vector are one row of a product, and every copy gets its matches, the smallest ids first."""
    vectors = [[1.0, 0.0], [1.0, 0.1], [0.0, 1.0]]
    queries = spark.createDataFrame([(i, vectors[i % 3]) for i in range(30)] + [(4, vectors[2])], "id long, vector array<float>")
    items = spark.createDataFrame([(1000 - i, vectors[i % 2]) for i in range(40)], "id long, vector array<float>")
    got = {}
    for r in M.top_k(queries, items, 3, 0.4, block=1).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.item_id)
    ids = [sorted(1000 - i for i in range(40) if i % 2 == v)[:3] for v in (0, 1)]
    assert got == {i: ids[i % 3] for i in range(30) if i % 3 < 2}
    seen = M.top_k(queries, items, 3, 0.4)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in seen
