"""Small cases of operators whose queries run over made-up relations: nulls, ties, order of rows, what is rewritten."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from provisio.operators import candidates as C
from provisio.operators import datasets as D
from provisio.operators import evidence as V
from provisio.operators import explorer_merge as M
from provisio.operators import findings as N
from provisio.operators import lint as Q
from provisio.operators import model_rows as R
from provisio.operators import overrides as O
from provisio.operators import rollups as U
from provisio.operators import versions as H
from provisio.plans import scope_queries

PROP = "id string, source_record_id string, proposition_text string, label string, legal_subject string"
SOURCE = "id string, title string, citation string, authoritative_text string"


def _links(spark, text, label="", subject="operator", title="x", citation="y", body="noise"):
    _, _, scopes = scope_queries._tables(spark, "/root/testdata/sf0.001")
    props = spark.createDataFrame([("p", "s", text, label, subject)], PROP)
    found = V.scope_evidence(props, spark.createDataFrame([("s", title, citation, body)], SOURCE), scopes)
    return {r.scope_id: r for r in found.collect()}, scopes, found


@pytest.mark.parametrize(
    ("given", "field", "relevance", "confidence", "excluded"),
    [
        (dict(text="Operators must update the bovine herd register.", title="Derogation for equine passports and bovine herds", body="Bovine herds only."), "source_title", "contextual", "medium", False),
        (dict(text="Member States shall record database information for species other than bovine, ovine and equine when rules so provide."), "proposition_text", "contextual", "medium", True),
        (dict(text="Member States must record data on kept animals of the equine species."), "proposition_text", "direct", "high", False),
        (dict(text="Operators must keep records for livestock movement.", label="Equine passport logistics dashboard"), "proposition_label", "contextual", "medium", False),
        (dict(text="Authorities shall maintain a register.", body="The identification document for equidae shall contain the reference."), "source_fragment_text", "direct", "high", False),
        (dict(text="Operators shall register each animal.", subject="keeper of equidae"), "legal_subject", "direct", "high", False),
        (dict(text="There is a levy on oats purchased for bedding.", body="Unrelated preamble. " + "context filler. " * 400 + "The farmer kept many horses."), "source_context", "contextual", "low", False),
    ],
)
def test_evidence_of_a_scope(spark, given, field, relevance, confidence, excluded):
    links, _, _ = _links(spark, **given)
    e = links["equine"]
    assert (e.field, e.relevance, e.confidence, e.species_exclusion) == (field, relevance, confidence, excluded)
    assert e.term in e.excerpt and len(e.excerpt) <= 2 * V.EXCERPT_RADIUS + len(e.term) + 2


def test_scopes_above_and_review(spark):
    links, scopes, found = _links(spark, "The horse passport must show the cattle.", body=None, title=None)
    above = {r.scope_id: r for r in V.inherited_evidence(found, scopes).collect()}
    assert set(above) == {"kept_terrestrial_animal", "terrestrial_animal", "animal"} and not any(r.from_weak for r in above.values())
    cues = V.review_candidates(found, V.inherited_evidence(found, scopes), scopes, "r").collect()
    assert [(c.kind, c.related) for c in cues] == [("sibling_species_ambiguity", ["bovine", "equine"])]
    unknown = V.unknown_scope_candidates(spark.createDataFrame([("p", "Equine"), ("p", "Sea Eagle"), ("q", "sea-eagle"), ("r", None)], "id string, tag string"), scopes, "r", "tag").collect()
    assert [(u.suggested_slug, u.n, u.first_id) for u in unknown] == [("sea_eagle", 2, "p")]


def test_merged_groups_keep_each_artefact_once(spark):
    """Groups of equal multisets of rows merge; a repeated id counts once, rows without ids all stay; one row more is another group."""
    fields = "id string, ord long, source_record_id string, jurisdiction string, cluster string, lineage string, fragment_locator string, article_reference string, proposition_text string, proposition_key string, effective_status string, kind string, label string, group_key string"
    row = lambda i, n, key, text="must": (i, n, "s", "EU", "none", None, "annex", "", text, "k", "generated", "duty", "", key)
    rows = M.subgroups(spark.createDataFrame([row("a", 1, "g2"), row("b", 2, "g1"), row("b", 3, "g3"), row(None, 4, "g4"), row(None, 5, "g5"), row("c", 6, "g6"), row("d", 7, "g6"), row("e", 8, "g7", "shall")], fields))
    links = spark.createDataFrame([], "id string, scope_id string, relevance string, confidence string")
    found = M.merged(rows, links).collect()
    members = {}
    for r in found:
        members.setdefault(r.merged_key, []).append(r.id)
    assert {k: sorted(map(str, v)) for k, v in members.items()} == {"g1": ["None", "None", "a", "b", "e"], "g6": ["c", "d"]}
    assert {r.merged_groups for r in found if r.merged_key == "g1"} == {6}


def test_history_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(4)
    snap = lambda i, text: ("src", f"s{i % 4}", f"v{i % 2}", f"h{i % 3}", f"2026-0{1 + i % 2}-01", None, text, "document:full", "case")
    fields = "source_record_id string, id string, version_id string, content_hash string, retrieved_at string, as_of_date string, authoritative_text string, authoritative_locator string, provenance string"
    runs = [(f"run-{i % 5}", *snap(i, rng.choice(["", "told"]))) for i in range(30)]
    past = [(f"reg-{i % 2}", "src", rng.choice(["s1", ""]), rng.choice(["h1", "gone"]), None, "2026-05-01", i) for i in range(6)]
    seen = set()
    for _ in range(3):
        rng.shuffle(runs), rng.shuffle(past)
        out = H.snapshot_history(spark.createDataFrame(runs, "run_id string, " + fields).repartition(3), spark.createDataFrame([("reg-0", *snap(1, "now"))], "registry_id string, " + fields), spark.createDataFrame(past, "registry_id string, source_record_id string, source_snapshot_id string, content_hash string, version_id string, refreshed_at string, position int"))
        seen.add(str(sorted(map(str, out.collect()))))
        assert all(r.authoritative_text for r in out.collect() if r.id == "s1" and any(o.kind == "registry_current_state" for o in r.origins))
    assert len(seen) == 1


def test_nested_versions(spark):
    rows = spark.createDataFrame([("k", "b", ["s2", "s1"], 2), ("k", "a", [], 1), ("k", "c", None, 3), ("k", "d", ["s1", ""], 0)], "key string, v string, source_snapshot_ids array<string>, at int")
    got = H.by_snapshot(rows, ["key"], ["at"], ["v"], "source_snapshot_ids").first().groups
    assert [(g.source_snapshot_id, g.observed_version_count, [x.v for x in g.observed_versions]) for g in got] == [("s1", 2, ["d", "b"]), ("s2", 1, ["b"]), ("snapshot-unknown", 3, ["d", "a", "c"])]


def test_only_target_partitions_are_rewritten(spark, tmp_path):
    props = spark.createDataFrame([(f"p{i}", f"src-{i % 30}", f"f{i % 2}" if i % 5 else None) for i in range(300)], "id string, source_record_id string, source_fragment_id string")
    D.write_bucketed(props, str(tmp_path), "propositions", "r1")
    D.write_bucketed(props, str(tmp_path), "propositions", "r2")
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".parquet")}
    before = files()
    targets = D.repair_targets(spark.createDataFrame([("src-3", "f1"), ("src-3", "f1"), (" src-5 ", None), ("", "f0")], "source_record_id string, source_fragment_id string"))
    touched = D.repair_in_place(spark, str(tmp_path), "propositions", "r1", targets, spark.createDataFrame([("new", "src-3", "f1")], "id string, source_record_id string, source_fragment_id string"))
    assert {f.split("bucket=")[1].split("/")[0] for f in before ^ files()} == set(map(str, touched)) and not [f for f in before ^ files() if "run_id=r2" in f]
    left = {r.id for r in D.read_relation(spark, str(tmp_path), "propositions", "r1").collect()}
    gone = {f"p{i}" for i in range(300) if (i % 30 == 3 and i % 5 and i % 2 == 1) or (i % 30 == 5 and i % 5 == 0)}
    assert left == {f"p{i}" for i in range(300)} - gone | {"new"}
    with pytest.raises(ValueError):
        D.compare_datasets(props, props, "EU", "UK", ["source_record_id"], ["id"])


def test_close_titles_by_brute_force(spark):
    """Signatures of rare words find every pair of word sets that is close enough."""
    rng = random.Random(2)
    sets = sorted({tuple(sorted(rng.sample([f"w{i}" for i in range(12)], rng.randint(1, 8)))) for _ in range(150)})
    frame = spark.createDataFrame([(list(s),) for s in sets], "words array<string>")
    got = {(tuple(r.left_words), tuple(r.right_words)) for r in C.close_sets(frame, frame).collect()}
    assert got == {(a, b) for a in sets for b in sets if 2 * len(set(a) & set(b)) / (len(a) + len(b)) >= C.CLOSE}


def test_model_rows(spark):
    """Containers that are none give no items; what is left out before numbering; propositions of the accepted items."""
    out = spark.createDataFrame([("s", '{"propositions": [1, {"proposition_text": "The keeper must act before noon.", "reason": "why", "exceptions": ["x", " "], "source_locator": "article:4"}]}'), ("t", "plain"), ("u", None), ("v", '{"other": []}')], "source_id string, output string")
    assert [(r.source_id, r.row_index) for r in R.items(out).collect()] == [("s", 0)]
    found = R.checked(R.items(out), spark.createDataFrame([("s", None)], "source_id string, source_text string"), 5)
    made = R.propositions(found, spark.createDataFrame([("s", "EU", "document:full", "snap")], "source_id string, jurisdiction string, authoritative_locator string, current_snapshot_id string")).collect()
    assert [(r.id, r.legal_subject, r.action, r.article_reference, r.conditions) for r in made] == [("prop-s-001", "keeper", "act before noon", "article 4", ["exception: x"])]
    stamped = R.stamped(found.withColumn("validation_errors", F.array(F.lit("e"))), "frontier", None, "fallback", False, ("v2", "1")).first().meta
    assert '"extraction_mode":"frontier"' in stamped and '"validation_errors":["e"]' in stamped


def test_overrides(spark):
    art = spark.createDataFrame([("a", "old", ["c"]), ("b", "old", ["c"])], "id string, label string, conditions array<string>")
    dec = spark.createDataFrame([("1", "proposition", "a", "Overridden", '{"label": "new", "conditions": []}'), ("2", "proposition", "b", "overridden", '{"label": ["x"]}')], "id string, artifact_type string, artifact_id string, decision string, replacement string")
    assert {r.id: (r.label, r.conditions, r.overridden) for r in O.overridden(art, dec, "proposition").collect()} == {"a": ("new", [], True), "b": ("old", ["c"], False)}


def test_rules_tell_absent_tables_from_errors(spark):
    with pytest.raises(ValueError):
        Q.lint({}, Q.RUN_CHECKS)
    one = {"scopes": spark.createDataFrame([("a", "active")], "id string, status string")}
    assert Q.lint(one, Q.RUN_CHECKS).count() == 0
    with pytest.raises(KeyError):
        Q.lint(one, [Q.Check("X", "error", "g", "m", lambda t: {}["wrong"])])


def test_traces_and_merges_without_rows(spark):
    none = spark.createDataFrame([], "ord long, llm_invoked boolean, skipped_llm boolean, skip_reason string, estimated_input_tokens long, fragment_locator string, source_record_id string")
    assert U.call_summary(none).first().asDict() == {"llm_extraction_call_count": 0, "llm_extraction_skipped_count": 0, "context_window_risk_count": 0, "estimated_input_tokens": 0, "max_estimated_input_tokens": None, "largest_fragment_locator": None, "largest_source_record_id": None}
    row = lambda *r: spark.createDataFrame([r], "ord int, id string, title string")
    got = N.merged_sources(row(1, "a", "mirror"), row(1, " a ", None), row(1, "b", "listed"), ["title"]).collect()
    assert {r.id: (r.title, r.summary_only) for r in got} == {"a": (None, False), "b": ("listed", True)}


def test_calls_of_stages_in_parts(spark):
    """A stage trace in several rows gives the calls of one whole row, in its order; no row of the query holds all calls of a run."""
    import json

    from provisio.operators import rollups as U

    calls = [{"llm_invoked": i % 2 == 0, "skipped_llm": False, "skip_reason": None, "estimated_input_tokens": i % 3 + 1, "fragment_locator": f"a{i}", "source_record_id": f"s{i}"} for i in range(7)]
    text = lambda c: json.dumps({"extraction_mode": "frontier", "extraction_llm_call_traces": c})
    name, columns = "proposition extraction", "run_id string, position int, stage_name string, inputs string"
    whole = U.calls_of_stages(spark.createDataFrame([("r", 1, name, text(calls)), ("r", 2, name, text(calls[:1]))], columns))
    rows = [("r", 1, name, text(calls[i : i + 3]), i // 3) for i in (3, 6, 0)] + [("r", 2, name, text(calls[:1]), 0)]
    parts = U.calls_of_stages(spark.createDataFrame(rows, columns + ", part int"))
    plain = lambda d: [tuple(r) for r in d.orderBy("ord").drop("ord").collect()]
    assert plain(parts) == plain(whole) and len(plain(whole)) == 7
    assert U.call_summary(parts, ["run_id"]).first().largest_fragment_locator == "a2"


def test_stage_traces_hold_a_bounded_number_of_calls(spark, tmp_path):
    from pyspark.sql import functions as F

    from provisio.plans import record_queries as Q

    n = 3 * 32_768
    spark.range(n).selectExpr("id AS event_id", "id % 100 AS user_id", "'click' AS event_type").write.parquet(str(tmp_path / "events.parquet"))
    held = Q._stages(spark, str(tmp_path)).filter("position = 1").select(F.expr("json_array_length(get_json_object(inputs, '$.extraction_llm_call_traces'))").alias("n"))
    assert held.agg(F.max("n"), F.sum("n")).first() == (4096, n)
