"""Queries over the given tables: matching, review, history, differences between runs; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff as D
from ..operators import history as H
from ..operators import matching as M
from ..operators import review as R


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- vector matching: even vec_id are guidance statements, odd ones law ----------------------------------------------
def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return M.top_k(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), 5, 0.4)


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five law vectors closest to each guidance vector."""
    return _matches(spark, sf_dir)


COSINE_SQL = """
SELECT query_id, item_id, score, CAST(rank AS INT) AS rank FROM (
  SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT g.vec_id AS query_id, l.vec_id AS item_id, round(list_cosine_similarity(g.embedding::DOUBLE[], l.embedding::DOUBLE[]), 6) AS score
    FROM embeddings g, embeddings l WHERE g.vec_id % 2 = 0 AND l.vec_id % 2 = 1) WHERE score >= 0.4) WHERE rank <= 5
"""


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with the relationship and confidence that a model would give, here from labels and scores."""
    labels = _table(spark, sf_dir, "embeddings").select("vec_id", "label")
    rows = _matches(spark, sf_dir).join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("lq")), "query_id").join(labels.select(F.col("vec_id").alias("item_id"), F.col("label").alias("li")), "item_id")
    kind = F.when(F.col("lq") == F.col("li"), "confirmed").when((F.col("lq") + F.col("li")) % 5 == 0, "contradicts").when((F.col("lq") + F.col("li")) % 5 == 1, "guidance omits detail").when((F.col("lq") + F.col("li")) % 5 == 2, "outdated").otherwise("does not match")
    confidence = F.when(F.col("score") >= 0.7, "high").when(F.col("score") >= 0.55, "medium").otherwise("low")
    return rows.select("query_id", "item_id", "score", kind.alias("relationship"), confidence.alias("confidence"))


_RELATED_SQL = f"""
top AS ({COSINE_SQL}),
rel AS (SELECT query_id, item_id, score, CASE WHEN q.label = i.label THEN 'confirmed' WHEN (q.label + i.label) % 5 = 0 THEN 'contradicts' WHEN (q.label + i.label) % 5 = 1 THEN 'guidance omits detail' WHEN (q.label + i.label) % 5 = 2 THEN 'outdated' ELSE 'does not match' END AS relationship,
  CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.55 THEN 'medium' ELSE 'low' END AS confidence FROM top JOIN embeddings q ON q.vec_id = query_id JOIN embeddings i ON i.vec_id = item_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE relationship WHEN 'confirmed' THEN 1 WHEN 'guidance omits detail' THEN 2 WHEN 'guidance contains additional detail' THEN 3 WHEN 'outdated' THEN 4 WHEN 'contradicts' THEN 5 ELSE 6 END,
  CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, score DESC, item_id) AS place FROM rel)"""


def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best classified match of each guidance statement."""
    return M.best_match(_related(spark, sf_dir))


BEST_SQL = f"WITH {_RELATED_SQL} SELECT query_id, item_id, relationship, confidence, score FROM ranked WHERE place = 1"


def overlay_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colour of each guidance statement in the overlay."""
    return M.overlay_status(_related(spark, sf_dir))


OVERLAY_SQL = f"""
WITH {_RELATED_SQL} SELECT query_id, CASE WHEN grounded = 0 THEN 'none' WHEN c = grounded THEN 'green' WHEN x = grounded THEN 'red' ELSE 'amber' END AS status, grounded, matches FROM (
  SELECT query_id, count(*) FILTER (relationship <> 'does not match') AS grounded, count(*) FILTER (relationship = 'confirmed') AS c, count(*) FILTER (relationship = 'contradicts') AS x, count(*) AS matches FROM rel GROUP BY 1)
"""


def csv_export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One export row for each guidance statement, with its best match or blanks."""
    statements = _table(spark, sf_dir, "embeddings").filter("vec_id % 2 = 0").select(F.col("vec_id").alias("query_id"), "label")
    best = M.best_match(_related(spark, sf_dir))
    rows = statements.join(best, "query_id", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.select("query_id", "label", text("item_id").alias("item"), text("relationship").alias("relationship"), text("confidence").alias("confidence"), F.coalesce(F.format_number("score", 2), F.lit("")).alias("score"))


CSV_SQL = f"""
WITH {_RELATED_SQL} SELECT e.vec_id AS query_id, e.label, coalesce(CAST(item_id AS VARCHAR), '') AS item, coalesce(relationship, '') AS relationship, coalesce(confidence, '') AS confidence, coalesce(printf('%.2f', score), '') AS score
FROM embeddings e LEFT JOIN (SELECT * FROM ranked WHERE place = 1) b ON b.query_id = e.vec_id WHERE e.vec_id % 2 = 0
"""


# --- review: events are decisions on the artefact of their user ------------------------------------------------------
_DECISIONS = """
SELECT 'dec-' || lpad(CAST(event_id AS STRING), 8, '0') AS id, 'art-' || CAST(user_id AS STRING) AS artifact_id, CASE event_type WHEN 'click' THEN 'approved' WHEN 'purchase' THEN 'overridden' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'needs_review' ELSE 'deferred' END AS decision,
       CAST(CAST(ts AS DATE) AS STRING) AS reviewed_at, CASE WHEN event_id % 7 = 0 THEN 'dec-' || lpad(CAST(event_id + 7 AS STRING), 8, '0') ELSE '' END AS supersedes, value, 'because ' || event_type AS reason
FROM {events}
"""


def latest_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision in force for each artefact."""
    decisions = spark.sql(_DECISIONS, events=_table(spark, sf_dir, "events"))
    return R.current_decisions(decisions, ["artifact_id"]).select("artifact_id", F.col("id").alias("decision_id"), "decision", "reviewed_at")


_CURRENT_SQL = f"""
d AS ({_DECISIONS.format(events="events")}), cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY reviewed_at DESC, id DESC) AS place FROM d WHERE id NOT IN (SELECT supersedes FROM d WHERE supersedes <> '')) WHERE place = 1)"""
LATEST_SQL = f"WITH {_CURRENT_SQL} SELECT artifact_id, id AS decision_id, decision, reviewed_at FROM cur"


def effective_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as artefacts under the decision in force: status, and the segment where it was overridden."""
    decisions = R.current_decisions(spark.sql(_DECISIONS, events=_table(spark, sf_dir, "events")), ["artifact_id"])
    decisions = decisions.withColumn("replacement", F.create_map(F.lit("segment"), F.concat(F.lit("SEG-"), F.floor("value").cast("string"))))
    artefacts = _table(spark, sf_dir, "customer").select(F.concat(F.lit("art-"), F.col("c_custkey").cast("string")).alias("artifact_id"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))
    return R.effective(artefacts, decisions, "artifact_id", ["segment", "name"])


EFFECTIVE_SQL = f"""
WITH {_CURRENT_SQL} SELECT a.artifact_id, CASE WHEN decision = 'overridden' THEN 'SEG-' || CAST(floor(value) AS BIGINT) ELSE segment END AS segment, name, coalesce(decision, 'generated') AS effective_status, coalesce(reason, '') AS review_reason
FROM (SELECT 'art-' || c_custkey AS artifact_id, c_mktsegment AS segment, c_name AS name FROM customer) a LEFT JOIN cur USING (artifact_id)
"""

_STATUS = "CASE event_type WHEN 'click' THEN 'proposed' WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'needs_more_sources' ELSE 'superseded' END"


def review_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each status step of each artefact and whether the state machine allows it."""
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.expr(_STATUS).alias("status"))
    return R.transitions(rows, "user_id", ["ts", "event_id"], "status").select("event_id", "status", "previous_status", "allowed")


TRANSITIONS_SQL = f"""
WITH e AS (SELECT event_id, {_STATUS} AS status, lag({_STATUS}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_status FROM events)
SELECT event_id, status, previous_status, previous_status IS NULL OR previous_status = status OR (previous_status = 'proposed' AND status IN ('accepted', 'rejected', 'needs_more_sources', 'superseded'))
  OR (previous_status = 'needs_more_sources' AND status IN ('proposed', 'accepted', 'rejected', 'superseded')) OR (previous_status = 'accepted' AND status = 'superseded') OR (previous_status = 'rejected' AND status IN ('proposed', 'superseded')) AS allowed FROM e
"""


# --- history --------------------------------------------------------------------------------------------------------
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of each user's proposition in order, each with its change against the one before."""
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", F.get_json_object("props", "$.k").alias("k"), F.floor(F.col("value") / 50).alias("band"))
    found = H.with_changes(rows, ["user_id"], ["ts", "event_id"], "event_type", ["k", "band"])
    return found.select("event_id", "user_id", "position", "change", F.array_join("changed_fields", "|").alias("changed_fields"))


VERSION_SQL = """
WITH e AS (SELECT event_id, user_id, row_number() OVER w - 1 AS position, event_type IS DISTINCT FROM lag(event_type) OVER w AS t, json_extract_string(props, '$.k') IS DISTINCT FROM lag(json_extract_string(props, '$.k')) OVER w AS k, floor(value / 50) IS DISTINCT FROM lag(floor(value / 50)) OVER w AS b
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, CAST(position AS INT) AS position, CASE WHEN position = 0 THEN 'initial' WHEN t AND (k OR b) THEN 'text_and_metadata' WHEN t THEN 'text_only' WHEN k OR b THEN 'metadata_only' ELSE 'no_change' END AS change,
  CASE WHEN position = 0 THEN '' ELSE concat_ws('|', CASE WHEN k THEN 'k' END, CASE WHEN b THEN 'band' END) END AS changed_fields FROM e
"""


def snapshot_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as snapshots of a source, each compared with the one before."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    return H.with_changes(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus", ["o_orderpriority"]).select("o_orderkey", "o_custkey", "position", "change")


TIMELINE_SQL = """
WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER w - 1 AS position, o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER w AS t, o_orderpriority IS DISTINCT FROM lag(o_orderpriority) OVER w AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, o_custkey, CAST(position AS INT) AS position, CASE WHEN position = 0 THEN 'initial' WHEN t AND p THEN 'text_and_metadata' WHEN t THEN 'text_only' WHEN p THEN 'metadata_only' ELSE 'no_change' END AS change FROM o
"""


def round_robin_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lines an order by turns over their return flags."""
    return H.round_robin(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey", "l_shipdate"), ["l_orderkey"], "l_returnflag", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], 3)


ROUND_ROBIN_SQL = """
WITH t AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER w AS turn, l_partkey, l_suppkey, l_shipdate, first(row(l_linenumber, l_partkey, l_suppkey, l_shipdate)) OVER w AS f FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate))
SELECT l_orderkey, l_linenumber, l_returnflag, l_partkey, l_suppkey, l_shipdate, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY turn, f) AS place FROM t) WHERE place <= 3
"""


def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each normalised text and language."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.sha2(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))).cast("binary"), 256).alias("norm"))
    return H.first_wins(docs, ["norm", "lang"], ["doc_id"])


FIRST_WINS_SQL = r"""
SELECT norm, lang, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY norm, lang ORDER BY doc_id) AS place FROM (SELECT doc_id, lang, source, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS norm FROM documents)) WHERE place = 1
"""


# --- differences ----------------------------------------------------------------------------------------------------
def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"))
    baseline = orders.filter("o_orderkey % 10 <> 3")
    candidate = orders.filter("o_orderkey % 10 <> 4 AND o_custkey % 17 <> 2").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 == 0, "X").otherwise(F.col("o_orderstatus")))
    return baseline, candidate


_RUNS_SQL = """b AS (SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS price FROM orders WHERE o_orderkey % 10 <> 3),
c AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, round(o_totalprice, 2) AS price FROM orders WHERE o_orderkey % 10 <> 4 AND o_custkey % 17 <> 2),
ch AS (SELECT coalesce(b.o_orderkey, c.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN c.o_orderkey IS NULL THEN 'removed' WHEN b.o_orderstatus = c.o_orderstatus AND b.price = c.price THEN 'unchanged' ELSE 'changed' END AS change FROM b FULL JOIN c USING (o_orderkey)),
un AS (SELECT b.* FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM c) AND o_custkey IN (SELECT o_custkey FROM c))"""


def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of orders: what was added, removed or changed."""
    return D.run_diff(*_runs(spark, sf_dir), "o_orderkey", ["o_orderstatus", "price"])


RUN_DIFF_SQL = f"WITH {_RUNS_SQL} SELECT o_orderkey, change FROM ch"


def run_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the differences and the verdict on the candidate run."""
    b, c = _runs(spark, sf_dir)
    return D.verdict(D.run_diff(b, c, "o_orderkey", ["o_orderstatus", "price"]), D.unexplained_removals(b, c, "o_orderkey", ["o_custkey"]))


VERDICT_SQL = f"""
WITH {_RUNS_SQL} SELECT *, CASE WHEN unexplained > 0 THEN 'regression' WHEN added + removed + changed > 0 THEN 'changed' ELSE 'unchanged' END AS verdict
FROM (SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed, (SELECT count(*) FROM un) AS unexplained FROM ch)
"""


def two_pass_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of two runs paired by key, then by nation as the instrument."""
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(F.col("s_nationkey").cast("string")).alias("instrument"))
    return M.two_pass_pairs(s.filter("id % 3 <> 0"), s.filter("id % 3 <> 1"))


TWO_PASS_SQL = """
WITH s AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE CAST(s_nationkey AS VARCHAR) END AS inst FROM supplier), b AS (SELECT * FROM s WHERE id % 3 <> 0), c AS (SELECT * FROM s WHERE id % 3 <> 1),
l AS (SELECT * FROM b WHERE id NOT IN (SELECT id FROM c)), r AS (SELECT * FROM c WHERE id NOT IN (SELECT id FROM b)),
p AS (SELECT x.id AS id_b, y.id AS id_c, inst FROM (SELECT inst, min(id) AS id FROM l WHERE inst <> '' GROUP BY 1) x JOIN (SELECT inst, min(id) AS id FROM r WHERE inst <> '' GROUP BY 1) y USING (inst))
SELECT b.id AS id_b, c.id AS id_c, 'id' AS how FROM b JOIN c USING (id) UNION ALL SELECT id_b, id_c, 'instrument' FROM p
UNION ALL SELECT id, NULL, 'removed' FROM l WHERE inst NOT IN (SELECT inst FROM p) UNION ALL SELECT NULL, id, 'added' FROM r WHERE inst NOT IN (SELECT inst FROM p)
"""


def merge_datasets_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of two datasets by origin, and the ids that would clash."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    union, clash = D.merge_runs(orders.filter("o_orderkey % 2 = 0").withColumn("origin", F.lit("left")), orders.filter("o_orderkey % 2 = 1 OR o_orderkey % 100 = 0").withColumn("origin", F.lit("right")), "o_orderkey")
    counts = union.groupBy("origin", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(clash.agg(F.count(F.lit(1)).alias("n")).select(F.lit("clash").alias("origin"), F.lit(None).cast("string").alias("o_orderstatus"), "n"))


MERGE_SQL = """
SELECT 'left' AS origin, o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 2 UNION ALL SELECT 'right', o_orderstatus, count(*) FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 100 = 0 GROUP BY 2
UNION ALL SELECT 'clash', NULL, count(*) FROM orders WHERE o_orderkey % 100 = 0
"""

QUERIES = {
    "cosine_topk": (cosine_topk, COSINE_SQL),
    "best_match": (best_match, BEST_SQL),
    "overlay_status": (overlay_status, OVERLAY_SQL),
    "csv_export_rows": (csv_export_rows, CSV_SQL),
    "latest_decision": (latest_decision, LATEST_SQL),
    "effective_view": (effective_view, EFFECTIVE_SQL),
    "review_transitions": (review_transitions, TRANSITIONS_SQL),
    "version_history": (version_history, VERSION_SQL),
    "snapshot_timeline": (snapshot_timeline, TIMELINE_SQL),
    "round_robin_quota": (round_robin_quota, ROUND_ROBIN_SQL),
    "dedupe_first_wins": (dedupe_first_wins, FIRST_WINS_SQL),
    "run_diff": (run_diff, RUN_DIFF_SQL),
    "run_verdict": (run_verdict, VERDICT_SQL),
    "two_pass_pairing": (two_pass_pairing, TWO_PASS_SQL),
    "merge_datasets_guard": (merge_datasets_guard, MERGE_SQL),
}
