"""All queries of the engine by name, with the SQL they are held against."""

from __future__ import annotations

from . import candidate_queries, corpus_queries, dataset_queries, engine_queries, extraction_queries, guidance_queries, label_queries, merge_queries, model_queries, record_queries, registry_queries, rule_queries, scope_queries, source_queries, structure_queries, text_queries, version_queries

FLAGSHIP = "normative_sentences"
_ALL = {**text_queries.QUERIES, **engine_queries.QUERIES, **corpus_queries.QUERIES, **source_queries.QUERIES, **registry_queries.QUERIES, **extraction_queries.QUERIES, **scope_queries.QUERIES, **merge_queries.QUERIES, **version_queries.QUERIES, **record_queries.QUERIES, **candidate_queries.QUERIES, **model_queries.QUERIES, **rule_queries.QUERIES, **dataset_queries.QUERIES, **structure_queries.QUERIES, **guidance_queries.QUERIES, **label_queries.QUERIES}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
