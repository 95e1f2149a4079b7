"""Every query of the engine that has SQL is held against it in DuckDB; the others against plain Python."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from provisio.plans import catalog


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    return str(v)


def _rows(table):
    columns = sorted(table.column_names)
    return columns, sorted(tuple(map(_plain, r.values())) for r in table.select(columns).to_pylist())


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert _rows(catalog.QUERIES[name](spark, sf_dir).toArrow()) == _rows(duck.sql(catalog.ORACLE_SQL[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_other_queries_give_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_the_rest_stands_without_the_training_data_operators():
    """Nothing in the engine imports that subpackage."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(f"{top}/provisio"):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(f"{folder}/{f}") as source:
                        assert "llm" not in [w for line in source if "import" in line for w in line.replace(".", " ").split()]


def test_export_rounds_scores_as_its_sql(spark, tmp_path):
    """Two digits of a score are those nearest to its binary value, an even last one at a tie: 0.995 is below its decimal, 0.625 a tie."""
    scores = [0.995, 0.985, 0.815, 0.625, 0.875, 0.435, 0.42]
    rows = [(2 * i, [0.0] * i + [1.0] + [0.0] * (15 - i), i) for i in range(len(scores))]
    rows += [(2 * i + 1, [0.0] * i + [s] + [0.0] * (7 - i) + [math.sqrt(1 - s * s)] + [0.0] * 7, i) for i, s in enumerate(scores)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = _rows(catalog.QUERIES["csv_export_rows"](spark, str(tmp_path)).toArrow())
    assert got == _rows(con.sql(catalog.ORACLE_SQL["csv_export_rows"]).to_arrow_table())
    assert [r[got[0].index("score")] for r in sorted(got[1], key=lambda r: int(r[got[0].index("query_id")]))][:4] == ["0.99", "0.98", "0.81", "0.62"]
