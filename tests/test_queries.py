"""Every registered query against its SQL, run by another engine on the same tables."""

import math

import duckdb
import pytest

from quadrille.plans import registry

QUERIES, SQL = registry.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "INTEGER": "int"}
#: No SQL form: searches and floating-point geometry, tested by rules elsewhere.
ROWS_ONLY = {"witness_paths", "synthetic_searches", "simplified_pairs"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _norm(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) and math.isfinite(v) else v for v in r)) for r in rows)


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = df.select(*cols).collect()
    if name in ROWS_ONLY:
        assert rows
        return
    got = duck.execute(SQL[name])
    types = {d[0]: str(d[1]) for d in got.description}
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    assert {f.name: f.dataType.simpleString() for f in df.schema} == {k: TYPES[v] for k, v in types.items()}
    at = [names.index(c) for c in cols]
    assert _norm(rows) == _norm([tuple(r[i] for i in at) for r in got.fetchall()])


def test_line_lengths_round_once(spark, tmp_path):
    """Lengths just below half a millimetre stay below it; unknown numbers, parts and quantities as in SQL."""
    rows = [(1, 1, 0, 38.0), (1, 2, 28_800, 50.0), (2, 1, 3, 4.0), (2, None, 9, 5.0), (2, 2, None, 6.0), (2, 3, 100, None), (2, 4, 7, 1.0), (2, 4, None, 8.0), (2, 5, 60, 2.0), (3, 1, 5, 5.0), (None, 1, 0, 0.0), (None, 2, 3, 4.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["line_lengths"](spark, str(tmp_path)).collect()]
    assert (1, 2, 28_800_002) in got
    assert _norm(got) == _norm(con.execute(SQL["line_lengths"]).fetchall())
