"""The contract queries against their SQL, on whole tables and on rows with odd values."""

import duckdb
import pytest

from quadrille.llm import mixing, oracles, packing, registry, repeats, secrets

TABLES = ("documents", "embeddings")


def same(df, con, sql):
    cols = sorted(df.columns)
    got = con.execute(sql)
    at = [[d[0] for d in got.description].index(c) for c in cols]
    assert sorted(d[0] for d in got.description) == cols
    want = sorted(repr(tuple(r[i] for i in at)) for r in got.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == want


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    same(registry.queries()[name](spark, sf), con, oracles.SQL[name])


def _renamed(df):
    return df.withColumnRenamed("id", "doc_id").drop("kept")


ODD = {
    "op3_repeats": lambda d: _renamed(repeats.without_repeats(d, texts=False)),
    "op5_packing": lambda d: packing.packed(d.select("doc_id", "text")).drop("text"),
    "op7_secrets": lambda d: _renamed(secrets.secret_spans(d)),
    "op9_mixing": lambda d: _renamed(mixing.mix(d)),
}


@pytest.mark.parametrize("name", sorted(ODD))
def test_odd_rows(docs, odd, name):
    rows = [r for r in odd if r[0] is not None] + [(20 + i, t, "en", s) for i, (t, s) in enumerate([("token = 'abcdefgh12345' paſſwd=0123456789abcdef", "a"), ("é API_KEY: abcd", "b"), ("AKIA" + "A1" * 9 + " eyJa.b.c xoxb-1234567890-a", None), ("0123456789abcdef" * 5, "c"), ("-----BEGIN RSA PRIVATE KEY-----", "c")])]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    same(ODD[name](docs(rows)), con, oracles.SQL[name])
