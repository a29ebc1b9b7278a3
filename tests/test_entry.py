"""The registry: names, SQL and the plain queries against it."""

import duckdb
import pytest

import __spark_entry__
from chromafold.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) if x is not None and type(x).__name__ != "Decimal" else float(x) if x is not None else None


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).columns == ["ex_id", "target", "encoded"]


@pytest.mark.parametrize("name", ["word_cardinality", "vocab_dense_index", "edge_freq", "new_edges_curve", "encode_ft", "encode_with_dense", "mi_cumulative", "classification_metrics", "encode_tabular_dense", "encode_sm", "encode_ns", "encoding_grid", "dataset_summary", "greedy_color_assignment", "largest_first_order", "content_split", "positional_split", "finished_run_anti_join"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(map(plain, r)) for r in df.select(*names).collect())
    assert got == sorted(tuple(map(plain, r)) for r in found.fetchall())
