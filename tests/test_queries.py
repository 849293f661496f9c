"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from sparkloom import plans

FOLDER = os.environ.get("SPARKLOOM_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the shared tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{FOLDER}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def plain(rows):
    return sorted(repr([round(v, 6) + 0.0 if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    if name not in plans.SQL:
        assert got
        return
    want = duck.execute(plans.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    assert plain(tuple(r) for r in got) == plain(tuple(r[names.index(c)] for c in cols) for r in want.fetchall())


def test_seal_with_empty_texts(spark, tmp_path):
    """Empty and missing texts are sealed in their place; a source without any text has no digest."""
    rows = [(i, None if i % 7 == 3 else "" if i % 3 == 0 else f"text {i}", f"src{i % 2}") for i in range(40)] + [(40, None, "none")]
    rows = [(i, t, s, len(t or "")) for i, t, s in rows]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(plans.SQL["b8_seal"])
    cols = [d[0] for d in want.description]
    assert plain(plans.QUERIES["b8_seal"](spark, str(tmp_path)).select(*cols).collect()) == plain(want.fetchall())


def test_entry_lists_sql_for_known_queries_only():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
