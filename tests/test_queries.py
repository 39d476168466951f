"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from civicspark.plans import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    ours = sorted((tuple(r) for r in df.select(names).collect()), key=str)
    rows = duck.execute(f"SELECT * FROM ({ORACLES[name]}) z")
    columns = [c[0] for c in rows.description]
    assert sorted(columns) == names
    theirs = sorted((tuple(r[columns.index(c)] for c in names) for r in rows.fetchall()), key=str)
    assert ours == theirs


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).take(1)
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


def test_quotes_inside_punctuation_are_found(spark, tmp_path):
    docs = ['"What is\n a name?" they said', "(The end.", "pre-glued words stand here", "a b a b c", None, "a b a b c", "tab\x0bbed word here"]
    items = ["What is a name", "The end", "end", "glued words stand", "", " ", None, "b a b", "a c", "What was a name", "words never seen here", "he", "bed word here", "What is", "is a", "a b c d"]
    spark.createDataFrame([(None if i == 0 else i // 2, t) for i, t in enumerate(docs)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None if i == 0 else i // 2, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(ORACLES["quote_evidence_missing"]).fetchall(), key=str)
    assert sorted((tuple(r) for r in QUERIES["quote_evidence_missing"](spark, str(tmp_path)).collect()), key=str) == want
    assert len(want) == 5
