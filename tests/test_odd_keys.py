"""Queries against their SQL on small tables of odd keys: long, repeated, missing."""

import datetime as dt

import duckdb
import pytest

from civicspark import io
from civicspark.operators import records
from civicspark.plans import ORACLES, QUERIES

SCHEMAS = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
}


@pytest.fixture
def same(spark, tmp_path):
    """Compares a query with its SQL over the given rows; returns the rows."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, rows in tables.items():
            spark.createDataFrame(rows, SCHEMAS[t]).coalesce(2).write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        found = con.execute(f"SELECT * FROM ({ORACLES[name]}) z")
        names = [c[0] for c in found.description]
        want = sorted(found.fetchall(), key=str)
        assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select(names).collect()), key=str) == want
        return want

    return run


def test_places_of_keys_longer_than_their_code(same):
    customers = [(k, f"n{k}", k % 25, 0.0, "x") for k in (7, 12345, 123456, 123457, 99999, 100003)] + [(None, "none", 1, 0.0, "x")]
    orders = [(i, k, "F", 1.0, dt.datetime(2024, 1, 1), "1") for i, k in enumerate([7, 12345, 123456, 123457, 123458, None, 999990])]
    want = same("contest_places", customer=customers, orders=orders)
    assert len(want) == len(orders) and (2, "12345", "n123456") in want


def test_pairs_of_repeated_keys_come_once(same):
    rows = [(10, "a", "c1", "t1", 1, 0.0), (10, "a", "c2", "t1", 1, 0.0), (10, "a", "c2", "t1", 1, 0.0), (20, "b", "c1", "t1", 1, 0.0), (20, "b", None, "t2", 2, 0.0), (4, "d", "c1", "t1", 1, 0.0), (6, "e", None, "t2", 2, 0.0), (5, "f", "c2", None, 1, 0.0), (None, "g", "c1", "t1", 1, 0.0), (3, "h", "c1", "t9", 9, 0.0), (30, "i", "c1", "t9", None, 0.0)]
    assert (4, 10) in same("contest_matches", part=rows)


def test_pairs_reach_the_sink_without_a_shuffle_of_pairs(spark):
    text = QUERIES["contest_matches"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = text.split("Join")[0]
    assert text.startswith("Union") and "Aggregate" not in above


@pytest.mark.parametrize("lists, rows_of_a_task", [((1, 1), 5), ((2, 3), 40), ((64, 1024), 1 << 19)])
def test_pairs_of_keys_in_lists_of_any_length(same, monkeypatch, lists, rows_of_a_task):
    monkeypatch.setattr(records, "LIST_KEYS", lists)
    monkeypatch.setattr(io, "TASK_ROWS", rows_of_a_task)
    key = lambda i: None if i == 0 else i if i % 9 else i // 9
    rows = [(key(i), "n", ["c1", "c2", "c3", None][i % 7 % 4], f"t{i % 5}" if i % 11 else None, i % 3 if i % 13 else None, 0.0) for i in range(120)]
    want = same("contest_matches", part=rows)
    assert len(want) > 500 and any(place is None for place, _ in want)


def test_a_row_is_written_few_times_before_it_meets(spark, tmp_path):
    rows = [(i, "n", f"c{i % 4}", f"t{i % 2}", i % 3, 0.0) for i in range(4000)]
    spark.createDataFrame(rows, SCHEMAS["part"]).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = set(written())
    QUERIES["contest_matches"](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    assert 0 < sum(n for stage, n in written().items() if stage not in before) < 8 * len(rows)


def test_names_of_repeated_and_missing_keys(same):
    customers = [(k, "x", 1, 0.0, "x") for k in (0, 1, 2, 3, 4, 5, 6, 7, 10, 18, 8, 8, 8, None)]
    assert len(same("name_scores", customer=customers, supplier=[(k, "s", 1, 0.0) for k in (5, 0, 6, 1, 2, 3, 4, 4)])) == 11


def test_called_members_of_repeated_and_missing_keys(same):
    customers = [(k, "x", 1, 0.0, "x") for k in (*range(40), 3, 3, 16, 126, 206, None)]
    suppliers = [(k, "s", 1, 0.0) for k in (*range(30), 29, 29, 16, 1269, 3009)]
    assert len(same("member_by_nickname", customer=customers, supplier=suppliers)) > 30


def test_questions_of_one_text_are_answered_once(spark):
    plan = lambda q: QUERIES[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    for q in ("name_scores", "member_by_nickname"):
        lines = plan(q).splitlines()
        met = max((i for i, line in enumerate(lines) if "Join Inner" in line), key=lambda i: lines[i].index("Join"))
        assert any("Aggregate" in line and "c_custkey" not in line for line in lines[met + 1 :]), q


def test_members_are_reduced_before_they_meet_askers(spark):
    plan = QUERIES["district_members"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join") :]


def test_best_pairs_stream_through_a_task(spark):
    from civicspark.operators import checks

    rows = [("m", "a", "x", 0.5), ("m", "a", "y", 0.9), ("m", "b", "y", 0.8), ("m", "b", "x", 0.5), ("n", "a", "x", 0.3), ("n", "c", "x", 0.3)]
    df = checks.greedy(spark.createDataFrame(rows, "g string, e string, v string, s double"), ["g"], "e", "v", "s")
    assert sorted((r.g, r.e, r.v) for r in df.collect()) == [("m", "a", "y"), ("m", "b", "x"), ("n", "a", "x")]
    assert "FlatMapGroups" not in df._jdf.queryExecution().optimizedPlan().toString()
