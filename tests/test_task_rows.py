"""Tasks hold no more rows as tables grow: what is dealt by a key goes to more tasks, with the same rows as before."""

import re

import pytest

from civicspark import io
from civicspark.extract import minutes
from civicspark.plans import QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["traders_near", "lobby_bill_merge_ci", "reconcile_meetings"])
def test_rows_of_a_table_decide_the_number_of_tasks(spark, monkeypatch, name):
    want = sorted(map(str, QUERIES[name](spark, DIR).collect()))
    monkeypatch.setattr(io, "TASK_ROWS", 300)
    got = QUERIES[name](spark, DIR)
    dealt = {int(n) for n in re.findall(r"hashpartitioning\([^()]*(?:\([^()]*\))?[^()]*, (\d+)\), REPARTITION_BY_NUM", got._jdf.queryExecution().executedPlan().toString())}
    assert dealt and min(dealt) > 8
    assert sorted(map(str, got.collect())) == want


def test_outcomes_and_dates_come_from_one_reading_of_the_lines(spark):
    plan = QUERIES["minutes_outcomes"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 1
    text = "Minutes\n{}\n  0001-2024  Resolution\nThe motion carried\nMay 3, 2021\n  0002-2024  Resolution\nThe motion failed\nEnactment No: E7"
    docs = spark.createDataFrame([(1, text.format("April 2, 2020")), (2, text.format("")), (3, "May 3, 2021\nno items"), (4, "  0003-2024  Resolution"), (5, None)], "k int, t string")
    lines = minutes.read_lines(docs, "k", "t", [])
    got = minutes.dated_outcomes(lines, "k")
    assert sorted(map(str, got.collect())) == sorted(map(str, minutes.outcomes(lines, "k").join(minutes.dates(lines, "k"), "k").collect()))
    assert {(r.k, r.date) for r in got.collect()} == {(1, "2020-04-02"), (2, "2021-05-03"), (4, None)}
