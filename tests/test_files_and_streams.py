"""Readers and writers on small files, and streams against their batch twins."""

import base64
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from civicspark.operators import checks, records
from civicspark.sinks import tables
from civicspark.sources import files
from civicspark.streaming import jobs


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_json_documents(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"results": {"summary": {"n": 2}, "a": {"n": 1}, "b": {"n": None}}}))
    assert rows(files.json_map(spark, f"{tmp_path}/m.json", "results", "struct<n:int>", ["summary"])) == [("a", 1), ("b", None)]
    (tmp_path / "h.json").write_text(json.dumps({"members": [{"name": "Ann", "trades": [{"ticker": "X", "amount": 5}, {"ticker": None, "amount": 6}]}, {"name": "Bo", "trades": []}]}))
    assert [(r.member, r.ticker, r.amount) for r in files.holdings(spark, f"{tmp_path}/h.json").collect()] == [("Ann", "X", 5), ("Ann", None, 6)]


def test_csv_by_name_and_bad_bytes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'n,name\n1,"a, b"\nx,caf\xe9\n')
    got = files.csv_rows(spark, f"{tmp_path}/a.csv", "name string, n int").collect()
    assert [(r.name[:3], r.n) for r in got] == [("a, ", 1), ("caf", None)]


def test_roll_calls_and_fallback(spark, tmp_path):
    (tmp_path / "h.xml").write_text('<r><recorded-vote><legislator name-id="A" party="D" state="VA">Ann</legislator><vote>Yea</vote></recorded-vote><recorded-vote><legislator party="R" state="TX">Bo</legislator><vote>Nay</vote></recorded-vote></r>')
    (tmp_path / "s.xml").write_text("<r><member><first_name>Cy</first_name><last_name>Lee</last_name><party>D</party><state>VT</state><vote_cast>Yea</vote_cast></member></r>")
    house, senate = files.house_votes(spark, f"{tmp_path}/h.xml"), files.senate_votes(spark, f"{tmp_path}/s.xml")
    assert rows(house) == [("Ann", "D", "VA", "Yea"), ("Bo", "R", "TX", "Nay")] and rows(senate) == [("Cy Lee", "D", "VT", "Yea")]
    assert len(rows(files.first_source(senate, house, ["state"]))) == 3
    assert len(rows(files.first_source(senate, senate.withColumn("vote", F.lit("Nay")), ["state"]))) == 1


def test_archive_of_filings(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "2024FD.zip", "w") as z:
        z.writestr("2024FD.xml", "<F><Member><Last>Lee</Last><FilingType>P</FilingType><FilingDate>7/1/2024</FilingDate><DocID>12</DocID></Member><Member><Last>Kim</Last><FilingType>C</FilingType><FilingDate>1/1/2024</FilingDate><DocID>13</DocID></Member></F>")
        z.writestr("read.me", "no")
    got = files.filings(files.zip_members(spark, f"{tmp_path}/2024FD.zip", ".xml")).collect()
    assert [(r.doc_id, r.last, str(r.filed)) for r in got] == [("12", "Lee", "2024-07-01")]


def test_pages_feeds_stores_and_bodies(spark, tmp_path):
    (tmp_path / "p.txt").write_text("one   two\n\fthree\f  ")
    assert [(r.page, r.text) for r in files.pages(spark, f"{tmp_path}/p.txt").collect()] == [(1, "one   two\n"), (2, "three")]
    (tmp_path / "f.xml").write_text("<rss><channel><item><title> A &amp; B </title><link>http://x/1</link></item><item><title>C</title><link>http://x/2</link></item></channel></rss>")
    assert rows(files.feed_entries(spark, f"{tmp_path}/f.xml")) == [("A & B", "http://x/1"), ("C", "http://x/2")]
    (tmp_path / "stores").mkdir()
    for name, body in {"a": {"meetings": {"m": "x"}}, "b": {"contests": ["c"]}, "side": {"other": 1}}.items():
        (tmp_path / "stores" / f"{name}.json").write_text(json.dumps(body))
    assert sorted(r.kind for r in files.stores(spark, f"{tmp_path}/stores").collect()) == ["elections", "source"]
    body = base64.b64encode(b"hello").decode()
    df = spark.createDataFrame([(body, "text/html"), (body, "application/pdf"), ("%%", "text/plain")], "b string, m string")
    assert [r[0] for r in df.select(files.decoded(F.col("b"), F.col("m"))).collect()] == ["hello", None, None]


def test_four_record_types_and_prices(spark, tmp_path):
    event = {"event_id": "e1", "body": "Council", "date": "2024-01-02", "items": [{"item_id": "i1", "file": "24-1", "title": "t", "flag": 1, "votes": [{"name": "Ann", "value": "Aye"}]}, {"item_id": "i2", "file": "", "flag": 1}, {"item_id": "i3", "file": "24-3", "flag": None, "votes": [{"name": "Bo", "value": "No"}]}]}
    (tmp_path / "e.json").write_text(json.dumps(event))
    got = {k: rows(v) for k, v in files.record_types(spark, f"{tmp_path}/e.json").items()}
    assert got["meetings"] == [("e1", "Council", "2024-01-02")] and len(got["agenda_items"]) == 2
    assert got["vote_events"] == [("i1", "Ann", "aye")] and got["members"] == [("Ann",)]
    (tmp_path / "c.json").write_text(json.dumps({"ticker": "X", "timestamp": [0, 86400], "close": [1.5, None]}))
    assert [(r.ticker, str(r.day), r.close) for r in files.closes(spark, f"{tmp_path}/c.json").collect()] == [("X", "1970-01-01", 1.5)]


def test_logs_and_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "certified"), (2, "quarantined")], "id int, status string")
    for _ in range(2):
        tables.append_log(df, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 4
    tables.export_certified(df, f"{tmp_path}/out", "status")
    assert rows(spark.read.parquet(f"{tmp_path}/out").select("id")) == [(1,)]


@pytest.fixture
def events(spark, tmp_path):
    every = spark.createDataFrame(
        [(i, f"2024-01-{1 + i // 3:02d} {7 * i % 24:02d}:00:00", i % 4, ["view", "click", "purchase", "signup"][i * 7 % 4]) for i in range(60)], "event_id long, ts string, user_id long, event_type string"
    ).select("event_id", F.to_timestamp("ts").alias("ts"), "user_id", "event_type")
    for part in range(3):  # files in the order of time
        every.where((F.col("event_id") >= 20 * part) & (F.col("event_id") < 20 * part + 20)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    return every, jobs.read_events(spark, f"{tmp_path}/events")


def run(spark, stream, tmp_path, mode="append"):
    jobs.start(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", mode)
    return spark.read.parquet(f"{tmp_path}/out")


def test_daily_counts_of_closed_days(spark, events, tmp_path):
    every, stream = events
    got = run(spark, jobs.daily_counts(stream, limit=0), tmp_path)
    batch = every.groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).withColumn("limited", F.lit(True))
    last = got.agg(F.max("day")).first()[0]
    assert rows(got) == rows(batch.where(F.col("day") <= last)) and got.count() > 20


def test_weekly_usage_and_sessions(spark, events, tmp_path):
    every, stream = events
    got = run(spark, jobs.weekly_usage(stream), tmp_path)
    batch = every.groupBy(F.window("ts", "7 days", "1 day").alias("w")).agg(F.count("*").alias("n")).select("w.start", "n")
    assert got.count() > 5 and set(rows(got)) <= set(rows(batch))
    assert set(rows(run(spark, jobs.sessions(stream, "1 day"), tmp_path / "s"))) <= set(rows(every.groupBy("user_id", F.session_window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select("user_id", "w.start", "n")))


def test_each_event_once(spark, events, tmp_path):
    every, stream = events
    every.where("event_id % 5 = 0 AND event_id >= 40").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    assert rows(run(spark, jobs.once_only(stream), tmp_path).select("event_id")) == rows(every.select("event_id"))


def test_transitions_remember_the_last_state(spark, events, tmp_path):
    every, stream = events
    rank = F.create_map(*[x for k, v in jobs.PRIORITY.items() for x in (F.lit(k), F.lit(v))])[F.col("event_type")]
    acted = every.select("event_id", F.col("user_id").alias("bill"), "ts", F.col("event_type").alias("state"), rank.alias("priority"))
    batch = records.transitions(acted, list(jobs.PRIORITY)).where("notify").select("event_id", F.col("bill").alias("user_id"), F.col("before").cast("int"), F.col("priority").alias("now"))
    assert rows(run(spark, jobs.transitions(stream), tmp_path)) == rows(batch)


def test_cooldown_counts_sent_events_alone(spark, events, tmp_path):
    every, stream = events
    got = run(spark, jobs.cooldown(stream, 5 * 86400), tmp_path)
    assert rows(got) == rows(checks.sent_only(every, ["user_id", "event_type"], "ts", 5 * 86400))
    assert {r.blocked for r in got.collect()} == {True, False}


def test_a_batch_with_findings_is_left_out(spark, events, tmp_path):
    every, stream = events
    out = f"{tmp_path}/store"
    merge = lambda batch: batch.write.mode("append").parquet(out)
    jobs.start_batches(stream, jobs.gated(lambda b: b.where("event_id = 25"), merge), f"{tmp_path}/c")
    assert rows(spark.read.parquet(out).select("event_id")) == rows(every.where("event_id < 20 OR event_id >= 40").select("event_id"))
