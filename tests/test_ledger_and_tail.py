"""The ledger of batches under kills and replays, the daily job, and the tail of growing logs over restarts."""

import pytest
from pyspark.sql import functions as F

from civicspark.sources import log_tail
from civicspark.streaming import jobs, ledger

SCHEMA = "id long, v string"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_batches_count_once(spark, tmp_path):
    path = f"{tmp_path}/store"
    batch = lambda *ids: spark.createDataFrame([(i, f"v{i}") for i in ids], SCHEMA)
    run = ledger.once(path, lambda b: b.where("id < 0"))
    run(batch(1, 2), 0)
    run(batch(2, 1), 0)  # the same batch again, in another order
    run(batch(3, -1), 1)
    run(batch(1, 2), 2)  # the same rows under another number
    run(batch(1, 2, 2), 3)
    run(batch(), 4)
    assert rows(ledger.merged(spark, path, SCHEMA).select("id", "batch")) == [(1, 0), (1, 3), (2, 0), (2, 3), (2, 3)]
    assert [(r.batch, r.status) for r in ledger.lines(spark, path).orderBy("batch").collect()] == [(0, "merged"), (1, "held back"), (2, "repeated"), (3, "merged")]
    with pytest.raises(ValueError, match="other rows"):
        run(batch(9), 0)


def test_a_batch_lost_before_its_line_is_written_anew(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/store"
    one = spark.createDataFrame([(1, "a"), (2, None)], SCHEMA)
    spark.createDataFrame([(7, "half")], SCHEMA).write.parquet(f"{path}/data/batch=0")  # what a lost driver left
    assert rows(ledger.merged(spark, path, SCHEMA)) == []
    ledger.once(path)(one, 0)
    assert sorted(r.id for r in ledger.merged(spark, path, SCHEMA).collect()) == [1, 2]
    assert ledger.digest(one) != ledger.digest(spark.createDataFrame([(1, "a"), (2, "")], SCHEMA))


def test_a_stream_that_is_killed_and_replayed_merges_once(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"{tmp_path}/store"
    for part in range(4):
        spark.range(10 * part, 10 * part + 10).select("id", F.concat(F.lit("v"), "id").alias("v")).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    good = ledger.once(path)

    def dies(batch, number):
        good(batch, number)
        if number == 1:
            raise RuntimeError("lost after the line was written, before the checkpoint has it")

    with pytest.raises(Exception, match="lost after"):
        jobs.start_batches(stream(), dies, f"{tmp_path}/c")
    jobs.start_batches(stream(), good, f"{tmp_path}/c")
    jobs.start_batches(stream(), good, f"{tmp_path}/other")  # the whole source again, from another checkpoint
    assert sorted(r.id for r in ledger.merged(spark, path, SCHEMA).collect()) == list(range(40))


def test_a_day_runs_once(spark, tmp_path):
    ran = []

    def job(day):
        if day == "2024-01-02" and len(ran) == 1:
            ran.append("failed")
            raise RuntimeError("no source")
        ran.append(day)

    assert ledger.daily(spark, f"{tmp_path}/d", "2024-01-01", job) and not ledger.daily(spark, f"{tmp_path}/d", "2024-01-01", job)
    with pytest.raises(RuntimeError):
        ledger.daily(spark, f"{tmp_path}/d", "2024-01-02", job)
    assert ledger.daily(spark, f"{tmp_path}/d", "2024-01-02", job)
    assert ran == ["2024-01-01", "failed", "2024-01-02"]


def test_a_log_is_read_line_by_line_over_restarts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log_tail, "STEP", 20)
    log_tail.register(spark)
    folder = tmp_path / "logs"
    folder.mkdir()
    out, c = f"{tmp_path}/out", f"{tmp_path}/c"
    go = lambda: jobs.start(spark.readStream.format("log_tail").load(str(folder)), out, c)
    (folder / "a.log").write_bytes(b'{"n": 1}\n{"n": 2}\r\n\n{"n": 3')
    go()
    with (folder / "a.log").open("ab") as f:
        f.write("0, \"s\": \"é\"}\n".encode() + b"x" * 100 + b"\nend")
    (folder / "b.log").write_bytes(b"only\n")
    (folder / "_hidden").write_bytes(b"no\n")
    go()
    go()
    got = [(r.file.rsplit("/", 1)[-1], r.line) for r in sorted(spark.read.parquet(out).collect())]
    assert got == [("a.log", '{"n": 1}'), ("a.log", '{"n": 2}'), ("a.log", ""), ("a.log", '{"n": 30, "s": "é"}'), ("a.log", "x" * 100), ("b.log", "only")]
    (folder / "a.log").write_bytes(b"new\n")
    go()
    assert sorted(r.line for r in spark.read.parquet(out).where("at = 0 AND file LIKE '%a.log'").collect()) == ["new", '{"n": 1}']
