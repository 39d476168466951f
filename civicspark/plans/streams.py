"""Streams run over files that Spark writes from the tables, until all is read; their SQL is the batch rule.

Each query writes its source to the shared folder in several files, some rows out of order, runs the stream with
restarts where it says so, and returns what the sink holds. Rows far ahead at the end let the last timers go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..io import shared_dir, table
from ..registry import query
from ..sources import log_tail
from ..streaming import jobs, ledger, stateful
from .checks import _COOLDOWN

_EVENTS = "event_id long, ts timestamp, user_id long, event_type string, title string, asked string, results long"
#: Days by which rows come out of order, and files that the source has; states that the keys of a stream share.
_OFF, _FILES, _BUCKETS = 1, 2, 512


def _fed(spark: SparkSession, d: str, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream gives of all events: dealt to files by their time, each hour's by another day's delay."""
    root = shared_dir(spark, "stream")
    kind = F.col("event_type")
    events = table(spark, d, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.when(kind.isin("signup", "purchase"), F.concat_ws(" ", kind, "event_id")).alias("title"),
        F.concat(kind, (F.col("user_id") % 50).cast("string")).alias("asked"), F.when(F.col("event_id") % 3 > 0, F.get_json_object("props", "$.k").cast("long")).alias("results"),
    )
    came = F.unix_seconds("ts") + F.hour("ts") % 2 * 43_200 * _OFF
    first, last = events.agg(F.min(came), F.max(came)).first()
    step = max(1, (last - first) // _FILES + 1) if first is not None else 1
    dealt = events.withColumn("part", F.coalesce(F.floor((came - F.lit(first)) / step), F.lit(0)))
    schema = spark.createDataFrame([], _EVENTS).schema

    def go() -> None:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(f"{root}/in")
        with stateful.timers(spark):
            jobs.start(job(source), f"{root}/out", f"{root}/checkpoint")

    for part in range(_FILES):
        dealt.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{root}/in")
        go()  # each time a new query, which goes on from the checkpoint
    for days in (1000, 2000):
        ahead = events.agg(F.max("ts").alias("ts")).where("ts is not null").select(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.make_dt_interval(F.lit(days))).alias("ts"), F.lit(-1).cast("long").alias("user_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("event_type", "string"), ("title", "string"), ("asked", "string"), ("results", "long"))])
        ahead.write.mode("append").parquet(f"{root}/in")
        go()
    return spark.read.parquet(f"{root}/out")


@query("stream_cooldown", _COOLDOWN.format(days=3))
def stream_cooldown(spark, d):
    return _fed(spark, d, lambda s: stateful.cooldown(s, 3 * 86400, "2 days", _BUCKETS)).where("event_id >= 0")


@query("stream_transitions", """WITH a AS (SELECT event_id, user_id, epoch_us(ts) AS t, CASE event_type WHEN 'purchase' THEN 4 WHEN 'signup' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS now FROM events),
    b AS (SELECT *, lag(now) OVER w AS held, lag(t) OVER w AS was FROM a WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    c AS (SELECT event_id, user_id, CASE WHEN t // 1000 - was // 1000 <= 10 * 86400000 THEN held ELSE 0 END AS before, now FROM b)
    SELECT event_id, user_id, CAST(before AS INTEGER) AS before, CAST(now AS INTEGER) AS now FROM c WHERE now > before""")
def stream_transitions(spark, d):
    """States that a user's events raise; a state is forgotten ten days after the user's last event."""
    return _fed(spark, d, lambda s: stateful.transitions(s, 10, "2 days", _BUCKETS)).where("event_id >= 0")


@query("stream_title_segments", """WITH e AS (SELECT event_id, user_id, ts, epoch_us(ts) AS t, CASE WHEN event_type IN ('signup', 'purchase') THEN event_type || ' ' || event_id END AS title FROM events),
    g AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t // 1000 - lag(t) OVER w // 1000 > 5 * 86400000 THEN 1 ELSE 0 END AS pause FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    s AS (SELECT *, sum(pause + CASE WHEN title IS NOT NULL AND pause = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM g)
    SELECT user_id, max(title) AS title, min(ts) AS start, max(ts) AS stop, count(*) AS n FROM s GROUP BY user_id, segment HAVING max(title) IS NOT NULL""")
def stream_title_segments(spark, d):
    """Runs of a user's events from one with a title to the next, or to a pause of five days."""
    return _fed(spark, d, lambda s: stateful.title_segments(s, 5 * 86400, "2 days", _BUCKETS)).where("user_id >= 0")


@query("stream_cache_hits", """WITH RECURSIVE e AS (SELECT event_id, event_type || CAST(user_id % 50 AS VARCHAR) AS asked, epoch_us(ts) AS t, CASE WHEN event_id % 3 > 0 AND CAST(json_extract_string(props, '$.k') AS BIGINT) <> 0 THEN 48 ELSE 2 END AS hours FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY t, event_id) AS i FROM e),
    r AS (SELECT event_id, asked, i, t + hours * 3600000000 AS ends, false AS hit FROM o WHERE i = 1
        UNION ALL SELECT o.event_id, o.asked, o.i, CASE WHEN o.t < r.ends THEN r.ends ELSE o.t + o.hours * 3600000000 END, o.t < r.ends FROM r JOIN o ON o.asked = r.asked AND o.i = r.i + 1)
    SELECT event_id, hit FROM r""")
def stream_cache_hits(spark, d):
    """Requests that an answer was held for: two days, or two hours where it was empty."""
    return _fed(spark, d, lambda s: stateful.cache_hits(s, 2 * 3600, 48 * 3600, "2 days", _BUCKETS)).where("event_id >= 0")


@query("stream_log_tail", """SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1""")
def stream_log_tail(spark, d):
    """Orders written to logs of JSON lines and read as they grow, with a restart between."""
    root = shared_dir(spark, "log")
    log_tail.register(spark)
    lines = table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct("o_orderkey", "o_orderstatus")).alias("value"))
    for half in (0, 1):
        lines.where(F.col("o_orderkey") % 2 == half).select("value").write.mode("append").text(f"{root}/in")
        jobs.start(spark.readStream.format("log_tail").load(f"{root}/in"), f"{root}/out", f"{root}/checkpoint")
    row = F.from_json("line", "o_orderkey long, o_orderstatus string")
    read = spark.read.parquet(f"{root}/out").select(row.alias("r"))
    return read.groupBy(F.col("r.o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum("r.o_orderkey").alias("keys"))


@query("stream_gated_ledger", """WITH y AS (SELECT year(o_orderdate) AS y, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, max(o_orderkey) % 3 = 0 AS bad FROM orders GROUP BY 1) SELECT CAST(y AS INTEGER) AS y, n, keys FROM y WHERE NOT bad""")
def stream_gated_ledger(spark, d):
    """Orders that come year by year, are gated as batches and sent twice: what counts is each clean year once."""
    root = shared_dir(spark, "gated")
    orders = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    gate = ledger.once(f"{root}/store", lambda b: b.agg(F.max("o_orderkey").alias("last")).where("last % 3 = 0"))
    for again in (0, 1):
        # a file for each year in one pass; a file is a batch
        orders.withColumn("came", F.col("y")).repartition("came").write.partitionBy("came").parquet(f"{root}/in{again}")
        stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{root}/in{again}")
        jobs.start_batches(stream, gate, f"{root}/checkpoint")
    return ledger.merged(spark, f"{root}/store", "o_orderkey long, y int").groupBy("y").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
