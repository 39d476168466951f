"""Batches that count once: each micro-batch is stored under its own number, and a ledger says which numbers count.

The data of a batch is written first, its line in the ledger last; readers take only batches that the ledger has as
merged. A batch that is run again, as after a lost driver, finds its line and does nothing, or, if it was lost before
its line, overwrites what it had begun. The same rows sent again under another number are known by their digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "batch long, digest string, n long, status string, note string"
MERGED, HELD_BACK, REPEATED = "merged", "held back", "repeated"


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The ledger: a line for each batch that was decided."""
    return spark.read.schema(LINE).json(f"{path}/ledger/*") if _there(spark, f"{path}/ledger") else spark.createDataFrame([], LINE)


def merged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches that count, with their batch. schema: of the rows, as DDL."""
    if not _there(spark, f"{path}/data"):
        return spark.createDataFrame([], f"{schema}, batch long")
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", f"{path}/data").parquet(f"{path}/data")
    return rows.join(lines(spark, path).where(F.col("status") == MERGED).select("batch"), "batch", "left_semi")


def digest(rows: DataFrame) -> tuple[str, int]:
    """The same for the same rows in whatever order, repeats counted; and how many there are."""
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    halves = [F.sum(F.conv(F.substring(F.sha2(row, 256), at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 16)]
    a, b, n = rows.agg(*halves, F.count("*")).first()
    return f"{a or 0}-{b or 0}-{n}", n


def once(path: str, check: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls. check: gives the findings of a batch; a batch with findings is held back whole."""

    def write(batch: DataFrame, number: int, line: tuple) -> None:
        batch.sparkSession.createDataFrame([line], LINE).coalesce(1).write.mode("overwrite").json(f"{path}/ledger/batch={number}")

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = batch.repartition(spark.sparkContext.defaultParallelism).persist()  # a file would be one task's
        known, n = digest(kept)
        before = lines(spark, path).where((F.col("batch") == number) | (F.col("digest") == known) & (F.col("status") == MERGED)).collect()  # one line of that number, and one of that digest
        mine = [r for r in before if r.batch == number]
        if mine and mine[0].digest != known:
            raise ValueError(f"batch {number} was decided with other rows")
        if not mine and n:
            found = check(kept).take(1) if check else []
            if before:
                write(kept, number, (number, known, n, REPEATED, f"as batch {before[0].batch}"))
            elif found:
                write(kept, number, (number, known, n, HELD_BACK, str(found[0].asDict())))
            else:
                kept.write.mode("overwrite").parquet(f"{path}/data/batch={number}")
                write(kept, number, (number, known, n, MERGED, ""))
        kept.unpersist()

    return run


def daily(spark: SparkSession, path: str, day: str, job: Callable[[str], None]) -> bool:
    """Runs a job once for a day; the next call of that day does nothing. A day that was missed is run when it is asked for,
    as the first call after it should do; whether it ran. The day's line is written after the job, so a job that failed runs again."""
    if _there(spark, f"{path}/days/day={day}/_SUCCESS"):
        return False
    job(day)
    spark.createDataFrame([(day,)], "ran string").coalesce(1).write.mode("overwrite").json(f"{path}/days/day={day}")
    return True
