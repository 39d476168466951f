"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Spark's own setting: the shuffle files of a statement go when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share (spark.checkpoint.dir, else the one set with setCheckpointDir).

    A session without one gets an error: a folder of one machine can't stand in for it. What a query leaves there is cleared
    by whoever clears the session's checkpoints.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors.

    What the write shuffled isn't kept beside what it wrote.
    """
    spark = df.sparkSession
    path, before = shared_dir(spark, name), spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(text: str | Column = "text") -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.cast("binary"), F.lit(b""))


def word_pieces(text: bytes, table: bytes, step: int = 8 << 20) -> Iterator[list[bytes]]:
    """The words of a text in pieces of about step bytes, one at least. table: 256 bytes, in which what parts words is a space."""
    text = text.translate(table)
    at = 0
    while at < len(text) or not at:
        end = text.find(b" ", at + step) if len(text) - at > step else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = max(end, 1)


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text falls on this remainder; a null id never does."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in zip(schema, (columns[f.name] for f in schema), strict=True)], schema=schema)


def gapless_rank(df: DataFrame, group: str, order: list[str], rank: str, rows: int, cell_rows: int = 4096) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps, a hot group over many tasks.

    Rows fall into cells by the hash of the order columns; a bounded table of counts by group and
    cell gives each cell its first number, and a window numbers the rows inside the cell.
    """
    cells = max(1, rows // cell_rows)
    celled = df.withColumn("__cell", F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    counts = celled.groupBy(F.col(group).alias("__g"), F.col("__cell").alias("__c")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__g").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("__g", "__c", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy(group, "__cell").orderBy(*order)
    numbered = celled.withColumn("__i", F.row_number().over(inside) - 1)
    return (
        numbered.join(firsts, (F.col(group) == F.col("__g")) & (F.col("__cell") == F.col("__c")))
        .withColumn(rank, F.col("__first") + F.col("__i"))
        .drop("__cell", "__g", "__c", "__first", "__i")
    )
