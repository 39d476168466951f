"""Upserts over stored rows, each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..io import table
from ..registry import query
from ..sinks import tables as s


def _halves(spark, d):
    """A store of customers' orders in one month and what comes in after it, one row a customer on each side."""
    o = table(spark, d, "orders")
    side = lambda n: o.where(F.col("o_orderkey") % 2 == n).groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"), F.min("o_orderstatus").alias("status"))
    return side(0), side(1)


_HALVES = """WITH a AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey, min(o_orderstatus) AS status FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey, min(o_orderstatus) AS status FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)"""


@query("upsert_all", _HALVES + "SELECT o_custkey, coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, coalesce(b.status, a.status) AS status FROM a FULL JOIN b USING (o_custkey)")
def upsert_all(spark, d):
    return s.upsert_all(*_halves(spark, d), ["o_custkey"])


@query("insert_missing", _HALVES + "SELECT * FROM a UNION ALL SELECT * FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a)")
def insert_missing(spark, d):
    return s.insert_missing(*_halves(spark, d), ["o_custkey"], ["o_orderkey"])


@query("upsert_columns", _HALVES + """SELECT o_custkey, coalesce(CASE WHEN b.o_orderkey % 3 <> 0 THEN b.o_orderkey END, a.o_orderkey) AS o_orderkey, CASE WHEN a.status = 'F' OR b.status = 'F' THEN 'F' ELSE coalesce(b.status, a.status) END AS status FROM a FULL JOIN b USING (o_custkey)""")
def upsert_columns(spark, d):
    """One status wins over all others; a new key without a value leaves the old one."""
    old, new = _halves(spark, d)
    new = new.withColumn("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")))
    return s.upsert_columns(old, new, ["o_custkey"], {"o_orderkey": s.keep, "status": s.prefer("F")})


@query("numbered_upsert", _HALVES + """, n AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) AS i FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a)) SELECT o_custkey, coalesce(a.o_orderkey, (SELECT max(o_orderkey) FROM a) + i) AS id FROM a FULL JOIN n USING (o_custkey)""")
def numbered_upsert(spark, d):
    """Known customers keep their id, new ones get the next. The rows of one call are those that one request adds, which are few."""
    old, new = _halves(spark, d)
    return s.numbered(old.select("o_custkey", F.col("o_orderkey").alias("id")), new.select("o_custkey"), ["o_custkey"], "id").select("o_custkey", "id")


@query("prefix_delete", "SELECT c_custkey, c_name FROM customer WHERE NOT starts_with(c_name, 'Customer#00000000')")
def prefix_delete(spark, d):
    return s.without_prefix(table(spark, d, "customer").select("c_custkey", "c_name"), "c_name", "Customer#00000000")


@query("newest_versions", "SELECT o_custkey, o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) = 1")
def newest_versions(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_orderdate")
    return s.newest_versions(o, ["o_custkey", "o_orderstatus"], [F.desc("o_orderdate"), "o_orderkey"]).drop("o_orderdate")


@query("merged_children", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey % 2 = 0 OR (l_orderkey % 3 = 0 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0))")
def merged_children(spark, d):
    """The children of the store and of those incoming records that it doesn't have; all other children stay out."""
    o, lines = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    _, children = s.merge_children(o.where("o_orderkey % 2 = 0"), lines.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0"), lines, "o_orderkey")
    return children.withColumnRenamed("o_orderkey", "l_orderkey")


@query("slim_rows", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS kind FROM orders WHERE o_orderkey % 5 <> 0")
def slim_rows(spark, d):
    o = table(spark, d, "orders").withColumn("kind", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")))
    return s.slim(o, ["o_orderkey", "kind"], ["kind"])


@query("section_lines", """SELECT '{"section":"order","data":{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}}' AS "value" FROM orders""")
def section_lines(spark, d):
    return s.sections(table(spark, d, "orders"), "order", "o_orderkey", "o_orderstatus")
