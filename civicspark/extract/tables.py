"""Tables of projects in laid-out text.

A line is a row of headings (three fiscal years at least), a section's name, furniture, or else it is read by
the last headings above it: each number belongs to the heading whose end its own end stands nearest to, if
that is at most max(least, half the smallest gap between headings) away. Numbers make a line a source of
funds, or a project's total; a line without numbers of a column is a title or goes on with one. A project ends
with its total, with a section's name, or where the next title begins.

Lines of a document meet in one window by their place; what carries forward (headings, section) is the last
one above, so that no line is read twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headings of fiscal years and totals; numbers.
YEAR, TOTAL, NUMBER = r"(?i)FY\s?(\d{4})(?!\d)", r"(?i)total", r"\(?\$?\d[\d,]*\)?"


@dataclass(frozen=True)
class Layout:
    """sections: names that stand alone in a line; furniture: lines that say nothing; least: of the distance to a heading."""

    sections: tuple[str, ...]
    furniture: str = r"^Page \d+$|\(\$000"
    least: int = 6
    alone: int = 10
    years: int = 3


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def spans(line: Column, pattern: str) -> Column:
    """text and end (characters up to its last) of every match. Each regular expression runs once a line."""
    both = F.arrays_zip(F.split(line, pattern).alias("before"), F.regexp_extract_all(line, F.lit(pattern), F.lit(0)).alias("text"))

    # Lines have few matches; an array that grew match by match would be copied as often.
    until = lambda b, i: F.aggregate(F.slice(b, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x["before"]) + F.length(x["text"]))
    return _with(both, lambda b: F.transform(F.filter(b, lambda x: x["text"].isNotNull()), lambda x, i: F.struct(x["text"].alias("text"), until(b, i + 1).alias("end"))))


def headings(line: Column, how: Layout) -> Column:
    """columns (name, end) and reach of a row of headings, null of other lines: its fiscal years, and the last total; how far a number may stand from one."""
    fy = F.transform(spans(line, YEAR), lambda h: F.struct(F.concat(F.lit("FY"), F.regexp_extract(h["text"], r"(\d{4})", 1)).alias("name"), h["end"].alias("end")))
    total = F.transform(F.slice(F.reverse(spans(line, TOTAL)), 1, 1), lambda h: F.struct(F.lit("Total").alias("name"), h["end"].alias("end")))

    def reach(ends: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(1), F.size(ends) - 1), lambda i: F.get(ends, i) - F.get(ends, i - 1))
        return F.when(F.size(ends) > 1, F.greatest(F.lit(how.least), F.floor(F.array_min(gaps) / 2).cast("int"))).otherwise(how.alone)

    heads = _with(F.concat(fy, total), lambda columns: F.struct(columns.alias("columns"), _with(F.array_sort(F.transform(columns, lambda c: c["end"])), reach).alias("reach")))
    return F.when(line.rlike(YEAR) & (F.size(F.regexp_extract_all(line, F.lit(YEAR), F.lit(0))) >= how.years), heads)


def placed(line: Column, heads: Column) -> Column:
    """name, amount and start of the numbers of a line that stand below a heading."""

    def near(s: Column) -> Column:
        # gap, whether it is the total, and place of the nearest heading, in one number each: structs would be compared field by field.
        each = F.transform(heads["columns"], lambda c, i: (F.abs(c["end"] - s["end"]).cast("long") * 2 + (c["name"] == "Total").cast("long")) * 65536 + i)
        return F.array_min(each)

    numbers = F.transform(spans(line, NUMBER), lambda s: F.struct(near(s).alias("at"), s.alias("s")))
    fits = F.filter(numbers, lambda x: x["at"] < (heads["reach"].cast("long") + 1) * 131072)
    value = lambda x: F.regexp_replace(x["s"]["text"], r"\D", "").cast("long")
    return F.transform(fits, lambda x: F.struct(F.get(heads["columns"], (x["at"] % 65536).cast("int"))["name"].alias("name"), value(x).alias("amount"), (x["s"]["end"] - F.length(x["s"]["text"])).alias("start")))


def projects(documents: DataFrame, key: str, text: str, how: Layout) -> DataFrame:
    """key, project (1, 2 ... down the document), section, title, funds (array), amounts (map of year to sum), printed (the total
    that stands there, or null) of every project with funds, an amount or a total.

    Lines above the first headings say nothing but sections. A project without a title has the first fund's name. A null
    document has no projects; key has to tell documents apart.
    """
    lines = documents.select(key, F.posexplode_outer(F.split(F.regexp_replace(F.col(text), "\f", ""), "\n")).alias("place", "line")).where(F.trim("line") != "")
    down = Window.partitionBy(key).orderBy("place")
    name = F.trim(F.regexp_replace(F.trim("line"), r"\s+", " "))
    lines = lines.withColumn("section", F.when(name.isin(*how.sections), name)).withColumn("heads", F.when(F.col("section").isNull(), headings(F.col("line"), how)))
    plain = F.col("section").isNull() & F.col("heads").isNull()
    lines = lines.withColumn("columns", F.last("heads", True).over(down)).withColumn("of", F.last("section", True).over(down))
    lines = lines.where("heads is null").where(~plain | (F.col("columns").isNotNull() & ~F.trim("line").rlike(how.furniture)))
    lines = lines.withColumn("numbers", F.when(plain, placed(F.col("line"), F.col("columns"))))
    first = F.array_min(F.transform("numbers", lambda n: n["start"]))
    lines = lines.withColumn("label", F.when(F.size("numbers") > 0, F.trim(F.substring(F.col("line"), F.lit(1), first))).otherwise(F.trim("line")))
    kind = F.when(F.col("section").isNotNull(), "section").when(F.size("numbers") == 0, "text").when(F.col("label").rlike(TOTAL), "total").otherwise("fund")
    lines = lines.withColumn("kind", kind).withColumn("prior", F.coalesce(F.lag("kind").over(down), F.lit("section")))
    closed = F.col("prior").isin("section", "total")
    begins = (F.col("kind") == "text") & (F.col("prior") != "text") | (F.col("kind") == "fund") & closed
    lines = lines.withColumn("begins", begins).withColumn("project", F.count_if("begins").over(down).cast("int"))
    lines = lines.where((F.col("kind") != "section") & ~((F.col("kind") == "total") & closed) & (F.col("project") > 0))

    named = (F.col("kind") == "text") & (F.col("begins") | ((F.length("label") <= 90) & ~F.col("label").endswith("."))) | (F.col("kind") == "fund") & F.col("begins")
    is_fund = (F.col("kind") == "fund") & (F.col("label") != "") & ~F.col("label").rlike(r"^\d") & (F.length("label") < 80)
    in_order = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("place", "label")))), lambda x: x["label"])
    total = F.get(F.filter("numbers", lambda n: n["name"] == "Total"), F.lit(0))["amount"]
    # A project's lines meet once: a second branch for its amounts would read every document again.
    dated = F.flatten(F.collect_list(F.when(F.col("kind") == "fund", F.filter("numbers", lambda n: n["name"] != "Total"))))
    whole = lines.groupBy(key, "project").agg(F.first("of").alias("section"), F.array_join(in_order(named), " ").alias("title"), F.array_distinct(in_order(is_fund)).alias("funds"), F.max(F.when(F.col("kind") == "total", total)).alias("printed"), F.count_if(F.col("kind") == "total").alias("totals"), dated.alias("dated"))
    year = lambda y: F.struct(y.alias("year"), F.aggregate("dated", F.lit(0).cast("long"), lambda a, n: F.when(n["name"] == y, a + n["amount"]).otherwise(a)).alias("amount"))
    amounts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(F.transform("dated", lambda n: n["name"]))), year))
    return whole.where("size(dated) > 0 or size(funds) > 0 or totals > 0").select(key, "project", "section", "title", "funds", amounts.alias("amounts"), "printed")
