"""Minutes read line by line: attendance, items, votes with their names, results.

A line is a roll call's heading, an item's first line, a position with its count and names, or text. What a line
belongs to is what stands last above it: the item, whether a roll call is open, the position whose names go on in
lines that hold nothing but names. All of that carries forward in one window over a document's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The lines of the minutes, and the words of titles that are no names.
ROLL = r"^\s*ROLL CALL\s*$"
ITEM = r"^\s+(\d{4}-\d{4})\s+\S"
LABEL = r"^\s*(Aye|No|Abstain|Absent|Present|Recused):?\s+(\d+)(?:\s*-\s*(.*))?$"
ENACTMENT = r"Enactment No:\s*(\S+)"
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
CARRIED, FAILED = "The motion carried", "The motion failed"
TITLES = ["Council", "Member", "President"]
COVER = 40


def names(text: Column) -> Column:
    """The names of a list, without titles, which a line's end may have cut in two."""
    parts = F.transform(F.split(text, r",|\band\b"), lambda p: F.array_join(F.filter(F.split(p, r"\s+"), lambda t: (t != "") & ~t.isin(TITLES)), " "))
    return F.filter(parts, lambda p: p != "")


def only_names(line: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(line, r"Council\s+(Member|President)", ""), r"\band\b|,", " ")
    return bare.rlike(r"^\s*[A-Z][A-Za-z.'\-]*(?:\s+[A-Z][A-Za-z.'\-]*)*\s*$")


def read_lines(documents: DataFrame, key: str, text: str, furniture: list[str]) -> DataFrame:
    """Every line of text but page furniture, with what it is and what it belongs to. key has to tell documents apart; a null
    document has no lines. entry: the item's number down the document, 0 before the first."""
    line = F.regexp_replace("line", "\f", "")
    rows = documents.select(key, F.posexplode_outer(F.split(F.col(text), "\r\n|\n")).alias("place", "line")).where("line is not null").select(key, "place", line.alias("line"))
    for pattern in furniture:
        rows = rows.where(~F.col("line").rlike(pattern))
    rows = rows.select(key, "place", "line", F.regexp_extract("line", ITEM, 1).alias("number"), F.lower(F.regexp_extract("line", LABEL, 1)).alias("label"))
    kind = F.when(F.col("line").rlike(ROLL), "roll").when(F.col("number") != "", "item").when(F.col("label") != "", "label").when(only_names(F.col("line")), "names").otherwise("text")
    down = Window.partitionBy(key).orderBy("place")
    rows = rows.select(key, "place", "line", kind.alias("kind"), "number", "label")
    rows = rows.withColumn("nth", F.row_number().over(down)).withColumn("entry", F.count_if(F.col("kind") == "item").over(down).cast("int"))
    rows = rows.withColumn("item", F.last(F.when(F.col("kind") == "item", F.col("number")), True).over(down))
    rows = rows.withColumn("in_roll", F.coalesce(F.last(F.when(F.col("kind") == "roll", True).when(F.col("kind") == "item", False), True).over(down), F.lit(False)))
    applies = (F.col("kind") == "label") & F.when(F.col("in_roll"), F.col("label").isin("present", "absent")).otherwise(F.col("entry") > 0)
    open_at = F.when(applies, F.col("place")).when(F.col("kind").isin("item", "text"), -1)
    return rows.withColumn("applies", applies).withColumn("open", F.coalesce(F.last(open_at, True).over(down), F.lit(-1)))


def positions(lines: DataFrame, key: str) -> DataFrame:
    """key, entry (0: the roll call), item, position, count, members: of a position that stands twice in one entry, the later one."""
    listed = lines.where(F.col("applies") | (F.col("kind") == "names") & (F.col("open") >= 0))
    text = F.when(F.col("applies"), F.regexp_extract("line", LABEL, 3)).otherwise(F.col("line"))
    own = lambda c: F.max(F.when(F.col("applies"), F.col(c)))
    scope = F.when(F.col("in_roll"), 0).otherwise(F.col("entry"))
    parts = F.array_sort(F.collect_list(F.struct("place", names(text).alias("names"))))
    lists = listed.groupBy(key, "open").agg(
        F.max(F.when(F.col("applies"), scope)).alias("entry"), F.max(F.when(F.col("applies") & ~F.col("in_roll"), F.col("item"))).alias("item"), own("label").alias("position"),
        F.max(F.when(F.col("applies"), F.regexp_extract("line", LABEL, 2).try_cast("int"))).alias("count"), F.flatten(F.transform(parts, lambda p: p["names"])).alias("members"),
    )
    return lists.groupBy(key, "entry", "position").agg(F.max_by(F.struct("item", "count", "members"), "open").alias("v")).select(key, "entry", "v.item", "position", "v.count", "v.members")


def _said() -> list[Column]:
    """The item, result and enactment of a group of lines."""
    free = F.col("kind").isin("text", "names") & ~((F.col("kind") == "names") & (F.col("open") >= 0))
    result = F.when(free & F.col("line").contains(CARRIED), "pass").when(free & F.col("line").contains(FAILED), "fail")
    enactment = F.when(free, F.nullif(F.regexp_extract("line", ENACTMENT, 1), F.lit("")))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("place")))
    return [F.first("item").alias("item"), last(result).alias("result"), last(enactment).alias("enactment")]


def outcomes(lines: DataFrame, key: str) -> DataFrame:
    """key, entry, item, result, enactment of every entry; what its last line of text says of either counts."""
    return lines.where("entry > 0").groupBy(key, "entry").agg(*_said())


def dated_outcomes(lines: DataFrame, key: str) -> DataFrame:
    """outcomes with the date of each document, which has to have a key, in one reading of its lines."""
    date = _date()
    found = lines.where(F.col(key).isNotNull()).groupBy(key, "entry").agg(*_said(), F.min(F.when(date.isNotNull(), F.struct("place", date.alias("date")))).alias("first"))
    return found.withColumn("date", F.min("first").over(Window.partitionBy(key))["date"]).where("entry > 0").drop("first")


def _date() -> Column:
    parts = [F.regexp_extract("line", rf"({'|'.join(MONTHS)})\s+(\d{{1,2}}),\s+(\d{{4}})", i) for i in (1, 2, 3)]
    month = F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), parts[0]).cast("string"), 2, "0")
    return F.when((F.col("nth") <= COVER) & (parts[0] != ""), F.concat_ws("-", parts[2], month, F.lpad(parts[1], 2, "0")))


def dates(lines: DataFrame, key: str) -> DataFrame:
    """key, date (ISO) of every document: the first date on its first lines, or null."""
    date = _date()
    return lines.groupBy(key).agg(F.min_by(date, F.when(date.isNotNull(), F.col("place"))).alias("date"))
