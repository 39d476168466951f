"""Readers: each takes a path and gives rows, with Spark's own sources wherever there is one."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_map(spark: SparkSession, path: str, field: str, value: str, skip: list[str] | None = None) -> DataFrame:
    """key and the value's fields for each entry of a map in JSON documents; keys to be skipped hold metadata."""
    rows = spark.read.schema(f"`{field}` map<string,{value}>").json(path, multiLine=True)
    entries = rows.select(F.explode(field).alias("key", "value"))
    return entries.where(~F.col("key").isin(skip or [])).select("key", "value.*")


def holdings(spark: SparkSession, path: str) -> DataFrame:
    """member, ticker, asset, date, amount of every trade in documents of members with lists of trades."""
    trade = "struct<ticker:string,asset:string,date:string,amount:bigint>"
    members = spark.read.schema(f"members array<struct<name:string,trades:array<{trade}>>>").json(path, multiLine=True)
    rows = members.select(F.explode("members").alias("m")).select(F.col("m.name").alias("member"), F.explode("m.trades").alias("t"))
    return rows.select("member", "t.*")


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV files with a header; columns are found by their names, bytes that are no UTF-8 become the replacement sign."""
    named = spark.read.csv(path, header=True, encoding="UTF-8", mode="PERMISSIVE", multiLine=True)
    names = spark.createDataFrame([], schema).schema
    return named.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in names])


def house_votes(spark: SparkSession, path: str) -> DataFrame:
    """member, party, state, vote of the rows of House roll calls."""
    legislator = "struct<_VALUE:string,`_name-id`:string,_party:string,_state:string>"
    rows = spark.read.schema(f"legislator {legislator}, vote string").xml(path, rowTag="recorded-vote")
    return rows.select(F.col("legislator._VALUE").alias("member"), F.col("legislator._party").alias("party"), F.col("legislator._state").alias("state"), "vote")


def senate_votes(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("first_name string, last_name string, party string, state string, vote_cast string").xml(path, rowTag="member")
    return rows.select(F.concat_ws(" ", "first_name", "last_name").alias("member"), "party", "state", F.col("vote_cast").alias("vote"))


def first_source(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """All rows of the first source, and those of the second for keys that the first has nothing for."""
    return first.unionByName(second.join(first.select(*key).distinct(), key, "left_anti"))


def zip_members(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """path, name, text of the members of ZIP archives whose name ends so. An archive is read whole by one task, as its index stands at its end."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if name.lower().endswith(suffix):
                            yield pd.DataFrame({"path": [where], "name": [name], "text": [z.read(name).decode("utf-8", "replace")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, name string, text string")


def filings(members: DataFrame) -> DataFrame:
    """doc_id, last, filed of the filings with a document (type P) in index files of an archive."""
    entry = "struct<Member:array<struct<Last:string,FilingType:string,FilingDate:string,DocID:string>>>"
    rows = members.select(F.explode(F.from_xml("text", entry)["Member"]).alias("m")).select("m.*")
    return rows.where((F.col("FilingType") == "P") & (F.col("DocID") != "")).select(F.col("DocID").alias("doc_id"), F.col("Last").alias("last"), F.try_to_date("FilingDate", "M/d/yyyy").alias("filed"))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """path, page (from 1), text of the pages of laid-out text files: a form feed ends a page, columns stay where they are."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    cut = files.select("path", F.posexplode(F.split("value", "\f")).alias("i", "text"))
    return cut.select("path", (F.col("i") + 1).alias("page"), "text").where("trim(text) <> ''")


def feed_entries(spark: SparkSession, path: str) -> DataFrame:
    """title, link of the items of RSS files."""
    rows = spark.read.schema("title string, link string").xml(path, rowTag="item")
    return rows.select(F.trim("title").alias("title"), F.trim("link").alias("link"))


def stores(spark: SparkSession, path: str) -> DataFrame:
    """path, kind of the store documents of a folder, told by their shape; other files beside them are left out."""
    rows = spark.read.schema("meetings map<string,string>, capital_projects array<string>, contests array<string>").json(path, multiLine=True)
    kind = F.when(F.col("meetings").isNotNull(), "source").when(F.col("capital_projects").isNotNull(), "capital_projects").when(F.col("contests").isNotNull(), "elections")
    return rows.select(F.input_file_name().alias("path"), kind.alias("kind")).where("kind is not null")


def decoded(body: Column, mime: Column) -> Column:
    """The text of a base64 body of text or HTML; null for other kinds."""
    return F.when(mime.rlike("(?i)^text/(plain|html)"), F.try_to_binary(body, F.lit("base64")).cast("string"))


def record_types(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Meetings, items, votes and members of documents of events: items need a file number, votes a flag and positions."""
    vote = "array<struct<name:string,value:string>>"
    item = f"struct<item_id:string,file:string,title:string,flag:int,votes:{vote}>"
    events = spark.read.schema(f"event_id string, body string, date string, items array<{item}>").json(path)
    items = events.select("event_id", F.explode("items").alias("i")).where(F.col("i.file") != "").select(F.col("event_id").alias("meeting_id"), "i.*")
    votes = items.where(F.col("flag").isNotNull() & (F.size("votes") > 0))
    positions = votes.select(F.col("item_id").alias("vote_id"), F.explode("votes").alias("v")).select("vote_id", F.col("v.name").alias("member"), F.lower("v.value").alias("position"))
    return {
        "meetings": events.select(F.col("event_id").alias("meeting_id"), "body", "date"), "agenda_items": items.select("item_id", "meeting_id", F.col("file").alias("file_number"), "title"),
        "vote_events": positions, "members": positions.select(F.col("member").alias("name")).distinct(),
    }


def closes(spark: SparkSession, path: str) -> DataFrame:
    """ticker, day, close of price documents; points without a price go."""
    rows = spark.read.schema("ticker string, timestamp array<bigint>, close array<double>").json(path)
    points = rows.select("ticker", F.explode(F.arrays_zip("timestamp", "close")).alias("p")).where("p.close is not null")
    return points.select("ticker", F.to_date(F.timestamp_seconds("p.timestamp")).alias("day"), "p.close")
