"""Extractors as whole jobs: from a source's documents to certified votes.

An extractor is a function from documents (doc, text) to votes in one schema. A job runs it, checks what it gives
for shape and consistency, sets it against a second source, and says of every vote whether it may be served. What
an extractor can't find it leaves out: a source without a verified document gives no rows, not guesses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.people import member_key
from . import blocks, minutes

VOTES = "doc string, item string, member string, position string, quote string"
#: The positions of a vote; absent members stand beside a vote and count in no tally.
POSITIONS = ["aye", "no", "abstain", "absent", "recused"]

Extractor = Callable[[DataFrame], DataFrame]
EXTRACTORS: dict[str, Extractor] = {}


def extractor(name: str) -> Callable[[Extractor], Extractor]:
    def add(f: Extractor) -> Extractor:
        EXTRACTORS[name] = f
        return f

    return add


def _rows(df: DataFrame, names: Column, position: Column, item: Column, quote: Column) -> DataFrame:
    """A row for each name. The outer form keeps Spark from deriving a filter that would read the document again."""
    rows = df.select("doc", item.alias("item"), position.alias("position"), quote.alias("quote"), F.explode_outer(names).alias("member")).where("member is not null")
    return rows.select("doc", "item", "member", "position", "quote")


@extractor("council_file")
def council_file(docs: DataFrame) -> DataFrame:
    """Pages with vote blocks; the item is the block's action."""
    found = blocks.votes(blocks.vote_blocks(docs, "doc", "text"), "doc")
    return found.select("doc", "action", F.col("name").alias("member"), "position", F.concat_ws(" ", "date", "action").alias("quote")).withColumnRenamed("action", "item").select("doc", "item", "member", "position", "quote")


@extractor("printed_minutes")
def printed_minutes(docs: DataFrame) -> DataFrame:
    """Minutes line by line; the item is its number."""
    lists = minutes.positions(minutes.read_lines(docs, "doc", "text", [r"^City Council\s+Meeting Minutes", r"^City Clerk\s+Page \d+"]), "doc").where("entry > 0")
    return _rows(lists, F.col("members"), F.col("position"), F.col("item"), F.concat_ws(" ", F.initcap("position"), F.col("count")))


# Tallies with counts before or after the names, and the words of their positions.
TALLY = r"(Yea|Nay|Abstain|Absent): \((\d+)\)([^:()]*?)(?=\s*(?:Yea|Nay|Abstain|Absent): \(|$)"
COUNTED = r"(AYE|NAY|ABSTAIN|ABSENT) (\d+) - ([^;]*)"
SAID = {"yea": "aye", "aye": "aye", "nay": "no", "no": "no", "abstain": "abstain", "absent": "absent"}


def _said(word: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(word) == w, p) for w, p in SAID.items()])


def _lines(docs: DataFrame) -> DataFrame:
    """doc, item (the number before the first colon of a line), line."""
    rows = docs.select("doc", F.explode_outer(F.split("text", "\n")).alias("line")).where("line is not null")
    return rows.select("doc", F.nullif(F.regexp_extract("line", r"^\s*Item (\S+?):", 1), F.lit("")).alias("item"), "line")


def _hits(docs: DataFrame, pattern: str) -> DataFrame:
    """doc, item, word, n, names, quote of every match in a line with an item."""
    rows = _lines(docs).select("doc", "item", F.explode_outer(F.regexp_extract_all("line", F.lit(pattern), F.lit(0))).alias("quote")).where("quote is not null AND item is not null")
    part = lambda i: F.regexp_extract("quote", pattern, i)
    names = F.filter(F.transform(F.split(part(3), ","), lambda n: F.trim(n)), lambda n: n != "")
    return rows.select("doc", "item", _said(part(1)).alias("position"), part(2).try_cast("int").alias("n"), names.alias("names"), "quote")


@extractor("tally_lines")
def tally_lines(docs: DataFrame) -> DataFrame:
    """Lines such as "Item 5: Yea: (2) Lee, Kim Nay: (0)". A position of nobody gives nothing, so a block of zeros is no vote."""
    found = _hits(docs, TALLY).where("n > 0")
    return _rows(found, F.col("names"), F.col("position"), F.col("item"), F.trim("quote"))


@extractor("counted_lines")
def counted_lines(docs: DataFrame) -> DataFrame:
    """Lines such as "Item 5: AYE 2 - Lee, Kim, Notes; NAY 1 - Diaz": no more names than the count says."""
    found = _hits(docs, COUNTED)
    return _rows(found, F.slice("names", F.lit(1), F.greatest(F.lit(0), F.col("n"))), F.col("position"), F.col("item"), F.trim("quote"))


# What says that a motion was decided, and what takes a member out of those who voted for it.
DECIDED = r"(?i)\b(?:motion )?(?:carried|passed|adopted|approved)\b"
OVERRIDES = [("no", r"{m}(?: and \w+)? voting nay"), ("absent", r"{m}(?: and \w+)?,? (?:who )?(?:was|were) (?:absent|away)"), ("abstain", r"{m}(?: and \w+)? abstain")]


def narrative(roster: list[str]) -> Extractor:
    """Prose: where a line says that a motion carried, every member of the roster is for it unless the sentence takes them
    out, the first such words counting. The roster is a body's few members."""

    def run(docs: DataFrame) -> DataFrame:
        rows = _lines(docs).where(F.col("item").isNotNull() & F.col("line").rlike(DECIDED))
        rows = rows.select("doc", "item", F.trim("line").alias("quote"), F.explode(F.array(*map(F.lit, roster))).alias("member"))
        out = [F.when(F.regexp_like("quote", F.concat(F.lit("(?i)\\b"), F.replace(F.lit(pattern), F.lit("{m}"), F.col("member")))), position) for position, pattern in OVERRIDES]
        return rows.select("doc", "item", "member", F.coalesce(*out, F.lit("aye")).alias("position"), "quote")

    return run


EXTRACTORS["narrative"] = narrative(["Lee", "Kim", "Diaz", "Cruz"])


@extractor("unverified")
def unverified(docs: DataFrame) -> DataFrame:
    """A source whose documents nobody could verify: no rows."""
    return docs.sparkSession.createDataFrame([], VOTES)


def findings(votes: DataFrame) -> DataFrame:
    """layer, check, doc, item: shape (missing fields, unknown positions) and consistency (a member with two positions on one item, by the canonical key)."""
    shape = F.when(F.col("item").isNull() | (F.trim("item") == ""), "missing item").when(F.trim("member") == "", "missing member").when(~F.col("position").isin(POSITIONS), "unknown position")
    broken = votes.select(F.lit("structural").alias("layer"), shape.alias("check"), "doc", "item").where("check is not null").distinct()
    people = votes.select("member").distinct().select("member", member_key(F.col("member")).alias("who"))
    twice = votes.join(people, "member").groupBy("doc", "item", "who").agg(F.countDistinct("position").alias("n")).where("n > 1")
    return broken.unionByName(twice.select(F.lit("consistency").alias("layer"), F.lit("two positions").alias("check"), "doc", "item").distinct())


def run(name: str, docs: DataFrame, asserted: DataFrame) -> DataFrame:
    """doc, item, aye, no, result, status of every item that the extractor found votes on.

    asserted: doc, item, result of a second source. certified: it says the same and nothing was found against the item;
    disputed: it says otherwise; quarantined: there are findings, or nothing to compare with.
    """
    votes = EXTRACTORS[name](docs)
    bad = findings(votes).select("doc", "item", F.lit(True).alias("bad")).distinct()
    count = lambda p: F.count_if(F.col("position") == p).alias(p)
    items = votes.groupBy("doc", "item").agg(count("aye"), count("no")).withColumn("result", F.when(F.col("aye") > F.col("no"), "pass").otherwise("fail"))
    said = asserted.groupBy("doc", "item").agg(F.min("result").alias("said"), F.max("result").alias("said_too"))
    joined = items.join(bad, ["doc", "item"], "left").join(said, ["doc", "item"], "left")
    same = (F.col("said") == F.col("result")) & (F.col("said_too") == F.col("result"))
    status = F.when(F.col("bad") | F.col("said").isNull(), "quarantined").when(same, "certified").otherwise("disputed")
    return joined.select("doc", "item", "aye", "no", "result", status.alias("status"))
