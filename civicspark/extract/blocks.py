"""Vote blocks in a page of markup.

A page is its texts between tags. A block opens at START if a text ACTION follows within WITHIN texts; the
fields of its head are the texts after their labels; MEMBERS and two more headings end the head; then come name,
district and vote, again and again, until a third text is no vote. What opens inside an open head is part of it.

A page's blocks are found inside its row with array functions, so that no text is shuffled and a page is read
once; rows leave it as blocks, and blocks as votes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

# The labels of a council file's page, and the words of its votes.
START, ACTION, TALLY, MEMBERS, WITHIN = "Meeting Date:", "Vote Action:", "Vote Given:", "Member Name", 12
VOTE_WORDS = {"YES": "aye", "NO": "no", "ABSENT": "absent", "RECUSED": "recused", "EXCUSED": "absent"}


def texts(html: Column) -> Column:
    """The texts between tags and bars, references decoded, without white space around them; empty ones are left out."""
    parts = F.split(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", "|"), r"\|")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(t.unescape(x), r"^[\s ]+|[\s ]+$", "")), lambda x: x != "")


def _after(head: Column, label: str) -> Column:
    """The text after the last such label of a head, whose last text only closes it."""
    inner = F.slice(head, F.lit(1), F.size(head) - 1)
    at = F.size(inner) - F.array_position(F.reverse(inner), label) + 1
    return F.when(F.array_contains(inner, label), F.get(head, at.cast("int")))


def vote_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, block (1, 2 ... down the page), date, action, tally, votes (array of name and position, in order) of every block.

    A date that isn't month/day/year is null; a block without a table of members has no votes. A null page has no blocks;
    a page that comes twice is read twice.
    """
    n, at, end = F.size("x"), lambda i: F.get("x", i - 1), F.size("x") + 1
    words = F.create_map(*[F.lit(x) for pair in VOTE_WORDS.items() for x in pair])
    position = lambda text: F.try_element_at(words, F.upper(text))
    every = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    opens = lambda i: (at(i) == START) & F.array_contains(F.slice("x", i, F.lit(WITHIN)), ACTION)
    pages = pages.select(key, texts(F.col(html)).alias("x"))
    others = F.concat(F.filter(every, lambda i: position(at(i)).isNull()), F.sequence(end, end + 4))
    pages = pages.select(key, "x", F.filter(every, opens).alias("opens"), F.filter(every, lambda i: at(i) == MEMBERS).alias("closes"), others.alias("others"))

    def span(s: Column) -> Column:
        def ending(close: Column) -> Column:
            stop = F.array_min(F.filter("others", lambda o: (o >= close + 5) & ((o - close - 5) % 3 == 0))) - 2
            return F.struct(s.alias("start"), close.alias("close"), F.when(close < end, stop).otherwise(end).alias("stop"))

        # Through an array of one, so that the search for close isn't repeated for each text it is compared with.
        close = F.coalesce(F.array_min(F.filter("closes", lambda c: c > s)), end)
        return F.get(F.transform(F.array(close), ending), F.lit(0))

    # A block that opens before the one above it has ended is part of that.
    spans = pages.select(key, "x", F.transform("opens", span).alias("spans"))
    none = F.slice("spans", 1, 0)
    chain = lambda kept, s: F.when(s["start"] >= F.coalesce(F.get(kept, F.size(kept) - 1)["stop"], F.lit(1)), F.concat(kept, F.array(s))).otherwise(kept)
    spans = spans.select(key, "x", F.aggregate("spans", none, chain).alias("spans"))
    cut = lambda s: F.struct(F.slice("x", s["start"], s["close"] - s["start"] + 1).alias("head"), F.slice("x", s["close"] + 3, F.greatest(F.lit(0), s["stop"] - s["close"] - 3)).alias("table"), (s["close"] < end).alias("closed"))
    # The outer form keeps Spark from deriving a filter that would read the page again for each of its texts.
    blocks = spans.select(key, F.posexplode_outer(F.transform("spans", cut)).alias("block", "b")).where("b is not null")
    # A head that nothing closes has no last text of its own.
    head = F.when(F.col("b.closed"), F.col("b.head")).otherwise(F.concat(F.col("b.head"), F.array(F.lit(""))))
    rows = F.when(F.size("b.table") >= 3, F.sequence(F.lit(0), F.floor(F.size("b.table") / 3).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    votes = F.transform(rows, lambda k: F.struct(F.get("b.table", 3 * k).alias("name"), position(F.get("b.table", 3 * k + 2)).alias("position")))
    date = F.regexp_extract(F.get(head, F.lit(1)), r"^(\d{2})/(\d{2})/(\d{4})", 0)
    date = F.regexp_replace(F.nullif(date, F.lit("")), r"(\d{2})/(\d{2})/(\d{4})", "$3-$1-$2")
    action = F.trim(F.regexp_replace(_after(head, ACTION), r"\s+", " "))
    return blocks.select(key, (F.col("block") + 1).alias("block"), date.alias("date"), action.alias("action"), _after(head, TALLY).alias("tally"), votes.alias("votes"))


def assertions(blocks: DataFrame, key: str) -> DataFrame:
    """key, block, date, action, aye, no, absent, recused, result of every block with votes: passed with more ayes than noes."""
    count = lambda p: F.size(F.filter("votes", lambda v: v["position"] == p))
    # Every vote has one of the four words; a filter on the counts would be pushed down and count all of them again.
    rows = blocks.where(F.size("votes") > 0).select(key, "block", "date", "action", *[count(p).alias(p) for p in ("aye", "no", "absent", "recused")])
    return rows.withColumn("result", F.when(F.col("aye") > F.col("no"), "pass").otherwise("fail"))


def votes(blocks: DataFrame, key: str) -> DataFrame:
    """key, block, date, action, tally, seat (1, 2 ... down the table), name, position: a row for each vote."""
    rows = blocks.select(key, "block", "date", "action", "tally", F.posexplode_outer("votes").alias("seat", "v")).where("v is not null")
    return rows.select(key, "block", "date", "action", "tally", (F.col("seat") + 1).alias("seat"), "v.name", "v.position")
