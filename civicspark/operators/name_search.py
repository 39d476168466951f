"""Members by what they are called: nicknames, last names, parts of names.

Every part of a question counts for each member in whose name it stands: three where it is the last name, else one; a
nickname counts beside the name it stands for. Names lie in an index of all pieces of their words, so a part meets
the names that hold it by equality, not every name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names that nicknames stand for.
NICKNAMES = {
    "ted": "edward", "bill": "william", "bob": "robert", "joe": "joseph", "jim": "james", "mike": "michael", "dick": "richard", "chuck": "charles", "bernie": "bernard",
    "liz": "elizabeth", "betty": "elizabeth", "jack": "john", "mitt": "willard", "al": "albert", "tom": "thomas", "dan": "daniel", "fred": "frederick", "ed": "edward", "pat": "patricia",
}
LAST, PART = 3, 1


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def parts(question: Column) -> Column:
    """The words of a question and, after them, the names that nicknames among them stand for."""
    full = F.create_map(*[F.lit(x) for pair in NICKNAMES.items() for x in pair])
    words = _words(question)
    return F.concat(words, F.filter(F.transform(words, lambda w: F.try_element_at(full, w)), lambda w: w.isNotNull()))


def pieces(name: Column) -> Column:
    """Every piece of every word of a name."""
    ends = lambda w, i: F.transform(F.sequence(F.lit(1), F.length(w) - i + 1), lambda n: F.substring(w, i, n))
    of_word = lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: ends(w, i)))
    return F.array_distinct(F.flatten(F.transform(_words(name), of_word)))


def best_members(questions: DataFrame, key: str, question: str, roster: DataFrame, member: str, name: str) -> DataFrame:
    """key, member, score of the member with the highest score, the smallest of several; questions that name nobody give none.

    roster: names as "Last, First". A part that comes twice counts twice, and a key that stands in several rows has the texts of
    all of them. Null names and questions match nothing. Points depend on texts alone, so every text is compared once, with
    the smallest member of each name; an index has a row for each piece of each name, some hundreds a name.
    """
    def texts(df: DataFrame, of: str, text: str, name: str) -> DataFrame:
        """of, name: the texts of a key together. A key without one isn't there."""
        return df.where(F.col(text).isNotNull()).groupBy(F.col(of).alias(f"{name}_key")).agg(F.sort_array(F.collect_list(text)).alias(name))

    asked, called = texts(questions, key, question, "asks"), texts(roster, member, name, "names")
    one = asked.select("asks").distinct()
    part = one.select("asks", F.explode(F.flatten(F.transform("asks", parts))).alias("part")).groupBy("asks", "part").agg(F.count("*").alias("times"))
    first = called.groupBy("names").agg(F.min("names_key").alias("member"))
    last = lambda n: F.get(_words(F.replace(n, F.lit(","), F.lit(""))), F.lit(0))
    index = first.select("member", F.explode("names").alias("n")).select("member", last(F.col("n")).alias("last"), F.explode(pieces(F.col("n"))).alias("part"))
    met = part.join(index, "part").withColumn("points", F.col("times") * F.when(F.col("part") == F.col("last"), LAST).otherwise(PART))
    scored = met.groupBy("asks", "member").agg(F.sum("points").cast("int").alias("score"))
    best = scored.groupBy("asks").agg(F.min_by("member", F.struct(-F.col("score"), "member")).alias("member"), F.max("score").alias("score"))
    return asked.join(best, "asks").select(F.col("asks_key").alias(key), "member", "score")
