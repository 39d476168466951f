"""Names of people and committees, parties, offices and elections. Column to Column, with built-in functions but for the taking apart of letters."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .bills import any_of

# Fixed values.
INVISIBLE = "​‌‍﻿"
GENERATIONS = ["JR", "SR", "II", "III", "IV"]
HONORIFIC = r"(?i)^(rep|sen|del|res|hon|senator|representative|commissioner|dr|mr|mrs|ms)\.?\s+"
PARTIES = {"democratic": "Democratic", "democrat": "Democratic", "dem": "Democratic", "republican": "Republican", "rep": "Republican", "gop": "Republican", "independent": "Independent", "ind": "Independent", "libertarian": "Libertarian", "green": "Green", "nonpartisan": "Nonpartisan"}
CONDUITS = ["ACTBLUE", "WINRED"]
NOT_FEDERAL = "govern|gubernatorial|mayor|council|school|attorney|treasurer|assembly|state senate|state house|legislat|county|city|judge|sheriff|ballot measure|proposition"
NO_NAME = r"[\n\t]|\d|(?i:attachment|exhibit|committee report|resolution|ordinance|a motion|meeting|agenda)"
FORMS_OF_ADDRESS = ["mr", "mr.", "mrs", "mrs.", "ms", "ms.", "dr", "dr.", "hon", "hon."]


@F.pandas_udf(StringType())
def without_accents(names: pd.Series) -> pd.Series:
    """Compatible forms taken apart (NFKD), combining signs left out; nulls stay."""
    return names.map(lambda n: None if n is None else n if n.isascii() else "".join(c for c in unicodedata.normalize("NFKD", n) if not unicodedata.combining(c)))


def member_key(name: Column) -> Column:
    """The last word of a name in capitals, without accents, invisible characters, periods and generations. Only names beyond
    ASCII need Python, whose tables of characters Spark's functions lack."""
    bare = without_accents(F.regexp_replace(F.coalesce(name, F.lit("")), f"[{INVISIBLE}]", ""))
    tokens = F.filter(F.split(F.translate(F.upper(bare), ".", ""), r"\s+"), lambda t: (t != "") & ~t.isin(GENERATIONS))
    return F.coalesce(F.get(tokens, F.size(tokens) - 1), F.lit(""))


def clean_name(raw: Column) -> Column:
    """First and last name as a search takes them: no tags, forms of address, initials, generations; "LAST, First" turned round."""
    n = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"\[[^\]]*\]", "")
    n = F.btrim(F.regexp_replace(n, HONORIFIC, ""), F.lit(" ,"))
    turned = F.concat_ws(" ", F.trim(F.regexp_extract(n, r"^[^,]*,(.*)$", 1)), F.trim(F.split_part(n, F.lit(","), F.lit(1))))
    n = F.when(n.contains(","), turned).otherwise(n)
    n = F.regexp_replace(F.regexp_replace(n, r"\b[A-Za-z]\.", " "), r"(?i)\b(jr|sr|ii|iii|iv)\b\.?", "")
    return F.trim(F.regexp_replace(n, r"\s+", " "))


def last_name(name: Column) -> Column:
    n = F.trim(name)
    words = F.filter(F.split(F.regexp_replace(n, r"(?i)\b(jr|sr|ii|iii|iv)\b\.?", ""), r"\s+"), lambda w: w != "")
    return F.lower(F.when(n.contains(","), F.trim(F.split_part(n, F.lit(","), F.lit(1)))).otherwise(F.coalesce(F.get(words, F.size(words) - 1), F.lit(""))))


def committee_title(name: Column) -> Column:
    """Each word with one capital, but the short forms of committees whole."""
    return reduce(lambda t, a: F.regexp_replace(t, rf"\b{a}\b", a.upper()), ["Pac", "Jfc", "Llc", "Inc", "Pc"], F.initcap(F.trim(F.regexp_replace(name, r"\s+", " "))))


def display_name(raw: Column) -> Column:
    """"LAST, FIRST JR" as "First Last Jr."."""
    n = F.trim(F.coalesce(raw, F.lit("")))
    rest = F.when(n.contains(","), F.regexp_extract(n, r"^[^,]*,(.*)$", 1)).otherwise(n)
    last = F.when(n.contains(","), F.trim(F.split_part(n, F.lit(","), F.lit(1)))).otherwise("")
    tokens = F.filter(F.split(rest, r"\s+"), lambda t: t != "")
    tail = F.lower(F.btrim(F.coalesce(F.get(tokens, F.size(tokens) - 1), F.lit("")), F.lit(".")))
    has = tail.isin("jr", "sr", "ii", "iii", "iv", "v")
    cap = lambda w: F.when(w.contains("."), F.upper(w)).when((w == F.upper(w)) & w.rlike("[A-Z]") & (F.length(w) <= 2), w).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w)))))
    given = F.filter(F.when(has, F.slice(tokens, F.lit(1), F.greatest(F.lit(0), F.size(tokens) - 1))).otherwise(tokens), lambda t: ~F.lower(t).isin(FORMS_OF_ADDRESS))
    suffix = F.when(has, F.when(tail.isin("jr", "sr"), F.concat(F.initcap(tail), F.lit("."))).otherwise(F.upper(tail)))
    return F.concat_ws(" ", F.transform(given, cap), F.when(last != "", cap(last)), suffix)


def party(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    return F.when(raw != "", F.coalesce(*[F.when(low == k, v) for k, v in PARTIES.items()], F.trim(raw)))


def party_class(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(low.contains("democrat"), "dem").when(any_of(low, ["republican", "gop"]), "rep").when(low.contains("libertarian"), "lib").when(low.contains("green"), "grn").otherwise("ind")


def party_rank(name: Column) -> Column:
    """Places of parties from left to right in a chamber; others in the middle."""
    return F.when(name == "D", 0).when(name.isin("L", "R"), F.when(name == "L", 2).otherwise(3)).otherwise(1)


def no_person(name: Column) -> Column:
    """Whether a name can't be a person's: too long, or with digits, line ends or a document's words."""
    return (F.length(name) > 60) | name.rlike(NO_NAME)


def stage(title: Column) -> Column:
    low = F.lower(title)
    return F.when(low.contains("runoff"), "runoff").when(low.contains("special"), "special").when(low.contains("primary"), "primary").otherwise("general")


def primary_party(title: Column) -> Column:
    low = F.lower(title)
    return F.when(low.contains("primary"), F.when(any_of(low, ["republican", "gop"]), "republican").when(low.contains("democrat"), "democratic"))


def federal_races(title: Column, state: Column, day: Column) -> Column:
    """The races (office, state, cycle) that an election's title and date imply."""
    low, year = F.lower(title), F.year(day)
    cycle = year + year % 2
    race = lambda office, st: F.struct(F.lit(office).alias("office"), st.alias("state"), cycle.alias("cycle"))
    nowhere = F.lit(None).cast("string")
    named = F.array_compact(F.array(F.when(low.contains("president"), race("P", nowhere)), F.when(any_of(low, ["senate", "senator"]) & state.isNotNull(), race("S", state))))
    generic = state.isNotNull() & (year % 2 == 0) & any_of(low, ["general", "primary"]) & ~low.rlike(NOT_FEDERAL)
    bundled = F.array_compact(F.array(F.when(generic, race("S", state)), F.when(generic & (cycle % 4 == 0), race("P", nowhere))))
    return F.when(F.size(named) > 0, named).otherwise(bundled)


def contest_office(office: Column, level: Column) -> Column:
    """P, S or H of a contest for a federal office; null for others."""
    s, lv = F.lower(office), F.lower(F.coalesce(level, F.lit("")))
    federal = any_of(s, ["u.s.", "united states"]) | any_of(lv, ["federal", "country"])
    return F.when(s.contains("president"), "P").when(federal & any_of(s, ["senate", "senator"]), "S").when(federal & any_of(s, ["house", "representative", "congress"]), "H")


def election_day(year: Column) -> Column:
    """The Tuesday after the first Monday of November."""
    return F.date_add(F.next_day(F.make_date(year, F.lit(10), F.lit(31)), "Mon"), 1)


def countdown(day: Column, today: Column) -> Column:
    n = F.datediff(day, today)
    plural = lambda k: F.when(k == 1, " day").otherwise(" days")
    return F.when(n == 0, "today").when(n > 0, F.concat(F.lit("in "), n, plural(n))).otherwise(F.concat(-n, plural(-n), F.lit(" ago")))
