"""Lobbying and campaign-finance rollups. Amounts are whole cents inside and dollars in results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dollars(cents: Column) -> Column:
    return cents / F.lit(100.0)


def thousandth(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / 1000


def quarter_label(day: str) -> Column:
    return F.concat_ws(" Q", F.year(day), F.quarter(day))


def spend_of(income: Column, expenses: Column) -> Column:
    """The first of income and expenses that parses to something other than zero, else zero."""
    amount = lambda c: F.nullif(c.try_cast("double"), F.lit(0.0))
    return F.coalesce(amount(income), amount(expenses), F.lit(0.0))


def profile_quarters(filings: DataFrame, entity: str = "registrant") -> DataFrame:
    """Spend and filings by entity and quarter."""
    return filings.groupBy(entity, quarter_label("filed").alias("quarter")).agg(dollars(F.sum("cents")).alias("spend"), F.count("*").alias("filings"))


def top_by(df: DataFrame, group: list[str], by: list[Column], top: int) -> DataFrame:
    """The first rows of each group with their rank from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*by))).where(F.col("rank") <= top)


def profile_counterparties(filings: DataFrame, top: int = 12) -> DataFrame:
    """The clients that each registrant was paid most by."""
    sums = filings.groupBy("registrant", "client").agg(F.sum("cents").alias("cents"))
    return top_by(sums, ["registrant"], [F.desc("cents"), F.col("client")], top).select("registrant", "client", dollars(F.col("cents")).alias("spend"), "rank")


def profile_issues(filings: DataFrame, top: int = 12) -> DataFrame:
    counts = filings.groupBy("registrant", "issue").agg(F.count("*").alias("n"))
    return top_by(counts, ["registrant"], [F.desc("n"), F.col("issue")], top)


def profile_bills(filings: DataFrame, activities: DataFrame, top: int = 24) -> DataFrame:
    """By registrant the bills mentioned most: mentions count by activity, a filing's spend once for each bill it names."""
    named = activities.groupBy("filing", "bill").agg(F.count("*").alias("mentions"))
    sums = named.join(filings, "filing").groupBy("registrant", "bill").agg(F.sum("mentions").alias("mentions"), F.sum("cents").alias("cents"))
    return top_by(sums, ["registrant"], [F.desc("mentions"), F.desc("cents"), F.col("bill")], top).select("registrant", "bill", "mentions", dollars(F.col("cents")).alias("bill_spend"), "rank")


def merge_names(mentions: DataFrame) -> DataFrame:
    """bill, entity, kind, mentions, entity_cents: names that differ in case are one entity, called as its
    row with most mentions; mentions add up, spends are the largest. A column key, if there, is the name in upper case."""
    head = F.max_by(F.struct("entity", "kind"), F.struct("mentions", "entity"))
    key = F.col("key") if "key" in mentions.columns else F.upper("entity")
    merged = mentions.groupBy("bill", key.alias("__key")).agg(head.alias("h"), F.sum("mentions").alias("mentions"), F.max("entity_cents").alias("entity_cents"))
    return merged.select("bill", "h.entity", "h.kind", "mentions", "entity_cents")


def search_rank(names: DataFrame, name: str, typed: str, top: int = 10) -> DataFrame:
    """Names that contain what was typed, those that start with it first, then the shortest."""
    low = F.lower(name)
    hits = names.where(low.contains(typed.lower())).select(F.col(name), low.startswith(typed.lower()).alias("starts"), F.length(name).alias("length"))
    return hits.orderBy(F.desc("starts"), "length", name).limit(top)


def pac_totals(contributions: DataFrame, cycle: int) -> DataFrame:
    """By candidate and PAC what came in this cycle and the one before."""
    both = contributions.where(F.col("cycle").isin(cycle, cycle - 2))
    return both.groupBy("candidate", "pac").agg(dollars(F.sum("cents")).alias("total"), F.count("*").alias("gifts"))


def interest_shares(contributions: DataFrame, names: int = 4, top: int = 12) -> DataFrame:
    """By candidate the interests with most money, each with its share and its largest PACs."""
    pacs = contributions.groupBy("candidate", "interest", "pac").agg(F.sum("cents").alias("cents"))
    pacs = pacs.withColumn("r", F.row_number().over(Window.partitionBy("candidate", "interest").orderBy(F.desc("cents"), "pac")))
    largest = F.array_sort(F.collect_list(F.when(F.col("r") <= names, F.struct("r", "pac"))))
    sums = pacs.groupBy("candidate", "interest").agg(F.sum("cents").alias("cents"), largest.alias("p"))
    everything = F.sum("cents").over(Window.partitionBy("candidate"))
    shared = sums.withColumn("share", thousandth(F.col("cents") / F.when(everything == 0, 1).otherwise(everything)))
    ranked = top_by(shared, ["candidate"], [F.desc("cents"), F.col("interest")], top)
    return ranked.select("candidate", "interest", dollars(F.col("cents")).alias("total"), "share", F.array_join(F.transform("p", lambda x: x["pac"]), "; ").alias("top_pacs"), "rank")


def pick_cycle(contributions: DataFrame, other: str, cycle: int, top: int = 10) -> DataFrame:
    """By candidate the industries of whichever of two cycles has more classified money (the current one on a
    tie); what is unclassified comes last, after the cut."""
    both = contributions.where(F.col("cycle").isin(cycle, cycle - 2))
    known = F.coalesce(F.sum(F.when(F.col("interest") != other, F.col("cents"))), F.lit(0))
    best = both.groupBy("candidate", "cycle").agg(known.alias("known")).groupBy("candidate").agg(F.max_by("cycle", F.struct("known", "cycle")).alias("cycle"))
    sums = both.join(best, ["candidate", "cycle"]).groupBy("candidate", "cycle", "interest").agg(F.sum("cents").alias("cents"))
    first = top_by(sums.where(F.col("interest") != other), ["candidate"], [F.desc("cents"), F.col("interest")], top)
    last = sums.where(F.col("interest") == other).withColumn("interest", F.lit("Unclassified employers")).withColumn("rank", F.lit(top + 1))
    return first.unionByName(last).select("candidate", "cycle", "interest", dollars(F.col("cents")).alias("total"), "rank")


def latest_cycle(contributions: DataFrame) -> DataFrame:
    """By candidate the totals of the newest cycle."""
    sums = contributions.groupBy("candidate", "cycle").agg(F.sum("cents").alias("cents"))
    newest = sums.groupBy("candidate").agg(F.max_by(F.struct("cycle", "cents"), "cycle").alias("t"))
    return newest.select("candidate", "t.cycle", dollars(F.col("t.cents")).alias("receipts"))


def composition(contributions: DataFrame, parts: list[str], least: float = 0.02) -> DataFrame:
    """By candidate each named part of the receipts and what else there is, where that is more than a share least."""
    wide = contributions.groupBy("candidate").agg(F.sum("cents").alias("all"), *[F.coalesce(F.sum(F.when(F.col("interest") == p, F.col("cents"))), F.lit(0)).alias(p) for p in parts])
    rest = F.greatest(F.lit(0), F.col("all") - sum((F.col(p) for p in parts), F.lit(0)))
    rows = wide.withColumn("Other", rest).unpivot(["candidate", "all"], [*parts, "Other"], "segment", "cents")
    kept = rows.where((F.col("cents") > 0) & ((F.col("segment") != "Other") | (F.col("cents") > least * F.col("all"))))
    return kept.select("candidate", "segment", dollars(F.col("cents")).alias("amount"), thousandth(F.col("cents") / F.col("all")).alias("share"))
