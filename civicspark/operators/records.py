"""Record quality: checks, reconciliation of two sources, certification, merging."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import io


def finding(layer: str, check: str, ref: Column | str, message: Column) -> list[Column]:
    """The columns of a finding."""
    ref = F.col(ref) if isinstance(ref, str) else ref
    return [F.lit(layer).alias("layer"), F.lit(check).alias("check"), ref.cast("string").alias("ref"), message.alias("message")]


def result_of(aye: str = "aye", no: str = "no") -> Column:
    return F.when(F.col(aye) > F.col(no), "pass").otherwise("fail")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is missing."""
    return children.join(parents, children[child_key] == parents[parent_key], "left_anti")


def consistency(votes: DataFrame, positions: DataFrame, meetings: DataFrame) -> DataFrame:
    """Findings on votes: votes without a meeting, tallies that their positions don't give, results that tallies contradict."""
    counted = positions.groupBy("vote_id").agg(*[F.count_if(F.col("position") == p).alias(f"n_{p}") for p in ("aye", "no")])
    tallied = votes.join(counted, "vote_id", "left").na.fill(0, ["n_aye", "n_no"])
    off = (F.col("aye") != F.col("n_aye")) | (F.col("no") != F.col("n_no"))
    wrong = F.col("result") != result_of()
    return reduce(DataFrame.unionByName, [
        orphans(votes, meetings, "vote_id", "meeting_id").select(*finding("consistency", "orphan_vote", "vote_id", F.lit("no such meeting"))),
        tallied.where(off).select(*finding("consistency", "count_mismatch", "vote_id", F.concat_ws("-", "aye", "no", "n_aye", "n_no"))),
        votes.where(wrong).select(*finding("consistency", "result_vs_tally", "vote_id", F.concat_ws(" ", "result", "aye", "no"))),
    ])


def reconcile(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """Findings where two sources hold different multisets of values for a key: coverage, multiplicity, mismatch.

    Both sides are counted by key and value and then summed by key with order-free seals, so no task
    gathers the values of a key.
    """
    counted = first.groupBy(key, value).agg(F.count("*").alias("a")).join(second.groupBy(key, value).agg(F.count("*").alias("b")), [key, value], "full_outer").na.fill(0, ["a", "b"])
    by_key = counted.groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.abs(F.col("a") - F.col("b"))).alias("apart"))
    check = F.when(F.col("b") == 0, "missing_in_second").when(F.col("a") == 0, "missing_in_first").when(F.col("a") != F.col("b"), "multiplicity").when(F.col("apart") > 0, "mismatch")
    return by_key.withColumn("check", check).where("check is not null").select(key, "check", "a", "b", "apart")


#: Keys that a list of the left and of the right holds at most. A task holds all pairs of two lists at once.
LIST_KEYS = 64, 1024


def key_lists(df: DataFrame, key: str, on: list[str], lots: int, most: int) -> DataFrame:
    """on, lot, key: the keys of equal values in lists of so many at most, dealt to lots by their hash. A list of no key stands for a null key."""
    lists = df.groupBy(*on, F.pmod(F.xxhash64(key), F.lit(lots)).cast("int").alias("lot"), F.col(key).isNull().alias("none")).agg(F.collect_list(key).alias(key))
    starts = F.sequence(F.lit(1), F.greatest(F.size(key), F.lit(1)), F.lit(most))
    return lists.withColumn("at", F.explode(starts)).select(*on, "lot", F.slice(key, F.col("at"), most).alias(key))


def either_equal(left: DataFrame, right: DataFrame, a: str, b: str, first: list[str], second: list[str], listed: Callable[[Column], Column], parts: int = 8) -> DataFrame:
    """a, b, each pair once: rows of the two sides that are equal in all columns of `first`, if listed(b), or in all of `second`.

    Two equality joins instead of one with OR. The second leaves out what the first has, so a pair comes once without a
    shuffle of pairs, which can be far more than rows; only pairs of keys that stand in several rows are gathered. What meets are
    lists of keys of equal values, unfolded after: a row is written to disk as its key in a list, once on the left. A hot
    value's lists are dealt to `parts` tasks on the left, and meet all of its lists on the right, which are written `parts` times.
    """
    columns = list(dict.fromkeys(first + second))
    tasks_a, tasks_b = max(1, io.tasks(left)), max(1, io.tasks(right))
    # About io.TASK_ROWS keys at most come together before they are cut into lists, whatever the values.
    lots_a, lots_b = parts * -(-tasks_a // parts), tasks_b
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def once(df: DataFrame, key: str, tasks: int) -> DataFrame:
        rows = df.select(key, *columns).repartition(max(n, tasks), key).distinct()
        return rows.withColumn(f"several_{key}", F.count("*").over(Window.partitionBy(key)) > 1)

    l, r = once(left, a, tasks_a), once(right, b, tasks_b).select(b, f"several_{b}", *[F.col(c).alias(f"other_{c}") for c in columns])
    same = lambda on: reduce(Column.__and__, [F.col(c) == F.col(f"other_{c}") for c in on])
    others = lambda on: [f"other_{c}" for c in on]

    def met(lists_l: DataFrame, lists_r: DataFrame, on: list[str]) -> DataFrame:
        # The number of tasks is given, else few bytes would go to few tasks, though their pairs are many.
        dealt = lists_l.withColumn("part", F.col("lot") % parts).repartition(max(n, tasks_a), *on, "part")
        every = lists_r.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(max(n, tasks_a), *others(on), "of")
        return dealt.drop("lot").join(every.drop("lot").hint("merge"), same(on) & (F.col("part") == F.col("of")))

    def pairs(which_l: Column, which_r: Column) -> DataFrame:
        rows_l, rows_r = l.where(which_l), r.where(which_r).withColumn("listed", F.coalesce(listed(F.col(b)), F.lit(False)))
        lists_l = lambda on: key_lists(rows_l, a, on, lots_a, LIST_KEYS[0])
        lists_r = lambda df, on: key_lists(df, b, on, lots_b, LIST_KEYS[1])
        by_first = met(lists_l(first), lists_r(rows_r.where("listed"), others(first)), first)
        by_second = met(lists_l(columns), lists_r(rows_r, [*others(columns), "listed"]), second)
        both = by_first.select(a, b).unionByName(by_second.where(~F.coalesce(same(first) & F.col("listed"), F.lit(False))).select(a, b))
        return both.select(F.explode_outer(a).alias(a), b).select(a, F.explode_outer(b).alias(b))

    several_a, several_b = F.col(f"several_{a}"), F.col(f"several_{b}")
    return pairs(~several_a, ~several_b).unionByName(pairs(several_a, ~several_b).unionByName(pairs(F.lit(True), several_b)).distinct())


def certify(meetings: DataFrame, disputed: DataFrame, asserted: DataFrame, key: str) -> DataFrame:
    """certified where the second source asserts the record and nobody disputes it, else disputed or unverified."""
    d = disputed.select(F.col(key), F.lit(True).alias("__d")).distinct()
    s = asserted.select(F.col(key), F.lit(True).alias("__s")).distinct()
    status = F.when(F.col("__d"), "disputed").when(F.col("__s"), "certified").otherwise("unverified")
    return meetings.join(d, key, "left").join(s, key, "left").withColumn("status", status).drop("__d", "__s")


def merge_latest(store: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """The store with later records in the place of earlier ones of the same key."""
    both = store.withColumn("__batch", F.lit(0)).unionByName(incoming.withColumn("__batch", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("__batch"), F.desc(order))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__batch")


def merge_new(store: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The store and those incoming records whose key it doesn't have."""
    return store.unionByName(incoming.join(store, key, "left_anti"))


def golden_diff(golden: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """key and whether it is missing, extra or changed against the golden records."""
    both = golden.select(F.col(key), F.col(value).alias("g"), F.lit(1).alias("in_g")).join(found.select(F.col(key), F.col(value).alias("f"), F.lit(1).alias("in_f")), key, "full_outer")
    what = F.when(F.col("in_f").isNull(), "missing").when(F.col("in_g").isNull(), "extra").when(~F.col("g").eqNullSafe(F.col("f")), "changed")
    return both.withColumn("difference", what).where("difference is not null").select(key, "difference")


def duplicates(df: DataFrame, body: Column, ident: str) -> DataFrame:
    """digest, copies and the smallest id of each body that several rows have."""
    return df.groupBy(F.md5(body).alias("digest")).agg(F.count("*").alias("copies"), F.min(ident).alias("first_id")).where("copies > 1")


def first_by(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key: keep-first deduplication and priority coalescing."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")


# Words of a vote on the floor.
FLOOR = r"(?i)floor|third reading|final passage|final reading|passage"


def floor_vote(votes: DataFrame, group: str, seats: int) -> DataFrame:
    """The vote that decided, of votes with desc, participation and day: committees' votes aside, one with a floor marker before
    others, then participation, then date; none where the best has no marker and fewer than half of the seats took part."""
    floor = votes.where(~F.lower(F.coalesce("desc", F.lit(""))).contains("committee")).withColumn("marker", F.coalesce(F.col("desc").rlike(FLOOR), F.lit(False)))
    best = first_by(floor, [group], [F.desc("marker"), F.desc("participation"), F.desc("day"), "vote_id"])
    return best.where(F.col("marker") | (F.col("participation") * 2 >= seats))


def transitions(actions: DataFrame, notify: list[str]) -> DataFrame:
    """Each action with the state before it, and whether it moved forward to a state worth a notice."""
    w = Window.partitionBy("bill").orderBy("ts", "event_id")
    before = F.coalesce(F.lag("priority").over(w), F.lit(0))
    return actions.withColumn("before", before).withColumn("notify", (F.col("priority") > F.col("before")) & F.col("state").isin(notify))


def budget_prefix(df: DataFrame, group: str, order: str, size: str, most: int) -> DataFrame:
    """The rows of each group before the first that overflows the budget, with the running sum."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = df.withColumn("running", F.sum(size).over(w))
    return run.withColumn("__over", F.max((F.col("running") > most).cast("int")).over(w)).where("__over = 0").drop("__over")
