"""Checks of records before they are served: shape, consistency, floors, gates, tiered matching of two sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .records import finding

# Fixed values of the record schema and of the gates.
POSITIONS = ["aye", "no", "abstain", "absent", "present", "recused"]
DATE, FILE_NUMBER = r"^\d{4}-\d{2}-\d{2}$", r"^\d{2,4}-\d{4}(-S\d+)?$"
QUOTED = [(r"\baffirmative\s*[:\-–]\s*(\d+)", "aye"), (r"\bnegative\s*[:\-–]\s*(\d+)", "no"), (r"\byeas?\s*[:(]+\s*(\d+)", "aye"), (r"\bnays?\s*[:(]+\s*(\d+)", "no"), (r"\babstentions?\s*[:\-–(]+\s*(\d+)", "abstain")]
ATTACHED = r"(?i)fiscal impact statement|committee report|hearing (?:testimony|transcript)|stated meeting|exhibit [a-z]\b|memorandum in support|\battachments?:"
NO_SUBJECT = r"(?i)\b(approve[ds]?|adopt(?:ed)?|accept(?:ed)?|amend(?:ed)?|defer(?:red)?|motion|res(?:olution)?|int(?:roduction)?|ord(?:inance)?|no|m|lu|slr|item)\b|[\d\-–/.,:;()#]+"
OUTCOME = r"(?i)approv|denie|deny|carrie|passe?d|fail|adopt|defer|motion|moved|second|aye|nay|unanimous|vote"


def violations(required: list[str], **rules: Column) -> Column:
    """The rules that a record breaks, as text; where required fields are null or empty, those alone."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(f"missing {c}")) for c in required]))
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]))
    return F.when(F.size(missing) > 0, missing).otherwise(broken)


def structural(records: DataFrame, kind: str, ref: str, required: list[str], **rules: Column) -> DataFrame:
    """A finding for each rule of shape that a record breaks."""
    rows = records.select(F.coalesce(F.col(ref).cast("string"), F.lit("?")).alias("__ref"), F.explode(violations(required, **rules)).alias("__why"))
    return rows.select(*finding("structural", "schema", F.concat_ws(":", F.lit(kind), "__ref"), F.col("__why")))


def row_count_delta(counts: DataFrame, prior: DataFrame, shrink: float = 0.5) -> DataFrame:
    """Record types with less than that share of the rows of the run before."""
    both = counts.join(prior.withColumnRenamed("n", "before"), "kind").where((F.col("before") > 0) & (F.col("n") < F.col("before") * shrink))
    return both.select(*finding("consistency", "row_count_delta", "kind", F.concat(F.col("n"), F.lit(" rows against "), F.col("before"))))


def quoted_tally(votes: DataFrame) -> DataFrame:
    """Votes whose quote states another count than the record's map of counts: the first such statement of each."""
    said = lambda p: F.nullif(F.regexp_extract("quote", "(?i)" + p, 1), F.lit("")).cast("int")
    held = lambda k: F.coalesce(F.try_element_at("counts", F.lit(k)), F.lit(0))
    first = F.coalesce(*[F.when(said(p) != held(k), F.concat(F.lit(f"{k}="), said(p), F.lit(" but "), held(k))) for p, k in QUOTED])
    return votes.withColumn("__why", first).where("__why is not null").select(*finding("gate", "quote_tally_mismatch", "vote_id", F.col("__why")))


def vague(title: Column) -> Column:
    """Whether a title is a list of attachments or says nothing of its subject."""
    words = F.filter(F.split(F.regexp_replace(F.coalesce(title, F.lit("")), NO_SUBJECT, " "), r"\s+"), lambda w: F.length(w) > 2)
    return F.coalesce(title, F.lit("")).rlike(ATTACHED) | (F.size(words) < 2)


def certify_votes(votes: DataFrame, disputed: DataFrame, asserted: DataFrame) -> DataFrame:
    """status and note of votes (vote_id, meeting_id, ref): certified where the second source has the meeting and neither
    the meeting nor the vote is disputed (ref); disputed: ref, note (of a dispute that was settled by hand, or null)."""
    d = disputed.groupBy("ref").agg(F.max("note").alias("note"))
    of = lambda key, name: d.select(F.col("ref").alias(key), F.col("note").alias(f"{name}_note"), F.lit(True).alias(name))
    meetings = of("__m", "d_m")
    joined = votes.join(asserted.select("meeting_id").distinct().withColumn("known", F.lit(True)), "meeting_id", "left")
    joined = joined.join(of("ref", "d_v"), "ref", "left").join(meetings, F.col("meeting_id").cast("string") == F.col("__m"), "left")
    ok = F.col("known").isNotNull() & F.col("d_v").isNull() & F.col("d_m").isNull()
    return joined.select("vote_id", F.when(ok, "certified").otherwise("quarantined").alias("status"), F.col("d_v_note").alias("note"))


def shared_enough(a: Column, b: Column) -> Column:
    """Two words in common, and three tenths of the smaller set of words; without words on one side there is nothing to compare."""
    n = F.size(F.array_intersect(a, b))
    return (F.size(a) == 0) | (F.size(b) == 0) | ((n >= 2) & (t.overlap(a, b) >= 0.3))


def greedy(pairs: DataFrame, group: list[str], entry: str, vote: str, score: str) -> DataFrame:
    """Pairs best first within each group: an entry once, a vote once. Groups are the entries of one meeting; sorted pairs
    stream through a task, which holds what the group at hand has used, and nothing is called for each group."""
    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, entries, votes = None, set(), set()
        for pdf in frames:
            keep = []
            for *of, e, v in pdf[[*group, entry, vote]].itertuples(index=False, name=None):
                if of != at:
                    at, entries, votes = of, set(), set()
                free = e not in entries and v not in votes
                keep.append(free)
                if free:
                    entries.add(e)
                    votes.add(v)
            yield pdf[np.array(keep, bool)]

    return pairs.repartition(*group).sortWithinPartitions(*group, F.desc(score), entry, vote).mapInPandas(pick, pairs.schema)


def tiered_match(entries: DataFrame, votes: DataFrame) -> DataFrame:
    """entry_id, vote_id, tier. Both sides: meeting, key (printed number), words (array), result; entries entry_id, votes vote_id.

    First the same number with titles that don't contradict; then an entry of a part ("5.a") with the vote on the whole ("5");
    then, of what is left, pairs of the same result with enough words in common, best first.
    """
    e, v = entries.select("meeting", "key", "entry_id", F.col("words").alias("ew"), F.col("result").alias("er")), votes.select("meeting", "key", "vote_id", F.col("words").alias("vw"), F.col("result").alias("vr"))
    alike = shared_enough(F.col("ew"), F.col("vw"))
    first = e.join(v, ["meeting", "key"]).where(alike).select("meeting", "entry_id", "vote_id")
    rest = e.join(first.select("entry_id").distinct(), "entry_id", "left_anti")
    whole = rest.withColumn("key", F.regexp_extract("key", r"^(\d+)[.\-]?[a-z0-9]+$", 1)).where("key <> ''")
    second = whole.join(v, ["meeting", "key"]).where(alike).select("meeting", "entry_id", "vote_id")
    used = first.unionByName(second)
    left = e.join(used.select("entry_id").distinct(), "entry_id", "left_anti")
    free = v.join(used.select("vote_id").distinct(), "vote_id", "left_anti")
    both = left.join(free, (left["meeting"] == free["meeting"]) & (F.col("er") == F.col("vr"))).withColumn("n", F.size(F.array_intersect("ew", "vw"))).where("n >= 2")
    scored = both.select(left["meeting"], "entry_id", "vote_id", (F.col("n") / F.least(F.size("ew"), F.size("vw"))).alias("score")).where("score >= 0.3")
    third = greedy(scored, ["meeting"], "entry_id", "vote_id", "score").select("meeting", "entry_id", "vote_id")
    tier = lambda df, n: df.withColumn("tier", F.lit(n))
    return tier(first, 1).unionByName(tier(second, 2)).unionByName(tier(third, 3)).select("entry_id", "vote_id", "tier")


def prefix_names(titles: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """key, name: the known name of which the title is the beginning in whole words. The same name first; else the only one, or
    the one shortest of several; a tie gives none. Both have an array column words; a title meets a name on its own words joined."""
    joined = lambda c: F.array_join(c, " ")
    heads = names.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size("words")), lambda i: joined(F.slice("words", F.lit(1), i)))).alias("head"), joined("words").alias("whole"))
    met = titles.where(F.size("words") > 0).withColumn("head", joined("words")).join(heads, "head")
    w = Window.partitionBy(key)
    ranked = met.withColumn("exact", F.col("head") == F.col("whole")).withColumn("size", F.when(F.col("exact"), 0).otherwise(F.length("name")))
    best = ranked.withColumn("least", F.min("size").over(w)).where("size = least").groupBy(key).agg(F.count("*").alias("n"), F.min("name").alias("name"), F.max("least").alias("least"))
    return best.where("n = 1 OR least = 0").select(key, "name")


def sent_only(events: DataFrame, keys: list[str], at: str, seconds: int) -> DataFrame:
    """event_id, blocked: an event is blocked while one that was sent by its keys is at most that long ago; blocked ones don't
    start a wait of their own, so each decision needs the one before. A key's events pass through one task in order, which
    holds the last time it sent and nothing else."""
    ordered = events.select("event_id", F.concat_ws("\u0001", *keys).alias("__k"), F.unix_micros(F.col(at).cast("timestamp")).alias("__t"))
    ordered = ordered.repartition("__k").sortWithinPartitions("__k", "__t", "event_id")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, 0
        for b in batches:
            out = []
            for k, now in zip(b["__k"], b["__t"], strict=True):
                blocked = k == key and now - last <= seconds * 1_000_000
                if not blocked:
                    key, last = k, now
                out.append(blocked)
            yield pd.DataFrame({"event_id": b["event_id"], "blocked": out})

    return ordered.mapInPandas(decide, f"event_id {dict(events.dtypes)['event_id']}, blocked boolean")


# The arrays that a run's records have.
ROOTS = ["meetings", "agenda_items", "vote_events", "members"]


def malformed_roots(runs: DataFrame, ref: str, text: str) -> DataFrame:
    """A finding for each run whose records aren't an object, else for each array that is missing or no array. Text that isn't JSON is no object."""
    kind = lambda path: F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), path, "variant"))
    rows = runs.select(F.col(ref).cast("string").alias("__ref"), kind("$").startswith("OBJECT").alias("__root"), F.array_compact(F.array(*[F.when(~F.coalesce(kind(f"$.{k}").startswith("ARRAY"), F.lit(False)), F.lit(k)) for k in ROOTS])).alias("__keys"))
    broken = rows.select("__ref", F.explode_outer(F.when(F.coalesce("__root", F.lit(False)), F.col("__keys")).otherwise(F.array(F.lit("records")))).alias("__key")).where("__key is not null")
    message = F.when(F.col("__key") == "records", "not an object").otherwise("missing or not an array")
    return broken.select(*finding("structural", "malformed_root", F.concat_ws(":", "__ref", "__key"), message))
