"""Small cases of the operators."""

import datetime as dt

from pyspark.sql import functions as F

from civicspark.functions import bills, people, text
from civicspark.operators import money, records, seats, temporal, trades

D = dt.date


def test_asof_takes_the_first_point_at_or_after(spark):
    series = spark.createDataFrame([("a", D(2024, 1, 5), 1.0), ("a", D(2024, 1, 9), 2.0), ("b", D(2024, 1, 1), 3.0)], "k string, d date, v double")
    asked = spark.createDataFrame([("a", D(2024, 1, 5)), ("a", D(2024, 1, 6)), ("a", D(2024, 1, 10)), ("c", D(2024, 1, 1)), ("a", None)], "k string, t date")
    got = {(r.k, r.t): r.hit for r in temporal.asof(asked, series, "k", "t", "d", "v").collect()}
    assert got == {("a", D(2024, 1, 5)): 1.0, ("a", D(2024, 1, 6)): 2.0, ("a", D(2024, 1, 10)): None, ("c", D(2024, 1, 1)): None}
    back = {(r.k, r.t): r.hit for r in temporal.asof(asked, series, "k", "t", "d", "v", forward=False).collect()}
    assert back[("a", D(2024, 1, 6))] == 1.0 and back[("a", D(2024, 1, 10))] == 2.0


def test_range_join_has_both_ends(spark):
    left = spark.createDataFrame([("a", D(2024, 3, 1))], "k string, t date")
    right = spark.createDataFrame([("a", D(2024, 3, 1) + dt.timedelta(n)) for n in (-31, -30, 0, 75, 76)], "k string, e date")
    assert sorted(r.gap for r in temporal.range_join(left, right, "k", "t", "e", 30, 75).collect()) == [-30, 0, 75]


def test_intervals_that_touch_merge(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 3, 5), ("a", 7, 8), ("a", 2, 2)], "k string, s int, e int")
    assert sorted((r.s, r.e, r.parts) for r in temporal.merge_intervals(df, "k", "s", "e").collect()) == [(1, 5, 3), (7, 8, 1)]


def test_amount_labels(spark):
    rows = spark.createDataFrame([(0,), (1,), (1000,), (1001,), (60_000_000,)], "low long").select(trades.amount_label(F.col("low")).alias("x")).collect()
    assert [r.x for r in rows] == ["$1–$1K", "$1–$1K", "$1–$1K", "$1K–$15K", "$50M+"]


def test_amended_laws_from_titles_and_summaries(spark):
    cases = [
        ("To amend the Clean Air Act of 1970, and for other purposes.", None, ("Amends", "Clean Air Act")), ("A bill to reauthorize the Farm Program to 2030.", None, ("Reauthorizes", "Farm Program")),
        ("A short title", "This bill is to amend the Public Health Service Act.\nMore to amend nothing, here.", ("Amends", "Public Health Service Act")), ("To amend it.", None, None), ("", "", None),
    ]
    df = spark.createDataFrame([(t, s) for t, s, _ in cases], "t string, s string").select(bills.amends(F.col("t"), F.col("s")).alias("a"))
    assert [tuple(r.a) if r.a else None for r in df.collect()] == [want for _, _, want in cases]


def test_bill_ids_are_whole_questions(spark):
    federal = {"H.R. 3684": ("hr", 3684), "show me s 12": ("s", 12), "H. J. Res. 7.": ("hjres", 7), "what did anyone do about S. 2208": None, "HR 0": None, "hr": None, "SConRes 5": ("sconres", 5)}
    df = spark.createDataFrame([(q,) for q in federal], "q string").select("q", bills.federal_bill(F.col("q")).alias("b"))
    assert {r.q: tuple(r.b) if r.b else None for r in df.collect()} == federal
    state = {"HB 12": ("HB", 12, None), "sb 7 from 2019": ("SB", 7, "2019"), "the AB 5 in the 88th legislature": ("AB", 5, "88"), "LD 3, second session": None}
    df = spark.createDataFrame([(q,) for q in state], "q string").select("q", bills.state_bill(F.col("q")).alias("b"), bills.state_session(F.col("q")).alias("s"))
    assert {r.q: (*r.b, r.s) if r.b else None for r in df.collect()} == state


def test_member_keys(spark):
    names = {"Soto-Mart\u200bínez": "SOTO-MARTINEZ", "CURREN D. PRICE JR.": "PRICE", "Bob Blumenfield": "BLUMENFIELD", "III": "", "": ""}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", people.member_key(F.col("n")).alias("k"))
    assert {r.n: r.k for r in df.collect()} == names


def test_chamber_plans():
    for n, rows in ((5, 2), (100, 5), (1, 3)):
        assert sum(seats.row_sizes(n, rows)) >= n and seats.row_sizes(n, rows) == sorted(seats.row_sizes(n, rows))
        plan = seats.chamber_plan(n, rows)
        assert [s for s, *_ in plan] == list(range(1, n + 1)) and all(-1 <= x <= 1 and 0 <= y <= 1 for _, _, x, y in plan)


def test_character_references(spark):
    df = spark.createDataFrame([("a &amp; b &#233; &#x1F600; &nope; & &lt;",)], "h string").select(text.unescape(F.col("h")).alias("x"))
    assert df.first().x == "a & b é 😀 &nope; & <"


def test_spend_takes_the_first_that_counts(spark):
    rows = spark.createDataFrame([("5", "7"), ("0", "7"), (None, "x"), ("bad", "2.5")], "i string, e string").select(money.spend_of(F.col("i"), F.col("e")).alias("x")).collect()
    assert [r.x for r in rows] == [5.0, 7.0, 0.0, 2.5]


def test_names_that_differ_in_case_merge(spark):
    rows = [(1, "Acme", "client", 2, 10), (1, "ACME", "firm", 5, 7), (1, "Other", "client", 1, 1)]
    got = {r.entity: (r.kind, r.mentions, r.entity_cents) for r in money.merge_names(spark.createDataFrame(rows, "bill int, entity string, kind string, mentions int, entity_cents long")).collect()}
    assert got == {"ACME": ("firm", 7, 10), "Other": ("client", 1, 1)}


def test_reconcile_finds_each_kind(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (3, "x"), (4, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (1, "x"), (2, "y"), (3, "x"), (3, "x"), (5, "x")], "k int, v string")
    assert {r.k: r.check for r in records.reconcile(a, b, "k", "v").collect()} == {2: "mismatch", 3: "multiplicity", 4: "missing_in_second", 5: "missing_in_first"}


def test_consistency_is_silent_on_clean_votes(spark):
    positions = spark.createDataFrame([(1, 1, "aye"), (1, 2, "aye"), (1, 3, "no")], "vote_id int, member int, position string")
    votes = spark.createDataFrame([(1, 2, 1, "pass")], "vote_id int, aye long, no long, result string")
    meetings = spark.createDataFrame([(1,)], "meeting_id int")
    assert not records.consistency(votes, positions, meetings).take(1)
    bad = spark.createDataFrame([(1, 3, 1, "fail"), (2, 0, 0, "fail")], "vote_id int, aye long, no long, result string")
    assert {r.check for r in records.consistency(bad, positions, meetings).collect()} == {"orphan_vote", "count_mismatch", "result_vs_tally"}


def test_floor_vote_needs_a_marker_or_half_of_the_seats(spark):
    rows = [("a", 1, "Motion", 30, 1), ("b", 2, "Third Reading", 30, 1), ("b", 3, "Motion", 90, 1), ("c", 4, None, 80, 1), ("c", 5, "Floor, in committee", 99, 1)]
    got = records.floor_vote(spark.createDataFrame(rows, "bill string, vote_id int, desc string, participation int, day int"), "bill", 100)
    assert sorted(r.vote_id for r in got.collect()) == [2, 4]


def test_members_by_nickname_equal_brute_force(spark):
    import random

    from civicspark.operators import name_search

    rng = random.Random(5)
    first, last = ["Edward", "William A.", "Elizabeth", "Al", "Jo-Ann", "Ted"], ["Lee", "Diaz", "Kim", "Albert", "Lee Kim", "O'Neil"]
    roster = [(i, f"{rng.choice(last)}, {rng.choice(first)}") for i in range(30)] + [(40, None), (41, "")]
    asked = [(i, " ".join(rng.choice(["ted", "Lee", "bill", "liz", "al", "kim,", "o", "x9", "DIAZ", "ted"]) for _ in range(rng.randrange(4)))) for i in range(60)] + [(99, None)]
    want = {}
    for q, text in asked:
        parts = (text or "").lower().split()
        parts += [name_search.NICKNAMES[p] for p in parts if p in name_search.NICKNAMES]
        best = (0, None)
        for m, name in roster:
            words = (name or "").lower().replace(",", "").split()
            score = sum((3 if p == words[0] else 1) for p in parts if words and p in (name or "").lower())
            if score > best[0]:
                best = score, m
        if best[0]:
            want[q] = best[1], best[0]
    got = name_search.best_members(spark.createDataFrame(asked, "q long, t string"), "q", "t", spark.createDataFrame(roster, "m long, n string"), "m", "n")
    assert {r.q: (r.member, r.score) for r in got.collect()} == want and len(want) > 30
