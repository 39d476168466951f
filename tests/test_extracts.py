"""Extractors on hand-made documents, against plain walks, and on nulls, empty documents and repeats."""

import html
import json
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from civicspark.extract import blocks, disclosures, tables, walk
from civicspark.functions import projects

WORDS = blocks.VOTE_WORDS


def walked(page):
    """The blocks of a page, text by text."""
    texts = [t for t in (html.unescape(x).strip() for x in re.sub(r"<[^>]+>", "|", page).split("|")) if t]
    out, i = [], 0
    while i < len(texts):
        if texts[i] != "Meeting Date:" or "Vote Action:" not in texts[i : i + 12]:
            i += 1
            continue
        block = [None, None, None, []]
        if m := re.match(r"(\d\d)/(\d\d)/(\d{4})", texts[i + 1]):
            block[0] = f"{m[3]}-{m[1]}-{m[2]}"
        i += 1
        while i < len(texts) and texts[i] != "Member Name":
            if texts[i] in ("Vote Action:", "Vote Given:"):
                block[1 if texts[i] == "Vote Action:" else 2] = texts[i + 1] if i + 1 < len(texts) else ""
            i += 1
        i += 3
        while i + 2 < len(texts) and texts[i + 2].upper() in WORDS:
            block[3].append((texts[i], WORDS[texts[i + 2].upper()]))
            i += 3
        out.append(tuple(block))
    return out


def test_blocks_equal_a_plain_walk(spark):
    rng = random.Random(3)
    parts = ["Meeting Date:", "Meeting Date:", "01/02/2003", "x", "Vote Action:", "Vote Action:", "Vote Given:", "(9 - 0)", "Member Name", "Member Name", "CD", "Vote", "Ann", "7", "Yes", "NO", "absent", "Excused", "A &amp; B"]
    pages = [(i, "".join(f"<td>{rng.choice(parts)}</td>" for _ in range(rng.randrange(60)))) for i in range(400)] + [(900, None), (901, ""), (902, "no markup | at all")]
    # Between random texts a whole block, so that tables are common.
    whole = "<p>Meeting Date:<p>03/04/2005<p>Vote Action:<p>Adopted  as amended<p>Vote Given:<p>(2-1)<p>Member Name<p>CD<p>Vote" + "<p>Ann<p>1<p>YES<p>Bo &amp; Co<p>2<p>no<p>Cy<p>3<p>Yes"
    pages += [(1000 + i, p[1] + whole * (i % 3) + pages[(i * 7) % 400][1]) for i, p in enumerate(pages[:300])]
    df = spark.createDataFrame(pages, "id long, page string")
    got = {}
    for r in sorted(blocks.vote_blocks(df, "id", "page").collect()):
        got.setdefault(r.id, []).append((r.date, r.action, r.tally, [tuple(v) for v in r.votes]))
    squeezed = lambda b: (b[0], None if b[1] is None else re.sub(r"\s+", " ", b[1]).strip(), b[2], b[3])
    assert got == {i: [squeezed(b) for b in found] for i, p in pages if (found := walked(p or ""))}
    assert any(len(b[3]) > 2 for found in got.values() for b in found)


def test_results_follow_from_votes(spark):
    page = "Meeting Date:|03/04/2005|Vote Action:|Adopted|Member Name|CD|Vote|Ann|1|YES|Bo|2|no|Cy|3|excused|Di|4|pending|Ed|5|yes"
    df = spark.createDataFrame([(1, page), (2, "Meeting Date:|x|Vote Action:|Adopted")], "id long, page string")
    found = blocks.vote_blocks(df, "id", "page")
    assert [tuple(r) for r in blocks.assertions(found, "id").collect()] == [(1, 1, "2005-03-04", "Adopted", 1, 1, 1, 0, "fail")]
    assert [(r.seat, r.name, r.position) for r in blocks.votes(found, "id").orderBy("seat").collect()] == [(1, "Ann", "aye"), (2, "Bo", "no"), (3, "Cy", "absent")]
    assert found.where("id = 2").first().votes == []


PLAN = """Adopted Plan FY 2026
12  Not yet a table   $5
Sources            FY 2026   FY 2027   FY 2028     Total
    ($000)
Parks   and Trails
  Lake Path
   Phase II - 2018 & TBD
Bonds                 $100              $1,200     $1,300
Grants 2019            $20       $30
Bonds                                       $5
Total                 $120       $30    $1,205     $1,355
Total                   $9        $9        $9        $27

Fees                   $11
Page 12
Sources             FY 2026       FY 2027       FY 2028
Loose end
Fees                                  $7
  Another Title.
that goes on.
Fees                     $1
Public Works
12345678
"""


def test_tables_are_read_by_their_own_headings(spark):
    how = tables.Layout(("Parks and Trails", "Public Works"))
    df = spark.createDataFrame([(1, PLAN), (2, None), (3, ""), (4, "Sources  FY 2026  FY 2027\nA title\nFees  $1  $2")], "id long, plan string")
    got = [(r.id, r.project, r.section, r.title, r.funds, r.amounts, r.printed) for r in sorted(tables.projects(df, "id", "plan", how).collect(), key=lambda r: (r.id, r.project))]
    assert got == [
        (1, 1, "Parks and Trails", "Lake Path Phase II - 2018 & TBD", ["Bonds", "Grants 2019"], {"FY2026": 120, "FY2027": 30, "FY2028": 1205}, 1355),
        (1, 2, "Parks and Trails", "Fees", ["Fees"], {"FY2026": 11}, None),
        (1, 3, "Parks and Trails", "Loose end", ["Fees"], {"FY2027": 7}, None),
        (1, 4, "Parks and Trails", "Another Title.", ["Fees"], {"FY2026": 1}, None),
    ]


def test_spans_tell_where_matches_end(spark):
    rng = random.Random(1)
    lines = ["".join(rng.choice(["$1,234", " ", "x", "7", "(9)", ",", "é"]) for _ in range(12)) for _ in range(200)] + ["", None]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    for r in df.select("line", tables.spans(F.col("line"), tables.NUMBER).alias("s")).collect():
        assert r.s is None if r.line is None else [tuple(s) for s in r.s] == [(m[0], m.end()) for m in re.finditer(tables.NUMBER, r.line)]


def test_projects_are_named_and_placed(spark):
    rows = [("Library Renovation - 2018 & 2024", 5, 0, False), ("New Pool - TBD", 0, 3, False), ("Roads", 0, 0, True), ("Annex 2020", 0, 0, False), (None, 1, 0, False)]
    df = spark.createDataFrame(rows, "t string, budget int, ahead int, goes boolean")
    got = df.select(projects.bare_title(F.col("t")), projects.bond_years(F.col("t")), projects.work_type(F.col("t")), projects.status(F.col("budget"), F.col("ahead"), F.lit(0), F.col("goes"))).collect()
    assert [tuple(r) for r in got] == [("Library Renovation", ["2018", "2024"], "renovation", "completed"), ("New Pool", ["TBD"], "new_construction", "active"), ("Roads", [], None, "ongoing"), ("Annex 2020", [], None, "unspecified"), (None, None, None, "completed")]


def test_disclosed_trades(spark):
    text = "\n".join([
        "Filer: Hon. A. Person",
        "SP Apple Inc. (AAPL) [ST]   P  01/02/2024  01/09/2024  $1,001 - $15,000",
        "JT Long Name Holdings   S (partial)  02/03/2024 02/10/2024 $50,001 -",
        "   Class B (BRK.B) [ST]  $100,000",
        "SPDR Fund   E 03/04/2024 03/04/2024 $15,001",
        "   Filing Status: New",
        "Odd one P 03/04/2024 03/04/2024 $, none",
        "x" * 100 + " (TOOLONGX) P 03/04/2024 03/04/2024 $1",
    ])
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (3, "P 01/02/2024 01/02/2024 $5")], "id long, t string")
    got = sorted(tuple(r) for r in disclosures.disclosed_trades(df, "id", "t").fillna("-", ["ticker"]).collect())
    assert got == [
        (1, 2, "AAPL", "Apple Inc.", "buy", "01/02/2024", "$1K–$15K", 1001, "spouse"),
        (1, 3, "BRK.B", "Long Name Holdings Class B", "sell (partial)", "02/03/2024", "$50K–$100K", 50001, "joint"),
        (1, 5, "-", "SPDR Fund", "exchange", "03/04/2024", "$15K–$50K", 15001, ""),
        (1, 8, "-", "x" * 80, "buy", "03/04/2024", "$1–$1K", 1, ""),
        (3, 1, "-", "", "buy", "01/02/2024", "$1–$1K", 5, ""),
    ]


def test_slimming_keeps_what_is_named_and_what_holds_it(spark):
    x = {"value": [{"EventName": "a", "id": 1, "deep": [[{"title": None, "date": ""}], []], "flags": ["", 0, "x", {"n": 1}]}] + [{"time": i} for i in range(60)], "count": 3, "status": False}
    text = json.dumps(x)
    df = spark.createDataFrame([(1, text), (2, None), (3, "{bad"), (4, "[]"), (5, '"x"'), (5, '"x"')], "id long, j string")
    got = [(r.id, r.s) for r in df.select("id", walk.slim_json(F.col("j")).alias("s")).collect()]
    assert got[0] == (1, json.dumps({"value": [{"EventName": "a", "deep": [[{"date": ""}]], "flags": ["x"]}] + [{"time": i} for i in range(39)], "status": False}))
    assert got[1:] == [(2, None), (3, None), (4, "[]"), (5, '"x"'), (5, '"x"')]
    kept = Counter((r.id, r.path, r.value) for r in walk.kept_leaves(df, "id", "j").collect())
    assert kept == Counter([(1, "$.value[0].EventName", "a"), (1, "$.value[0].deep[0][0].date", ""), (1, "$.value[0].flags[2]", "x"), (1, "$.status", "false"), (5, "$", "x"), (5, "$", "x"), *((1, f"$.value[{i + 1}].time", str(i)) for i in range(39))])


def test_deep_documents_are_walked(spark):
    text = "[" * 400 + '{"MatterID": 7}' + "]" * 400
    df = spark.createDataFrame([(1, f'{{"Number": "n", "a": {text}, "b": {{"matterId": 7, "number": "late"}}}}'), (2, None)], "id long, j string")
    assert [tuple(r) for r in walk.nested_records(df, "id", "j", "matterid", {"number": ["file", "number"]}).collect()] == [(1, 1, "7", "n")]


MINUTES = """City Council    Meeting Minutes
Regular session, March 4, 2024 and April 5, 2024
  ROLL CALL
Present: 3 - Council Member Coghill, Council President Strassburger and Council
  Member Wilson
Aye 9 - Nobody
Warwick
Absent 0
   2024-0012  A resolution
City Clerk      Page 2
Lavelle
   Aye: 2 - Council Member Coghill,
    Strassburger
A motion was made by Wilson. The motion failed.
Charland
  No 1 - Wilson
The motion carried. Enactment No: 77
   2024-0013 Another one
  Aye: 1 - Coghill
  Aye: 2 - Coghill and
 Mosley
Recused: 1
   2024-0012  The first again
Enactment No: 78 x
Enactment No: 79
"""


def test_minutes_are_read_line_by_line(spark):
    from civicspark.extract import minutes

    df = spark.createDataFrame([(1, MINUTES), (2, None), (3, ""), (4, "   2024-0001 lone\n  Present 1 - A. Person")], "id long, t string")
    lines = minutes.read_lines(df, "id", "t", [r"^City Council\s+Meeting Minutes", r"^City Clerk\s+Page \d+"])
    got = sorted((r.id, r.entry, r.item, r.position, r["count"], r.members) for r in minutes.positions(lines, "id").collect() if r.entry)
    assert got == [(1, 1, "2024-0012", "aye", 2, ["Coghill", "Strassburger"]), (1, 1, "2024-0012", "no", 1, ["Wilson"]), (1, 2, "2024-0013", "aye", 2, ["Coghill", "Mosley"]), (1, 2, "2024-0013", "recused", 1, []), (4, 1, "2024-0001", "present", 1, ["A. Person"])]
    roll = {(r.id, r.position): r.members for r in minutes.positions(lines, "id").collect() if not r.entry}
    assert roll == {(1, "present"): ["Coghill", "Strassburger", "Wilson", "Warwick"], (1, "absent"): []}
    assert sorted((r.id, r.entry, r.result, r.enactment) for r in minutes.outcomes(lines, "id").collect() if r.id == 1) == [(1, 1, "pass", "77"), (1, 2, None, None), (1, 3, None, "79")]
    assert {r.id: r.date for r in minutes.dates(lines, "id").collect()} == {1: "2024-03-04", 3: None, 4: None}


def test_jobs_certify_what_a_second_source_says_too(spark):
    from civicspark.extract import jobs

    text = "\n".join([
        "Item 1: Yea: (2) Ann Lee, Bo Kim Nay: (1) Cy Diaz", "Item 2: Yea: (0) Nay: (0)", "Item 3: Yea: (1) Lee Nay: (1) LEÉ", "no item: Yea: (1) Lee", "Item 4: AYE 1 - Lee, Notes; NAY 2 - Kim, Diaz",
        "Item 5: Motion carried, Kim and Cruz voting nay; Diaz abstaining", "Item 6: withdrawn", "Item 7: Yea: (1) Kim",
    ])
    docs = spark.createDataFrame([("d", text), ("e", None), ("f", "")], "doc string, text string")
    said = spark.createDataFrame([("d", "1", "pass"), ("d", "3", "pass"), ("d", "4", "pass"), ("d", "5", "fail"), ("d", "5", "fail")], "doc string, item string, result string")
    got = {name: sorted((r.item, r.aye, r.no, r.result, r.status) for r in jobs.run(name, docs, said).collect()) for name in ("tally_lines", "counted_lines", "narrative", "unverified")}
    assert got["tally_lines"] == [("1", 2, 1, "pass", "certified"), ("3", 1, 1, "fail", "quarantined"), ("7", 1, 0, "pass", "quarantined")]
    assert got["counted_lines"] == [("4", 1, 2, "fail", "disputed")]
    assert got["narrative"] == [("5", 1, 2, "fail", "certified")] and got["unverified"] == []
    assert sorted((r["check"], r.item) for r in jobs.findings(jobs.EXTRACTORS["tally_lines"](docs)).collect()) == [("two positions", "3")]
    page = spark.createDataFrame([("p", "Meeting Date:|03/04/2005|Vote Action:|Adopted|Member Name|CD|Vote|Ann|1|YES"), ("m", "   2024-0001 x\n  Aye: 1 - Council Member Coghill")], "doc string, text string")
    assert [tuple(r) for r in jobs.EXTRACTORS["council_file"](page).collect()] == [("p", "Adopted", "Ann", "aye", "2005-03-04 Adopted")]
    assert [tuple(r) for r in jobs.EXTRACTORS["printed_minutes"](page).collect()] == [("m", "2024-0001", "Coghill", "aye", "Aye 1")]


def test_writers_and_readers_stay_within_what_the_jvm_compiles_and_read_documents_once(spark):
    """A method of more than 8000 bytes is never compiled; a second scan of a table but for its own join is a document read twice."""
    from civicspark.plans import extracts

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        written = extracts._written(spark, "/root/testdata/sf0.001", extracts._plan_texts(False), "lineitem", "orders")
        code = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenString(written._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(extracts.project_tables(spark, "/root/testdata/sf0.001")).count("posexplode") == 1


def test_spans_and_ties_between_headings(spark):
    how = tables.Layout(("Parks",))
    lines = ["Sources    FY 2024   FY 2025   FY 2026     Total", "a1 (2,000) x 30", "none", ""]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").select("i", tables.spans(F.col("line"), tables.NUMBER).alias("s")).orderBy("i").collect()
    assert [[(x.text, x.end) for x in r.s] for r in rows] == [[("2024", 18), ("2025", 28), ("2026", 38)], [("1", 2), ("(2,000)", 10), ("30", 15)], [], []]
    # Its end stands between two columns: the first one counts; between a year and the total: the year.
    text = "\n".join([lines[0], "Bonds" + "7".rjust(18) + "9".rjust(20), "Total" + "16".rjust(43)])
    docs = spark.createDataFrame([("d", text), ("e", None)], "doc string, text string")
    got = tables.projects(docs, "doc", "text", how).collect()
    assert [(r.doc, r.project, r.amounts, r.printed) for r in got] == [("d", 1, {"FY2024": 7, "FY2026": 9}, 16)]


def test_results_count_each_vote_once(spark):
    """The filter on counts was pushed below them, where it computed the votes again for each word."""
    page = "<b>Meeting Date:</b><i>01/02/2003</i><p>Vote Action:|Adopted</p><th>Member Name</th><th>CD</th><th>Vote</th><td>A</td><td>1</td><td>Yes</td><td>B</td><td>2</td><td>No</td><p>end</p>"
    found = blocks.assertions(blocks.vote_blocks(spark.createDataFrame([(1, page), (2, None), (3, page.replace("Yes", "?"))], "k int, h string"), "k", "h"), "k")
    assert [(r.k, r.block, r.aye, r.no, r.result) for r in found.collect()] == [(1, 1, 1, 1, "fail")]
    filters = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in line]
    assert not any("= aye" in line for line in filters)
