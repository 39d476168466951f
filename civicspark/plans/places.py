"""States, acts and vote values by the fixed tables, each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import phrase
from ..functions import places as p
from ..io import table
from ..registry import query

_TITLES = phrase("o_orderkey", ["West Virginia Primary {n}", "Virginia governor", "Arkansas runoff", "{n} vote in New York", "Statewide vote", "KANSAS and Iowa", "Washington County, Oregon", "Virginian affairs"], n="o_custkey")
_STATE = phrase("o_orderkey", ["ny", " New York ", "XX", "puerto rico", "Wy", "district of columbia", "", "NORTH DAKOTA"])
_TOPICS = phrase("o_orderkey", ["the GENIUS Act", "genius grants {n}", "SNAP rules", "Title 9 in schools", "farm bill {n}", "NDAA and FISA", "vacation"], n="o_custkey")
_VALUES = phrase("l_partkey", ["Aye", "Yea", "No", "Nay", "Recuse", "Excused", "ABSENT", "Absent", "Present"])


def _map(names: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in names.items()) + "}"


@query("state_names_in_text", f"""WITH q AS (SELECT o_orderkey, lower({_TITLES}) AS t FROM orders) SELECT o_orderkey, {_map(p.STATES)}[regexp_extract(t, '{p.ANY_STATE}', 1)] AS state FROM q WHERE regexp_matches(t, '{p.ANY_STATE}')""")
def state_names_in_text(spark, d):
    """The first state that a title names, the longest name at a place."""
    return table(spark, d, "orders").select("o_orderkey", p.state_in(F.expr(_TITLES)).alias("state")).where("state is not null")


@query("state_codes", f"""WITH q AS (SELECT o_orderkey, trim({_STATE}) AS t, lpad(CAST(o_custkey % 80 AS STRING), 2, '0') AS n FROM orders) SELECT o_orderkey, coalesce({_map(p.STATES)}[lower(t)], CASE WHEN list_contains(map_values({_map(p.STATES)}), upper(t)) THEN upper(t) END) AS code, {_map(p.FIPS)}[n] AS by_number FROM q""")
def state_codes(spark, d):
    """States by name or code, and by their Census numbers."""
    return table(spark, d, "orders").select("o_orderkey", p.usps(F.expr(_STATE)).alias("code"), p.of_fips(F.col("o_custkey") % 80).alias("by_number"))


@query("acts_by_short_name", f"""WITH q AS (SELECT o_orderkey, lower({_TOPICS}) AS t FROM orders) SELECT o_orderkey, CASE {" ".join(f"WHEN contains(t, '{k}') THEN '{v}'" for k, v in p.ACRONYMS.items())} END AS act FROM q""")
def acts_by_short_name(spark, d):
    return table(spark, d, "orders").select("o_orderkey", p.act_called(F.expr(_TOPICS)).alias("act"))


@query("vote_values", f"""WITH q AS (SELECT l_orderkey, {_VALUES} AS v FROM lineitem) SELECT l_orderkey, coalesce({_map(p.VOTE_VALUES)}[v], lower(v)) AS position, count(*) AS n FROM q GROUP BY 1, 2""")
def vote_values(spark, d):
    """Positions of a meeting system's vote values; what its table lacks stays, in lower case."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", p.vote_value(F.expr(_VALUES)).alias("position")).agg(F.count("*").alias("n"))
