"""Capital projects, Column to Column: bond years in titles, kinds of work, where a project stands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The years of bond votes at a title's end, and words of kinds of work, the first that fits counts.
BOND = r"\s*-\s*((?:\d{4}|TBD)(?:\s*(?:&|and|,|/)\s*(?:\d{4}|TBD))*)\s*$"
WORK = [("renovation", r"renovation|moderniz|retrofit|rehabilit"), ("new_construction", r"shell building|repurpos|\bnew\b"), ("addition", r"addition|expansion|capacity|modular|modification")]


def bond_years(title: Column) -> Column:
    """The years (or TBD) after the last dash of a title; none without."""
    return F.regexp_extract_all(F.regexp_extract(title, BOND, 1), F.lit(r"(\d{4}|TBD)"), F.lit(1))


def bare_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, BOND, ""))


def work_type(title: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(title).rlike(p), kind) for kind, p in WORK])


def status(budget: Column, ahead: Column, future: Column, continuing: Column) -> Column:
    """completed: money was budgeted and none lies ahead; ongoing: it goes on without end; active: money lies ahead."""
    return (
        F.when((ahead == 0) & (future == 0) & (budget > 0) & ~continuing, "completed").when(continuing, "ongoing")
        .when((ahead > 0) | (future > 0), "active").otherwise("unspecified")
    )
