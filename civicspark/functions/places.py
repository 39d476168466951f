"""States by name, code and number; acts by their short names. Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# States by name, by their Census numbers, and acts by what they are called.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "district of columbia": "DC", "florida": "FL",
    "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD",
    "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ",
    "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI",
    "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI",
    "wyoming": "WY", "puerto rico": "PR",
}
FIPS = {
    "01": "AL", "02": "AK", "04": "AZ", "05": "AR", "06": "CA", "08": "CO", "09": "CT", "10": "DE", "11": "DC", "12": "FL", "13": "GA", "15": "HI", "16": "ID", "17": "IL", "18": "IN", "19": "IA",
    "20": "KS", "21": "KY", "22": "LA", "23": "ME", "24": "MD", "25": "MA", "26": "MI", "27": "MN", "28": "MS", "29": "MO", "30": "MT", "31": "NE", "32": "NV", "33": "NH", "34": "NJ", "35": "NM",
    "36": "NY", "37": "NC", "38": "ND", "39": "OH", "40": "OK", "41": "OR", "42": "PA", "44": "RI", "45": "SC", "46": "SD", "47": "TN", "48": "TX", "49": "UT", "50": "VT", "51": "VA", "53": "WA",
    "54": "WV", "55": "WI", "56": "WY", "60": "AS", "66": "GU", "69": "MP",
}
ACRONYMS = {
    "genius act": "Guiding and Establishing National Innovation for US Stablecoins stablecoin payment", "genius": "Guiding and Establishing National Innovation for US Stablecoins stablecoin",
    "cara": "Comprehensive Addiction and Recovery Act", "aca": "Affordable Care Act", "chips act": "Creating Helpful Incentives to Produce Semiconductors", "fisa": "Foreign Intelligence Surveillance Act",
    "ndaa": "National Defense Authorization Act", "vawa": "Violence Against Women Act", "essa": "Every Student Succeeds Act", "snap": "Supplemental Nutrition Assistance Program",
    "tanf": "Temporary Assistance for Needy Families", "title ix": "Title IX", "title 9": "Title IX",
}
#: Values of votes as a meeting system has them; others are taken in lower case.
VOTE_VALUES = {"Aye": "aye", "Yea": "aye", "No": "no", "Nay": "no", "Abstain": "abstain", "Absent": "absent", "Present": "present", "Recused": "recused", "Recuse": "recused"}
#: State names as one pattern, the longest first, so that a name within another isn't taken for it.
ANY_STATE = r"\b(" + "|".join(sorted(STATES, key=lambda n: (-len(n), n))) + r")\b"


def _of(text: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), text)


def usps(state: Column) -> Column:
    """The code of a state's name or code, in any case; null of what is neither."""
    plain = F.trim(state)
    return F.coalesce(_of(F.lower(plain), STATES), F.when(F.upper(plain).isin(sorted(set(STATES.values()))), F.upper(plain)))


def of_fips(number: Column) -> Column:
    return _of(F.lpad(number.cast("string"), 2, "0"), FIPS)


def state_in(text: Column) -> Column:
    """The code of the first state that a text names."""
    return _of(F.regexp_extract(F.lower(text), ANY_STATE, 1), STATES)


def act_called(text: Column) -> Column:
    """What the first short name, in the list's order, that a text holds stands for."""
    return F.coalesce(*[F.when(F.lower(text).contains(k), v) for k, v in ACRONYMS.items()])


def vote_value(value: Column) -> Column:
    return F.coalesce(_of(value, VOTE_VALUES), F.lower(value))
