"""The queries, by family; importing this package registers them."""

from ..registry import ORACLES, QUERIES
from . import bill_texts, bills, checks, extracts, lookups, market, minutes, people, places, records, rollups, streams, text, upserts

__all__ = ["ORACLES", "QUERIES", "bill_texts", "bills", "checks", "extracts", "lookups", "market", "minutes", "people", "places", "records", "rollups", "streams", "text", "upserts"]
