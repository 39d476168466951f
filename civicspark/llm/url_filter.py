"""URL filter by a weighted vocabulary and by host rules.

An Aho-Corasick automaton reads each whole URL once, whatever the size of the vocabulary. A term
counts only where no ASCII letter or digit stands directly before or after it. A strict term
rejects a URL alone, soft ones when several distinct ones are hit. A rule on the URL's host or a
domain above it, and on the beginning of its path, goes before the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch

ALLOW, BLOCK = "allow", "block"
#: Terms of which one is enough, and terms of which several are needed.
STRICT = ("casino", "cialis", "escorts", "malware", "phishing", "porn", "porno", "sexcam", "spam", "viagra", "warez", "xxx")
SOFT = ("adult", "bet", "betting", "bonus", "cheap", "crack", "discount", "farm", "free", "jackpot", "keygen", "loan", "loans", "nude", "pills", "poker", "replica", "sexy", "slots", "torrent", "win")
#: Rules as (verdict, host with its path).
RULES = ((BLOCK, "net/"), (ALLOW, "example.net/en/"), (BLOCK, "example.com/de/"), (ALLOW, "org/fr/"))


@dataclass(frozen=True)
class Vocabulary:
    """Terms and how many distinct soft hits reject. Terms are lower-case; one that is both strict and soft is strict; the empty term is none."""

    strict: Sequence[str] = STRICT
    soft: Sequence[str] = SOFT
    several: int = 2

    def automaton(self):
        """The automaton of all terms with their weights (None without terms): a strict term weighs as much as several soft ones."""
        import ahocorasick

        found = ahocorasick.Automaton()
        weights = dict.fromkeys(self.soft, 1) | dict.fromkeys(self.strict, self.several)
        for term, weight in weights.items():
            if term:
                found.add_word(term, (term, weight))
        found.make_automaton()
        return found if len(found) else None


def _lower(text: str) -> str:
    """Only A-Z change, so that no letter grows or shrinks."""
    return text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text)


def _inside(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isascii() and text[at].isalnum()


def hits(automaton, url: str) -> dict[str, int]:
    """The distinct terms that stand in the URL by themselves, with their weights."""
    if automaton is None:
        return {}
    text = _lower(url)
    return {term: weight for end, (term, weight) in automaton.iter(text) if not _inside(text, end + 1) and not _inside(text, end - len(term))}


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lowered) and path of a URL; both empty without ://."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return _lower(host), slash + path


class Rules:
    """Rules by host. Of those that fit the longest wins, then the longer host, then the one that blocks."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[tuple, str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            order = len(rule), len(host), verdict == BLOCK
            self.by_host.setdefault(_lower(host), []).append((order, slash + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule and its verdict."""
        best = None
        domain = host
        while domain:
            for order, begin, rule, verdict in self.by_host.get(domain, ()):
                if path.startswith(begin) and (best is None or order > best[0]):
                    best = order, rule, verdict
            domain = domain.partition(".")[2]
        return best and best[1:]


_JUDGED = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("strict_hits", pa.int32()), ("soft_hits", pa.int32())])
_JUDGED_DDL = "page_id long, host string, path string, rule string, verdict string, strict_hits int, soft_hits int"


def _judge(vocabulary: Vocabulary, rules: Sequence[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, strict, by_host = vocabulary.automaton(), frozenset(vocabulary.strict), Rules(rules)
        for b in batches:
            out = []
            for page_id, url in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                host, path = parts(url)
                found = hits(automaton, url or "")
                rule, verdict = by_host.find(host, path) or (None, BLOCK if sum(found.values()) >= vocabulary.several else ALLOW)
                hard = len(strict.intersection(found))
                out.append((page_id, host, path, rule, verdict, hard, len(found) - hard))
            if out:
                yield batch(dict(zip(_JUDGED.names, zip(*out, strict=True), strict=True)), _JUDGED)

    return run


def judge_urls(pages: DataFrame, vocabulary: Vocabulary = Vocabulary(), rules: Sequence[tuple[str, str]] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits (distinct terms) of every row.

    The vocabulary and the rules are short lists that travel with the tasks. A null URL, or one without
    ://, has an empty host and path, so no rule fits it; its vocabulary hits count all the same (a null
    URL has none). An empty part of a host ("a..net", a dot at the end) is a part like others. Repeated
    rows and null ids are kept, an empty table gives no rows, other columns are ignored.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"))
    return rows.mapInArrow(_judge(vocabulary, rules), _JUDGED_DDL)
