"""Resampling, divergence and URL rules against brute force and SQL, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from civicspark.llm import common, divergence, importance, queries, url_filter

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, weight string, rank int"
ODD = [(1, None, None, None, "w", 1), (2, "", "en", "a", "w", 1), (2, "", "en", "a", "w", 1), (None, "ghost words " * 30, "en", "b", "w", 1), (3, "Ünï 漢字x A1b\x00c é " * 40, "en", "a", None, None), (4, "one", "", "", "x", 2), (5, "long words here " * 30_000, "en", "b", "y", 3), (5, "long words here " * 30_000, "en", "b", "y", 3)]
ITEMS = [(1, "long words here ghost", "k"), (2, None, "k"), (3, "", "k"), (None, "Ünï 漢字x", "k")]


def sql_rows(name, tables):
    con = duckdb.connect()
    for t, path in tables.items():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    rel = con.execute(f"SELECT * FROM ({queries.ORACLES[name]}) z")
    names = [c[0] for c in rel.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(r[i] for i in order) for r in rel.fetchall())


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_source_divergence", "op13_url_filter", "op4_ngram_join", "op10_warc"])
def test_queries_equal_their_sql(spark, name):
    names, want = sql_rows(name, {t: f"{DIR}/{t}.parquet" for t in ("documents", "benchmark", "pages")})
    got = queries.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == names
    assert Counter(tuple(r) for r in got.select(names).collect()) == want


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resample(docs, items, least_words=20, percent=5):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for text in texts for f in features(text)[1]) for texts in ([d[1] for d in docs], [i[1] for i in items]))
    big, small = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * big / ((s[b] + 1) * small))) for b in range(10_000)]
    out, drawn = [], []
    for doc_id, text, *_ in docs:
        words, fs = features(text)
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, len(words), len(fs), weight, score))
        if len(words) >= least_words:
            drawn.append((-score, doc_id is None, doc_id or 0))
    place = defaultdict(list)
    for rank, x in enumerate(sorted(drawn), 1):
        place[x].append(rank if rank <= percent * len(drawn) // 100 else None)
    return Counter((*r, place[-r[4], r[0] is None, r[0] or 0].pop() if r[1] >= least_words else None) for r in out)


def test_resampling_equals_brute_force_on_odd_rows(spark):
    want = plain_resample(ODD, ITEMS, percent=50)
    df, items = spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string, bucket string")
    got = importance.resample(df, items, percent=50)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == want
    assert importance.resample(df.limit(0), items).collect() == []
    assert Counter(map(tuple, importance.resample(df, items.limit(0), percent=50).collect())) == plain_resample(ODD, [], percent=50)


@pytest.mark.parametrize("block", [1, 7, 40, 1 << 20])
def test_runs_are_counted_once_however_texts_are_cut(monkeypatch, block):
    monkeypatch.setattr(importance, "BLOCK", block)
    monkeypatch.setattr(importance, "VOCABULARY", 3)
    import pyarrow as pa

    texts = ["a b a b c", "", "one", "x y", "The the THE the", "é é é é é é é é é", "p q r s t u v w x y z " * 3, "  "]
    table = pa.record_batch({"doc_id": list(range(len(texts))), "text": [t.encode() for t in texts]})
    got = next(importance._bucket_counts(iter([pa.record_batch({"text": table["text"]})])))
    want = Counter(zlib.crc32(f.encode()) % 10_000 for t in texts for f in features(t)[1])
    assert dict(zip(got["bucket"].to_pylist(), got["n"].to_pylist(), strict=True)) == want
    gain = np.arange(10_000) * 7 - 30_000
    rows = [tuple(r.values()) for b in importance._weigher(gain)(iter([table, table.slice(0, 0), table.slice(3)])) for r in b.to_pylist()]
    plain = [(i, len(features(t)[0]), len(features(t)[1]), sum(int(gain[zlib.crc32(f.encode()) % 10_000]) for f in features(t)[1])) for i, t in enumerate(texts)]
    assert rows == plain + plain[3:]


def test_states_of_nodes_go_on_from_their_parents():
    builder = importance.TrieBuilder()
    words = [b"to", b"be", b"o" * 64, "né".encode(), b"to", b"be"]
    trie = builder.build(words, np.zeros(6, np.int64), np.ones(6, bool))
    assert [len(s) for s in trie.states] == [4, 4, 4]
    for n, (states, ends) in enumerate(zip(trie.states, trie.ends, strict=True), 1):
        assert [int(states[e]) if e >= 0 else None for e in ends] == [zlib.crc32(b" ".join(words[i - n + 1 : i + 1])) if i >= n - 1 else None for i in range(6)]


def test_ranks_hold_over_many_tasks_and_ties(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "cast(id % 3 as long) as score")
    got = {r.doc_id: r.rank for r in importance.ranked(df, df.doc_id >= 100, 10).collect()}
    order = sorted(range(100, 5000), key=lambda i: (-(i % 3), i))[:490]
    assert got == dict.fromkeys(range(5000)) | {d: i + 1 for i, d in enumerate(order)}


def plain_audit(docs, least, top):
    docs = [((l or ""), (s or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t, l, s, *_ in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = sorted(t for t, n in Counter(t for d in own for t in set(d[2])).items() if n >= least)
        sources = sorted({d[1] for d in own})

        def shares(rows, kept=kept):
            c = Counter(t for d in rows for t in d[2])
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: (1 + 10**9 * (c[t] + 5) // total, c[t]) for t in kept}

        whole, by = shares(own), {s: shares([d for d in own if d[1] == s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(abs(by[s][t][0] - by[o][t][0]) for t in kept)) for o in sources if o != s]
            terms = [(t, by[s][t][0] - whole[t][0]) for t in kept if by[s][t][1] and by[s][t][0] > whole[t][0]]
            for part, rows in (("pair", pairs), ("term", terms)):
                ordered = sorted(rows, key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ordered, 1) if part == "pair" or i <= top]
    return Counter(out)


def test_divergence_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"w{chr(97 + i)}" for i in range(26)] + ["Éa", "ea", "漢", "MIX"]
    docs = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 30)))) + ("1 2-3" if i % 2 else ""), ["en", "fr", None][i % 3], f"s{int(rng.integers(0, 6)) * int(rng.integers(0, 2))}") for i in range(120)]
    docs += [(200, None, "en", "empty"), (201, "lone", "de", "x"), (202, "!!", "fr", None)] + [d[:4] for d in ODD]
    df = spark.createDataFrame([(*d, "t", 1) for d in docs], "doc_id long, text string, lang string, source string, term string, n int")
    for least, top in ((1, 3), (9, 50), (1000, 5)):
        assert Counter(map(tuple, divergence.audit(df, least, top).collect())) == plain_audit(docs, least, top)
    assert divergence.audit(df.limit(0)).collect() == []


def test_shares_of_counts_beyond_64_bits(spark):
    df = spark.createDataFrame([(7 * 10**12, 9 * 10**12, 10**6), (0, 0, 0)], "n long, total long, terms long")
    assert [r[0] for r in df.select(divergence.share(df.n, df.total, df.terms)).collect()] == [1 + 10**9 * (7 * 10**12 + 5) // (9 * 10**12 + 5 * 10**6), None]


def test_terms_are_counted_the_same_however_texts_are_cut(monkeypatch):
    import pyarrow as pa

    rows = pa.record_batch({"lang": ["en"] * 4, "source": ["a", "a", "b", "b"], "text": [b"To be or not to be", b"be", b"", b"to-be 9 to"]})
    pieces = common.word_pieces
    for step, gather in ((8 << 20, 1 << 20), (1, 1)):
        monkeypatch.setattr(divergence, "GATHER", gather)
        monkeypatch.setattr(divergence, "word_pieces", lambda t, table, step=step: pieces(t, table, step))
        total = Counter()
        for b in divergence._count(iter([rows])):
            for r in b.to_pylist():
                total[r["source"], r["term"], "n"] += r["n"]
                total[r["source"], r["term"], "docs"] += r["docs"]
        assert {k: v for k, v in total.items() if v} == {("a", "to", "n"): 2, ("a", "to", "docs"): 1, ("a", "be", "n"): 3, ("a", "be", "docs"): 2, ("a", "or", "n"): 1, ("a", "or", "docs"): 1, ("a", "not", "n"): 1, ("a", "not", "docs"): 1, ("b", "to", "n"): 2, ("b", "to", "docs"): 1, ("b", "be", "n"): 1, ("b", "be", "docs"): 1}


URLS = [
    (None, "", "", None, "allow"), ("no scheme casino", "", "", None, "block"), ("http://", "", "", None, "allow"), ("http://A.NET", "a.net", "", None, "allow"), ("http://A.NET/x?y=/z#w", "a.net", "/x", "net/", "block"),
    ("https://www.Example.net/en/1", "www.example.net", "/en/1", "example.net/en/", "allow"), ("https://notexample.net/en/1", "notexample.net", "/en/1", "net/", "block"), ("https://example.com/de/casino", "example.com", "/de/casino", "example.com/de/", "block"),
    ("https://casino.org/fr/", "casino.org", "/fr/", "org/fr/", "allow"), ("https://casino.org/FR/", "casino.org", "/FR/", None, "block"), ("https://Casino1.org/", "casino1.org", "/", None, "allow"), ("https://a.com/cheap", "a.com", "/cheap", None, "allow"),
    ("https://cheap.com/cheap-cheap", "cheap.com", "/cheap-cheap", None, "allow"), ("https://a.com?q=cheap#PILLS", "a.com", "", None, "block"), ("https://a.com/freewin", "a.com", "/freewin", None, "allow"), ("https://a.com/é casino é", "a.com", "/é casino é", None, "block"),
    ("https://a..net./x", "a..net.", "/x", None, "allow"), ("https://.net/x", ".net", "/x", "net/", "block"), ("x://y://z/w", "y:", "//z/w", None, "allow"), ("https://ÀXXX.com/", "Àxxx.com", "/", None, "block"), ("", "", "", None, "allow"),
]


def test_urls_are_judged(spark, tmp_path):
    df = spark.createDataFrame([(i, u, "h") for i, (u, *_) in enumerate(URLS)] + [(None, "http://b.net/", "h"), (0, None, "h")], "page_id long, url string, host string")
    got = url_filter.judge_urls(df)
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == Counter([(i, *x) for i, (_, *x) in enumerate(URLS)] + [(None, "b.net", "/", "net/", "block"), (0, "", "", None, "allow")])
    df.write.parquet(f"{tmp_path}/pages")
    names, want = sql_rows("op13_url_filter", {"pages": f"{tmp_path}/pages/*.parquet"})
    assert Counter(tuple(r) for r in got.select(names).collect()) == want
    assert url_filter.judge_urls(df.limit(0)).collect() == []


def test_vocabulary_against_plain_search():
    rng = np.random.default_rng(4)
    vocabulary = url_filter.Vocabulary(strict=("ab", "a-b", ""), soft=("a", "b", "aba", "bb", "ab"))
    automaton = vocabulary.automaton()
    for _ in range(500):
        url = "".join(rng.choice(list("abAB-1./é"), int(rng.integers(0, 14))))
        want = {t for t in ("ab", "a-b", "a", "b", "aba", "bb") if re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", re.sub("[AB]", lambda m: m[0].lower(), url))}
        assert set(url_filter.hits(automaton, url)) == want
    assert url_filter.hits(url_filter.Vocabulary((), ()).automaton(), "http://casino") == {}


def test_the_longest_rule_wins():
    rules = url_filter.Rules([("block", "b.com/"), ("allow", "a.b.com/"), ("allow", "b.com/x/"), ("block", "b.com/x/"), ("allow", "com/x/y/z")])
    assert rules.find("a.b.com", "/x/y/z") == ("com/x/y/z", "allow") and rules.find("a.b.com", "/x/") == ("a.b.com/", "allow")
    assert rules.find("c.b.com", "/x/") == ("b.com/x/", "block") and rules.find("c.b.com", "/") == ("b.com/", "block") and rules.find("com", "/") is None and rules.find("xb.com", "/x/") is None
