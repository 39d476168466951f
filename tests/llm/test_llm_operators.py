"""The operators against brute force, exact round trips and held-out labels, and on odd rows."""

import base64
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from civicspark.llm import decontaminate, html_text, lm_ctw, media_avi, ngram_join, packing, quality_cnn, queries, sharding, token_files, warc

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, key string, place int, length long"
ODD = [(1, None, "a", 1, 1), (2, "", "a", 1, 1), (3, " \n\t ", None, None, None), (4, "one", "b", 2, 2), (4, "one", "b", 2, 2), (None, "ghost", "c", 3, 3), (5, "Ünïcode 漢字 \x00 text " * 9, "d", 4, 4), (6, "long words here " * 40_000, "e", 5, 5)]


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.execute(f"SELECT doc_id, coalesce(text, '') FROM '{DIR}/documents.parquet'").fetchall())


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def rows(spark, name):
    return queries.QUERIES[name](spark, DIR).collect()


def test_quality_on_held_out_labels(spark):
    labels = dict(duckdb.execute(f"SELECT doc_id, quality FROM '{DIR}/labels.parquet'").fetchall())
    got = rows(spark, "op1_quality_cnn")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    held = [r.predicted == labels[r.doc_id] for r in got if r.held_out and r.doc_id in labels]
    assert np.mean(held) > 0.8


def test_media_round_trip(spark, docs):
    for r in rows(spark, "op2_media_avi"):
        raw = docs[r.doc_id].encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_packing_bounds_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(30):
        hist = [(int(n), int(rng.integers(1, 9))) for n in sorted(rng.choice(40, 7, replace=False) + 1)]
        waste = lambda bounds: sum((min(b for b in bounds if b >= n) - n) * c for n, c in hist)
        for k in (1, 2, 3, 7):
            best = min(waste((*cut, hist[-1][0])) for cut in itertools.combinations([n for n, _ in hist[:-1]], k - 1))
            assert waste(packing.optimal_boundaries(hist, k)) == best


def test_packing_batches_hold_their_budget(spark):
    by = defaultdict(list)
    for r in rows(spark, "op3_packing"):
        assert r.bucket_tokens >= r.n_tokens and r.padding == r.bucket_tokens - r.n_tokens
        by[r.bucket, r.batch].append(r)
    for batch in by.values():
        assert len(batch) == 1 or sum(r.bucket_tokens for r in batch) <= 65_536
        assert sorted(r.place for r in batch) == list(range(len(batch)))


def test_packing_stays_optimal_beside_a_long_text(spark):
    lengths = [3, 3, 3, 3, 3, 4, 6, 7, 7, 7, 8, 31, 31, 33, 70_001]
    df = spark.createDataFrame([(i, "w " * (n - 1)) for i, n in enumerate(lengths)], "doc_id long, text string")
    waste = lambda bounds: sum(min(b for b in bounds if b >= n) - n for n in lengths)
    for k in (3, 4, 5):
        got = packing.pack_documents(df, buckets=k).collect()
        assert sorted(r.n_tokens for r in got) == lengths and {r.bucket_tokens for r in got} <= set(lengths)
        best = min(waste((*cut, 70_001)) for cut in itertools.combinations(sorted(set(lengths))[:-1], k - 1))
        assert sum(r.padding for r in got) == best


def grams(text, n):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize("how", [ngram_join.Similarity(), ngram_join.Similarity(ngram=5, num=80)])
def test_ngram_join_against_all_pairs(spark, how):
    rng, vocabulary = np.random.default_rng(5), [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(25):
        base = list(rng.choice(vocabulary, int(rng.integers(1, 120))))
        for edits in (0, 0, 1, 2, 4, 8):
            t = list(base)
            for _ in range(edits):
                t[int(rng.integers(len(t)))] = str(rng.choice(vocabulary))
            texts.append(" ".join(t))
    sets = [grams(t, how.ngram) for t in texts]
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and how.den * both >= how.num * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    got = ngram_join.similar_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), how).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 5, 300)] + [np.zeros(0, np.uint64)]
    maps = ngram_join.parity(sets)
    for i, j in itertools.combinations(range(len(sets)), 2):
        assert sum(int(x).bit_count() for x in (maps[i] ^ maps[j]).view(np.uint64)) <= len(np.setxor1d(sets[i], sets[j]))


def test_decontamination_finds_planted_passages_and_spares_others(spark):
    rng = np.random.default_rng(2)
    prose = lambda n: " ".join(rng.choice([f"v{i}" for i in range(5000)], n))
    items = [(i, prose(40)) for i in range(12)] + [(90, None), (91, "")]
    docs = [(i, f"{prose(200)} {items[i % 12][1].upper()}. {prose(150)}") for i in range(24)] + [(100 + i, prose(300)) for i in range(20)] + [(200, items[3][1]), (201, None)]
    changed = items[5][1].split()
    changed[20] = "changed"
    docs.append((300, f"{prose(50)} {' '.join(changed)} {prose(20)}"))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(i, i % 12) for i in range(24)} | {(200, 3)}
    assert not [r for r in got if 100 <= r.doc_id < 200 or r.doc_id == 201 or r.similarity < 0.8]


def test_html_keeps_the_article_alone(spark):
    body = "<p>First &amp; foremost, a long paragraph of the article that says quite a lot about its subject.</p><p>And a second\n one,  with <b>bold</b> words &#233;t more prose to read.</p>"
    page = f"<html><head><title>T</title><script>x()</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article>{body}</article><footer>Copyright</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page, "x"), (2, "u", None, "x"), (3, None, "", "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract_text(df).collect()}
    assert got[1].text == "First & foremost, a long paragraph of the article that says quite a lot about its subject. And a second one, with bold words ét more prose to read."
    assert all(got[i].text == "" and got[i].n_chars == 0 for i in (2, 3))


PROSE = "A long paragraph of the article that says quite a lot about its subject, and more."


@pytest.mark.parametrize("page", [
    "<div class='layout with-sidebar'><article><p>{}</p></article></div>",
    "<body class='x'><div class='no-sidebar has-comments' id='social-science'><main><p>{}</p></main></div></body>",
    "<div id=search-results><p>{}</p></div><footer>Copyright</footer>",
    "<body><form action='/'><nav><a href='/'>Home</a></nav><div><p>{}</p></div></form></body>",
    "<main><form><p>{}</p></form></main>",
    "<div class=sidebar><article><p>{}</p></article></div>",
    "<article><p>{}</p></article><footer>" + "Longer than the article. " * 9 + "</footer>",
    "<article><p title='a hidden gem'>{}</p></article>",
    "<article><div data-id='search' data-class=nav><p>{}</p></div></article>",
    "<article><p>{}</p><div class='box comments'>Nice post <article>I agree</article></div><div hidden>Not seen</div></article><div id='sidebar'>Elsewhere</div>",
])
def test_html_drops_nothing_for_a_name_alone(page):
    assert html_text.main_text(page.format(PROSE)) == PROSE


def test_shards_are_level_and_keep_copies_together(spark, docs):
    load, slots, places = Counter(), defaultdict(list), defaultdict(set)
    for r in rows(spark, "op7_sharding"):
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        places[raw].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(p) == 1 for p in places.values())
    # No shard is fuller than the mean by more than the largest group that has to stay together.
    group = Counter()
    for raw in map(str.encode, docs.values()):
        group[raw] += len(raw) + 8
    assert set(load) == set(range(24)) and max(load.values()) - min(load.values()) <= max(group.values())


def test_lm_base_scores(spark, docs):
    tokens = {d: [*WORD.findall(lower(t)), None] for d, t in docs.items()}
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    counts = Counter(w for d, ts in tokens.items() if not held(d) for w in ts)
    n, v = sum(counts.values()), len(counts)
    for r in rows(spark, "op8_lm_ctw"):
        ts = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(ts), sum(counts[w] > 0 for w in ts), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts), rel_tol=1e-9)
        assert r.score < 0


def test_token_files(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, {}
    for d in sorted(docs):
        ids = [*tokenizer.encode(docs[d], add_special_tokens=False).ids, 2]
        want[d] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows(spark, "op9_token_files")} == want


def test_warc_records(spark):
    pages = duckdb.execute(f"SELECT page_id, coalesce(html, '') FROM '{DIR}/pages.parquet'").fetchall()
    owner = {}
    for p, h in pages:
        owner[h] = max(p, owner.get(h, p))
    want = {p: (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if owner[h] == p else "revisit", None if owner[h] == p else owner[h]) for p, h in pages}
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows(spark, "op10_warc")} == want


def test_warc_writes_every_row_and_checks_revisits(spark, tmp_path):
    rows = [(1, "a", "x"), (1, "b", "y"), (1, "b", "y"), (2, "c", "x"), (3, None, None), (None, "d", "x"), (None, "e", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages")
    want = duckdb.execute(f"WITH pages AS (SELECT * FROM '{tmp_path}/pages/*.parquet') {queries.ORACLES['op10_warc'].replace('WITH p AS', ', p AS', 1)}").fetchall()
    got = warc.archive_pages(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, got)) == Counter(want)
    warc.write_archive(df, f"{tmp_path}/archive")
    back = warc.reconstruct(spark, f"{tmp_path}/archive").collect()
    assert Counter((r.page_id, bytes(r.payload)) for r in back) == Counter((i, (h or "").encode()) for i, _, h in rows)
    odd = [None, "", " ", "http://a/%20b", " http://a/ b\r\nWARC-Type: x\u2028é\x00 ", "http://é/\t", "x" * 5000]
    urls = spark.createDataFrame([(i, u, "page") for i, u in enumerate(odd)], "page_id long, url string, html string")
    warc.write_archive(urls, f"{tmp_path}/urls")
    assert {r.page_id: r.url for r in warc.reconstruct(spark, f"{tmp_path}/urls").collect()} == dict(enumerate(odd))
    # A revisit whose digest isn't its response's.
    payload, sha256 = b"x", hashlib.sha256(b"x").hexdigest()
    good = warc.record_headers("response", 2, "c", warc.sha1_base32(payload), sha256, None, 1) + payload + b"\r\n\r\n"
    bad = warc.record_headers("revisit", 1, "a", warc.sha1_base32(b"other"), sha256, 2, 0) + b"\r\n\r\n"
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part.gz").write_bytes(warc.gzip_member(good) + warc.gzip_member(bad))
    with pytest.raises(Exception, match="doesn't match the payload"):
        warc.reconstruct(spark, f"{tmp_path}/bad").collect()


ON_DOCUMENTS = {
    "quality": lambda df: quality_cnn.score_documents(df, quality_cnn.train([b"good prose", b"bad"], np.array([1.0, 0.0]))),
    "media": lambda df: media_avi.media_features(media_avi.store_media(df)),
    "packing": packing.pack_documents,
    "ngram_join": ngram_join.similar_components,
    "sharding": sharding.shard_documents,
    "lm": lm_ctw.score_documents,
}


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_odd_rows_and_empty_tables(spark, name):
    df = spark.createDataFrame(ODD, SCHEMA)
    got = ON_DOCUMENTS[name](df).collect()
    assert len(got) == len(ODD)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ODD)
    assert ON_DOCUMENTS[name](df.limit(0)).collect() == []


def test_odd_rows_elsewhere(spark):
    df, items = spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([(1, "long words here long words here", "x"), (None, "a", "y")], "item_id long, text string, doc_id string")
    assert {r.doc_id for r in decontaminate.contaminated(df, items).collect()} == {6}
    assert decontaminate.contaminated(df.limit(0), items).collect() == [] and decontaminate.contaminated(df, items.limit(0)).collect() == []
    pages = spark.createDataFrame([(1, None, None, 1), (2, "u", "", 1), (3, "u", "x" * 300_000, 1)], "page_id long, url string, html string, payload int")
    assert {r.page_id: r.refers_to for r in warc.archive_pages(pages).collect()} == {1: 2, 2: None, 3: None}
    assert warc.archive_pages(pages.limit(0)).collect() == [] and html_text.extract_text(pages.limit(0)).collect() == []


def test_pipeline_keeps_the_columns_and_good_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, DIR)
        assert kept.columns == docs.columns
        docs = spark.createDataFrame(kept.collect(), docs.schema)
        assert docs.count() > 0
    assert corpus_pipeline.pack(spark, docs, DIR).count() == docs.count()


def test_packed_rows_come_back():
    rng = np.random.default_rng(4)
    for n in (1, 2, 500):
        h = np.sort(rng.integers(0, 1 << 48, n).astype(np.uint64))
        a, b = rng.integers(-(1 << 62), 1 << 62, n), rng.integers(-5, 5, n)
        got = ngram_join.unpack(ngram_join.pack(h, a, b), 2)
        assert all((x == y).all() for x, y in zip(got, (h.view(np.int64), a, b), strict=True))


def test_fine_parity_never_exceeds_the_difference(spark):
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 2**63, 2000).astype(np.uint64))
    for cut in (0, 1, 300, 1100, 1900):
        other = np.unique(np.concatenate((base[cut:], rng.integers(0, 2**63, 2 * cut).astype(np.uint64))))
        a, b = ([int(w) for w in ngram_join.fine_parity(s)] for s in (base, other))
        df = spark.createDataFrame([(a, b), (a, None)], "a array<long>, b array<long>")
        apart = [r[0] for r in df.select(ngram_join._bits_apart(F.col("a"), F.col("b"))).collect()]
        assert apart[1] == 0 and apart[0] <= len(np.setxor1d(base, other)) and (cut == 0) == (apart[0] == 0)


def test_ngram_join_tells_texts_of_one_id_apart(spark):
    words = [f"w{i}" for i in range(40)]
    a, b, c = " ".join(words), " ".join(words[:39]), " ".join(f"x{i}" for i in range(40))
    df = spark.createDataFrame([(9, a, "p"), (9, c, "q"), (9, c, "q"), (3, b, "r"), (4, c, "s"), (None, a, "t"), (5, "", "u"), (6, None, "v")], "doc_id long, text string, __node string")
    got = ngram_join.similar_components(df, ngram_join.Similarity(ngram=3, num=90)).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter([(9, 3), (9, 4), (9, 4), (3, 3), (4, 4), (None, None), (5, 5), (6, 6)])
    kept = ngram_join.keep_one(df, ngram_join.Similarity(ngram=3, num=90))
    assert kept.columns == df.columns and sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("3", b), ("4", c), ("None", a), ("5", ""), ("6", None)], key=lambda x: (x[0], x[1] or ""))
