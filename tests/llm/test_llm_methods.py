"""The operators against plain references of their methods, planted cases, and odd rows."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict, namedtuple

import duckdb
import numpy as np
import pytest

from civicspark.llm import decontaminate, html_text, lm_ctw, media_avi, packing, quality_cnn, sharding, token_files, warc

DIR = "/root/testdata/sf0.001"


def naive_ctw(train, texts, depth):
    """Log10 probabilities of the texts by context-tree weighting over dictionaries."""
    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)

    def decisions(t):
        s = b"\xff" * depth + t + b"\xff"
        for i in range(depth, len(s)):
            for j in range(8):
                yield s[:i][::-1], (1 << j) | (s[i] >> (8 - j)), (s[i] >> (7 - j)) & 1

    for t in train:
        for past, node, bit in decisions(t):
            for d in range(depth + 1):
                counts[past[:d], node][bit] += 1
                if d:
                    children[past[: d - 1], node].add(past[:d])

    def own(c, node):
        a, b = counts[c, node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    known = {}

    def weighted(c, node):
        if (c, node) not in known:
            deeper = sum(weighted(x, node) for x in children[c, node])
            known[c, node] = own(c, node) if len(c) == depth else np.logaddexp(own(c, node), deeper) - math.log(2)
        return known[c, node]

    def log10(t):
        total = 0.0
        for past, node, bit in decisions(t):
            p = None
            for d in range(depth, -1, -1):
                n = counts.get((past[:d], node), [0, 0])
                mine = (n[bit] + 0.5) / (sum(n) + 1)
                if p is None:
                    p = mine if sum(n) or not d else None
                else:
                    share = math.exp(own(past[:d], node) - math.log(2) - weighted(past[:d], node))
                    p = share * mine + (1 - share) * p
            total += math.log10(p)
        return total

    return [log10(t) for t in texts]


def test_tree_scores_equal_a_plain_context_tree(spark):
    texts = ["the cat sat on the mat", "the dog sat", "Ünï the mat", "", "a cat", "the  CAT\tsat on the mat", "zz 9"]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in lm_ctw.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), modulus=2).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 2 == 0 for i, _ in rows}
    assert any(held.values()) and not all(held.values())
    forms = [lm_ctw.normalised(t.encode()) for t in texts]
    want = naive_ctw([f for i, f in enumerate(forms) if not held[i]], forms, lm_ctw.DEPTH)
    assert all(got[i].held_out == held[i] and math.isclose(got[i].score, want[i], rel_tol=1e-9) for i in range(len(texts)))
    assert all(math.isclose(got[i].bits_per_byte, -want[i] / math.log10(2) / (len(forms[i]) + 1), rel_tol=1e-9) for i in range(len(texts)))


def test_next_bytes_of_a_context_sum_to_one():
    import pyarrow as pa

    learned = b"the cat sat on the mat, the dog the cat".ljust(48, b".")
    counts = Counter((learned[i - 5 : i][::-1], learned[i]) for i in range(5, len(learned)))
    contexts = sorted({c for c, _ in counts} | {b"tac e", b"zzzzz", b"eht z"})  # nearest byte first; some never met
    rows = [(int.from_bytes(c + bytes([x])), counts[c, x]) for c in contexts for x in range(256)]
    table = pa.record_batch({"key": np.array([k for k, _ in rows]), "n": np.array([n for _, n in rows])})
    sums = defaultdict(lambda: np.zeros(3))
    for b in lm_ctw._tops(iter([table])):
        for r in b.to_pylist():
            sums[r["c1"], r["node"]] += (r["n0"], r["n1"], r["children"])
    Row = namedtuple("Row", "c1 node n0 n1 children")
    top = lm_ctw._Top([Row(*k, *v) for k, v in sums.items()])
    total = Counter()
    for b in lm_ctw._log_probabilities(top)(iter([table])):
        for key, logp in zip(b["key"].to_pylist(), b["logp"].to_pylist(), strict=True):
            total[key >> 8] += 10**logp
    assert len(total) == len(contexts) and all(math.isclose(t, 1, rel_tol=1e-9) for t in total.values())


def naive_probability(net, text):
    padded = text + bytes(quality_cnn.FILTER)
    padded = padded.ljust(-(-len(padded) // quality_cnn.HALF) * quality_cnn.HALF, b"\0")
    halves = []
    for h in range(len(padded) // quality_cnn.HALF):
        best = None
        for i in range(h * quality_cnn.HALF, (h + 1) * quality_cnn.HALF, quality_cnn.STRIDE):
            window = padded[i : i + quality_cnn.FILTER]
            if len(window) < quality_cnn.FILTER:
                continue
            r = net.embed[list(window)].ravel() @ net.filters + net.bias
            best = r if best is None else np.maximum(best, r)
        halves.append(np.maximum(best, 0))
    chunks = [np.maximum(a, b) for a, b in itertools.pairwise(halves)] or halves
    z = np.concatenate([np.max(chunks, axis=0), np.mean(chunks, axis=0)]) @ net.weights + net.offset[0]
    return 1 / (1 + math.exp(-z))


def test_scores_equal_a_plain_convolution_and_don_t_depend_on_neighbours():
    rng = np.random.default_rng(6)
    net = quality_cnn.train([b"good prose of some length " * 5, b"\x01\x02 bad"], np.array([1.0, 0.0]))
    net = quality_cnn.Network(*(p + rng.normal(0, 0.3, p.shape).astype(np.float32) for p in net.parameters()))
    texts = [b"", b"x", bytes(rng.integers(0, 256, 247).astype(np.uint8)), bytes(rng.integers(0, 256, 248).astype(np.uint8)), bytes(rng.integers(0, 256, 249).astype(np.uint8)), bytes(rng.integers(0, 256, 3000).astype(np.uint8))]
    together = quality_cnn.score(net, texts)
    for t, p in zip(texts, together, strict=True):
        assert math.isclose(p, naive_probability(net, t), rel_tol=1e-3, abs_tol=1e-5)
        assert math.isclose(p, quality_cnn.score(net, [t])[0], rel_tol=1e-4, abs_tol=1e-6)


def test_fit_takes_no_more_rows_than_its_bound(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    net = quality_cnn.fit(docs, labels, max_docs=5)
    kept = quality_cnn.keep_good(spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (None, None, "y"), (4, "", None)], "doc_id long, text string, score string"), net, least=0.0)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == 4
    assert quality_cnn.keep_good(docs.limit(0), net).collect() == []


def test_decontamination_finds_near_copies_of_at_least_the_threshold(spark):
    rng = np.random.default_rng(12)
    prose = lambda n: [f"v{i}" for i in rng.integers(0, 5000, n)]
    items = [prose(80) for _ in range(30)]
    docs, want = [], set()
    for i, item in enumerate(items):
        for k, changes in enumerate((0, 1, 2, 6)):
            copy = list(item)
            for at in rng.choice(np.arange(8, 72, 6), changes, replace=False):
                copy[at] = "changed"
            a, b = (Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for w in (item, copy))
            alike = sum((a & b).values()) / sum((a | b).values())
            docs.append((10 * i + k, " ".join([*prose(40), *copy, *prose(30)])))
            if alike >= 0.8:
                want.add((10 * i + k, i))
    docs += docs[:1]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert len(want) == 60 and len(got) == len(found) and found == want
    assert all(math.isclose(r.similarity, 1.0 if r.doc_id % 10 == 0 else 71 / 81) for r in got)
    kept = decontaminate.clean(spark.createDataFrame([*docs, (None, " ".join(items[0])), (999, None)], "doc_id long, text string"), spark.createDataFrame([(0, " ".join(items[0]))], "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, i in found if i == 0} | {None, 999}


def test_clips_are_timed_and_files_come_back(spark):
    rng = np.random.default_rng(1)
    dark, light = bytes(rng.integers(0, 40, 192 * 64).astype(np.uint8)), bytes(rng.integers(200, 255, 192 * 64).astype(np.uint8))
    texts = [(1, (dark + light).decode("latin-1")), (2, None), (3, "same " * 400), (3, "same " * 400), (None, "x")]
    media = media_avi.store_media(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    table = spark.createDataFrame(media, "doc_id long, n_bytes long, media binary")
    clips = media_avi.clips(table).collect()
    by = defaultdict(list)
    for c in clips:
        by[c.doc_id].append(c)
    for rows in by.values():
        rows.sort(key=lambda c: (c.clip, c.first_frame))
        assert rows[0].first_frame == 0 and all(c.end_s > c.start_s and c.frames > 0 for c in rows)
    assert all(a.end_s == b.start_s and a.first_frame + a.frames == b.first_frame for a, b in itertools.pairwise(by[1]))
    features = {(r.doc_id, r.feature, r.payload_sha256) for r in media_avi.media_features(table).collect()}
    raw = texts[0][1].encode()
    assert hashlib.sha256(raw.ljust(-(-len(raw) // 192) * 192, b" ")).hexdigest() in {h for d, _, h in features if d == 1}
    assert len({f for d, f, _ in features if d == 3}) == 1
    assert media_avi.clips(table.limit(0)).collect() == []


def test_packing_rows_by_brute_force(spark):
    rng = np.random.default_rng(9)
    lengths = [int(n) for n in rng.integers(1, 40, 60)]
    got = packing.pack_documents(spark.createDataFrame([(i, "w " * (n - 1)) for i, n in enumerate(lengths)], "doc_id long, text string"), buckets=3, token_budget=100).collect()
    bounds = packing.optimal_boundaries(sorted(Counter(lengths).items()), 3)
    for r in got:
        assert r.bucket_tokens == min(b for b in bounds if b >= lengths[r.doc_id]) and r.padding == r.bucket_tokens - r.n_tokens
    for b in bounds:
        in_bucket = sorted((r.batch, r.place) for r in got if r.bucket_tokens == b)
        per = max(1, 100 // b)
        assert in_bucket == [(i // per, i % per) for i in range(len(in_bucket))]


def test_heap_places_groups_as_a_plain_search_does():
    rng = np.random.default_rng(5)
    sizes = [(f"g{i:03d}", int(n)) for i, n in enumerate(rng.integers(1, 1000, 200))]
    loads, want = [0] * 7, {}
    for key, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        at = min(range(7), key=lambda s: (loads[s], s))
        want[key] = at
        loads[at] += n
    assert sharding.lpt(sizes, 7) == want and max(loads) - min(loads) < 1000


def test_html_of_odd_pages(spark):
    prose = "A long paragraph of the article that says quite a lot about its subject, and more."
    deep = "<div>" * 20_000 + f"<p>{prose}</p>" + "</section>" * 20_000
    rows = [(1, "u", deep, "t"), (1, "u", deep, "t"), (None, None, f"<p>{prose}", "t"), (2, "u", "no tags at all", "t"), (3, "u", "<p>" + "word " * 200_000, "t"), (4, "u", "<<<>>> <a", "t")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows) and all(r.n_chars == len(r.text) for r in got)
    texts = {r.page_id: r.text for r in got}
    assert texts[1] == texts[None] == prose and texts[2] == "no tags at all" and texts[3] == ("word " * 200_000).strip()


def neutral(page):
    """The page without classes, ids and roles, and with plain elements for all that tell of their part."""
    page = re.sub(r"""\s(class|id|role)=("[^"]*"|'[^']*'|[^\s>]+)""", "", page)
    return re.sub(r"<(/?)(article|main|nav|footer|aside|header|section|form)\b", r"<\1div", page)


def test_density_alone_finds_the_article():
    pages = [h for (h,) in duckdb.execute("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' WHERE html IS NOT NULL").fetchall()]
    chosen = [html_text.main_element(html_text.parse(p)).name for p in pages]
    assert np.mean([c == "article" for c in chosen]) >= 0.95
    assert np.mean([html_text.main_text(p) == html_text.main_text(neutral(p)) for p in pages]) >= 0.95


def naive_density(x, body_links):
    """chars, tags, link chars, link tags and density of an element, by recursion."""
    own = len("".join("".join(c.split()) for c in x.children if isinstance(c, str)))
    inside = [c for c in x.children if not isinstance(c, str) and not c.skip]
    chars, tags, links, link_tags = own, 0, own if x.link else 0, 0
    for c in inside:
        n, t, ln, lt, _ = naive_density(c, body_links)
        chars, tags, links, link_tags = chars + n, tags + t + 1, links + ln, link_tags + lt + (c.name == "a")
    if not chars:
        return chars, tags, links, link_tags, 0.0
    t, ln, lt = max(tags, 1), max(links, 1), max(link_tags, 1)
    ratio = math.log(1 + math.log(chars * links / max(1, chars - links) + body_links * chars + math.e))
    return chars, tags, links, link_tags, chars / t * max(0.0, math.log(chars / ln * t / lt)) / ratio


def test_densities_and_sums_equal_their_definition():
    pages = [h for (h,) in duckdb.execute(f"SELECT html FROM '{DIR}/pages.parquet' WHERE html IS NOT NULL LIMIT 20").fetchall()]
    for page in pages:
        root = html_text.parse(page)
        best = html_text.main_element(root)
        body = next((c for c in root.children if getattr(c, "name", "") == "body"), root)
        chars, _, links, _, _ = naive_density(body, 0.0)
        body_links = links / max(1, chars)
        nodes = html_text._order(body)
        densities = {x: naive_density(x, body_links)[4] for x in nodes}
        assert all(math.isclose(x.density, densities[x], rel_tol=1e-9, abs_tol=1e-12) for x in nodes)
        blocks = [x for x in nodes if x is body or x.name not in html_text.INLINE]
        for x in blocks:
            inside = [c for c in x.children if not isinstance(c, str) and not c.skip]
            if any(c.name not in html_text.INLINE and c.name not in html_text.VOID for c in inside):
                assert x.sum >= sum(densities[c] for c in inside) - 1e-9
            else:
                assert math.isclose(x.sum, densities[x], rel_tol=1e-9, abs_tol=1e-12)
        x = first = max(blocks, key=lambda x: x.sum)
        path = [first]
        while x is not body:
            x = x.parent
            path.append(x)
        assert best.sum == max(x.sum for x in blocks if x.density >= min(y.density for y in path))


def test_a_heading_comes_along_only_directly_before():
    body = "<p>A long paragraph of prose that says much.</p><p>Another long paragraph of prose that says more.</p>"
    assert html_text.main_text(f"<h1>Head</h1>\n<div>{body}</div>").startswith("Head A long")
    assert html_text.main_text(f"<h1>Head</h1><p><a href=x>Go</a></p><div>{body}</div>").startswith("A long")


def test_token_files_of_odd_rows(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(3, "b c", "x"), (3, "b c", "x"), (3, "another", "y"), (1, None, "z"), (-5, "", None), (None, "lost", "q"), (7, "long words " * 60_000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = token_files.token_files(df, path, vocabulary=49_408, end_id=2).collect()
    tokenizer = Tokenizer.from_file(path)
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    want = Counter((d, len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for d, t, _ in rows if d is not None)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(d for d, _, _ in rows if d is not None)
    assert token_files.token_files(df.limit(0), path, vocabulary=49_408, end_id=2).collect() == []


def test_tokens_of_more_stems_than_a_worker_remembers(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["one, two. three, four! one. ÉTÉ, five, six?! seven, two, eight.", "one. nine... ten, three,", "a! b!! c!!! d!!!! e!!!!! f, a!!!!!!"]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    for most in range(1, 12):
        monkeypatch.setattr(token_files, "CACHE_WORDS", most)
        coder = token_files._Coder(path, "<u2")
        assert coder.by_stem
        for _ in range(3):
            for t, x in zip(texts, want, strict=True):
                assert coder.encode([t.encode()]) == [x]
                assert len(coder.stems) <= most


def test_archives_of_clashing_columns_and_many_files(spark, tmp_path):
    rows = [(i, f"u {i}", f"page {i % 7}" * 50, "x", "y") for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha256 string, member string")
    warc.write_archive(df, f"{tmp_path}/a")
    back = warc.reconstruct(spark, f"{tmp_path}/a").collect()
    assert Counter((r.page_id, bytes(r.payload).decode()) for r in back) == Counter((i, h) for i, _, h, _, _ in rows)
    for r in back:
        kind = "response" if r.page_id >= 193 else "revisit"
        assert bytes(r.headers).startswith(b"WARC/1.1\r\nWARC-Type: " + kind.encode()) and bytes(r.headers).endswith(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", bytes(r.headers))[1])
        assert length == (len(bytes(r.payload)) if kind == "response" else 0)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_against_plain_references(spark, tmp_path, empty):
    import corpus_pipeline

    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(f"v{i}" for i in rng.integers(0, 3000, n))
    base = [prose(60) for _ in range(6)]
    item = prose(50)
    rows = [(i, t) for i, t in enumerate(base)] + [(10 + i, t) for i, t in enumerate(base[:3])] + [(20, base[0].replace(" ", "  ").upper()), (21, f"{prose(30)} {item} {prose(30)}"), (22, ""), (23, None)]
    rows += [(30 + i, t.rsplit(" ", 2)[0]) for i, t in enumerate(base)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.limit(0) if empty else docs
    for name, df in {"documents": docs, "labels": spark.createDataFrame([(i, 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(1, item)], "item_id long, text string")}.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["near_duplicates"](spark, docs, str(tmp_path))
    assert one.columns == docs.columns
    if empty:
        assert one.collect() == [] and corpus_pipeline.run(spark, str(tmp_path)).collect() == []
        return
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w := words(t)) > 4 else {tuple(w)} if w else set() for i, t in rows}
    root = {i: i for i, _ in rows}
    find = lambda x: x if root[x] == x else find(root[x])
    for (i, _), (j, _) in itertools.combinations(rows, 2):
        both = len(sets[i] & sets[j])
        if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    kept = sorted(i for i, _ in rows if find(i) == i)
    assert sorted(r.doc_id for r in one.collect()) == kept
    clean = stages["decontamination"](spark, one, str(tmp_path))
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [i for i in kept if i != 21]
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in final) == [i for i in kept if i != 21]  # one class of labels: nothing is rejected
    assert {r.doc_id: r.n_tokens for r in final} == {i: len(words(t)) + 1 for i, t in rows if i in kept and i != 21}


def test_a_block_of_the_language_model_holds_its_distinct_strings_once(monkeypatch):
    """Strings of all chunks waited for one sum, so a block of many chunks held as many copies of them."""
    import random
    import tracemalloc
    from collections import Counter

    import pyarrow as pa

    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(3000)).encode()

    def grams(times: int) -> tuple[Counter, int]:
        texts = [text] * times
        row = pa.RecordBatch.from_pydict({"block": [1], "doc_ids": [list(range(times))], "held": [[i == 0 for i in range(times)]], "sizes": [[len(text)] * times], "text": [pa.compress(b"".join(texts), "zstd", asbytes=True)]}, schema=lm_ctw._PACKS)
        tracemalloc.start()
        batches = list(lm_ctw._grams(iter([row])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return Counter({k: n for b in batches for k, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)}), peak

    monkeypatch.setattr(lm_ctw, "CHUNK", len(text))
    (few, small), (many, large) = grams(8), grams(48)
    assert few.keys() == many.keys() and all(many[k] * 7 == few[k] * 47 for k in few) and sum(few.values()) == 7 * (len(text) + 1)
    assert large < small + 48 * len(text) * 2
    assert lm_ctw._learned([b"a b a", b"b c"], [False, True]) == {b"a": 2, b"b": 1, b"c": 0, lm_ctw.END: 1}


def test_scoring_a_block_holds_its_words_as_numbers(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(8)
    texts = [b" ".join(map(bytes, rng.integers(97, 101, (200, 20), np.uint8))) for _ in range(500)] + [b"", b"long " + b"x" * 300 + b" " + b"x" * 301]
    held, ids = [i % 10 == 0 for i in range(len(texts))], list(range(len(texts)))
    row = pa.RecordBatch.from_pydict({"block": [1], "doc_ids": [ids], "held": [held], "sizes": [[len(t) for t in texts]], "text": [pa.compress(b"".join(texts), "zstd", asbytes=True)]}, schema=lm_ctw._PACKS)
    monkeypatch.setattr(lm_ctw, "CHUNK", 1 << 16)
    strings = pa.Table.from_batches(lm_ctw._grams(iter([row])))["key"]
    padded = [b"\xff" * 5 + t + b"\xff" for t in texts]
    assert set(strings.to_pylist()) == {int.from_bytes(p[i - 5 : i][::-1] + p[i : i + 1]) for p in padded for i in range(5, len(p))}  # none across two texts
    model = pa.table({"block": pa.array([1] * len(strings)), "kind": pa.array([1] * len(strings), pa.int32()), "key": strings, "value": pa.array([-1.0] * len(strings))})
    learned = Counter(w for t, h in zip(texts, held, strict=True) if not h for w in (*t.split(), b"end"))
    packs, score = pa.Table.from_batches([row]), lm_ctw._scorer(sum(learned.values()), len(learned))
    score(packs, model)
    tracemalloc.start()
    got = score(packs, model).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    total = math.log10(sum(learned.values()) + 0.1 * (len(learned) + 1))
    for r, t in zip(got, texts, strict=True):
        words = (*t.split(), b"end")
        assert (r["n_tokens"], r["n_known"], r["score"]) == (len(words), sum(learned[w] > 0 for w in words), -len(t) - 1.0)
        assert math.isclose(r["base_score"], sum(math.log10(learned[w] + 0.1) - total for w in words), rel_tol=1e-9)
    assert peak < 6 * sum(map(len, texts)), peak / sum(map(len, texts))
