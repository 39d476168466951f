"""The inverted file and the exact search against brute force: recall, hot lists, odd vectors."""

import numpy as np
import pytest

from civicspark.operators import vector_index, vectors

SCHEMA = "vec_id long, embedding array<float>, x string"


def brute(x, queries, k):
    u = np.divide(x, (n := np.linalg.norm(x, axis=1, keepdims=True)), out=np.full_like(x, np.nan), where=n > 0)
    out = set()
    for q in queries:
        s = np.floor(u[q] @ u.T * 10_000 + 0.5) / 10_000
        order = sorted((i for i in range(len(x)) if i != q and not np.isnan(s[i])), key=lambda i: (-s[i], i))[:k]
        out |= {(q, i, float(s[i]), r) for r, i in enumerate(order, 1)}
    return out


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    spots = rng.normal(size=(20, 16))
    x = np.concatenate([spots[rng.integers(0, 20, 1500)] + 0.4 * rng.normal(size=(1500, 16)), np.repeat(spots[:1], 700, axis=0), np.zeros((3, 16))]).astype(np.float32)
    x = x[rng.permutation(len(x))]
    df = spark.createDataFrame([(i, [float(v) for v in row], "x") for i, row in enumerate(x)], SCHEMA)
    return x.astype(float), df


def rows(df):
    return {(r["query"], r.vec_id, r.similarity, r["rank"]) for r in df.collect()}


def test_recall_of_few_lists_and_exact_search(spark, table, monkeypatch):
    x, df = table
    monkeypatch.setattr(vector_index, "ROWS", 100)  # the hot list is cut
    queries = list(range(0, len(x), 20))
    want = brute(x, queries, 8)
    index = vector_index.fit(df, sample=400)
    assert index.lists.agg({"subs": "max"}).first()[0] >= 5 and index.rows.count() == len(x) - 3
    asked = df.where("vec_id % 20 = 0")
    truth = spark.createDataFrame(list(want), "query long, vec_id long, similarity double, rank int")
    few = vector_index.search(index, asked, probes=6)
    assert vector_index.recall(few, truth) >= 0.9
    assert rows(vector_index.search(index, asked, probes=2, exact=True)) == want


def test_exact_search_in_place(table, monkeypatch):
    x, df = table
    monkeypatch.setattr(vectors, "ROUND", 30)
    queries = list(range(0, len(x), 20))
    assert rows(vectors.nearest(df, df.where("vec_id % 20 = 0"))) == brute(x, queries, 8)


def test_empty_and_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    zero = spark.createDataFrame([(1, [0.0, 0.0], "a"), (2, [1.0, 0.0], "b"), (2, [1.0, 0.0], "b"), (3, [0.0, 2.0], "c")], SCHEMA)
    for q, v in ((none, none), (zero, none), (none, zero)):
        assert vectors.nearest(v, q).collect() == [] and vector_index.search(vector_index.fit(v), q, exact=True).collect() == []
    got = sorted(map(tuple, vector_index.search(vector_index.fit(zero), zero.where("vec_id = 3"), exact=True).collect()))
    assert got == [(3, 2, 0.0, 1), (3, 2, 0.0, 2)]


def test_a_search_holds_few_similarities_at_a_time():
    import tracemalloc

    import numpy as np
    from civicspark.operators import vectors

    rng = np.random.default_rng(1)
    x = vectors._unit(np.round(rng.normal(size=(6000, 4)), 1) + 0.05)
    own, ids, xs = np.arange(6000)[::-1].copy(), np.arange(4000, 7000), x[::2]
    tracemalloc.start()
    best = vectors.top(3, ids, xs, iter([(own[:2500], x[:2500]), (own[2500:2502], x[2500:2502]), (own[2502:], x[2502:])]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # all similarities are 144 MB
    s = np.floor(xs @ x.T * 10_000 + 0.5) / 10_000
    s[ids[:, None] == own[None, :]] = -np.inf
    order = np.lexsort((np.broadcast_to(own, s.shape), -s))[:, :3]
    assert (best[1] == own[order]).all() and (best[0] == np.take_along_axis(s, order, axis=1)).all()
