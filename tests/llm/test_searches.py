import numpy as np
import pytest
from pyspark.sql import functions as F

from merchantlens.llm import ann, topk

DIM = 16


def rows_of(points):
    return [(n, [float(x) for x in p], 0) for n, p in enumerate(points)]


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    found = rng.normal(size=(700, DIM)).astype(np.float32)
    found[100:400] = found[100]  # a large group of copies
    return found


def odd(points):
    return [
        *rows_of(points),
        (9001, None, 0),
        (9002, [None] * DIM, 0),
        (9003, [float("nan")] * DIM, 0),
        (9004, [float("inf")] * DIM, 0),
        (9005, [], 0),
        (9020, [1.0, 2.0], 0),
        (9040, [1.0, 3.0], 0),
        (None, [1.0] * DIM, 0),
        (0, [float(x) for x in points[0]], 0),  # repeated
    ]


def brute(points, k, query, score):
    out = []
    for q in range(0, len(points), query):
        found = [(score(points[q], p), n) for n, p in enumerate(points) if n != q]
        out += [(q, rank, n, s) for rank, (s, n) in enumerate(sorted(found)[:k], 1)]
    return out


def test_top_k_is_exact(vectors, points):
    whole = np.floor(64 * points.astype(float)).astype(int)
    expected = [(q, r, n, -s) for q, r, n, s in brute(whole, 5, 20, lambda a, b: -int(a @ b))]
    df = vectors(odd(points))
    got = topk.top_k(df, F.col("id") % 20 == 0, k=5, shard_rows=150, block_rows=10)
    got = sorted(map(tuple, got.collect()))
    assert [r for r in got if r[0] < 9000] == sorted(expected)
    short = [(64 * (64 + 0) + 128 * 192 - 0)]
    assert [r for r in got if r[0] >= 9000] == [(9020, 1, 9040, short[0]), (9040, 1, 9020, short[0])]


def test_top_k_of_large_numbers(vectors):
    data = [(0, [1e15, 1.0], 0), (20, [1e15, 2.0], 0), (40, [-1e15, 0.0], 0)]
    got = topk.top_k(vectors(data), F.col("id") % 20 == 0, k=2, component=lambda x: F.floor(x)).collect()
    assert [r.score for r in got if r.query_id == 0] == [2**63 - 1, -(2**63)]


def test_nearest_finds_most(vectors, points):
    points = points[400:]  # no copies: distances differ
    expected = brute(points.astype(float), 10, 10, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())))
    got = ann.nearest(vectors(odd(points)), F.col("id") % 10 == 0, shard_rows=100, block_rows=10).collect()
    pairs = {(r.query_id, r.vec_id): r.score for r in got if r.query_id < 9000}
    hits = [(q, n) for q, _, n, _ in expected if (q, n) in pairs]
    assert len(hits) >= 0.9 * len(expected)
    assert all(pairs[q, n] == pytest.approx(s, abs=1e-9) for q, _, n, s in expected if (q, n) in pairs)
    assert len(pairs) == len(expected)


def test_probing_retrieves_every_code_in_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (3000, 4), dtype=np.uint8)
    index = ann.SubstringIndex(codes)
    bits = np.unpackbits(codes, axis=1)
    for radius in (0, 1, 5, 9, 13, 32):
        for n in range(5):
            away = (bits != bits[n]).sum(axis=1)
            assert set(index.within(codes[n], radius)) == set(np.flatnonzero(away <= radius))


def test_copies_and_zero_vectors(vectors, points):
    df = vectors([*rows_of(points[:420]), (500, [0.0] * DIM, 0)])
    got = ann.nearest(df, F.col("id") == 100, k=5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(n, 0.0) for n in range(101, 106)]
    assert ann.nearest(df, F.col("id") == 500).count() == 0


@pytest.mark.parametrize("search", [topk.top_k, ann.nearest])
def test_empty_and_alone(vectors, search):
    assert search(vectors([(0, [1.0], 0)]).limit(0), F.lit(True)).count() == 0
    assert search(vectors([(0, [1.0, 2.0], 0)]), F.lit(True)).count() == 0


def test_recall_on_the_test_table(spark):
    from merchantlens.llm import queries

    sf = "/root/testdata/sf0.01"
    found = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    points = np.stack(found["embedding"]).astype(float)
    expected = brute(points, 10, 100, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())))
    got = {(r.query_id, r.vec_id) for r in queries.op4_nearest(spark, sf).collect()}
    assert sum((q, n) in got for q, _, n, _ in expected) >= 0.9 * len(expected)
