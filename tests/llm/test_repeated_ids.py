"""Vectors that share an id, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from merchantlens.llm import ann, topk


@pytest.mark.parametrize("search", [topk.top_k, ann.nearest])
def test_different_vectors_of_an_id_all_take_part(vectors, search):
    rng = np.random.default_rng(8)
    points = np.floor(rng.normal(size=(60, 4)) * 4) + 0.5
    ids = [n % 25 for n in range(60)]
    rows = [(i, [float(x) for x in p], 0) for i, p in zip(ids, points, strict=True)]
    found = search(vectors([*rows, rows[0]]), F.col("id") % 5 == 0, k=6, shard_rows=10, block_rows=3)
    expected = []
    for q in range(0, 25, 5):
        pairs = [(a, b, n) for a, m in zip(points, ids, strict=True) if m == q for b, n in zip(points, ids, strict=True) if n != q]
        if search is topk.top_k:
            each = sorted((-int(np.floor(64 * a) @ np.floor(64 * b)), n) for a, b, n in pairs)[:6]
            expected += [(q, rank, n, -s) for rank, (s, n) in enumerate(each, 1)]
        else:
            each = sorted((float(np.sqrt(((b - a) ** 2).sum())), n) for a, b, n in pairs)[:6]
            expected += [(q, rank, n, s) for rank, (s, n) in enumerate(each, 1)]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
