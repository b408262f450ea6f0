"""Dense search holds few rows of pairs, however large the tables, and ranks as its SQL does."""

import math

import pytest

from docloom import catalog
from docloom.operators import dense, retrieval


def best(rows, asked, k):
    """The k best by the formula written out: {query: [(id, score)]}."""
    norm = lambda v: math.sqrt(sum(c * c for c in v))

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / norm(a) / norm(b) if norm(a) * norm(b) else math.nan

    out = {}
    for q, x in rows:
        if q in asked and x:
            found = [(v, round(cosine(y, x), 6)) for v, y in rows if v != q and y and None not in y and len(y) == len(x)]
            out[q] = sorted(((v, s) for v, s in found if not s <= 0), key=lambda r: (-math.inf if math.isnan(r[1]) else -r[1], r[0]))[:k]
    return {q: r for q, r in out.items() if r}


@pytest.mark.parametrize("block", [None, 3])
def test_odd_vectors(spark, block):
    rows = [(i, [float((i * 7) % 11) - 5, float((i * 3) % 5), 1.0]) for i in range(60)]
    rows += [(i, [1.0, 2.0, 3.0]) for i in range(60, 90)]  # a group of equal vectors: ties go by id
    rows += [(90, [0.0, 0.0, 0.0]), (91, None), (92, []), (93, [1.0, 2.0]), (94, [2.0, 1.0]), (95, [1.0, None, 2.0]), (96, [1e300, 2e300, 3e300])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [i for i, _ in rows if i % 3 == 0]
    got = {}
    for r in sorted(retrieval.dense(vectors, vectors.where("vec_id % 3 = 0"), 4, block=block).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    # Norms of numbers near the limit are taken of scaled ones here.
    want = best([(i, [c / 1e300 for c in x] if i == 96 else x) for i, x in rows], asked, 4)
    assert repr(sorted(got.items())) == repr(sorted(want.items()))


def test_no_candidates(spark):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert retrieval.dense(vectors, vectors, 5).collect() == []


def test_pairs_are_not_rows(spark):
    """Pairs were rows before: as many as queries times candidates. Now a task sends k rows a query."""
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 8))
    held = type("Held", (), {"value": {8: (np.arange(100), x[:100])}})
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(list(x))], names=["id", "v"])
    sent = sum(b.num_rows for b in dense.search(held, 5, 6)([batch]))
    assert sent == 500


def test_blocks_are_bounded_and_candidates_are_dealt(spark, monkeypatch):
    one = sorted(map(tuple, catalog.dense_topk(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(retrieval, "DENSE_BYTES", 2000)
    monkeypatch.setattr(retrieval, "DENSE_PAIRS", 100)
    assert sorted(map(tuple, catalog.dense_topk(spark, "/root/testdata/sf0.001").collect())) == one


def test_rounding_is_half_up():
    import numpy as np

    assert dense.rounded(np.array([0.1234565, 0.1234575, -0.1234565, 0.9999996, 1.5e-7]), 6).tolist() == [0.123457, 0.123458, -0.123457, 1.0, 0.0]
