"""Packed pieces carry the texts; the whole result against a brute-force packing."""

import itertools
from collections import Counter

from docloom.llm import packing


def brute_force(docs, max_tokens, buckets):
    """Lengths of the pieces of each document, and the bounds with the least padding."""
    lengths = []
    for i, t in docs:
        n = len((t or "").encode().split())
        lengths += [(i, k, min(n - k * max_tokens, max_tokens)) for k in range(max(1, -(-n // max_tokens)))]
    counts = Counter(n for _, _, n in lengths)
    sizes = sorted(counts)
    waste = lambda bounds: sum(k * (min(b for b in bounds if b >= n) - n) for n, k in counts.items())
    best = min(waste([*c, sizes[-1]]) for r in range(buckets) for c in itertools.combinations(sizes[:-1], r))
    return sorted(lengths, key=str), best


def test_pieces_bounds_and_texts_match_brute_force(spark):
    words = lambda n, gap=" ": gap.join(f"w{i}" for i in range(n))
    docs = [(1, words(3)), (2, words(7, "\n\t")), (3, None), (4, "  " + words(10) + " \n"), (5, words(23)), (6, words(23)), (7, ""), (7, words(5)), (None, words(6)), (8, "été " + words(11, "  "))]
    given = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, bucket string, n int")
    rows = packing.pack(given, max_tokens=5, buckets=2, budget=12, shards=3).collect()
    want, best = brute_force(docs, 5, 2)
    assert sorted(((r["doc_id"], r["piece"], r["n_tokens"]) for r in rows), key=str) == want
    assert sum(r["bound"] - r["n_tokens"] for r in rows) == best
    for i, t in docs:
        if i not in (7, None):
            own = sorted((r["piece"], r["text"]) for r in rows if r["doc_id"] == i)
            assert "".join(x for _, x in own) == (t or "")
    for r in rows:
        assert len(r["text"].encode().split()) == r["n_tokens"]


def test_histogram_counts_what_pieces_gives(spark):
    docs = spark.createDataFrame([(i, " ".join(["x"] * n)) for i, n in enumerate([0, 1, 4, 5, 6, 10, 11, 25])], "doc_id long, text string")
    counted = Counter(r["n_tokens"] for r in packing.pieces(docs, max_tokens=5).collect())
    assert packing.histogram(docs, max_tokens=5) == sorted(counted.items())


def test_very_long_texts_are_cut_whole(spark):
    text = "word " * 300_000
    rows = packing.pieces(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sum(r["n_tokens"] for r in rows) == 300_000 and "".join(r["text"] for r in sorted(rows, key=lambda r: r["piece"])) == text


def test_batches_of_the_query_carry_all_texts(spark, sf):
    from docloom.llm.common import table

    rows = packing.op5_packing(spark, sf).collect()
    texts = {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        texts[r["doc_id"]] = texts.get(r["doc_id"], "") + r["text"]
    assert texts == {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
