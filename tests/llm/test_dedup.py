import hashlib
import random
import string
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docloom.llm import exact_dedup, graph, line_dedup, near_dedup
from docloom.llm.common import WHITE

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


# --- line dedup ---


def brute_lines(rows, min_chars=20, min_docs=3):
    holders = defaultdict(set)
    cut = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda x: x.strip(WHITE).translate(LOWER)
    for i, lines in cut:
        for x in lines:
            holders[key(x)].add(i)
    out = []
    for i, lines in cut:
        keep = [x for x in lines if not (len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and i != max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out)


def spark_lines(docs):
    found = line_dedup.apply_bitmaps(docs.select("doc_id", "text"), line_dedup.line_dedup(docs))
    return sorted(tuple(r) for r in found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect())


def test_lines_of_edge_cases(edge_docs, edge_rows):
    assert spark_lines(edge_docs) == brute_lines([r[:2] for r in edge_rows])


def test_lines_hot_and_cold_keys_agree(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "\n".join(f"a line with number {rng.randint(0, 40) if rng.random() < 0.7 else 0:05d} in it" for _ in range(8))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lines(rows)
    for share in (0.0, 0.05, 2.0):
        monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
        assert spark_lines(docs) == want


def test_lines_runs_are_the_bitmap(edge_docs):
    for r in line_dedup.line_dedup(edge_docs).collect():
        gone = set(r["dropped"])
        last = max(gone) + 5
        kept = {p for run in r["keep_runs"] for p in range(run["start"], min(run["start"] + run["length"], last))}
        assert kept == set(range(last)) - gone


def test_lines_empty_table_and_null_ids(spark, empty_docs):
    assert spark_lines(empty_docs) == []
    docs = spark.createDataFrame([(None, "x" * 30), (1, "x" * 30), (2, "x" * 30)], "doc_id long, text string")
    found = {r["doc_id"]: r["n_dropped"] for r in line_dedup.apply_bitmaps(docs, line_dedup.line_dedup(docs)).collect()}
    assert found == {None: 1, 1: 1, 2: 0}


# --- exact dedup ---


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    return sorted((i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)


def test_exact_edge_cases(edge_docs, edge_rows):
    got = sorted(tuple(r) for r in exact_dedup.exact_dedup(edge_docs).select("doc_id", "keep_id", "group_size", "kept", "digest").collect())
    assert got == brute_exact([r[:2] for r in edge_rows])


def test_exact_compares_content_when_digests_clash(edge_docs, edge_rows):
    got = sorted(tuple(r)[:4] for r in exact_dedup.exact_dedup(edge_docs, digest=lambda c: F.substring(c, 1, 1)).select("doc_id", "keep_id", "group_size", "kept").collect())
    assert got == [r[:4] for r in brute_exact([r[:2] for r in edge_rows])]


def test_exact_keeps_one_row_of_each_group_with_all_columns(edge_docs, edge_rows, empty_docs):
    kept = exact_dedup.keep_distinct(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r[1] for r in brute_exact([r[:2] for r in edge_rows])})
    assert exact_dedup.keep_distinct(empty_docs).count() == 0
    assert exact_dedup.exact_dedup(empty_docs).count() == 0


# --- near dedup ---


def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def spark_near(docs):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_components(docs).collect()}


def test_near_edge_cases(edge_docs, edge_rows):
    assert near_dedup.near_components(edge_docs).count() == len(edge_rows)
    assert spark_near(edge_docs) == brute_near([r[:2] for r in edge_rows])


def test_near_groups_of_unequal_copies(spark):
    """A group whose members are partly linked to its centre and partly to each other only."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            w[rng.randrange(80)] = f"x{rng.randint(0, 3)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"u{rng.randint(0, 500)}" for _ in range(50))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert spark_near(docs) == brute_near(rows)


def test_near_small_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    test_near_groups_of_unequal_copies(spark)


def test_near_empty_null_and_repeated_ids(spark, empty_docs):
    assert spark_near(empty_docs) == {}
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (3, "g h i j k l"), (5, "g h i j k l")], "doc_id long, text string")
    rows = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in near_dedup.near_components(docs).collect())
    assert rows == [(0, None, True), (3, 3, True), (5, 3, False), (5, 3, False)]


def test_near_keeps_representatives(edge_docs, edge_rows):
    kept = near_dedup.keep_representatives(edge_docs)
    assert kept.columns == edge_docs.columns
    want = {i for i, r in brute_near([r[:2] for r in edge_rows]).items() if r[2]}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_min_max_agreement_is_the_jaccard_similarity():
    a = near_dedup.shingle_sets([" ".join(f"w{k}" for k in range(400)), " ".join(f"w{k}" for k in range(100, 500))])
    exact = len(set(a[0]) & set(a[1])) / len(set(a[0]) | set(a[1]))
    s = near_dedup.signatures(a, 512)
    assert abs((s[0] == s[1]).mean() - exact) < 0.06


def test_components_of_a_path_a_star_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(tuple(r) for r in graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


@pytest.mark.parametrize("name", ["op1_line_dedup", "op4_exact_dedup"])
def test_queries_match_their_sql(spark, sf, name):
    from tests.oracle import assert_same

    assert_same(spark, sf, name)


def test_near_query_matches_brute_force(spark, sf):
    from docloom.llm.common import table

    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.op2_minhash_near_dedup(spark, sf).collect()} == brute_near(rows)
