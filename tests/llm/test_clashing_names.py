"""Columns of the caller's whose names operators use inside, and hot groups."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.llm import common, exact_dedup, line_dedup, near_dedup

NAMES = ["text_tag", "dropped", "keep_runs", "_id", "_tag", "own_id", "own_text", "own_tag", "row", "bitmap_id", "_norm", "_keep", "_digest", "_rows", "kept_id", "kept_digest", "n", "digest", "_gone", "component_id", "_salt", "_hot"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "the same line in three of them\nown one"), (2, "THE same line in three of them\nown two"), (3, "the same line in three of them"), (4, None), (None, "Same"), (5, "same"), (5, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce("text", F.lit("-"))).alias(c) for c in NAMES])


def test_bitmaps_leave_the_callers_columns_alone(clashing):
    found = line_dedup.apply_bitmaps(clashing, line_dedup.line_dedup(clashing))
    assert found.columns == [c for c in clashing.columns if c != "text"] + ["n_lines", "n_dropped", "kept_text"]
    got = {r["doc_id"]: r for r in found.collect() if r["doc_id"] != 5}
    assert [(got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_text"]) for i in (1, 2, 3, 4)] == [(2, 1, "own one"), (2, 1, "own two"), (1, 0, "the same line in three of them"), (1, 0, "")]
    assert all(got[1][c] == f"{c} the same line in three of them\nown one" for c in NAMES)


@pytest.mark.parametrize("keep, left", [(exact_dedup.keep_distinct, [1, 2, 3, 4, 5]), (near_dedup.keep_representatives, [None, 1, 2, 3, 4, 5, 5])])
def test_kept_rows_have_all_their_columns(clashing, keep, left):
    found = keep(clashing)
    assert found.columns == clashing.columns
    rows = found.collect()
    assert sorted((r["doc_id"] for r in rows), key=lambda x: x or -1) == left
    assert all(r[c] == f"{c} {r['text'] or '-'}" for r in rows for c in NAMES)


@pytest.mark.parametrize("hot_rows", [1, 5, 1 << 20])
def test_hot_digests_give_the_same_lines(spark, hot_rows):
    rng = random.Random(3)
    rows = [(i, "\n".join(f"a line that is number {min(rng.randint(0, 40), rng.randint(0, 40))} of all" for _ in range(6))) for i in range(120)]
    digests = line_dedup.line_digests(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(tuple(r)[::2] for r in line_dedup.dropped_lines(digests, hot_rows=hot_rows).collect())
    held = {}
    for i, t in rows:
        for line in t.split("\n"):
            held.setdefault(line, set()).add(i)
    want = sorted((i, p) for i, t in rows for p, line in enumerate(t.split("\n")) if len(held[line]) >= 3 and i != max(held[line]))
    assert got == want


def test_spread_join_gives_each_row_its_group(spark):
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).cast("long").alias("k"))
    groups = rows.where("k <> 2001").groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"))
    got = {r["id"]: (r["size"], r["first"]) for r in common.spread_join(rows, groups, ["k"], "size", "id", 4999).collect()}
    assert len(got) == 5000 and got[5] == (2000, 0) and got[2500] == (1, 2500) and got[2001] == (None, None)
