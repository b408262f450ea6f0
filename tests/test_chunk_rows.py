"""Chunks of whole rows are those of their blocks, and no text is shuffled for them."""

from pyspark.sql import functions as F

from docloom import catalog
from docloom.operators import chunks

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_not_shuffled(spark):
    found = catalog.chunk_pack(spark, SF)
    assert "Exchange" not in plan(found) and "FlatMapGroupsInPandas" not in plan(found)


def test_rows_are_packed_as_their_blocks(spark):
    got = {}
    for r in sorted(catalog.chunk_pack(spark, SF).collect(), key=lambda r: (r["doc_id"], r["chunk_no"])):
        got.setdefault(r["doc_id"], []).append((r["chunk_no"], r["tokens"], r["n_blocks"], r["text_hash"]))
    want = {}
    import hashlib

    for r in catalog.table(spark, SF, "documents").collect():
        for i, c in enumerate(chunks.pack([(f"b{i}", 1, "text", None, x) for i, x in enumerate(r["text"].split("\n"))])):
            assert c["tokens"] == chunks.tokens(c["text"])
            want.setdefault(str(r["doc_id"]), []).append((i + 1, c["tokens"], len(c["block_ids"]), hashlib.sha256(c["text"].encode()).hexdigest()))
    assert got == want


def test_odd_rows(spark, tmp_path):
    rows = [(1, "a b\nc"), (2, None), (3, ""), (4, " \n\t"), (None, "x"), (5, "é ü\n" * 3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["chunk_no"], r["tokens"], r["n_blocks"]) for r in catalog.chunk_pack(spark, str(tmp_path)).collect()}
    assert got == {("1", 1, 3, 2), ("None", 1, 1, 1), ("5", 1, 7, 3)}


def test_rows_that_share_an_id_are_one_document(spark, tmp_path):
    spark.createDataFrame([(1, "a b\nc"), (1, "d\ne f\ng")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r["doc_id"], r["chunk_no"], r["tokens"], r["n_blocks"]) for r in catalog.chunk_pack(spark, str(tmp_path)).collect()] == [("1", 1, 9, 5)]


def test_blocks_in_any_order(spark):
    blocks = spark.createDataFrame([(str(d), i, f"b{i}", None if d else 2, "heading" if i == 4 else "text", None, f"w{i} " * 150) for d in range(3) for i in (3, 1, 4, 0, 2)], "doc_id string, block_ord int, block_id string, page_no int, kind string, section string, text string")
    found = sorted(chunks.chunk(blocks).where(F.col("doc_id") == "0").collect(), key=lambda r: r["chunk_no"])
    assert [(r["block_ids"], r["page"], r["section"]) for r in found] == [(["b0", "b1"], 2, None), (["b1", "b2"], 2, None), (["b2", "b3"], 2, None), (["b3", "b4"], 2, ("w4 " * 150).strip())]
