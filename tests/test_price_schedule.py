"""Every line item enters the grid of its order."""

from pyspark.sql import functions as F

from docloom import catalog

SF = "/root/testdata/sf0.001"


def test_all_lines_of_all_orders_are_priced(spark):
    best = {}
    for r in catalog.table(spark, SF, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("q")).collect():
        key = str(r["l_orderkey"]), f"Line {r['l_linenumber']}"
        best[key] = max(best.get(key, 0), r["q"])
    assert any(line == "Line 4" for _, line in best)
    assert {(r["doc_id"], r["line"]): int(r["target_quantity"]) for r in catalog.price_schedule(spark, SF).collect()} == best
