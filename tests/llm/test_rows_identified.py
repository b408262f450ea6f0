"""A rejected row takes no other row of the same doc_id with it."""

import pytest

from docloom.llm import language_id


@pytest.mark.parametrize("shared", [None, 9])
def test_rows_go_by_their_own_text(spark, shared):
    text = "the quick brown fox jumps over the lazy dog " * 3
    rows = [(i, text, "en", 0.5) for i in range(8)] + [(shared, text, "en", 1.5), (shared, "?!", "en", 2.5), (shared, None, None, 3.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = language_id.keep_identified(docs)
    assert got.schema == docs.schema
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((r for r in rows if r[1] == text), key=repr)
    assert language_id.keep_identified(docs.drop("lang").selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).count() == 0
