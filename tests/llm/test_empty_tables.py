"""Empty tables through every query of the training-data operators and through the pipeline."""

import pytest

SCHEMAS = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "pages": "page_id long, url string, html string", "embeddings": "vec_id long, embedding array<float>, label int"}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("empty")
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{home}/{name}.parquet")
    return str(home)


def test_queries_and_pipeline_give_empty_tables(spark, empty):
    import corpus_pipeline
    from docloom.llm import queries

    for name, query in (queries.QUERIES | {"pipeline": corpus_pipeline.run}).items():
        assert query(spark, empty).count() == 0, name


def test_a_table_without_labels_goes_through_language_id(spark, tmp_path):
    from docloom.llm import language_id

    spark.createDataFrame([(1, "some words of text", None), (2, None, None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.op7_language_id(spark, str(tmp_path)).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
