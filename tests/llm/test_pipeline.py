import pytest

from tests.llm.test_dedup import brute_exact, brute_near


def test_stages_match_brute_force(spark, sf):
    import corpus_pipeline as p
    from docloom.llm.common import stage, table

    assert [n for n, _ in p.STAGES] == ["language_id", "exact_dedup", "near_dedup", "packing"]
    docs = table(spark, sf, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, function in p.STAGES[:-1]:
        out, _ = stage(function(spark, docs, sf), name)
        assert out.columns == docs.columns
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "language_id":
            assert set(rows) - set(got) <= {i for i, t in rows.items() if not any(c.isalpha() for c in t or "") or len(set((t or "").split())) < 0.2 * len((t or "").split())}
        elif name == "exact_dedup":
            assert set(got) == {r[0] for r in brute_exact(rows.items()) if r[3]}
        else:
            assert set(got) == {i for i, r in brute_near(list(rows.items())).items() if r[2]}
        rows, docs = got, out
    packed = p.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == set(rows)


def test_run_has_no_sql_and_gives_rows(spark, sf):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()
    assert entry.queries()["pipeline"](spark, sf).count() > 0


@pytest.mark.parametrize("n", range(1, 11))
def test_one_query_per_operator(n):
    import __spark_entry__ as entry

    assert sum(q.startswith(f"op{n}_") for q in entry.queries()) == 1
