"""Scores tell the words of a class apart, by the counts of all documents."""

import math

import pytest

from docloom.llm import lm_scoring


@pytest.mark.parametrize("head_words", [lm_scoring.HEAD_WORDS, 195, 0])
def test_words_of_a_class_have_probabilities_of_their_own(spark, head_words):
    common = [f"w{i}" for i in range(lm_scoring.FREQUENT)]
    rows = [(i, " ".join(common * 2)) for i in range(40)]
    # Both end in "zz", so they share a class; one is 30 times as frequent.
    rows += [(1000 + i, "w1 w2 oftenzz w3 w4") for i in range(30)] + [(2000, "w1 w2 rarezz w3 w4"), (2000, "w1 w2 rarezz w3 w4 rarezz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_tokens"]): r["log_prob"] for r in lm_scoring.score(docs, head_words=head_words).collect()}
    assert len([r for r in rows if r[0] == 2000]) == len([k for k in got if k[0] == 2000])
    assert abs(got[1000, 5] - got[2000, 5] - math.log(30 / 3)) < 1e-5


def test_head_holds_no_more_than_asked(spark):
    counted = spark.createDataFrame([(b"a", 100), (b"b", 70), (b"c", 9), (b"d", 1), (b"e", 1)], "word binary, n long")
    assert lm_scoring.head_counts(counted, 4) == {b"a": 100, b"b": 70, b"c": 9}
    assert lm_scoring.head_counts(counted, 1) == {}
    assert len(lm_scoring.head_counts(counted)) == 5
