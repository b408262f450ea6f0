"""Letters of every plane count, each with a vector of its own, and nothing else does."""

import numpy as np

from docloom.llm import language_id


def test_letters_beyond_the_basic_plane_count_and_emoji_do_not():
    vectors, n = language_id.bundles(["\U0001f600\U0001f601 \U0001f600", "\U00020000\U00020001", "\U00010400a"], 64)
    assert n.tolist() == [0, 2, 2]
    assert not vectors[0].any() and vectors[1].any() and vectors[2].any()


def test_letters_do_not_share_vectors():
    found = [chr(c) for c in range(language_id.POINTS) if chr(c).isalpha()][::37]
    own = language_id.letters(512)[language_id.symbols()[[ord(c) for c in found]]]
    assert len(np.unique(own, axis=0)) == len(found) and set(np.unique(own)) == {-1, 1}
    assert abs(own[:200] @ own[:200].T / 512 - np.eye(200)).max() < 0.3


def test_large_alphabets_give_the_vectors_of_small_ones(monkeypatch):
    text = ["".join(chr(0x4E00 + i * 7 % 400) for i in range(900)) + " plain words", "über"]
    sorted_, n = language_id.bundles(text, 64)
    monkeypatch.setattr(language_id, "TABLE", 1 << 28)
    table, m = language_id.bundles(text, 64)
    assert np.array_equal(sorted_, table) and n.tolist() == m.tolist()


def test_one_long_document_does_not_outweigh_its_language(spark):
    long = "zzz yyy xxx " * 3000
    rows = [(i, "the house and the garden and the river", "en") for i in range(20)] + [(50, long, "en"), (51, "das haus und der garten und der fluss", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(docs, language_id.train(docs)).collect()}
    assert got[3]["lang_pred"] == "en" and got[3]["score"] > 0.9
    assert got[51]["lang_pred"] == "de"


def test_a_cut_text_has_the_vector_of_the_whole(monkeypatch):
    text = "Über den Wolken, it's 12 o'clock! " * 20
    whole, n = language_id.bundles([text], 64)
    monkeypatch.setattr(language_id, "CHUNK", 17)
    again, m = language_id.bundles([text], 64)
    assert (whole == again).all() and n == m
