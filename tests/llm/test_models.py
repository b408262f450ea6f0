import hashlib
import itertools
import random

import numpy as np
import pytest

from docloom.llm import bpe, language_id, lm_scoring, nearest, packing


# --- packing ---


def padding(lengths, counts, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(lengths, counts))


def test_bounds_are_optimal():
    rng = random.Random(4)
    for _ in range(40):
        lengths = sorted(rng.sample(range(0, 60), rng.randint(1, 9)))
        counts = [rng.randint(1, 30) for _ in lengths]
        k = rng.randint(1, 4)
        got = packing.optimal_bounds(lengths, counts, k)
        assert got == sorted(set(got)) and got[-1] == lengths[-1] and len(got) <= k
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for r in range(k) for c in itertools.combinations(lengths[:-1], r))
        assert padding(lengths, counts, got) == best
    assert packing.optimal_bounds([], []) == []


def check_packed(rows, docs, max_tokens, budget):
    words = {}
    for i, t in docs:
        words.setdefault(i, []).append(len((t or "").encode().split()))
    tokens = {}
    for r in rows:
        assert r["n_tokens"] <= r["bound"] and r["n_tokens"] <= max_tokens
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["n_tokens"]
    assert tokens == {i: sum(n) for i, n in words.items()}
    for b in {r["bucket"] for r in rows}:
        own = [r for r in rows if r["bucket"] == b]
        fits = max(1, budget // max(1, own[0]["bound"]))
        places = sorted((r["batch"], r["slot"]) for r in own)
        assert places == [divmod(i, fits) for i in range(len(own))]


def test_packing_edge_cases(edge_docs, edge_rows, empty_docs):
    rows = packing.pack(edge_docs, max_tokens=50, buckets=3, budget=200, shards=5).collect()
    check_packed(rows, [r[:2] for r in edge_rows], 50, 200)
    assert packing.pack(empty_docs).count() == 0


def test_packing_query(spark, sf):
    from docloom.llm.common import table

    check_packed(packing.op5_packing(spark, sf).collect(), [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()], packing.MAX_TOKENS, packing.BUDGET)


# --- language identification ---


def brute_vector(text, dim):
    own = language_id.letters(dim)
    lut = language_id.symbols()
    s = "".join(c if c.isalpha() else " " for c in text.lower())
    out = np.zeros(dim)
    for w in s.split():
        ids = [0, *[int(lut[ord(c)]) for c in w], 0]
        for a, b, c in zip(ids, ids[1:], ids[2:]):
            out += np.roll(own[a], 2) * np.roll(own[b], 1) * own[c]
    return out


def test_document_vectors_match_brute_force():
    texts = ["Über den Wolken, it's 12 o'clock!", "", None, "a", "¡Ñandú!"]
    got, letters = language_id.bundles(texts, 64)
    for t, v in zip(texts, got):
        assert np.array_equal(v, brute_vector(t or "", 64))
    assert letters.tolist() == [sum(c.isalpha() for c in t or "") for t in texts]


def test_long_texts_are_read_whole(monkeypatch):
    text = "the quick brown fox " * 300 + "jumps"
    whole, n = language_id.bundles([text], 64)
    monkeypatch.setattr(language_id, "CHUNK", 500)
    again, m = language_id.bundles([text], 64)
    assert n == m
    cos = (whole * again).sum() / np.linalg.norm(whole) / np.linalg.norm(again)
    assert cos > 0.99  # trigrams over the cuts differ, nothing else


def test_language_edge_cases(edge_docs, edge_rows, empty_docs):
    from pyspark.sql import functions as F

    prototypes = language_id.train(edge_docs.where(F.col("lang").isNotNull()))
    assert set(prototypes) == {"en", "fr", "de"}
    got = language_id.identify(edge_docs, prototypes).collect()
    assert len(got) == len(edge_rows)
    for r in got:
        blank = not any(c.isalpha() for t in [x[1] for x in edge_rows if x[0] == r["doc_id"]] for c in t or "")
        assert (r["lang_pred"] == "und") == blank and 0 <= r["score"] <= 1
    assert language_id.train(empty_docs) == {}
    assert {r["lang_pred"] for r in language_id.identify(edge_docs, {}).collect()} == {"und"}
    assert language_id.identify(empty_docs, prototypes).count() == 0


def test_language_query_is_right_on_held_out_documents(spark, sf):
    from docloom.llm.common import table

    rows = language_id.op7_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_rejected_documents_go_and_clean_ones_stay(edge_docs, edge_rows):
    kept = {r["doc_id"] for r in language_id.keep_identified(edge_docs).collect()}
    assert kept.isdisjoint({1, 2, 3, 16}) and {4, 5, 10, 13} <= kept


# --- BPE ---


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def model():
    with open(bpe.vocabulary_path(), encoding="utf-8") as f:
        return bpe.Model(f.read())


def texts():
    rng = random.Random(5)
    alphabet = [chr(c) for c in [*range(1, 0x250), *range(0x370, 0x600), 0x130, 0x2028, 0x3000, 0xA0, 0x3A3, 0xFB01, 0x301, 0xAC00, 0x4E00, 0x1F600]]
    parts = ["'s", "'t", "it's", " ", "a", "'LL", "don't", "<|endoftext|>", "<|startoftext|>", "<|", "1234", "!!", "\n", "'re", "x'd", "''s", "'"]
    out = ["", "a" * 3000, "ab" * 900, "!" * 300, "word " * 50]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)]


def test_ids_and_decoded_text_are_the_librarys(library, model):
    given = texts()
    want = [e.ids for e in library.encode_batch(given, add_special_tokens=False)]
    got = bpe.Encoder(model).encode(given)
    assert [x.tolist() for x in got] == want
    assert [bpe.decode(model, x) for x in got] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_both_merge_routines_agree(model):
    rng = random.Random(6)
    words = [bytes(rng.choice(b"abceinorst'\xc3\xa9") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    assert [x.tolist() for x in model.merge(words)] == [model.merge_long(w) for w in words]


def test_lexicon_is_exact_and_minimal(model):
    words = sorted({a + b for a in (b"walk", b"talk", b"stalk") for b in (b"", b"s", b"ed", b"ing")})
    lexicon = bpe.Lexicon(bpe.compile_lexicon(dict(zip(words, model.merge(words)))))
    assert lexicon.lookup(words).tolist() == list(range(len(words)))
    assert lexicon.lookup([b"walke", b"wal", b"", b"x", b"walkss"]).tolist() == [-1] * 5
    assert [lexicon.output(i).tolist() for i in range(len(words))] == [model.merge_long(w) for w in words]
    # Equal right languages are one state: w-alk, t-alk and st-alk share all but their starts.
    right = lambda prefix: frozenset(w[len(prefix) :] for w in words if w.startswith(prefix))
    assert len(lexicon.finals) == len({right(w[:k]) for w in words for k in range(len(w) + 1)})
    assert bpe.Lexicon(bpe.compile_lexicon({})).lookup([b"a"]).tolist() == [-1]


def test_bpe_edge_cases(edge_docs, edge_rows, empty_docs, library):
    got = sorted((r["doc_id"], tuple(r["ids"])) for r in bpe.encode(edge_docs).collect())
    assert got == sorted((i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in edge_rows)
    assert bpe.encode(empty_docs).count() == 0


def test_bpe_query(spark, sf, library):
    from docloom.llm.common import table

    rows = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    for r in bpe.op8_bpe(spark, sf).collect():
        ids = library.encode(rows[r["doc_id"]], add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


# --- language model ---


def test_log_probabilities_sum_to_one_and_ignore_the_token_itself():
    net = lm_scoring.initial()
    for v in range(1, 256, 50):
        probabilities = []
        for w in range(1, 256):
            tokens, at = lm_scoring.padded([bytes([3, v, w, 9, 8])])
            probabilities.append(np.exp(lm_scoring.log_probabilities(net, tokens, at)[2]))
        assert abs(sum(probabilities) - 1) < 1e-4


def test_training_learns_both_sides():
    rng = np.random.default_rng(1)
    docs = [bytes([x for a in rng.integers(1, 20, 30).tolist() for x in (a, a + 100, a + 50)]) for _ in range(300)]
    tokens, at = lm_scoring.padded(docs)
    trainer = lm_scoring.Trainer(lm_scoring.initial(), np.bincount(tokens, minlength=256).astype(float))
    before = lm_scoring.log_probabilities(trainer.net, tokens, at).mean()
    for _ in range(3):
        for i in range(0, len(at), 512):
            trainer.step(tokens, at[i : i + 512])
    after = lm_scoring.log_probabilities(trainer.net, tokens, at).mean()
    assert before < -4 and after > -1.5


def test_lm_edge_cases(edge_docs, edge_rows, empty_docs):
    got = lm_scoring.score(edge_docs).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in edge_rows)
    for r in got:
        assert r["n_tokens"] in {len((t or "").encode().split()) for i, t, _ in edge_rows if i == r["doc_id"]}
        assert (r["mean_log_prob"] is None) == (r["n_tokens"] == 0) and r["log_prob"] <= 0
    assert lm_scoring.score(empty_docs).count() == 0


def test_lm_query_prefers_prose_to_shuffled_prose(spark, sf):
    from docloom.llm.common import table

    docs = table(spark, sf, "documents").select("doc_id", "text")
    tokens, _ = lm_scoring.stage(docs.mapInArrow(lm_scoring._tokenise(lm_scoring.vocabulary(docs)), "doc_id long, tokens binary"), "tokens")
    net = lm_scoring.train(tokens)
    rows = [bytes(r["tokens"]) for r in tokens.collect()]
    rng = random.Random(7)
    mixed = [bytes(rng.sample(d, len(d))) for d in rows]
    mean = lambda docs: float(lm_scoring.log_probabilities(net, *lm_scoring.padded(docs)).mean())
    assert mean(rows) > mean(mixed)


# --- nearest neighbours ---


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(30, 70)) * rng.lognormal(size=(30, 1)), rng.normal(size=(40, 70))
    low, high = nearest.bounds(nearest.quantise(x), nearest.quantise(y))
    exact = ((x[:, None] - y[None]) ** 2).sum(2)
    assert (low <= exact).all() and (exact <= high).all()


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=8).round(1)]) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(30)]  # ties
    rows += [(400, None), (401, [0.0] * 8), (402, [1.0] * 7 + [None]), (403, [float("nan")] * 8), (404, [float("inf")] + [1.0] * 7), (405, []), (406, [1.0, 2.0]), (None, [1.0] * 8), (500, [2.0, 2.0]), (600, [1e300] * 8)]
    vectors = nearest.usable(spark.createDataFrame([(*r, "extra") for r in rows], "vec_id long, embedding array<double>, v string"))
    got = sorted(tuple(r) for r in nearest.nearest(vectors.where("vec_id % 10 = 0 OR vec_id = 406"), vectors, 5).collect())
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    want = []
    for q, x in good:
        if q % 10 == 0 or q == 406:
            near = sorted((float(nearest.distances(np.array([x]), np.array([y]))[0]), i) for i, y in good if i != q and len(y) == len(x))[:5]
            want += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    assert got == sorted(want)


def test_nearest_in_several_blocks_and_empty(spark, sf):
    from docloom.llm.common import table

    vectors = nearest.usable(table(spark, sf, "embeddings"))
    queries = vectors.where("vec_id % 100 = 0")
    one, many = (sorted(tuple(r) for r in nearest.nearest(queries, vectors, 10, b).collect()) for b in (1 << 24, 1000))
    assert one == many and one
    assert nearest.nearest(queries.limit(0), vectors).count() == 0
    assert nearest.nearest(queries, vectors.limit(0)).count() == 0


def test_nearest_query_matches_its_sql(spark, sf):
    from tests.oracle import assert_same

    assert_same(spark, sf, "op10_nearest_neighbours")
