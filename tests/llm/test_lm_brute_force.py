"""Scores of a small corpus against sums written out, and their independence of how the input is split."""

import math
import random

import numpy as np
import pytest

from docloom.llm import lm_scoring as lm


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    common = [f"w{i}" for i in range(lm.FREQUENT)]
    middle = ["".join(rng.choice("abcde") for _ in range(4)) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(common) if rng.random() < 0.7 else rng.choice(middle) for _ in range(60))) for i in range(200)]
    rows += [(900 + i, f"{common[0]} once{i} {middle[0]} Twice{i // 2}zz") for i in range(20)]
    return rows + [(990, None), (991, " \t"), (992, "w1"), (992, "w1")]


def softmax(net_out, net_prior, h):
    z = [sum(float(a) * float(b) for a, b in zip(row, h)) + float(p) for row, p in zip(net_out, net_prior)]
    top = max(z)
    e = [math.exp(x - top) for x in z]
    return [x / sum(e) for x in e]


def brute_force(text, counts, frequent, further, net):
    ids = {w: i + 1 for i, w in enumerate(frequent)} | {w: lm.VOCABULARY + i for i, w in enumerate(further)}
    class_of = lambda w: ids[w] if ids.get(w, 999) < lm.VOCABULARY else lm.word_class(w) if w in ids else lm.shared_class(w)
    as_id = lambda w: ids.get(w) or lm.shared_class(w)
    ws = (text or "").encode().lower().split()
    total = 0.0
    for i, w in enumerate(ws):
        h = [float(b) for b in net["bias"]]
        for k, o in enumerate(lm.OFFSETS):
            j = i + o
            row = net["tables"][k][as_id(ws[j]) if 0 <= j < len(ws) else 0]
            h = [a + float(b) for a, b in zip(h, row)]
        h = [math.tanh(x) for x in h]
        c = class_of(w)
        total += math.log(softmax(net["out"][1:], net["prior"][1:], h)[c - 1])
        if c > lm.FREQUENT:
            before = sum(1 + sum(lm.word_class(x) == d for x in further) for d in range(lm.FREQUENT + 1, c))
            members = [None, *[x for x in further if lm.word_class(x) == c]]
            p = softmax(net["inner"][before : before + len(members)], net["inner_prior"][before : before + len(members)], h)
            if w in ids:
                total += math.log(p[members.index(w)])
            else:
                rest = sum(n for x, n in counts.items() if x not in ids and lm.shared_class(x) == c)
                total += math.log(p[0]) + math.log(counts[w] / rest)
    return len(ws), total


def test_scores_are_the_sums_written_out(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    counts = {}
    for _, t in corpus:
        for w in (t or "").encode().lower().split():
            counts[w] = counts.get(w, 0) + 1
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    frequent, further = ranked[: lm.FREQUENT], [w for w in ranked[lm.FREQUENT :] if counts[w] >= 10]
    assert 50 < len(further) < len(ranked) - lm.FREQUENT
    layout = lm.Layout(further)
    tokens, _ = lm.stage(docs.mapInArrow(lm._tokenise(frequent, None, further), "doc_id long, tokens binary"), "tokens")
    net = lm.train(tokens, layout=layout)
    got = sorted((r["doc_id"], r["n_tokens"], r["log_prob"]) for r in lm.score(docs, head_words=230, min_count=10).collect())
    want = sorted((i, *brute_force(t, counts, frequent, further, net)) for i, t in corpus)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-4, atol=1e-3)


def test_scores_do_not_depend_on_the_split(spark, corpus, monkeypatch):
    monkeypatch.setattr(lm, "TASK_TOKENS", 500)
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    one, many = (sorted((r["doc_id"], r["log_prob"]) for r in lm.score(d, min_count=10).collect()) for d in (docs.coalesce(1), docs.repartition(7)))
    assert [a for a, _ in one] == [a for a, _ in many]
    assert np.allclose([b for _, b in one], [b for _, b in many], atol=1e-4)


def test_all_words_of_the_vocabulary_add_up_to_one():
    layout = lm.Layout([b"alpha", b"beta", b"gamma", b"delta"] + [b"x%d" % i for i in range(300)])
    net = lm.initial(layout)
    total = 0.0
    for w in range(1, len(layout)):
        tokens, at = lm.padded([np.array([3, 300, w, 9, 8], np.uint16).tobytes()], np.uint16)
        total += math.exp(lm.log_probabilities(net, tokens, at, layout)[2])
    assert abs(total - 1) < 1e-4


def test_training_learns_words_within_a_class():
    layout = lm.Layout([b"%dzz" % i for i in range(40)])
    rng = np.random.default_rng(1)
    docs = [np.array([x for a in rng.integers(1, 20, 30).tolist() for x in (a, lm.VOCABULARY + 2 * a)], np.uint16).tobytes() for _ in range(300)]
    tokens, at = lm.padded(docs, np.uint16)
    trainer = lm.Trainer(lm.initial(layout), np.bincount(layout.classes[tokens], minlength=256).astype(float), layout=layout)
    words = at[tokens[at] >= lm.VOCABULARY]
    before = lm.log_probabilities(trainer.net, tokens, words, layout).mean()
    for _ in range(3):
        for i in range(0, len(at), 512):
            trainer.step(tokens, at[i : i + 512])
    assert before < -6 and lm.log_probabilities(trainer.net, tokens, words, layout).mean() > -1.5
