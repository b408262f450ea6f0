"""What op3 spends on words and training steps, and that its shorter ways give the same results."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import lm_scoring as lm
from docloom.llm.near_dedup import words

ODD = [None, "", "  ", " a B ", "\x0b\x0cx\x1cy\xa0z\x85w   q\x1f\x00r", "\ta\n\n\rb\v", "É é \U0001f600", "x", "THE the  the "]


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])


def test_words_beyond_the_vocabulary_are_told_by_their_ending_once(monkeypatch):
    asked, shared_class = [], lm.shared_class
    monkeypatch.setattr(lm, "shared_class", lambda w: asked.append(w) or shared_class(w))
    rows = [" ".join(f"w{i}zz" for i in range(j, j + 100)) for j in range(0, 2000, 100)]
    got = [t for b in lm._tokenise([b"a"])([batch(rows)]) for t in b.column("tokens").to_pylist()]
    assert got == [bytes([shared_class(b"zz")] * 100)] * 20
    assert len(asked) < 10


def make(rows=8192, further=2000):
    """A trainer, tokens, and positions of one step."""
    layout = lm.Layout([b"f%d" % i for i in range(further)])
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, rows), len(layout) - 1)
    tokens, at = lm.padded([ids.astype(np.uint16).tobytes()], np.uint16)
    frequency = np.bincount(tokens, minlength=len(layout)).astype(float)
    net = lm.with_priors(lm.initial(layout), layout, frequency)
    return lm.Trainer(net, np.bincount(layout.classes, frequency, lm.VOCABULARY), layout=layout), tokens, rng.permutation(at)


def test_a_step_stays_within_its_working_memory():
    trainer, tokens, at = make()
    trainer.step(tokens, at)
    tracemalloc.start()
    trainer.step(tokens, at)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20


def loss(net, tokens, at, layout, drawn, off):
    """What a step lowers, in double precision and one row at a time."""
    total = 0.0
    for i in at:
        w = int(tokens[i])
        c = int(layout.classes[w])
        h = np.tanh(net["bias"] + sum(net["tables"][k][tokens[i + o]] for k, o in enumerate(lm.OFFSETS)))
        own = net["out"][c] @ h + net["prior"][c]
        rest = [net["out"][d] @ h + net["prior"][d] - off[d] for d in drawn if d != c]
        total += np.logaddexp.reduce([own, *rest]) - own
        if layout.size[c] > 1:
            members = slice(layout.start[c], layout.start[c] + layout.size[c])
            inner = net["inner"][members] @ h + net["inner_prior"][members]
            total += np.logaddexp.reduce(inner) - inner[layout.place[w] - layout.start[c]]
    return total / len(at)


@pytest.mark.parametrize("safe", [lm.SAFE, 0.0])
def test_a_step_follows_the_gradient(monkeypatch, safe):
    monkeypatch.setattr(lm, "SAFE", safe)
    trainer, tokens, at = make(60, 300)
    layout, sent = trainer.layout, {}
    before = {k: v.astype(float) for k, v in trainer.net.items()}
    drawn = np.unique(np.random.default_rng(5).choice(lm.VOCABULARY, lm.NEGATIVES, p=trainer.chance))
    off = np.log(1 - (1 - trainer.chance) ** lm.NEGATIVES + 1e-12)
    monkeypatch.setattr(trainer, "_apply", lambda key, where, g: sent.__setitem__((key, where if isinstance(where, int) else None), np.array(g)))
    trainer.step(tokens, at)
    rng = np.random.default_rng(2)
    for (key, k), gradient in sent.items():
        values = before[key] if k is None else before[key][k]
        assert gradient.shape == values.shape
        direction = rng.normal(size=values.shape)
        ends = []
        for sign in (1, -1):
            values += sign * 1e-5 * direction
            ends.append(loss(before, tokens, at, layout, drawn, off))
            values -= sign * 1e-5 * direction
        assert math.isclose((ends[0] - ends[1]) / 2e-5, (gradient * direction).sum(), rel_tol=1e-3, abs_tol=1e-5), key


def test_scores_do_not_depend_on_the_size_of_exponents(monkeypatch):
    trainer, tokens, at = make(3000)
    one = lm.log_probabilities(trainer.net, tokens, at, trainer.layout)
    monkeypatch.setattr(lm, "SAFE", 0.0)
    assert np.allclose(one, lm.log_probabilities(trainer.net, tokens, at, trainer.layout), atol=1e-4)


def test_parts_have_the_words_of_each_text(monkeypatch):
    for part in (1, 10, lm.PART):
        monkeypatch.setattr(lm, "PART", part)
        got = []
        for start, found, ends in lm._parts(pa.array(["cut", *ODD, *ODD]).slice(1)):
            assert start == len(got)
            found = found.to_pylist()
            got += [found[a:b] for a, b in zip([0, *ends], ends)]
        assert got == [words(t) for t in ODD + ODD]


def test_counts_add_up_beyond_what_is_held(monkeypatch):
    monkeypatch.setattr(lm, "HELD_WORDS", 3)
    monkeypatch.setattr(lm, "PART", 1)
    got, want = {}, {}
    for b in lm._count([pa.RecordBatch.from_arrays([pa.array(ODD * 3)], names=["text"])] * 2):
        for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got[w] = got.get(w, 0) + n
    for w in (w for t in ODD * 6 for w in words(t)):
        want[w] = want.get(w, 0) + 1
    assert got == want and list(lm._count([])) == []


def test_tail_words_are_joined_whole(spark):
    tokens = spark.createDataFrame([(1, [b"abcdefghx", b"abcdefghy", b"once"]), (2, [b"abcdefghy", b"abcdefghy"]), (3, [b"once"]), (4, [])], "row long, tail array<binary>")
    counted = spark.createDataFrame([(b"abcdefghx", 7), (b"abcdefghy", 20), (b"once", 1), (b"absent", 5)], "word binary, n long")
    got = {r["row"]: r["tail"] for r in lm.tail_logs(tokens, counted).collect()}
    assert {k: v for k, v in got.items() if v} == {1: lm.scaled_log(7) + lm.scaled_log(20), 2: 2 * lm.scaled_log(20)}
