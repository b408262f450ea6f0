"""Masked pseudo-likelihood of documents under a bidirectional window network.

The network predicts each word from the WINDOW words on either side. Every
offset has a table with a hidden vector for each word of the vocabulary; their
sum goes through tanh. Two softmax levels follow: over classes, and over the
words within a class. The most frequent words are a class each; the others
share classes, those of the vocabulary by hash, so that classes are of one
size, and all beyond it by their last two bytes. The vocabulary grows with the corpus:
it has every word that occurs MIN_COUNT times in all documents, up to
FREQUENT + MAX_WORDS, the bound of what is broadcast and sent back. All words
beyond it, however rare, have a probability of their own too: that of their
class's remainder, given both sides, times the word's share of that remainder
by its count in all documents. The probabilities of all words add up to 1. A
document's score is the sum of the log-probabilities of its words.

All documents take part in everything: in the word counts that give the
vocabulary, in training and in scoring. Training runs in ROUNDS rounds, each
over its own share of the documents. They are dealt to tasks of about
TASK_TOKENS words by hash and sorted there, so that the result depends on the
documents alone and not on how the input is split. In a round, every task
starts from the common network, goes once through its documents, and sends its
network back; the networks are averaged, weighted by their words, in levels of
FAN_IN streamed sums. The driver gets one network a round.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import stage, table
from docloom.ship import ship

#: Classes: 0 stands beyond the ends; then come the FREQUENT most frequent words; all others share the rest by their last two bytes.
VOCABULARY, FREQUENT = 256, 191
#: Further words of the vocabulary: all with MIN_COUNT occurrences, the most frequent first, MAX_WORDS at most.
MIN_COUNT, MAX_WORDS = 64, 2048
WINDOW, HIDDEN = 2, 32
ROUNDS, RATE, BATCH, NEGATIVES = 3, 0.1, 8192, 64
#: Words that a training task goes through, and that a scoring task scores, about.
TASK_TOKENS = 1_500_000
FAN_IN = 16
#: Bytes of texts that are cut into words at once, about.
PART = 1 << 22
#: Distinct words that a task holds at once.
HELD_WORDS = 200_000
#: Words whose counts are broadcast, at most; the counts of all others are joined.
HEAD_WORDS = 100_000
#: Logarithms of counts are whole numbers of 1 / SCALE, so that sums do not depend on the order of tasks.
SCALE = 10**9
#: Tokens scored at once, and those of them whose classes are.
TOKENS, CLASS_TOKENS = 1 << 14, 1 << 10
#: Exponent of what does not count.
MASKED = -1e9
#: Exponents that are taken as they are; larger ones are taken relative to the largest of their row.
SAFE = 60.0

OFFSETS = [o for o in range(-WINDOW, WINDOW + 1) if o]


def keep_memory() -> None:
    """Let the process reuse freed arrays.

    glibc gives freed blocks above a threshold back to the system at once and
    takes them anew page by page. Freeing a block raises the threshold to its
    size, up to 32 MB. This one is never written to, so it takes no memory.
    """
    np.empty((32 << 20) - (64 << 10), np.uint8)


# --- Tokens ----------------------------------------------------------------


def _parts(texts: pa.Array):
    """(start, words, ends) of whole texts of about PART bytes: their words one after the other, and where those of each text end.

    The words are those of near_dedup.words().
    """
    texts = texts.fill_null("")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + PART, "right")))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(i, j - i)))
        found, ends = lists.flatten().cast(pa.binary()), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
        # White space at either end leaves an empty word.
        real = pc.binary_length(found).to_numpy(zero_copy_only=False) > 0
        if not real.all():
            found, ends = found.filter(pa.array(real)), _up_to(real, ends)
        yield i, found, ends
        i = j


def _up_to(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of the values before each end."""
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[ends]


def _count(batches):
    held, n = [], 0

    def merged():
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

    for batch in batches:
        for _, found, _ in _parts(batch.column(0)):
            found = found.dictionary_encode()
            held.append(pa.table({"word": found.dictionary, "n": np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))}))
            n += len(found.dictionary)
            if n > 2 * HELD_WORDS:
                held = [merged()]
                n = len(held[0])
                if n > HELD_WORDS:
                    yield from held[0].to_batches(20_000)
                    held, n = [], 0
    if held:
        yield from merged().to_batches(20_000)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n of every distinct word of all documents."""
    ship(docs.sparkSession)
    return docs.select(docs[text].alias("text")).mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counted: DataFrame, frequent: int = FREQUENT) -> list[bytes]:
    return [bytes(r["word"]) for r in counted.orderBy(F.desc("n"), "word").limit(frequent).collect()]


def vocabulary(docs: DataFrame, text: str = "text", frequent: int = FREQUENT) -> list[bytes]:
    """The most frequent words of all documents; ties go to the word that sorts first."""
    return most_frequent(word_counts(docs, text), frequent)


def head_counts(counted: DataFrame, most: int = HEAD_WORDS) -> dict[bytes, int]:
    """Counts of all words above the least power of two that leaves at most `most` of them."""
    power = F.length(F.bin("n"))
    left, least = most, None
    for r in counted.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("power")).collect():
        if r["words"] > left:
            break
        left, least = left - r["words"], r["power"]
    return {} if least is None else {bytes(r["word"]): r["n"] for r in counted.where(power >= least).collect()}


def scaled_log(n: int) -> int:
    return round(math.log(n) * SCALE)


def shared_class(word: bytes) -> int:
    shared = VOCABULARY - 1 - FREQUENT
    return VOCABULARY - shared + zlib.crc32(word[-2:]) % shared


def word_class(word: bytes) -> int:
    """The class of a word of the vocabulary that has none of its own."""
    shared = VOCABULARY - 1 - FREQUENT
    return VOCABULARY - shared + zlib.crc32(word) % shared


class Layout:
    """The classes of a vocabulary's words and their places in the inner level.

    Ids below VOCABULARY are classes; as a word, the id of a shared class stands
    for all its words beyond the vocabulary. From VOCABULARY on come the
    vocabulary's words with a place in a shared class.
    """

    def __init__(self, further: list[bytes] | tuple = ()):
        self.classes = np.concatenate([np.arange(VOCABULARY), [word_class(w) for w in further]]).astype(np.int64)
        members = [i for i in range(VOCABULARY + len(further)) if self.classes[i] > FREQUENT]
        members.sort(key=lambda i: (self.classes[i], i))
        self.members = np.array(members, np.int64)
        self.place = np.zeros(len(self.classes), np.int64)
        self.place[self.members] = np.arange(len(members))
        self.size = np.bincount(self.classes[self.members], minlength=VOCABULARY)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])

    def __len__(self) -> int:
        return len(self.classes)

    @property
    def dtype(self):
        return np.uint16 if len(self) > VOCABULARY else np.uint8


def further_words(counted: DataFrame, min_count: int = MIN_COUNT, most: int = MAX_WORDS) -> list[bytes]:
    """The vocabulary's words after the FREQUENT most frequent ones."""
    return most_frequent(counted.where(F.col("n") >= min_count), FREQUENT + most)[FREQUENT:]


def _shared_classes(found: pa.Array) -> np.ndarray:
    """shared_class() of each word."""
    ends = pc.binary_slice(found, -2).dictionary_encode()
    return np.array([*map(shared_class, ends.dictionary.to_pylist()), 0], np.int64)[ends.indices.to_numpy()]


def _binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of the values up to each end."""
    offsets = np.concatenate([[0], ends * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _tokenise(frequent: list[bytes], head=None, further: list[bytes] | tuple = ()):
    """doc_id and tokens of doc_id, text; with head, the broadcast scaled logarithms of counts, of row, text, doc_id also the sum over the words it has and the words it lacks."""
    dtype = np.uint16 if len(further) else np.uint8

    def run(batches):
        keep_memory()
        ids = {w: i + 1 for i, w in enumerate(frequent)} | {w: VOCABULARY + i for i, w in enumerate(further)}
        # Words of the vocabulary have their probability in context, so their counts add nothing.
        logs = ({} if head is None else head.value) | dict.fromkeys(ids, 0)
        known = pa.array(list(logs), pa.binary())
        # Id and logarithm by place among the known words; the last place is that of all other words.
        id_at = np.array([*(ids.get(w, -1) for w in logs), -1], np.int64)
        log_at = np.array([*logs.values(), 0], np.int64)
        for batch in batches:
            for at, found, ends in _parts(batch.column(1)):
                found = found.dictionary_encode()
                distinct, own = found.dictionary, found.indices.to_numpy()
                place = pc.index_in(distinct, value_set=known).fill_null(len(known)).to_numpy()
                of_word = np.where(id_at[place] < 0, _shared_classes(distinct), id_at[place]).astype(dtype)
                tokens = _binaries(of_word[own], ends)
                if head is None:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ends)), tokens], names=["doc_id", "tokens"])
                    continue
                lacking = (place == len(known))[own]
                tail = pa.ListArray.from_arrays(np.concatenate([[0], _up_to(lacking, ends)]).astype(np.int32), distinct.take(pa.array(own[lacking])))
                logged = np.diff(_up_to(log_at[place][own], ends), prepend=0)
                columns = [batch.column(0).slice(at, len(ends)), batch.column(2).slice(at, len(ends)), tokens, pa.array(logged, pa.int64()), tail]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "tokens", "known", "tail"])

    return run


# --- The network -----------------------------------------------------------

KEYS = ("tables", "bias", "out", "prior", "inner", "inner_prior")


def initial(layout: Layout | None = None, seed: int = 3) -> dict[str, np.ndarray]:
    layout = layout or Layout()
    rng = np.random.default_rng(seed)
    return {
        "tables": rng.normal(0, 0.1, (len(OFFSETS), len(layout), HIDDEN)).astype(np.float32),
        "bias": np.zeros(HIDDEN, np.float32),
        "out": rng.normal(0, 0.1, (VOCABULARY, HIDDEN)).astype(np.float32),
        "prior": np.zeros(VOCABULARY, np.float32),
        "inner": rng.normal(0, 0.1, (len(layout.members), HIDDEN)).astype(np.float32),
        "inner_prior": np.zeros(len(layout.members), np.float32),
    }


def with_priors(net: dict[str, np.ndarray], layout: Layout, frequency: np.ndarray) -> dict[str, np.ndarray]:
    """The network with the shares of classes, and of words in their class, as first guess. frequency counts ids."""
    of_class = np.bincount(layout.classes, frequency, VOCABULARY)
    share = np.maximum(frequency, 1) / np.maximum(of_class, 1)[layout.classes]
    return net | {"prior": np.log(np.maximum(of_class, 1) / max(of_class.sum(), 1)).astype(np.float32), "inner_prior": np.log(share[layout.members]).astype(np.float32)}


def flat(net: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in KEYS])


def unflat(values: np.ndarray, layout: Layout | None = None) -> dict[str, np.ndarray]:
    net, at = {}, 0
    for k, v in initial(layout).items():
        net[k] = values[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return net


def padded(docs: list[bytes], dtype=np.uint8) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of several documents with WINDOW zeros around each, and the positions of the real ones."""
    gap = bytes(WINDOW * np.dtype(dtype).itemsize)
    joined = np.frombuffer(gap + b"".join(d + gap for d in docs), dtype)
    return joined, np.flatnonzero(joined)


def hidden(net, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = np.broadcast_to(net["bias"], (len(at), HIDDEN)).copy()
    for k, o in enumerate(OFFSETS):
        h += net["tables"][k].take(tokens[at + o], 0)
    return np.tanh(h, out=h)


def _sums(p: np.ndarray) -> np.ndarray:
    """Sums of rows, as a product, which takes a fraction of the time of sum()."""
    return p @ np.ones(p.shape[-1], p.dtype)


def _log_sums(logits: np.ndarray, most: float) -> np.ndarray:
    """Logarithms of the sums of exponentials along the last axis; logits are overwritten. most bounds their size."""
    if most > SAFE:
        top = logits.max(-1)
        logits -= top[..., None]
        return top + np.log(_sums(np.exp(logits, out=logits)))
    return np.log(_sums(np.exp(logits, out=logits)))


def _bound(out: np.ndarray, prior: np.ndarray) -> float:
    """The size that h @ out.T + prior has at most, for components of h within -1 and 1."""
    return float((np.abs(out).sum(1) + np.abs(prior)).max(initial=0))


def with_column(rows: np.ndarray, last: np.ndarray) -> np.ndarray:
    return np.concatenate([rows, last[:, None]], 1)


def with_ones(h: np.ndarray) -> np.ndarray:
    """Hidden rows with one more input that is always 1, whose weight is the prior."""
    return with_column(h, np.ones(len(h), np.float32))


def _firsts(classes: np.ndarray) -> np.ndarray:
    """Where each class begins among sorted ones."""
    return np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))


def _classes(classes: np.ndarray, layout: Layout):
    """Each class of several words among sorted ones, the slice of its rows, and that of its members."""
    first = _firsts(classes)
    for c, start, stop in zip(classes[first].tolist(), first.tolist(), [*first[1:].tolist(), len(classes)]):
        if layout.size[c] > 1:
            yield c, slice(start, stop), slice(int(layout.start[c]), int(layout.start[c] + layout.size[c]))


def log_probabilities(net, tokens: np.ndarray, at: np.ndarray, layout: Layout | None = None) -> np.ndarray:
    """Log-probability of each token at `at`, given its neighbours but not itself."""
    layout = layout or Layout()
    out = np.empty(len(at))
    outer = np.ascontiguousarray(with_column(net["out"][1:], net["prior"][1:]).T)
    inner = with_column(net["inner"], net["inner_prior"])
    outer_most, inner_most = _bound(net["out"][1:], net["prior"][1:]), _bound(net["inner"], net["inner_prior"])
    for i in range(0, len(at), TOKENS):
        part = at[i : i + TOKENS]
        word = tokens[part].astype(np.int64)
        order = np.argsort(layout.classes[word].astype(np.uint8), kind="stable")
        part, word = part[order], word[order]
        classes = layout.classes[word]
        h = with_ones(hidden(net, tokens, part))
        found = np.empty(len(part))
        for j in range(0, len(part), CLASS_TOKENS):
            some = slice(j, min(j + CLASS_TOKENS, len(part)))
            logits = h[some] @ outer
            picked = logits[np.arange(len(logits)), classes[some] - 1]
            found[some] = picked - _log_sums(logits, outer_most)
        for c, rows, members in _classes(classes, layout):
            logits = h[rows] @ inner[members].T
            picked = logits[np.arange(len(logits)), layout.place[word[rows]] - members.start]
            found[rows] += picked - _log_sums(logits, inner_most)
        out[i + order] = found
    return out


class Trainer:
    """Adagrad on both softmax levels.

    Classes: over the target and shared negatives drawn by the square root of
    frequency, with their chance taken off. Words in their class: in full.
    frequency counts classes.
    """

    def __init__(self, net: dict[str, np.ndarray], frequency: np.ndarray, seed: int = 5, layout: Layout | None = None):
        self.layout = layout or Layout()
        self.net = {k: v.copy() for k, v in net.items()}
        self.squares = {k: np.full_like(v, 1e-4) for k, v in net.items()}
        weight = np.sqrt(np.maximum(frequency, 1))
        weight[0] = 0
        self.chance = weight / weight.sum()
        self.rng = np.random.default_rng(seed)

    def _apply(self, key: str, where, gradient: np.ndarray) -> None:
        squares, values = self.squares[key][where], self.net[key][where]
        squares += gradient * gradient
        gradient *= RATE
        gradient /= np.sqrt(squares)
        values -= gradient

    def step(self, tokens: np.ndarray, at: np.ndarray) -> None:
        net, layout = self.net, self.layout
        word = tokens[at].astype(np.int64)
        target = layout.classes[word]
        # Rows of one class follow one another, so that their gradients are sums of slices.
        order = np.argsort(target.astype(np.uint8), kind="stable")
        at, word, target = at[order], word[order], target[order]
        h = hidden(net, tokens, at)
        with_one, back = with_ones(h), np.empty_like(h)
        outer = self._step_classes(target, with_one, back)
        inner = self._step_inner(word, target, with_one, back)
        np.multiply(h, h, out=h)
        back *= np.subtract(1, h, out=h)
        sums, by_place = np.empty((HIDDEN, len(layout))), np.ascontiguousarray(back.T, np.float64)
        for k, o in enumerate(OFFSETS):
            keys = tokens[at + o].astype(np.int64)
            for values, into in zip(by_place, sums):
                into[:] = np.bincount(keys, values, len(layout))
            self._apply("tables", k, sums.T.astype(np.float32, order="C"))
        self._apply("bias", slice(None), back.sum(0))
        self._apply("out", slice(None), outer[:, :HIDDEN])
        self._apply("prior", slice(None), outer[:, HIDDEN])
        self._apply("inner", slice(None), inner[:, :HIDDEN])
        self._apply("inner_prior", slice(None), inner[:, HIDDEN])

    def _step_classes(self, target: np.ndarray, h: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Sets back to the gradient of the hidden rows h of the classes target, sorted, and returns that of out and prior."""
        n, outer = len(target), with_column(self.net["out"], self.net["prior"])
        drawn = np.unique(self.rng.choice(VOCABULARY, NEGATIVES, p=self.chance))
        negatives = outer[drawn]
        negatives[:, HIDDEN] -= np.log(1 - (1 - self.chance[drawn]) ** NEGATIVES + 1e-12).astype(np.float32)
        relative = max(_bound(outer[:, :HIDDEN], outer[:, HIDDEN]), _bound(negatives[:, :HIDDEN], negatives[:, HIDDEN])) > SAFE
        where = np.full(VOCABULARY, -1)
        where[drawn] = np.arange(len(drawn))
        gradient, negative = np.zeros_like(outer), np.zeros_like(negatives)
        for i in range(0, n, CLASS_TOKENS):
            part = slice(i, i + CLASS_TOKENS)
            mine, classes = h[part], target[part]
            positive = outer.take(classes, 0)
            p, q = mine @ negatives.T, np.einsum("ij,ij->i", mine, positive)
            twice = np.flatnonzero(where[classes] >= 0)
            p[twice, where[classes[twice]]] = MASKED  # the target counts once
            if relative:
                top = np.maximum(p.max(1), q)
                p -= top[:, None]
                q -= top
            np.exp(p, out=p)
            np.exp(q, out=q)
            scale = 1 / ((_sums(p) + q) * n)
            p *= scale[:, None]
            q = q * scale - np.float32(1 / n)
            np.matmul(p, negatives[:, :HIDDEN], out=back[part])
            positive *= q[:, None]
            back[part] += positive[:, :HIDDEN]
            negative += p.T @ mine
            first = _firsts(classes)
            gradient[classes[first]] += np.add.reduceat(q[:, None] * mine, first, axis=0)
        gradient[drawn] += negative
        return gradient

    def _step_inner(self, word: np.ndarray, target: np.ndarray, h: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Adds to back what the words within their classes have as gradient, and returns that of inner and inner_prior."""
        layout, inner = self.layout, with_column(self.net["inner"], self.net["inner_prior"])
        relative = _bound(inner[:, :HIDDEN], inner[:, HIDDEN]) > SAFE
        gradient, share = np.zeros_like(inner), np.float32(1 / len(target))
        for c, rows, members in _classes(target, layout):
            mine, own = h[rows], inner[members]
            p = mine @ own.T
            if relative:
                p -= p.max(1, keepdims=True)
            np.exp(p, out=p)
            p *= (share / _sums(p))[:, None]
            p[np.arange(len(p)), layout.place[word[rows]] - members.start] -= share
            back[rows] += p @ own[:, :HIDDEN]
            np.matmul(p.T, mine, out=gradient[members])
        return gradient


# --- Spark -----------------------------------------------------------------


def _train(shared, frequency: list[float], layout: Layout):
    """One network, and its number of words, for each shard of tokens, shard sorted by shard."""

    def run(batches):
        trainer, n, own = None, 0, None
        keep_memory()

        def sent():
            return pa.RecordBatch.from_arrays([pa.array([flat(trainer.net).tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["net", "n"])

        for batch in batches:
            shards = batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            for start, stop in zip(cuts, cuts[1:]):
                if start == stop:
                    continue
                if shards[start] != own:
                    if n:
                        yield sent()
                    trainer, n, own = Trainer(unflat(shared.value, layout), np.array(frequency), layout=layout), 0, shards[start]
                docs = [d for d in batch.column(0).slice(start, stop - start).to_pylist() if d]
                for i in range(0, len(docs), 256):
                    tokens, at = padded(docs[i : i + 256], layout.dtype)
                    at = trainer.rng.permutation(at)
                    for j in range(0, len(at), BATCH):
                        trainer.step(tokens, at[j : j + BATCH])
                    n += len(at)
        if n:
            yield sent()

    return run


def _weigh(batches):
    """The weighted mean of networks. Sums are in double precision; what is sent is not."""
    total, n = None, 0
    for batch in batches:
        for net, k in zip(batch.column(0), batch.column(1), strict=True):
            part = np.frombuffer(net.as_py(), np.float32).astype(float) * k.as_py()
            total, n = (part if total is None else total + part), n + k.as_py()
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([(total / n).astype(np.float32).tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["net", "n"])


def id_counts(tokens: DataFrame, layout: Layout | None = None) -> np.ndarray:
    layout = layout or Layout()
    frequency = np.zeros(len(layout))
    for i, n in tokens.select("tokens").mapInArrow(_histogram(layout), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        frequency[i] = n
    return frequency


def dealt(tokens: DataFrame, tasks: int) -> DataFrame:
    """tokens and shard of tokens (doc_id, tokens), a shard whole and sorted in one task. A document's shard, and its place there, follow from its id and tokens."""
    hashed = tokens.select("tokens", F.xxhash64("doc_id", "tokens").alias("at")).withColumn("shard", F.pmod("at", F.lit(tasks)))
    return hashed.repartitionById(tasks, F.col("shard").cast("int")).sortWithinPartitions("shard", "at", "tokens").select("tokens", "shard")


def train(tokens: DataFrame, rounds: int = ROUNDS, frequency: np.ndarray | None = None, layout: Layout | None = None) -> dict[str, np.ndarray]:
    """The network after one pass over all documents of tokens (doc_id, tokens)."""
    spark, layout = ship(tokens.sparkSession), layout or Layout()
    frequency = id_counts(tokens, layout) if frequency is None else frequency
    of_class = np.bincount(layout.classes, frequency, VOCABULARY)
    net = with_priors(initial(layout), layout, frequency)
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(flat(net))
        part = tokens.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == r)
        tasks = max(1, math.ceil(frequency.sum() / rounds / TASK_TOKENS))
        sent = dealt(part, tasks).mapInArrow(_train(shared, of_class.tolist(), layout), "net binary, n long")
        while tasks > 1:
            tasks = math.ceil(tasks / FAN_IN)
            sent = sent.repartition(tasks).mapInArrow(_weigh, "net binary, n long")
        sent = sent.collect()
        if sent:
            # The order of the sums may differ from run to run; rounding takes that off.
            net = unflat(np.round(np.frombuffer(sent[0]["net"], np.float32).astype(float), 5), layout)
    return net


def _histogram(layout: Layout):
    def run(batches):
        total = np.zeros(len(layout), np.int64)
        for batch in batches:
            for d in batch.column(0):
                total += np.bincount(np.frombuffer(d.as_py() or b"", layout.dtype), minlength=len(layout))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(layout)), pa.int32()), pa.array(total, pa.int64())], names=["id", "n"])

    return run


def _score(shared, frequency: list[float], layout: Layout):
    """row, doc_id, number of tokens and sum of log-probabilities of row, doc_id, tokens, known; without the counts of words in no head."""

    def run(batches):
        keep_memory()
        net = unflat(shared.value, layout)
        # What is left of the shared classes beyond the vocabulary, as logarithms of its counts.
        shares = np.array([scaled_log(n) if FREQUENT < i < VOCABULARY and n else 0 for i, n in enumerate(frequency)], np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                docs = [d or b"" for d in part.column(2).to_pylist()]
                joined, at = padded(docs, layout.dtype)
                sizes = np.array([len(d) for d in docs]) // layout.dtype().itemsize
                ends = np.cumsum(sizes)
                total = np.concatenate([[0], np.cumsum(log_probabilities(net, joined, at, layout))])
                of_class = np.concatenate([[0], np.cumsum(shares[joined[at]])])
                within = part.column(3).to_numpy() - (of_class[ends] - of_class[ends - sizes])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(total[ends] - total[ends - sizes], pa.float64()), pa.array(within, pa.int64())], names=["row", "doc_id", "n_tokens", "classes", "within"])

    return run


def tail_logs(tokens: DataFrame, counted: DataFrame) -> DataFrame:
    """row, tail: the sum of the scaled logarithms of the counts of each row's tail words; rows may lack if it is 0.

    Words meet by their hash, as numbers sort faster, and are then compared. An
    equality would be sorted by as well, so the comparison is two inequalities.
    Words that occur once have the logarithm 0 and are left out.
    """
    held = tokens.select("row", F.explode("tail").alias("word")).withColumn("hash", F.xxhash64("word"))
    given = counted.where("n > 1").select(F.col("word").alias("same"), "n", F.xxhash64("word").alias("same_hash"))
    met = held.join(given, (F.col("hash") == F.col("same_hash")) & (F.col("word") >= F.col("same")) & (F.col("word") <= F.col("same")))
    return met.groupBy("row").agg(F.sum(F.round(F.log("n") * SCALE).cast("long")).alias("tail"))


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", head_words: int = HEAD_WORDS, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, log_prob, mean_log_prob.

    Tokens are the whole text's runs of other than [\\x20\\x09-\\x0D], A-Z
    lower-cased. log_prob sums the log-probabilities of these words given both
    sides: that of the word's class, that of the word or the remainder in its
    class, and that of the word in the remainder, from the counts of all words.
    The vocabulary has the words with min_count occurrences, FREQUENT +
    max_words at most. The counts of head_words words at most are broadcast;
    all others are joined by the word itself. Null, empty or blank text has no
    tokens, log_prob 0 and a null mean. Repeated rows train and are scored
    each. An empty table gives an empty result; other columns are not read.
    """
    spark = ship(docs.sparkSession)
    counted, _ = stage(word_counts(docs, text), "words")
    head = head_counts(counted, head_words)
    logs = spark.sparkContext.broadcast({w: scaled_log(n) for w, n in head.items()})
    further = further_words(counted, min_count, max_words)
    layout = Layout(further)
    own = docs.select(F.monotonically_increasing_id().alias("row"), docs[text].alias("text"), docs[id_col].cast("long").alias("doc_id"))
    tokens, _ = stage(own.mapInArrow(_tokenise(most_frequent(counted), logs, further), "row long, doc_id long, tokens binary, known long, tail array<binary>"), "tokens")
    frequency = id_counts(tokens, layout)
    shared = spark.sparkContext.broadcast(flat(train(tokens, frequency=frequency, layout=layout)))
    given = tokens.select("row", "doc_id", "tokens", "known").repartition(max(1, math.ceil(frequency.sum() / TASK_TOKENS)), "row")
    scored = given.mapInArrow(_score(shared, frequency.tolist(), layout), "row long, doc_id long, n_tokens long, classes double, within long")
    tail = tail_logs(tokens, counted)
    total = F.round(F.col("classes") + (F.col("within") + F.coalesce("tail", F.lit(0))) / SCALE, 6)
    done = scored.join(tail, "row", "left").withColumn("log_prob", total)
    return done.select("doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """score() over all documents; edge cases are score()'s."""
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
