"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The frequent words of the corpus, counted over all documents, are compiled into
a minimal acyclic automaton that shares prefixes and suffixes. Its transitions
carry numbers; their sum along a word's path is the word's place in the table
of id outputs. The compiled file is sent to the executors once and memory
mapped by their Python workers. Words that the automaton does not accept are
merged exactly. Texts are cut into words, and words told apart by two 64-bit
hashes, in numpy; a word is looked up once a task.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import tempfile
import unicodedata
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import stage, table
from docloom.ship import ship

#: Words in the lexicon, at most; bounds what the driver compiles.
LEXICON_WORDS = 100_000
#: Longer words are not compiled.
LEXICON_BYTES = 48
#: Characters that are worked on at once.
CHUNK = 1 << 19
#: Distinct words that a task holds at once.
HELD_WORDS = 600_000

#: Fixed value: the pattern of the tokenizer file, which spans() follows.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_cache: dict = {}


# --- The model -------------------------------------------------------------


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Model:
    """What a tokenizer file holds: ids of bytes, merges, token strings and special tokens."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        if steps[0]["pattern"]["Regex"] != SPLIT:
            raise ValueError("spans() cuts words by another pattern than this file's")
        own = byte_symbols()
        self.inner = np.array([vocab[c] for c in own], np.int32)
        self.final = np.array([vocab[c + end] for c in own], np.int32)
        self.size = max(self.tokens) + 1
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        keys = np.array([a * self.size + b for a, b, _ in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.results = np.array([c for _, _, c in merges], np.int32)
        self.pairs = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        self.token_bytes = [self.tokens.get(i, "").encode() for i in range(self.size)]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; pairs that never merge get 2**30. Negative ids stand for nothing."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], 1 << 30)

    def merge_long(self, word: bytes) -> list[int]:
        """Lowest rank first, then leftmost: with a heap, for words of any length."""
        ids = [int(self.inner[b]) for b in word[:-1]] + [int(self.final[word[-1]])]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.results[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (s := self.pairs.get((ids[p], ids[q]))) is not None:
                    heapq.heappush(heap, (s, p, ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, by the same rule, for many words at once."""
        out: list = [None] * len(words)
        sizes = np.array([len(w) for w in words])
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 20), (20, 40)):
            chosen = np.flatnonzero((sizes > low) & (sizes <= high))
            for at in range(0, len(chosen), 50_000):
                pick = chosen[at : at + 50_000]
                for i, ids in zip(pick, self._merge_block([words[i] for i in pick], high), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(sizes > 40):
            out[i] = np.array(self.merge_long(words[i]), np.int32)
        return out

    def _merge_block(self, words: list[bytes], width: int) -> list[np.ndarray]:
        n = len(words)
        size = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        cols = np.arange(width)
        ids = np.where(cols < size[:, None], self.inner[raw], -1)
        ids[np.arange(n), size - 1] = self.final[raw[np.arange(n), size - 1]]
        rank = np.full((n, width), 1 << 30, np.int32)
        rank[:, :-1] = self.rank_of(ids[:, :-1], ids[:, 1:])
        open_ = np.arange(n)
        while len(open_):
            at = rank[open_].argmin(1)
            best = rank[open_, at]
            going = best < 1 << 30
            open_, at, best = open_[going], at[going], best[going]
            if not len(open_):
                break
            move = np.minimum(cols + (cols > at[:, None]), width - 1)
            for m, empty in ((ids, -1), (rank, 1 << 30)):
                part = np.take_along_axis(m[open_], move, 1)
                part[:, -1] = empty
                m[open_] = part
            ids[open_, at] = self.results[best]
            here, left, right = ids[open_, at], np.where(at > 0, ids[open_, at - 1], -1), np.where(at < width - 1, ids[open_, np.minimum(at + 1, width - 1)], -1)
            rank[open_, at] = self.rank_of(here, right)
            first = at > 0
            rank[open_[first], at[first] - 1] = self.rank_of(left[first], here[first])
        lengths = (ids >= 0).sum(1)
        return [row[:k] for row, k in zip(ids.astype(np.int32), lengths, strict=True)]


# --- The lexicon -----------------------------------------------------------


def compile_lexicon(words: dict[bytes, np.ndarray]) -> bytes:
    """A minimal acyclic transducer from words to ids, as bytes that lookup() reads in place.

    Words are added in order; as soon as a branch can't change any more, each
    of its states is replaced by an equal one if there is one. The number on a
    transition is how many words the state accepts before those that take it.
    """
    register: dict = {}
    counts: dict[int, int] = {}
    states: list[tuple] = []

    def settle(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
            counts[register[key]] = state[0] + sum(counts[t] for _, t in state[1])
        return register[key]

    path, last = [[False, []]], b""
    ordered = sorted(words)
    for word in ordered:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        for depth in range(len(last), shared, -1):
            path[depth - 1][1].append((last[depth - 1], settle(path.pop())))
        for _ in word[shared:]:
            path.append([False, []])
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        path[depth - 1][1].append((last[depth - 1], settle(path.pop())))
    start = settle(path[0])
    keys, targets, adds = [], [], []
    for s, (final, arcs) in enumerate(states):
        add = int(final)
        for label, t in arcs:
            keys.append(s << 8 | label)
            targets.append(t)
            adds.append(add)
            add += counts[t]
    ids = [words[w] for w in ordered]
    parts = [np.array(x, np.int64) for x in ([start], keys, targets, adds, [int(f) for f, _ in states], np.cumsum([0] + [len(i) for i in ids]), np.concatenate([*ids, np.empty(0, np.int32)]))]
    head = np.array([len(parts), *[len(p) for p in parts]], np.int64)
    return head.tobytes() + b"".join(p.tobytes() for p in parts)


class Lexicon:
    def __init__(self, data):
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, n, 8)
        at, parts = 8 * (n + 1), []
        for size in sizes:
            parts.append(np.frombuffer(data, np.int64, int(size), at))
            at += 8 * int(size)
        start, self.keys, self.targets, self.adds, self.finals, self.offsets, self.ids = parts
        self.start = int(start[0])

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the output table, or -1. All words walk the automaton together."""
        n = len(words)
        if not n or not len(self.keys):
            return np.full(n, -1, np.int64)
        sizes = np.array([len(w) for w in words])
        starts = np.cumsum(sizes) - sizes
        raw = np.frombuffer(b"".join(words), np.uint8)
        state, place, alive = np.full(n, self.start), np.zeros(n, np.int64), np.flatnonzero((sizes > 0) & (sizes <= LEXICON_BYTES))
        ok = np.zeros(n, bool)
        step = 0
        while len(alive):
            key = state[alive] << 8 | raw[starts[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = self.keys[at] == key
            alive, at = alive[good], at[good]
            state[alive] = self.targets[at]
            place[alive] += self.adds[at]
            step += 1
            done = sizes[alive] == step
            ok[alive[done]] = self.finals[state[alive[done]]] == 1
            alive = alive[~done]
        return np.where(ok, place, -1)

    def output(self, place: int) -> np.ndarray:
        return self.ids[self.offsets[place] : self.offsets[place + 1]]


# --- Words of texts --------------------------------------------------------


def classes() -> np.ndarray:
    """Of each code point: 0 white space, 1 letter, 2 number, 3 other, by the Unicode version of this Python.

    What later versions assign counts as other.
    """
    if "classes" not in _cache:
        out = np.array([{"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3) for c in range(0x110000)], np.uint8)
        out[_SPACE] = 0
        _cache["classes"] = out
    return _cache["classes"]


def normalise(text: str) -> str:
    """NFC, then each character lower-cased by itself."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _powers(x: int, n: int) -> np.ndarray:
    """The powers 0 to n of x, modulo 2**64."""
    factors = np.full(n + 1, x, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def _hashing() -> list:
    if "hashing" not in _cache:
        rng, out = np.random.default_rng(11), []
        for _ in range(2):
            r = int(rng.integers(0, 1 << 62)) * 4 + 3
            inverse = pow(r, -1, 1 << 64)
            n = 2 * CHUNK
            powers = [_powers(x, n) for x in (r, inverse)]
            out.append((rng.integers(0, 1 << 63, 0x110000, dtype=np.uint64), *powers))
        _cache["hashing"] = out
    return _cache["hashing"]


def spans(cps: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where SPLIT finds words: runs of one class, numbers one by one, and short endings after a lone apostrophe."""
    c = lut[cps]
    first = np.ones(len(c), bool)
    first[1:] = (c[1:] != c[:-1]) | (c[1:] == 2)
    s = np.flatnonzero(first)
    e = np.append(s[1:], len(c))[: len(s)]
    mark = np.flatnonzero((cps[s] == 39) & (e - s == 1) & (e < len(c)))
    if len(mark):
        a = cps[e[mark]]
        b = cps[np.minimum(e[mark] + 1, len(c) - 1)] * (e[mark] + 1 < len(c))
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = np.isin(a * 0x200000 + b, [ord(x) * 0x200000 + ord(y) for x, y in ("re", "ve", "ll")])
        size = one + 2 * two
        e[mark] += size
        s[mark + (size > 0)] += size
    word = (e > s) & (c[np.minimum(s, len(c) - 1)] != 0) if len(c) else np.zeros(0, bool)
    return s[word], e[word]


class Words:
    """The words of one text chunk: code points, and where words begin and end, in order of the texts."""

    def __init__(self, model: Model, texts: list[str]):
        parts, starts, ends, owners, specials = [], [], [], [], []
        at = 0
        lut = classes()
        finder = regex.compile("|".join(map(regex.escape, sorted(model.special, key=len, reverse=True)))) if model.special else None
        for owner, text in enumerate(texts):
            pieces = [text]
            if finder and "<|" in text:
                pieces = [x for i, x in enumerate(_cut(finder, text)) if x]
            for piece in pieces:
                if piece in model.special:
                    s, e = np.array([at]), np.array([at])  # an empty span stands for a special token
                    specials.append((len(owners), sum(map(len, starts)), model.special[piece]))
                else:
                    piece = normalise(piece)
                    cps = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
                    s, e = spans(cps, lut)
                    s, e = s + at, e + at
                    parts.append(cps)
                    at += len(cps)
                starts.append(s)
                ends.append(e)
                owners.append(np.full(len(s), owner))
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        self.cps, self.starts, self.ends, self.owners = join(parts, np.uint32), join(starts, np.int64), join(ends, np.int64), join(owners, np.int64)
        self.special = {i: token for _, i, token in specials}

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for letters, power, inverse in _hashing():
            if len(self.cps) >= len(power):
                power, inverse = (_powers(int(x[1]), len(self.cps)) for x in (power, inverse))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters[self.cps] * power[: len(self.cps)], dtype=np.uint64)])
            h = (total[self.ends] - total[self.starts]) * inverse[self.starts]
            out.append(h ^ (h >> np.uint64(32)))
        return out[0], out[1]

    def word(self, i: int) -> bytes:
        return self.cps[self.starts[i] : self.ends[i]].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")


def _cut(finder, text: str) -> list[str]:
    out, at = [], 0
    for m in finder.finditer(text):
        out += [text[at : m.start()], m.group()]
        at = m.end()
    return [*out, text[at:]]


def _chunks(texts: pa.Array):
    """(start, texts) with about CHUNK characters; null counts as empty."""
    i, n = 0, len(texts)
    while i < n:
        got, size, j = [], 0, i
        while j < n and (j == i or size < CHUNK):
            t = texts[j].as_py() or ""
            got.append(t)
            size += len(t)
            j += 1
        yield i, got
        i = j


class Distinct:
    """The distinct words that a task has met: sorted first hashes, and the number of each word."""

    def __init__(self):
        self.hashes, self.checks, self.codes, self.n = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), 0

    def number(self, words: Words) -> tuple[np.ndarray, list[bytes]]:
        """The code of each word, and the words that are new, in the order of their codes."""
        h, check = words.hashes()
        uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, uniq), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == uniq if len(self.hashes) else np.zeros(len(uniq), bool)
        codes = np.empty(len(uniq), np.int64)
        codes[known] = self.codes[at[known]]
        fresh = np.flatnonzero(~known)
        codes[fresh] = self.n + np.arange(len(fresh))
        agreed = np.empty(len(uniq), np.uint64)
        agreed[known] = self.checks[at[known]]
        agreed[fresh] = check[first[fresh]]
        if not np.array_equal(agreed[back], check):
            raise ArithmeticError("two words share a 64-bit hash; change the seed of the hashes")
        new = [words.word(i) for i in first[fresh]]
        self.n += len(fresh)
        where = np.searchsorted(self.hashes, uniq[fresh])
        self.hashes, self.checks, self.codes = (np.insert(a, where, b) for a, b in ((self.hashes, uniq[fresh]), (self.checks, agreed[fresh]), (self.codes, codes[fresh])))
        return codes[back], new


# --- Spark -----------------------------------------------------------------


def _model(text: str) -> Model:
    key = ("model", hash(text))
    if key not in _cache:
        _cache[key] = Model(text)
    return _cache[key]


def _count(model_text):
    def run(batches):
        model, seen, names, counts = _model(model_text.value), Distinct(), [], np.empty(0, np.int64)

        def rows():
            for at in range(0, len(names), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 20_000], pa.binary()), pa.array(counts[at : at + 20_000], pa.int64())], names=["word", "n"])

        for batch in batches:
            for _, texts in _chunks(batch.column(0)):
                codes, new = seen.number(Words(model, texts))
                names += new
                more = np.bincount(codes, minlength=seen.n)
                more[: len(counts)] += counts
                counts = more
                if seen.n > HELD_WORDS:
                    yield from rows()
                    seen, names, counts = Distinct(), [], np.empty(0, np.int64)
        yield from rows()

    return run


def frequent_words(docs: DataFrame, model_text, text: str = "text", limit: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent words of all documents, at most `limit`: all words above the least count that leaves no more.

    The counts' histogram in steps of a quarter octave, some 250 numbers, gives
    that count, so that no task sends the driver more than its share of the words.
    """
    counted = docs.select(docs[text].alias("text")).mapInArrow(_count(model_text), "word binary, n long")
    total, _ = stage(counted.where(f"octet_length(word) BETWEEN 1 AND {LEXICON_BYTES}").groupBy("word").agg(F.sum("n").alias("n")), "words")
    step = F.floor(F.log2("n") * 4)
    least, held = None, 0
    for r in sorted(total.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        held += r["words"]
        if held > limit:
            break
        least = r["s"]
    if least is None:
        return []
    return sorted(bytes(r["word"]) for r in total.where(step >= least).select("word").collect())


def _lexicon(name: str) -> Lexicon:
    if name not in _cache:
        with open(SparkFiles.get(name), "rb") as f:
            _cache[name] = Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    return _cache[name]


class Encoder:
    def __init__(self, model: Model, lexicon: Lexicon | None = None):
        self.model, self.lexicon = model, lexicon
        self.reset()

    def reset(self):
        self.seen, self.flat, self.starts, self.sizes = Distinct(), [np.empty(0, np.int32)], np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.seen.n > HELD_WORDS:
            self.reset()
        words = Words(self.model, texts)
        codes, new = self.seen.number(words)
        if new:
            place = self.lexicon.lookup(new) if self.lexicon else np.full(len(new), -1)
            ids: list = [self.lexicon.output(p) if p >= 0 else None for p in place]
            unseen = [i for i, x in enumerate(ids) if x is None]
            for i, x in zip(unseen, self.model.merge([new[i] for i in unseen]), strict=True):
                ids[i] = x if x is not None else np.empty(0, np.int32)
            size = np.array([len(x) for x in ids], np.int64)
            base = int(self.starts[-1] + self.sizes[-1]) if len(self.starts) else 0
            self.starts = np.concatenate([self.starts, base + np.cumsum(size) - size])
            self.sizes = np.concatenate([self.sizes, size])
            self.flat = [np.concatenate([*self.flat, *ids]).astype(np.int32)]
        size = self.sizes[codes]
        for i in words.special:
            size[i] = 1
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[0][np.minimum(np.repeat(self.starts[codes] - (ends - size), size) + np.arange(total), len(self.flat[0]) - 1)] if len(self.flat[0]) else np.zeros(total, np.int32)
        for i, token in words.special.items():
            flat[ends[i] - 1] = token
        bounds = np.concatenate([[0], ends])[np.searchsorted(words.owners, np.arange(len(texts) + 1))]
        return [flat[bounds[i] : bounds[i + 1]] for i in range(len(texts))]


def decode(model: Model, ids) -> str:
    """Token strings with a space between, which is what the file's missing decoder gives."""
    return b" ".join(map(model.token_bytes.__getitem__, [int(i) for i in ids])).decode()


def _encode(model_text, lexicon: str):
    def run(batches):
        encoder = Encoder(_model(model_text.value), _lexicon(lexicon))
        for batch in batches:
            for at, texts in _chunks(batch.column(1)):
                ids = encoder.encode(texts)
                values = pa.array(np.concatenate(ids), pa.int32())
                offsets = pa.array(np.cumsum([0] + [len(x) for x in ids]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "ids"])

    return run


def _digest(model_text, lexicon: str):
    def run(batches):
        model = _model(model_text.value)
        encoder, table_ = Encoder(model, _lexicon(lexicon)), model.token_bytes.__getitem__
        for batch in batches:
            for at, texts in _chunks(batch.column(1)):
                ids = encoder.encode(texts)
                raw = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
                back = [hashlib.sha256(b" ".join(map(table_, x.tolist()))).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([len(x) for x in ids], pa.int64()), pa.array(raw), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def prepare(docs: DataFrame, text: str = "text", path: str | None = None, limit: int = LEXICON_WORDS):
    """(broadcast tokenizer file, name of the lexicon file) for the words of docs."""
    spark = ship(docs.sparkSession)
    source = Path(path or vocabulary_path()).read_text(encoding="utf-8")
    shared = spark.sparkContext.broadcast(source)
    words = frequent_words(docs, shared, text, limit)
    compiled = compile_lexicon(dict(zip(words, Model(source).merge(words), strict=True)))
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    file = Path(tempfile.mkdtemp(prefix="docloom-")) / name
    file.write_bytes(compiled)
    spark.sparkContext.addFile(str(file))
    return shared, name


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, ids.

    ids are those of the tokenizers library for the file at path, without added
    special tokens; special strings within a text are tokens. Null or blank
    text has no ids. Texts of any length are read whole. Repeated rows get the
    same ids; other columns are not read.
    """
    shared, name = prepare(docs, text, path)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(_encode(shared, name), "doc_id long, ids array<int>")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shared, name = prepare(docs)
    return docs.mapInArrow(_digest(shared, name), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
