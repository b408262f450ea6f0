"""Language identification by hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A letter trigram is bound
from its letters' vectors, permuted (rotated) twice, once and not at all, by
multiplication. A document bundles the vectors of its trigrams, a language
those of its documents, each scaled to the same length, so that no long
document outweighs the others of its language; a document gets the language
whose prototype has the largest cosine. All components are whole numbers far
below 2**53, so sums do not depend on the order of tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import table
from docloom.ship import ship

#: Length of the vectors.
DIM = 512
#: Code points. A letter's symbol is its code point; 0 stands between words.
POINTS = 0x110000
#: Characters that are worked on at once; bounds memory for texts of any length.
CHUNK = 1 << 20
#: Length to which document vectors are scaled before their components are rounded and bundled.
SCALE = 1 << 20
#: Languages that a task holds at once.
HELD_LANGUAGES = 1024
UNKNOWN = "und"

_cache: dict = {}


def symbols() -> np.ndarray:
    """Symbol of each code point: its own number if it is a letter, else 0."""
    if "symbols" not in _cache:
        _cache["symbols"] = np.fromiter((cp if chr(cp).isalpha() else 0 for cp in range(POINTS)), np.int32, POINTS)
    return _cache["symbols"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Letters:
    """The vectors of all symbols, worked out from hashes of symbol and position where they are asked for."""

    def __init__(self, dim: int):
        self.dim = dim

    def __getitem__(self, symbol) -> np.ndarray:
        at = np.asarray(symbol).astype(np.uint64)[..., None] << np.uint64(16) | np.arange(-(-self.dim // 64), dtype=np.uint64)
        bits = np.unpackbits(_mix(_mix(at + np.uint64(0x9E3779B97F4A7C15))).astype("<u8").view(np.uint8), axis=-1)
        return bits[..., : self.dim].astype(np.float32) * 2 - 1


def letters(dim: int = DIM) -> Letters:
    return Letters(dim)


def trigram_vectors(codes: np.ndarray, alphabet: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The bound vectors of trigrams, whose code is (a * n + b) * n + c with places in the alphabet of n symbols."""
    own, n = letters(dim)[alphabet], len(alphabet)
    once, twice = np.roll(own, 1, 1), np.roll(own, 2, 1)
    return twice[codes // n**2] * once[codes // n % n] * own[codes % n]


def text_symbols(lowered: str) -> np.ndarray:
    return symbols()[np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)]


#: Codes that a table of the trigrams in use may have; with larger alphabets they are sorted.
TABLE = 1 << 22


def _places(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct symbols, and each value's place among them."""
    seen = np.zeros(POINTS, np.int32)
    seen[values] = 1
    used = np.flatnonzero(seen)
    seen[used] = np.arange(len(used))
    return used, seen[values]


def bundles(texts: list[str | None], dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Document vectors (float64, whole numbers) and the number of letters of each text."""
    out, n_letters = np.zeros((len(texts), dim)), np.zeros(len(texts), np.int64)
    docs, codes, held = [], [], 0

    def flush():
        nonlocal held
        if held:
            all_docs = np.concatenate(docs)
            alphabet, places = _places(np.concatenate(codes, axis=1))
            size = len(alphabet)
            all_codes = (places[0].astype(np.int64) * size + places[1]) * size + places[2]
            if size**3 <= TABLE:
                seen = np.zeros(size**3, np.int32)
                seen[all_codes] = 1
                used = np.flatnonzero(seen)
                seen[used] = np.arange(len(used))
                trigram = seen[all_codes]
            else:
                used, trigram = np.unique(all_codes, return_inverse=True)
            rows, local = np.unique(all_docs, return_inverse=True)
            for at in range(0, len(rows), 64):
                pick = (local >= at) & (local < at + 64) if len(rows) > 64 else slice(None)
                n = min(64, len(rows) - at)
                counts = np.bincount((local[pick] - at) * len(used) + trigram[pick], minlength=n * len(used)).reshape(n, -1)
                for lo in range(0, len(used), 4096):
                    out[rows[at : at + n]] += counts[:, lo : lo + 4096].astype(np.float32) @ trigram_vectors(used[lo : lo + 4096], alphabet, dim)
        docs.clear(), codes.clear()
        held = 0

    for i, text in enumerate(texts):
        lowered = (text or "").lower()
        for at in range(0, len(lowered), CHUNK):
            # A cut text is read with the characters on either side of the cuts, so it has the trigrams of the whole.
            stop = min(at + CHUNK, len(lowered))
            s = text_symbols(lowered[max(at - 1, 0) : stop + 1])
            s = np.concatenate([[0] * (at == 0), s, [0] * (stop == len(lowered))]).astype(np.int32)
            inner = s[1:-1] != 0
            n_letters[i] += np.count_nonzero(inner)
            c = np.stack([s[:-2], s[1:-1], s[2:]])[:, inner]
            if not c.shape[1]:
                continue
            codes.append(c)
            docs.append(np.full(c.shape[1], i, np.int64))
            held += c.shape[1]
            if held >= CHUNK // 4:
                flush()
    flush()
    return out, n_letters


def _pieces(texts: pa.Array):
    """(start, texts) of about CHUNK / 4 characters."""
    i, n = 0, len(texts)
    while i < n:
        got, size, j = [], 0, i
        while j < n and (j == i or size < CHUNK // 4):
            t = texts[j].as_py()
            got.append(t)
            size += len(t or "")
            j += 1
        yield i, got
        i = j


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length SCALE, in whole numbers; zero vectors stay."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.rint(vectors * (SCALE / np.where(length > 0, length, 1)))


def _profile(dim: int):
    def run(batches):
        sums: dict[str, np.ndarray] = {}

        def rows():
            for lang, v in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(np.arange(dim), pa.int32()), pa.array(v, pa.float64())], names=["lang", "i", "v"])

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at, texts in _pieces(batch.column(1)):
                for i, v in enumerate(scaled(bundles(texts, dim)[0])):
                    lang = langs[at + i]
                    if lang in sums:
                        sums[lang] += v
                    else:
                        sums[lang] = v
            if len(sums) > HELD_LANGUAGES:
                yield from rows()
                sums.clear()
        yield from rows()

    return run


def train(labelled: DataFrame, dim: int = DIM) -> dict[str, list[float]]:
    """Prototypes of each language of labelled (lang, text).

    All rows count. A task sends one vector for each language it meets; these
    are summed by key. What reaches the driver is dim numbers for each distinct
    label, so the bound is the number of languages.
    """
    ship(labelled.sparkSession)
    sums = labelled.select("lang", "text").mapInArrow(_profile(dim), "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    out: dict[str, list[float]] = {}
    for lang, v in sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("v")).collect():
        out[lang] = [x["v"] for x in v]
    return {k: v for k, v in sorted(out.items()) if any(v)}


def _matrix(prototypes: dict[str, list[float]]) -> np.ndarray:
    return np.array(list(prototypes.values()), float) if prototypes else np.zeros((0, DIM))


def _answers(names: list[str], prototypes: np.ndarray):
    """Language, score and number of letters of each of some texts."""
    dim = prototypes.shape[1]
    unit = prototypes / np.linalg.norm(prototypes, axis=1, keepdims=True)

    def answers(texts):
        vectors, n_letters = bundles(texts, dim)
        length = np.linalg.norm(vectors, axis=1)
        known = (n_letters > 0) & (length > 0) & bool(names)
        cos = vectors @ unit.T / np.where(length > 0, length, 1)[:, None] if names else np.zeros((len(texts), 1))
        best = cos.argmax(1)
        langs = [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        return langs, np.where(known, np.clip(cos[np.arange(len(texts)), best], 0, 1), 0.0), n_letters

    return answers


def _predict(names: list[str], prototypes: np.ndarray):
    answers = _answers(names, prototypes)

    def run(batches):
        for batch in batches:
            for at, texts in _pieces(batch.column(1)):
                langs, score, n_letters = answers(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(n_letters, pa.int64())], names=["doc_id", "lang_pred", "score", "n_letters"])

    return run


def _identified(names: list[str], prototypes: np.ndarray, text: int, min_letters: int, min_score: float):
    """The rows whose text, in column `text`, is not rejected."""
    answers = _answers(names, prototypes)

    def run(batches):
        for batch in batches:
            for at, texts in _pieces(batch.column(text)):
                langs, score, n_letters = answers(texts)
                rejected = (np.array(langs) == UNKNOWN) | (n_letters >= min_letters) & (score < min_score)
                yield batch.slice(at, len(texts)).filter(pa.array(~rejected))

    return run


def identify(docs: DataFrame, prototypes: dict[str, list[float]], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score, n_letters.

    score is the cosine of the document with its language's prototype, cut to 0
    to 1. Ties go to the language that sorts first. Text that is null, empty or
    without letters is "und" with score 0, and so is every text if there are no
    prototypes. Texts of any length are read whole. Repeated rows get the same
    answer; other columns are not read.
    """
    ship(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(_predict(list(prototypes), _matrix(prototypes)), "doc_id long, lang_pred string, score double, n_letters long")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """identify() over documents, with prototypes of all labelled documents outside the held-out fold. Edge cases are identify()'s; a null doc_id is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    prototypes = train(docs.where(~held_out() & F.col("lang").isNotNull()))
    return identify(docs, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: A document is rejected if it has no letters, or if it has MIN_LETTERS and its cosine is below MIN_SCORE.
#: The cosine of a shorter text is low whatever its language, so it doesn't count against it.
MIN_LETTERS, MIN_SCORE = 200, 0.2


def keep_identified(docs: DataFrame, min_letters: int = MIN_LETTERS, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs with a language, with the columns of docs, whatever their names.

    Each row goes or stays by its own text, whatever its doc_id, so rows with a
    null or repeated id and repeated rows need no rule. Null, empty and
    letter-free texts go, and so does every text if no row has a label. Texts of
    any length are read whole. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    prototypes = train(docs.where(~held_out() & F.col("lang").isNotNull()))
    return docs.mapInArrow(_identified(list(prototypes), _matrix(prototypes), docs.columns.index("text"), min_letters, min_score), docs.schema)
