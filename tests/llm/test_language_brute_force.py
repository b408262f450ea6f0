"""Predictions of a small corpus against vectors written out."""

import zlib

import numpy as np

from docloom.llm import language_id


def vector(text, dim=language_id.DIM):
    own, lut = language_id.letters(dim), language_id.symbols()
    out = np.zeros(dim)
    for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        ids = [0, *[int(lut[ord(c)]) for c in w], 0]
        for a, b, c in zip(ids, ids[1:], ids[2:]):
            out += np.roll(own[a], 2) * np.roll(own[b], 1) * own[c]
    return out


def test_query_matches_brute_force(spark, tmp_path):
    words = {"en": "the house and garden by river with trees", "de": "das haus und der garten am fluss mit bäumen", "fr": "la maison et le jardin près de la rivière"}
    rows = [(i, " ".join(words[lang].split()[i % 5 :]) + " xyz" * (i % 3) * (i % 7), lang) for i in range(60) for lang in [["en", "de", "fr"][i % 3]]]
    rows += [(70, "le haus garden", None), (71, "123 …", "en"), (72, None, "de"), (73, "\U0001f600 \U0001f601", "fr"), (74, "\U00020000\U00020001", None)]
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    sums = {}
    for i, text, lang in rows:
        v = vector(text)
        if lang and not held[i] and np.linalg.norm(v):
            sums[lang] = sums.get(lang, 0) + np.rint(v * (language_id.SCALE / np.linalg.norm(v)))
    got = {r["doc_id"]: r for r in language_id.op7_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        v = vector(text)
        cos = {k: float(v @ s / np.linalg.norm(v) / np.linalg.norm(s)) if np.linalg.norm(v) else 0.0 for k, s in sorted(sums.items())}
        known = any(c.isalpha() for c in text or "")
        best = max(cos, key=cos.get)
        assert got[i]["held_out"] == held[i]
        assert got[i]["lang_pred"] == (best if known else "und")
        assert abs(got[i]["score"] - (min(max(cos[best], 0), 1) if known else 0.0)) < 1e-9
