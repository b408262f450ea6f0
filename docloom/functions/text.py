"""Text normalisation as Column functions. White space is that of Unicode, as in (?U)\\s."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

#: The white space of (?U)\s, for trimming without a pattern.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space other than a single blank: of ASCII alone, and of Unicode.
SPACE_ASCII, SPACE = r" \s+|[\t-\r]\s*", r"(?U) \s+|[\s&&[^ ]]\s*"

# Fixed values.
BLANKS = "\u00a0\u2007\u202f\u2009"
REMOVED = "\u200b\u200c\u200d\ufeff"
SINGLE_QUOTES, DOUBLE_QUOTES, DASHES = "\u2018\u2019\u201a\u201b", "\u201c\u201d\u201e", "\u2013\u2014\u2212"
SPELLED = {"\u2026": "...", "\ufb01": "fi", "\ufb02": "fl"}
GLUED_LABELS = "Buyer|Email|Phone|Telephone|Fax|Address|Name|Date|Title|City"
PLACEHOLDERS = ["n/a", "not stated", "none", "-", "--", "tbd"]
NO_ITEM = ["n/a", "none", "-", "not stated"]
#: Running headers and footers: page numbers in three styles, and whatever the caller adds.
BOILERPLATE = [r"(?i)^\s*Page\s+\d+\s*(\|\s*\d+\s*)?$", r"^\s*\d+\s*\|\s*\d+\s*$", r"(?i)^\s*Page\s+\d+\s+of\s+\d+\s*$"]
STOPWORDS = "a an and are as at be by for from has have in is it its of on or that the this to was were will with your you our their not any all may must shall should".split()


def _nfkc(c: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.pandas_udf(run, StringType())(c)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def nfkc(c: Column) -> Column:
    """NFKC, in Python for values with other than ASCII characters alone."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, c).otherwise(_nfkc(F.when(~plain, c)))


def fix_unicode(c: Column, normalise: bool = True) -> Column:
    """NFKC, then typographic blanks, quotes, dashes and ligatures to ASCII; zero-width characters go."""
    out = nfkc(c) if normalise else c
    given = BLANKS + SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + REMOVED
    wanted = " " * len(BLANKS) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES)
    out = F.translate(out, given, wanted)
    for a, b in SPELLED.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def collapse_whitespace(c: Column) -> Column:
    """One kind of line end, single blanks, at most one empty line, nothing at the ends."""
    out = F.regexp_replace(c, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def dehyphenate(c: Column) -> Column:
    """Words cut by a hyphen at a line end become whole."""
    return F.regexp_replace(c, r"(?U)(\w)-\n(\w)", "$1$2")


def normalize_text(c: Column, rejoin: bool = True) -> Column:
    """N4."""
    out = fix_unicode(c)
    return collapse_whitespace(dehyphenate(out) if rejoin else out)


def deconcatenate_labels(c: Column) -> Column:
    """Blanks around a form label that is glued to its value."""
    return F.regexp_replace(F.regexp_replace(c, f"(?<![^A-Za-z0-9])({GLUED_LABELS})(?=[A-Z0-9])", " $1 "), r"(?U)^\s+", "")


def squish(c: Column) -> Column:
    """One line with single blanks."""
    # Patterns of Unicode's white space take many times as long, and single blanks stay as they are.
    plain = F.octet_length(c) == F.char_length(c)
    return F.btrim(F.when(plain, F.regexp_replace(c, SPACE_ASCII, " ")).otherwise(F.regexp_replace(c, SPACE, " ")), F.lit(" "))


def is_boilerplate(c: Column, more: list[str] | None = None) -> Column:
    """Blank, or one of the patterns."""
    out = strip(c) == ""
    for p in BOILERPLATE + (more or []):
        out = out | strip(c).rlike(p)
    return out


def strip_boilerplate_lines(c: Column, more: list[str] | None = None) -> Column:
    return strip(F.array_join(F.filter(F.split(c, "\n"), lambda x: ~is_boilerplate(x, more)), "\n"))


def shorten(c: Column, limit: int) -> Column:
    return F.when(F.char_length(c) > limit, F.concat(F.regexp_replace(F.substring(c, 1, limit), r"(?U)\s+$", ""), F.lit("..."))).otherwise(c)


def clean_text(c: Column, max_length: int | None = None) -> Column:
    """Squished, without a trailing "See more", shortened; empty is null."""
    out = strip(F.regexp_replace(squish(c), r"(?i)\s*(?:\u2026|\.\.\.)?\s*See more\s*$", ""))
    return F.nullif(shorten(out, max_length) if max_length else out, F.lit(""))


def strip_leading_label(c: Column) -> Column:
    """N10."""
    return strip(F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9 /#()\-]{1,38}:\s*", ""))


def sentence_of(c: Column, start: Column, end: Column, limit: int = 400) -> Column:
    """The sentence around the characters from start (0-based) to end (exclusive)."""
    before = F.substring(c, F.lit(1), start)
    left = F.char_length(F.regexp_extract(before, r"(?s)^(.*[.\n])?", 1))
    # A limit as in Python: what follows the span up to and with the next full stop or line end.
    rest = F.regexp_extract(F.substring(c, end + 1, F.char_length(c)), r"(?s)^([^.\n]*[.\n]?)", 1)
    return squish(shorten(strip(F.concat(F.substring(c, left + 1, end - left), rest)), limit))


def span_around(c: Column, start: Column, end: Column, margin: int = 80) -> Column:
    """The characters around a match, with dots where text was cut."""
    left = F.greatest(start - margin, F.lit(0))
    right = F.least(end + margin, F.char_length(c))
    dots = lambda cut: F.when(cut, "...").otherwise("")
    return F.concat(dots(left > 0), squish(F.substring(c, left + 1, right - left)), dots(right < F.char_length(c)))


def distinct_ignoring_case(items: Column) -> Column:
    """The first of each set of items that differ in case only, in order."""

    def first(xs: Column) -> Column:
        return once(F.transform(xs, F.lower), lambda keys: F.filter(xs, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1))

    return once(items, first)


def once(c: Column, use) -> Column:
    """use(c) with c worked out once a row, even where a lambda within names it for every element."""
    return F.element_at(F.transform(F.array(c), use), 1)


def to_list(c: Column) -> Column:
    """Items between commas, semicolons, double blanks and line ends."""
    items = F.transform(F.split(c, r"(?U)[,;]|\s{2,}|\n"), lambda x: F.btrim(squish(x), F.lit(" .,;")))
    return F.coalesce(distinct_ignoring_case(F.filter(items, lambda x: (x != "") & ~F.lower(x).isin(NO_ITEM))), F.array().cast("array<string>"))


def prune_subsumed(items: Column) -> Column:
    """Without short items and items within others; if none is left, without short ones."""
    kept = F.filter(items, lambda x: F.char_length(x) >= 4)
    out = F.filter(kept, lambda x: ~F.exists(kept, lambda y: (F.lower(y) != F.lower(x)) & F.contains(F.lower(y), F.lower(x))))
    return F.when(F.size(out) > 0, out).otherwise(kept)


def held_by_longer(texts: list[str], sizes: list[int], shortest: int) -> int:
    """How many texts of at least `shortest` characters lie within one that is longer by sizes.

    The texts are searched as one string, the longest first, so each one looks
    at no more than those that are longer, and stops at the first that holds it.
    """
    order = sorted(range(len(texts)), key=lambda i: -sizes[i])
    whole = "\n".join(texts[i] for i in order)
    n = at = end = 0  # end: where the longer ones end
    for place, i in enumerate(order):
        if sizes[i] < shortest:
            break
        if place and sizes[i] != sizes[order[place - 1]]:
            end = at
        n += end > 0 and whole.find(texts[i], 0, end) >= 0
        at += len(texts[i]) + 1
    return n


def n_held(texts: Column, sizes: Column, shortest: int) -> Column:
    """held_by_longer of arrays of texts without line ends; null for null."""
    from docloom.ship import ship

    ship(SparkSession.getActiveSession())

    def run(texts: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else held_by_longer(list(t), list(s), shortest) for t, s in zip(texts, sizes, strict=True)], dtype="Int64")

    return F.pandas_udf(run, LongType())(texts, sizes)


def norm_label(c: Column) -> Column:
    """N14."""
    return squish(F.regexp_replace(F.lower(c), r"[^a-z0-9 /#&]", " "))


def is_placeholder(value: Column, label: Column) -> Column:
    """Blank, the label itself, or a word for nothing."""
    v = F.lower(squish(F.coalesce(value, F.lit(""))))
    return (v == "") | (norm_label(value) == norm_label(label)) | v.isin(PLACEHOLDERS)


def slug(c: Column) -> Column:
    """Every character but letters and digits becomes a hyphen."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "-"), F.lit("-")), F.lit("")), F.lit("package"))


def estimate_tokens(c: Column) -> Column:
    """N18."""
    return F.floor(F.lit(1.3) * F.regexp_count(c, F.lit(r"(?U)\w+"))).cast("int")


def tokenize(c: Column, stopwords: list[str] | None = None) -> Column:
    """Lower-cased word-like tokens of two characters or more, in order."""
    drop = STOPWORDS if stopwords is None else stopwords
    raw = F.transform(F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9][A-Za-z0-9\-_.#/]*)"), 1), lambda t: F.lower(F.btrim(t, F.lit(".,;:!?"))))
    return F.filter(raw, lambda t: (F.char_length(t) > 1) & (~t.isin(drop) if drop else F.lit(True)))


def identifiers(c: Column) -> Column:
    """Tokens of five characters or more that mix letters and digits."""
    return F.filter(tokenize(c), lambda t: t.rlike(r"^(?=.*\d)(?=.*[a-z])[a-z0-9][a-z0-9\-]{4,}$"))


def clean_cell(c: Column) -> Column:
    """N21."""
    return F.btrim(squish(c), F.lit(" .;:,-"))


def is_prose(c: Column, words: str = r"shall|must|will|agreement|contractor|vendor") -> Column:
    """A contract word and more than six words."""
    return c.rlike(rf"(?i)\b({words})\b") & (F.size(F.split(squish(c), " ")) > 6)


def qty_value(c: Column) -> Column:
    """The digits as a number, else 0."""
    return F.coalesce(F.regexp_replace(c, r"[^0-9]", "").try_cast("bigint"), F.lit(0))
