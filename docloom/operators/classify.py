"""Document types from scored signals, and what addenda change."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import distinct_ignoring_case, squish

# Types in the order that settles ties, how far into a text signals are looked for, and the markers.
TYPES = ["master_rfp", "addendum", "portal_notice", "vendor_spec", "legal_affidavit", "assignment", "unknown"]
WHOLE, HEAD, NUMBER_HEAD = 20_000, 4_000, 1_500
ADDENDUM = r"(?i)addendum\s*(?:no\.?|#|number)?\s*(\d+)"
AFFIDAVIT = r"(?i)\baffidavit\b"
SOLICITATION = r"(?i)\brequest\s+for\s+proposal\b|\bRFP\b|\bPORFP\b|\bsolicitation\b"
STOCK = r"(?i)\bSKU\b|\bpart\s*number\b|\bXCTO\b|\bQuote\b"
VENDOR = r"(?i)dell|latitude|optiplex|hp\b|lenovo|apple\s+inc"
PORTAL = r"(?i)bidnet|mets-field|closing date|solicitation number"
DUE = r"(?i)solicitation\s+due|proposal\s+due|due\s+date"
BRIEF = r"(?is)\bobjective\b.*\bparticipants\b|\bdeliverables\b"
SUPERSEDES = [
    r"(?i)[^.]*\b(?:new|revised|changed|updated|extended)\s+due\s+date\b[^.]*\.",
    r"(?i)[^.]*\b(?:hereby\s+)?(?:supersede|replace|override|amend)s?\b[^.]*\.",
    r"(?i)[^.]*\b(?:will|shall)\s+(?:now\s+)?(?:be|only\s+require|not\s+require)\b[^.]*\.",
    r"(?i)[^.]*\bthe\s+purpose\s+of\s+this\s+addendum\s+is\b[^.]*\.",
]
QA = r"(?is)(\d{1,3})\s*[.)]\s*(.*?)(Answer\s*:\s*.*?)(?=(?:\n\s*\d{1,3}\s*[.)])|END OF ADDENDUM|\z)"
NEW_DUE = r"(?is)(?:new|revised|extended)\s+due\s+date[^.]*?([A-Z][a-z]+\s+\d{1,2},\s*\d{4}[^,.;]*(?:\d{1,2}:\d{2}\s*(?:AM|PM))?)"


@dataclass(frozen=True)
class Signal:
    """A named weight in favour of a type; weight is a Column and 0 where the signal doesn't fire."""

    name: str
    doc_type: str
    weight: Column


def when(condition: Column, weight) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(weight) if isinstance(weight, (int, float)) else weight).otherwise(F.lit(0.0)).cast("double")


def signals(file_name: str = "file_name", text: str = "text", file_format: str = "file_format", labels: str = "n_labels", pages: str = "page_count") -> list[Signal]:
    """C1."""
    name, t = F.coalesce(F.col(file_name), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    hay, head = F.concat(name, F.lit("\n"), F.substring(t, 1, WHOLE)), F.substring(t, 1, HEAD)
    html, hits = F.col(file_format) == "html", F.regexp_count(head, F.lit(STOCK))
    return [
        Signal("html_source", "portal_notice", when(html, 1.5)),
        Signal("label_value_grid", "portal_notice", when(html & (F.col(labels) > 0), 2.0)),
        Signal("portal_markers", "portal_notice", when(html & hay.rlike(PORTAL), 1.5)),
        Signal("addendum_marker", "addendum", when(hay.rlike(ADDENDUM), F.when(F.lower(name).contains("addendum"), 4.0).otherwise(2.0))),
        Signal("affidavit_marker", "legal_affidavit", when(name.rlike(AFFIDAVIT) | head.rlike(AFFIDAVIT), 4.0)),
        Signal("sku_markers", "vendor_spec", when(hits > 0, F.least(F.lit(3.0), 1.0 + 0.35 * hits))),
        Signal("vendor_filename", "vendor_spec", when(name.rlike(VENDOR), 1.0)),
        Signal("rfp_markers", "master_rfp", when(head.rlike(SOLICITATION), 2.0)),
        Signal("due_date_block", "master_rfp", when(head.rlike(DUE), 1.5)),
        Signal("long_document", "master_rfp", when(F.col(pages) >= 10, 1.0)),
        Signal("assignment_markers", "assignment", when(head.rlike(BRIEF), 5.0)),
    ]


def score(df: DataFrame, found: list[Signal], types: list[str] = TYPES) -> DataFrame:
    """Df with doc_type, doc_type_confidence and signals (those that fired).

    The highest sum wins, ties go to the type that comes first in types; with
    no signal the type is the last one and the confidence 0.
    """
    out = df.withColumns({f"_s{i}": s.weight for i, s in enumerate(found)})
    sums = [sum((F.col(f"_s{i}") for i, s in enumerate(found) if s.doc_type == t), F.lit(0.0)) for t in types]
    out = out.withColumn("_all", F.reverse(F.array_sort(F.array(*[F.struct(v.alias("s"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, (v, t) in enumerate(zip(sums, types, strict=True))]))))
    best, second = F.col("_all")[0], F.col("_all")[1]["s"]
    confidence = F.least(F.lit(1.0), 0.55 + 0.15 * (best["s"] - second) + 0.1 * F.least(best["s"], F.lit(6.0)))
    fired = F.filter(F.array(*[F.struct(F.lit(s.name).alias("name"), F.col(f"_s{i}").alias("weight")) for i, s in enumerate(found)]), lambda x: x["weight"] > 0)
    out = out.withColumns({"doc_type": F.when(best["s"] > 0, best["t"]).otherwise(types[-1]), "doc_type_confidence": F.when(best["s"] > 0, F.round(confidence, 3)).otherwise(0.0), "signals": fired})
    return out.drop("_all", *[f"_s{i}" for i in range(len(found))])


def addendum_number(file_name: Column, text: Column) -> Column:
    """C4: in the classifier's haystack, else in the file name, else early in the text."""
    places = [F.concat(file_name, F.lit("\n"), F.substring(text, 1, WHOLE)), file_name, F.substring(text, 1, NUMBER_HEAD)]
    return F.coalesce(*[F.regexp_extract(p, ADDENDUM, 1).try_cast("int") for p in places])


def supersession_notes(text: Column, most: int = 8) -> Column:
    """Sentences that replace earlier ones, of 25 to 400 characters."""
    # A sentence that has no match from its start on has none from later on, so only starts are tried.
    found = F.transform(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(r"(?<![^.])" + p), 0) for p in SUPERSEDES])), squish)
    return F.slice(distinct_ignoring_case(F.filter(found, lambda x: F.char_length(x).between(25, 400))), 1, most)


def qa_pairs(text: Column, most: int = 60) -> Column:
    """Numbered questions with answers."""
    zipped = F.zip_with(F.regexp_extract_all(text, F.lit(QA), 2), F.regexp_extract_all(text, F.lit(QA), 3), lambda q, a: F.struct(squish(q).alias("question"), squish(a).alias("answer")))
    kept = F.slice(F.filter(zipped, lambda x: F.char_length(x["question"]) >= 20), 1, most)
    return F.transform(kept, lambda x: F.struct(F.substring(x["question"], 1, 400).alias("question"), F.substring(x["answer"], 1, 600).alias("answer")))


def new_due_date(text: Column) -> Column:
    """The date that a change of the due date names; null if there is none."""
    return F.nullif(squish(F.regexp_extract(text, NEW_DUE, 1)), F.lit(""))


def annotate(docs: DataFrame) -> DataFrame:
    """docs (file_name, text, file_format, n_labels, page_count) with type, number, notes, answers and new due date."""
    out = score(docs, signals())
    return out.withColumns({"addendum_number": addendum_number(F.col("file_name"), F.col("text")), "amendment_notes": supersession_notes(F.col("text")), "qa_pairs": qa_pairs(F.col("text")), "addendum_effective_date": new_due_date(F.col("text"))})


def precedence(doc_type: Column, number: Column, weights: dict[str, int] | None = None, base: int = 100, step: int = 10) -> Column:
    """The weight of a type; addenda rise with their number."""
    w = {"master_rfp": 40, "portal_notice": 60, "vendor_spec": 25, "legal_affidavit": 20, "assignment": 0, "unknown": 10} | (weights or {})
    out = F.when(doc_type == "addendum", base + step * F.coalesce(F.nullif(number, F.lit(0)), F.lit(1)))
    for t, v in w.items():
        out = out.when(doc_type == t, v)
    return out.otherwise(w["unknown"]).cast("int")
