"""Mining candidate values with declarative rules.

All pattern rules are unrolled into one projection over the blocks, so a block
is read once whatever the number of rules, and each pattern is a literal that
is compiled once a task. Labels are an equi-join. Order comes from doc_ord,
block_ord, rule_ord and match_ord alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import dates
from docloom.functions.text import clean_text, is_placeholder, norm_label, sentence_of, span_around, squish, strip, strip_leading_label, to_list

#: Fixed values.
NOTHING = ["n/a", "not stated", "none", "-", "--"]
ALL_STOP = 500
RESCAN = "0.95"


@dataclass(frozen=True)
class Rule:
    field: str
    kind: str  # label, pattern or sentence
    name: str
    confidence: float
    regex: str = ""
    labels: tuple[str, ...] = ()
    doc_types: tuple[str, ...] = ()
    sections: tuple[str, ...] = ()
    transform: str | None = None
    multiplicity: str = "first"
    must_match: str | None = None
    must_not_match: str | None = None
    max_length: int | None = None
    group: str = "value"


@dataclass(frozen=True)
class Spec:
    field: str
    alias: str
    description: str = ""
    kind: str = "string"
    scope: str = "package"
    merge: str = "precedence"
    null_reason: str = "not stated in the documents"
    rules: tuple[Rule, ...] = field(default=())


def load(path: str | Path) -> list[Spec]:
    """Field specs from a YAML file: a list `fields`, each with labels, patterns and sentence_patterns.

    The rules that `fixed` holds by field, if it is there, come first.
    """
    import yaml

    def rule(name: str, kind: str, i: int, given: dict) -> Rule:
        known = {k: given[k] for k in ("transform", "multiplicity", "must_match", "must_not_match", "max_length", "group") if k in given}
        return Rule(name, kind, given.get("name", f"{kind}{i}"), float(given["confidence"]), given.get("regex", ""), tuple(given.get("labels", ())), tuple(given.get("doc_types", ())), tuple(given.get("sections", ())), **known)

    out = []
    given = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    for f in given["fields"]:
        fixed = given.get("fixed", {}).get(f["name"], {})
        rules = [rule(f["name"], kind, i, g) for key, kind in (("labels", "label"), ("patterns", "pattern"), ("sentence_patterns", "sentence")) for i, g in enumerate(fixed.get(key, []) + (f.get(key) or []))]
        known = {k: f[k] for k in ("description", "kind", "scope", "merge", "null_reason") if k in f}
        out.append(Spec(f["name"], f.get("alias", f["name"]), rules=tuple(rules), **known))
    return out


def frames(spark, specs: list[Spec]) -> tuple[DataFrame, DataFrame]:
    """(specs, rules) as small tables."""
    s = spark.createDataFrame([(i, x.field, x.alias, x.description, x.kind, x.scope, x.merge, x.null_reason) for i, x in enumerate(specs)], "field_ord int, field string, alias string, description string, kind string, scope string, merge string, null_reason string")
    numbered = [r for x in specs for r in x.rules]
    r = spark.createDataFrame([(i, x.field, x.kind, x.name, x.regex, list(x.labels), x.confidence) for i, x in enumerate(numbered)], "rule_ord int, field string, rule_kind string, name string, regex string, labels array<string>, confidence double")
    return s, r


def java_regex(pattern: str, group: str = "value") -> tuple[str, int]:
    """A Python pattern for the JVM, ignoring case and with dots that match line ends, and the number of its group."""
    index = re.compile(pattern, re.I | re.S).groupindex.get(group)
    return "(?isu)" + pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z"), int(group) if index is None and group.isdigit() else index or 0


def applies(rule: Rule) -> Column:
    """F1, F2."""
    out = F.lit(True)
    if rule.doc_types:
        out = out & F.col("doc_type").isin(list(rule.doc_types))
    if rule.sections:
        out = out & F.coalesce(F.col("section").isin(list(rule.sections)), F.lit(False))
    return out


def passes(raw: Column, rule: Rule) -> Column:
    """F4."""
    out = (raw != "") & ~F.lower(raw).isin(NOTHING)
    if rule.max_length:
        out = out & (F.char_length(raw) <= 3 * rule.max_length)
    if rule.must_match:
        out = out & raw.rlike(rule.must_match.replace("(?P<", "(?<"))
    if rule.must_not_match:
        out = out & ~raw.rlike(rule.must_not_match.replace("(?P<", "(?<"))
    return out


def matches(rule: Rule, number: int, text: Column) -> Column:
    """Array of (rule_ord, raw, whole) of all passing matches of a pattern rule in a block."""
    pattern, group = java_regex(rule.regex, rule.group)
    both = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), group), F.regexp_extract_all(text, F.lit(pattern), 0), lambda r, w: F.struct(F.lit(number).alias("rule_ord"), strip(r).alias("raw"), w.alias("whole")))
    return F.when(applies(rule), F.filter(both, lambda m: passes(m["raw"], rule))).otherwise(F.array().cast("array<struct<rule_ord:int,raw:string,whole:string>>"))


def _attributes(rules: list[tuple[int, Rule]], kinds: dict[str, str]) -> Column:
    """Literal array from which a rule's field, confidence, transform and limit are taken by number."""
    return F.array(*[F.struct(F.lit(i).alias("rule_ord"), F.lit(r.field).alias("field"), F.lit(r.name).alias("rule"), F.lit(f"{r.confidence:.3f}").cast("decimal(4,3)").alias("base"), F.lit(r.transform or ("datetime" if kinds[r.field] == "datetime" else "clean")).alias("transform"), F.lit(r.max_length).cast("int").alias("max_length"), F.lit(r.multiplicity).alias("multiplicity"), F.lit(kinds[r.field]).alias("kind")) for i, r in rules])


def transform(raw: Column, kind: Column, limit: Column, zone: str | Column | None = None) -> tuple[Column, Column]:
    """M6: (norm_str, norm_list)."""
    cleaned = clean_text(raw)
    short = F.when((limit.isNotNull()) & (F.char_length(cleaned) > limit), F.concat(F.regexp_replace(cleaned.substr(F.lit(1), limit), r"(?U)\s+$", ""), F.lit("..."))).otherwise(cleaned)
    text = F.when(kind == "datetime", F.coalesce(dates.normalize_datetime(raw, zone), short)).when(kind == "list", F.lit(None)).when(kind == "sentence", clean_text(raw, 400)).otherwise(short)
    return text, F.when(kind == "list", to_list(raw))


def adjusted(base: Column, value: Column, items: Column, kind: Column, has_block: bool = True) -> Column:
    """M7, on decimals: empty halves; early pages, tables, labels and addenda add; very short strings take off."""
    d = lambda x: F.lit(x).cast("decimal(5,4)")
    add = F.when(F.col("doc_type") == "addendum", d("0.04")).otherwise(d("0"))
    if has_block:
        add = add + F.when((F.col("page_no") <= 2) & kind.isin("string", "datetime"), d("0.03")).otherwise(d("0"))
        add = add + F.when(F.col("kind").isin("table", "label_value"), d("0.02")).otherwise(d("0"))
    add = add - F.when((kind == "string") & (F.char_length(value) < 3), d("0.15")).otherwise(d("0"))
    empty = (F.coalesce(value, F.lit("")) == "") & (F.coalesce(F.size(items), F.lit(0)) <= 0)
    start = F.when(empty, base * d("0.5")).otherwise(base)
    return F.greatest(F.lit(0), F.least(F.lit(1), start + add)).cast("decimal(4,3)")


CANDIDATE = ["doc_id", "doc_ord", "file_name", "doc_type", "precedence", "field", "rule", "rule_ord", "page", "block_id", "block_ord", "match_ord", "raw", "norm_str", "norm_list", "confidence", "span", "method"]


FOUND = ["doc_id", "doc_ord", "file_name", "doc_type", "precedence", "a", "page_no", "kind", "block_id", "block_ord", "match_ord", "raw", "found_span", "method"]


def _found(df: DataFrame, span: Column, method: Column) -> DataFrame:
    """What a rule has found, before its value is worked out."""
    return df.withColumns({"found_span": span, "method": method}).select(*FOUND, *[c for c in ("zone", "found_field") if c in df.columns])


def finish(found: DataFrame, zone=None, factor: Column | None = None) -> DataFrame:
    """Candidates of all that rules have found: values, confidence, spans."""
    out = found.withColumns({"field": F.col("a.field"), "rule": F.col("a.rule"), "rule_ord": F.col("a.rule_ord"), "page": F.coalesce(F.when(F.col("method") != "html_label", F.col("page_no")), F.lit(1)).cast("int"), "span": F.substring(squish(F.col("found_span")), 1, 400)})
    norm, items = transform(F.col("raw"), F.col("a.transform"), F.col("a.max_length"), zone)
    out = out.withColumns({"norm_str": norm, "norm_list": items})
    value = F.col("norm_str"), F.col("norm_list"), F.col("a.kind")
    sure = F.when(F.col("method") == "html_label", adjusted(F.col("a.base"), *value, False)).otherwise(adjusted(F.col("a.base"), *value))
    return out.withColumn("confidence", sure if factor is None else F.round(sure * factor, 3).cast("decimal(4,3)")).select(*CANDIDATE)


def numbered(specs: list[Spec]) -> list[tuple[int, Rule]]:
    return list(enumerate(r for s in specs for r in s.rules))


def pattern_hits(blocks: DataFrame, specs: list[Spec]) -> DataFrame:
    """All passing matches of all pattern rules: the blocks' columns, match_ord, hit, and the rule's attributes a."""
    rules = [(i, r) for i, r in numbered(specs) if r.kind == "pattern"]
    attributes = _attributes(rules, {s.field: s.kind for s in specs})
    hits = blocks.where(strip(F.col("text")) != "").withColumn("m", F.flatten(F.array(*[matches(r, i, F.col("text")) for i, r in rules]))).where(F.size("m") > 0).select("*", F.posexplode("m").alias("match_ord", "hit")).drop("m")
    return hits.withColumn("a", F.element_at(F.filter(attributes, lambda x: x["rule_ord"] == F.col("hit.rule_ord")), 1))


def from_patterns(hits: DataFrame) -> DataFrame:
    """M3: the first passing match of the first block that has one, or all up to the block that reaches ALL_STOP."""
    text = F.col("text")
    w = Window.partitionBy("doc_id", "hit.rule_ord").orderBy("block_ord", "match_ord")
    earlier = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "hit.rule_ord").orderBy("block_ord").rangeBetween(Window.unboundedPreceding, -1))
    kept = hits.withColumn("nth", F.row_number().over(w)).withColumn("before", earlier).where(F.when(F.col("a.multiplicity") == "first", F.col("nth") == 1).when(F.col("a.multiplicity") == "all", F.col("before") < ALL_STOP).otherwise(True))
    start = F.instr(text, F.col("hit.whole")) - 1
    return _found(kept.withColumn("raw", F.col("hit.raw")), span_around(text, start, start + F.char_length("hit.whole")), F.when(F.col("kind") == "table", "table").otherwise("regex"))


def sentence_hits(blocks: DataFrame, specs: list[Spec]) -> DataFrame:
    """The first match of each sentence rule in each block, with the texts of the three blocks that follow on its page."""
    rules = [(i, r) for i, r in numbered(specs) if r.kind == "sentence"]
    attributes = _attributes(rules, {s.field: s.kind for s in specs})
    text = F.col("text")
    order = Window.partitionBy("doc_id").orderBy("block_ord")
    ahead = blocks.where(strip(text) != "").withColumns({f"t{k}": F.when(F.lead("page_no", k).over(order) == F.col("page_no"), strip(F.lead("text", k).over(order))) for k in (1, 2, 3)})
    found = F.filter(F.array(*[F.when(applies(r) & text.rlike(java_regex(r.regex)[0]), F.struct(F.lit(i).alias("rule_ord"), F.regexp_instr(text, F.lit(java_regex(r.regex)[0]), 0).alias("at"), F.regexp_extract(text, java_regex(r.regex)[0], 0).alias("whole"))) for i, r in rules]), lambda x: x.isNotNull())
    hits = ahead.where("NOT coalesce(synthetic, false)").withColumn("m", found).where(F.size("m") > 0).select("*", F.explode("m").alias("hit")).drop("m")
    return hits.withColumn("a", F.element_at(F.filter(attributes, lambda x: x["rule_ord"] == F.col("hit.rule_ord")), 1)).withColumn("match_ord", F.lit(0))


def from_sentences(hits: DataFrame) -> DataFrame:
    """M4, M5: the sentence around the match in the first block that has one, continued over line breaks."""
    text = F.col("text")
    first = hits.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "hit.rule_ord").orderBy("block_ord"))).where("nth = 1")
    sentence = sentence_of(text, F.col("hit.at") - 1, F.col("hit.at") - 1 + F.char_length("hit.whole"))
    step = lambda s, t: F.when(F.coalesce(~s["done"] & t.rlike(r"^\p{Ll}"), F.lit(False)), F.struct(F.concat(s["text"], F.lit(" "), t).alias("text"), t.rlike(r"[.!?]$").alias("done"))).otherwise(F.struct(s["text"].alias("text"), F.lit(True).alias("done")))
    whole = F.aggregate(F.array("t1", "t2", "t3"), F.struct(F.col("sentence").alias("text"), F.col("sentence").rlike(r"[.!?:]$").alias("done")), step)["text"]
    kept = first.withColumn("sentence", sentence).withColumn("raw", strip_leading_label(F.substring(squish(whole), 1, 400))).where("raw <> ''")
    return _found(kept, F.col("raw"), F.lit("section"))


def _label_rules(spark, specs: list[Spec]) -> DataFrame:
    kinds = {s.field: s.kind for s in specs}
    rows = [(i, r.field, r.name, f"{r.confidence:.3f}", r.transform or ("datetime" if kinds[r.field] == "datetime" else "clean"), r.max_length, kinds[r.field], list(r.doc_types), label) for i, r in numbered(specs) if r.kind == "label" for label in r.labels]
    df = spark.createDataFrame(rows, "rule_ord int, field string, rule string, base string, transform string, max_length int, kind string, doc_types array<string>, label string")
    keyed = df.withColumn("key", norm_label(F.col("label")))
    # The later rule wins where two of a field have the same label.
    best = keyed.groupBy("field", "key").agg(F.max_by(F.struct("rule_ord", "field", "rule", F.col("base").cast("decimal(4,3)").alias("base"), "transform", "max_length", F.lit("first").alias("multiplicity"), "kind"), "rule_ord").alias("a"), F.max_by("doc_types", "rule_ord").alias("doc_types"))
    return best.select("key", "a", "doc_types")


def from_labels(pairs: DataFrame, specs: list[Spec], method: str = "html_label") -> DataFrame:
    """M1 over pairs of a document, M2 ("pdf_label") over label blocks: label, label_value and the document's columns."""
    spark = pairs.sparkSession
    rules = F.broadcast(_label_rules(spark, specs))  # as many rows as the rule file has labels
    block = method != "html_label"
    hits = pairs.withColumn("key", norm_label(F.col("label"))).join(rules, "key").where((F.size("doc_types") <= 0) | F.array_contains("doc_types", F.col("doc_type")))
    hits = hits.where(~is_placeholder(F.col("label_value"), F.col("label"))).withColumn("raw", strip(F.col("label_value"))).withColumn("match_ord", F.lit(0))
    if block:
        hits = hits.withColumn("a", F.struct(*[F.col(f"a.{c}") if c != "base" else (F.col("a.base") - F.lit("0.03").cast("decimal(4,3)")).cast("decimal(4,3)").alias("base") for c in ("rule_ord", "field", "rule", "base", "transform", "max_length", "multiplicity", "kind")]))
    else:
        hits = hits.withColumn("block_id", F.lit(None).cast("string"))
    return _found(hits, F.concat_ws(": ", "label", "label_value"), F.lit(method))


def mine(docs: DataFrame, blocks: DataFrame, specs: list[Spec], hits: DataFrame | None = None, zone=None) -> DataFrame:
    """M1 to M9: candidates of all documents.

    docs: doc_id, doc_ord, file_name, doc_type, precedence. blocks: doc_id,
    block_ord, block_id, page_no, kind, section, text, label, label_value,
    synthetic. hits (doc_id, field, block_id) restricts pattern and sentence
    rules of non-list fields to retrieved blocks; where that finds nothing, all
    blocks are scanned with a confidence of RESCAN times. Documents without any
    hit for a field are scanned whole as they are.
    """
    full = blocks.join(docs.select("doc_id", "doc_ord", "file_name", "doc_type", "precedence"), "doc_id")
    keep = full if zone is None else full.withColumn("zone", zone)
    pairs = keep.where("kind = 'label_value'")
    out = from_labels(pairs, specs, "pdf_label").unionByName(from_labels(pairs.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("block_ord"))).where("_n = 1"), specs, "html_label"))
    parts = [(select, scan(keep, specs)) for kind, select, scan in (("pattern", from_patterns, pattern_hits), ("sentence", from_sentences, sentence_hits)) if any(r.kind == kind for _, r in numbered(specs))]

    def chosen(only=lambda df: df) -> DataFrame:
        found = [select(only(df)) for select, df in parts]
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    scanned = chosen().withColumn("factor", F.lit("1").cast("decimal(4,3)"))
    if hits is not None:
        # The rules have been matched once; only the choice of the first match is made twice.
        lists = [s.field for s in specs if s.kind == "list"]
        own = hits.where(~F.col("field").isin(lists)).select("doc_id", "field", "block_id").distinct()
        inside = chosen(lambda df: df.withColumn("field", F.col("a.field")).join(own, ["doc_id", "field", "block_id"], "left_semi").drop("field"))
        searched, got = own.select("doc_id", "field").distinct(), inside.select("doc_id", F.col("a.field").alias("field")).distinct()
        tagged = scanned.withColumn("field", F.col("a.field")).join(searched.withColumn("_searched", F.lit(True)), ["doc_id", "field"], "left").join(got, ["doc_id", "field"], "left_anti")
        rescan = tagged.withColumn("factor", F.when(F.col("_searched"), F.lit(RESCAN)).otherwise(F.lit("1")).cast("decimal(4,3)")).drop("_searched", "field")
        scanned = inside.withColumn("factor", F.lit("1").cast("decimal(4,3)")).unionByName(rescan)
    everything = out.withColumn("factor", F.lit("1").cast("decimal(4,3)")).unionByName(scanned)
    return dedup(finish(everything, None if zone is None else F.col("zone"), F.col("factor")))


def signature() -> Column:
    return F.coalesce(dates.list_signature(F.col("norm_list")), dates.value_signature(F.coalesce("norm_str", "raw")))


def dedup(candidates: DataFrame) -> DataFrame:
    """M8: the first of each (document, field, signature, method, page), then numbered by falling confidence and page: cand_ord."""
    order = ["rule_ord", "block_ord", "match_ord"]
    signed = candidates.withColumn("signature", signature())
    once = signed.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "field", "signature", "method", "page").orderBy(*order))).where("_n = 1").drop("_n")
    pos = F.row_number().over(Window.partitionBy("doc_id", "field").orderBy(F.desc("confidence"), "page", *order))
    return once.withColumn("cand_ord", (F.col("doc_ord") * 1_000_000 + pos).cast("bigint"))


def provider_gaps(candidates: DataFrame, docs: DataFrame, specs: list[Spec], threshold: float) -> DataFrame:
    """F8: (doc_id, field) without a candidate of the threshold plus 0.3, for a provider to fill."""
    fields = F.array(*[F.lit(s.field) for s in specs])
    sure = candidates.where(F.col("confidence") >= threshold + 0.3).select("doc_id", "field").distinct()
    return docs.select("doc_id", F.explode(fields).alias("field")).join(sure, ["doc_id", "field"], "left_anti")
