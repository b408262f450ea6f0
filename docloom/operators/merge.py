"""Merge strategies: one answer per package and field, with evidence, losers and a reason for each absence.

Candidates have package_id, field, cand_ord (their order of appearance),
doc_id, precedence, confidence (decimal), signature, and one of norm_str,
norm_list and norm_map. Every strategy is one aggregation over structs by
(package, field), so that provenance stays with the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import distinct_ignoring_case, prune_subsumed

KEY = ["package_id", "field"]
#: Precedence that vendor-scoped fields add to candidates of vendor documents.
VENDOR_BONUS = 200
EVIDENCE = ["doc_id", "page", "span", "confidence"]


def rank() -> Column:
    """Better is larger: precedence, then confidence, then earlier appearance."""
    return F.struct(F.col("precedence").alias("p"), F.col("confidence").alias("c"), (-F.col("cand_ord")).alias("o"))


def ranked(entry: Column) -> Column:
    """The entries of a group by falling rank. Maps have no order, so ranks alone are compared."""
    better = lambda a, b: F.when(a["rank"] > b["rank"], -1).when(a["rank"] < b["rank"], 1).otherwise(0)
    return F.array_sort(F.collect_list(F.struct(rank().alias("rank"), entry.alias("v"))), better)


def present(candidates: DataFrame) -> DataFrame:
    """without candidates that have no value."""
    return candidates.where("coalesce(norm_str, '') <> '' OR size(norm_list) > 0 OR size(norm_map) > 0")


def evidence(df: DataFrame) -> Column:
    return F.struct(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in EVIDENCE])


def with_scope_bonus(candidates: DataFrame, specs: DataFrame) -> DataFrame:
    """Vendor documents rank higher for vendor-scoped fields."""
    scoped = candidates.join(F.broadcast(specs.select("field", "scope")), "field", "left")
    return scoped.withColumn("precedence", F.col("precedence") + F.when((F.col("scope") == "vendor") & (F.col("doc_type") == "vendor_spec"), VENDOR_BONUS).otherwise(0)).drop("scope")


def merge_precedence(candidates: DataFrame) -> DataFrame:
    """A1: the best candidate of the best signature; the best of each other signature loses.

    Equal ranks of different signatures go to the one that appeared first.
    """
    best = candidates.groupBy(*KEY, "signature").agg(
        F.max_by(F.struct("norm_str", "doc_id", "confidence", "precedence", evidence(candidates).alias("evidence")), rank()).alias("v"),
        F.min("cand_ord").alias("first"),
    )
    order = F.struct(F.col("v.precedence").alias("p"), F.col("v.confidence").alias("c"), (-F.col("first")).alias("o"), F.col("v"), F.col("signature"))
    groups = best.groupBy(*KEY).agg(F.reverse(F.array_sort(F.collect_list(order))).alias("all"))
    top = F.element_at("all", 1)
    others = F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0)))
    return groups.select(
        *KEY, top["v"]["norm_str"].alias("norm_str"), top["v"]["doc_id"].alias("doc_id"), top["v"]["confidence"].alias("confidence"), top["v"]["precedence"].alias("precedence"),
        F.array(top["v"]["evidence"]).alias("evidence"), F.transform(others, lambda x: x["v"]).alias("losers"), F.size(others).alias("n_losers"), F.lit("precedence").alias("strategy"),
    )


def conflicts(merged: DataFrame) -> DataFrame:
    """A row for each field whose winner had losers, with the reason."""
    why = F.format_string("%s (precedence %s) over %s other value(s)", F.col("doc_id"), F.col("precedence").cast("string"), F.col("n_losers").cast("string"))
    return merged.where("n_losers > 0").select(*KEY, F.struct("doc_id", "norm_str", "precedence", "confidence").alias("winner"), "losers", "strategy", why.alias("rationale"))


def bonus(confidence: Column, corroborating: Column, most: int = 3) -> Column:
    """0.03 for each corroborating candidate, up to `most`."""
    return F.least(F.lit(1), confidence + F.lit("0.03").cast("decimal(4,3)") * F.least(F.greatest(corroborating, F.lit(0)), F.lit(most))).cast("decimal(4,3)")


def _merged(candidates: DataFrame, value: Column, name: str, most: int = 3) -> DataFrame:
    entry = F.struct("norm_str", "norm_list", "norm_map", evidence(candidates).alias("evidence"))
    g = candidates.groupBy(*KEY).agg(ranked(entry).alias("all"), F.max("confidence").alias("best"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("values", F.transform("all", lambda x: x["v"])).select(*KEY, value, bonus(F.col("best"), F.col("n") - 1, most).alias("confidence"), F.slice(F.transform("values", lambda v: v["evidence"]), 1, 4).alias("evidence"), F.lit(name).alias("strategy"))


def merge_union(candidates: DataFrame) -> DataFrame:
    """A2: all items in rank order, without repeats (in any case) and without items within others."""
    items = F.flatten(F.transform("values", lambda v: F.coalesce(v["norm_list"], F.array().cast("array<string>"))))
    return _merged(candidates, prune_subsumed(distinct_ignoring_case(items)).alias("norm_list"), "union")


def accept_distinct(texts: Column, most: int = 6) -> Column:
    """A3: greedily, texts that neither equal, hold nor lie in an accepted one; the first `most`."""
    low = F.lower
    clash = lambda acc, x: F.exists(acc, lambda a: F.contains(low(a), low(x)) | F.contains(low(x), low(a)))
    kept = F.aggregate(texts, F.array().cast("array<string>"), lambda acc, x: F.when((F.coalesce(x, F.lit("")) == "") | clash(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return F.slice(kept, 1, most)


def merge_concat(candidates: DataFrame) -> DataFrame:
    """A3."""
    return _merged(candidates, F.array_join(accept_distinct(F.transform("values", lambda v: v["norm_str"])), "; ").alias("norm_str"), "concat")


def merge_longest(candidates: DataFrame) -> DataFrame:
    """A4: the longest text; equal lengths go by rank."""
    order = F.struct(F.char_length("norm_str").alias("n"), rank().alias("r"))
    best = candidates.groupBy(*KEY).agg(F.max_by(F.struct("norm_str", "confidence", evidence(candidates).alias("evidence")), order).alias("v"), F.count(F.lit(1)).alias("n"))
    return best.select(*KEY, "v.norm_str", bonus(F.col("v.confidence"), F.col("n") - 1).alias("confidence"), F.array("v.evidence").alias("evidence"), F.lit("longest").alias("strategy"))


def merge_most_specific(candidates: DataFrame) -> DataFrame:
    """For each device and attribute, the value of the best candidate that has one."""
    rows = candidates.select(*KEY, "precedence", "confidence", "cand_ord", F.explode("norm_map").alias("device", "attrs")).select("*", F.explode("attrs").alias("attr", "value")).drop("attrs")
    values = rows.groupBy(*KEY, "device", "attr").agg(F.max_by("value", rank()).alias("value"))
    devices = values.groupBy(*KEY, "device").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attr", "value")))).alias("attrs"))
    maps = devices.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("device", F.struct("attrs").alias("s"))), lambda a, b: F.when(a["device"] < b["device"], -1).when(a["device"] > b["device"], 1).otherwise(0))).alias("m"))
    best = candidates.groupBy(*KEY).agg(F.max("confidence").alias("best"), F.count(F.lit(1)).alias("n"), F.max_by(F.array(evidence(candidates)), rank()).alias("evidence"))
    return maps.join(best, KEY).select(*KEY, F.transform_values("m", lambda _, v: v["attrs"]).alias("norm_map"), bonus(F.col("best"), F.col("n") - 1, 2).alias("confidence"), "evidence", F.lit("most_specific").alias("strategy"))


STRATEGIES = {"precedence": merge_precedence, "union": merge_union, "concat": merge_concat, "longest": merge_longest, "most_specific": merge_most_specific}


def merge(candidates: DataFrame, specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, conflicts): one resolved row for each package and field of specs (field, merge, null_reason).

    A7: fields without a value have present = false and their null_reason.
    """
    have = present(candidates)
    packages = candidates.select("package_id").distinct()
    tagged = have.join(F.broadcast(specs.select("field", "merge")), "field")
    parts, found = None, None
    for name, function in STRATEGIES.items():
        part = function(tagged.where(F.col("merge") == name))
        if name == "precedence":
            found = conflicts(part)
        for column, kind in (("norm_str", "string"), ("norm_list", "array<string>"), ("norm_map", "map<string,map<string,string>>")):
            if column not in part.columns:
                part = part.withColumn(column, F.lit(None).cast(kind))
        part = part.select(*KEY, "norm_str", "norm_list", "norm_map", "confidence", "evidence", "strategy")
        parts = part if parts is None else parts.unionByName(part)
    resolved = _every(packages, specs).join(parts, KEY, "left")
    there = F.coalesce(F.col("norm_str"), F.array_join("norm_list", ","), F.to_json("norm_map")).isNotNull()
    return resolved.withColumn("present", there).withColumn("null_reason", F.when(~there, F.col("null_reason"))), found


def _every(packages: DataFrame, specs: DataFrame) -> DataFrame:
    """Each package with each field; the fields are a literal, so nothing is joined."""
    rows = [(r["field"], r["null_reason"]) for r in specs.orderBy("field_ord").select("field", "null_reason").collect()]
    fields = F.array(*[F.struct(F.lit(i).alias("field_ord"), F.lit(f).alias("field"), F.lit(why).alias("null_reason")) for i, (f, why) in enumerate(rows)])
    return packages.select("package_id", F.inline(fields))


def coverage(resolved: DataFrame) -> DataFrame:
    """Fields with a value, and their share, for each package."""
    return resolved.groupBy("package_id").agg(F.count_if("present").alias("populated"), F.count(F.lit(1)).alias("fields")).withColumn("coverage", F.round(F.col("populated") / F.col("fields"), 4))


def latest(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of the last row of each key by order."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*keys, "_v.*")


def first_rows(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key; Catalyst limits them before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
