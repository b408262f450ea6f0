"""Scoring resolved fields against a gold set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.dates import iso_instant

CHECKS = ["absent", "equals", "instant", "contains", "min_items"]


def passed(check: Column, expected: Column, value: Column, n_items: Column) -> Column:
    """One gold check of a value (string, or null if absent); an unknown check fails the query."""
    there = F.coalesce(value, F.lit("")) != ""
    out = F.when(check == "absent", ~there)
    out = out.when(check == "equals", F.lower(F.trim(value)) == F.lower(F.trim(expected)))
    out = out.when(check == "instant", iso_instant(value) == iso_instant(expected))
    out = out.when(check == "contains", F.contains(F.lower(value), F.lower(expected)))
    out = out.when(check == "min_items", n_items >= expected.try_cast("int"))
    return F.coalesce(out.otherwise(F.raise_error(F.concat(F.lit("unknown check "), check)).cast("boolean")), F.lit(False))


def score(gold: DataFrame, resolved: DataFrame) -> DataFrame:
    """Gold (package_id, bid_number, field, check, expected) with passed and actual.

    A package is found by its id, else by its bid number. Gold rows whose
    package is found neither way are left out, not failed.
    """
    numbers = resolved.where("field = 'bid_number' AND present").select(F.col("package_id").alias("_by_number"), F.col("norm_str").alias("bid_number")).dropDuplicates(["bid_number"])
    known = resolved.select(F.col("package_id").alias("_by_id")).distinct()
    found = gold.join(known, gold["package_id"] == known["_by_id"], "left").join(numbers, "bid_number", "left").withColumn("_package", F.coalesce("_by_id", "_by_number")).where("_package IS NOT NULL")
    values = resolved.select(F.col("package_id").alias("_package"), "field", F.coalesce("norm_str", F.array_join("norm_list", ", "), F.to_json("norm_map")).alias("actual"), F.coalesce(F.nullif(F.size("norm_list"), F.lit(-1)), F.nullif(F.size("norm_map"), F.lit(-1)), F.lit(0)).alias("_n"))
    both = found.join(values, ["_package", "field"], "left")
    return both.select("package_id", "field", "check", "expected", "actual", passed(F.col("check"), F.col("expected"), F.col("actual"), F.coalesce("_n", F.lit(0))).alias("passed"))


def accuracy(scores: DataFrame) -> DataFrame:
    """Accuracy and failed fields of each package, and of all (package_id null)."""
    return scores.groupingSets([["package_id"], []], "package_id").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"), F.round(F.avg(F.col("passed").cast("int")), 4).alias("accuracy"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("field")))).alias("failed"))
