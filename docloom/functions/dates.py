"""Dates in the notations of business documents. A value keeps its wall time and offset; its identity is the instant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import squish, strip

#: Abbreviation to zone. The offset follows from the date, whatever the abbreviation says.
ZONES = {
    "UTC": "UTC", "GMT": "UTC", "EST": "America/New_York", "EDT": "America/New_York", "CST": "America/Chicago", "CDT": "America/Chicago",
    "MST": "America/Denver", "MDT": "America/Denver", "PST": "America/Los_Angeles", "PDT": "America/Los_Angeles",
    "AKST": "America/Anchorage", "AKDT": "America/Anchorage", "HST": "Pacific/Honolulu", "AST": "America/Puerto_Rico",
}
FORMATS = ["d-MMM-yyyy H:mm:ss", "d-MMM-yyyy", "MMM d, yyyy h:mm a", "MMM d, yyyy", "MMMM d, yyyy h:mm a", "MMMM d, yyyy", "M/d/yyyy h:mm a", "M/d/yyyy H:mm", "M/d/yyyy", "M-d-yyyy", "yyyy-M-d H:mm:ss", "yyyy-M-d"]
ISO = r"^(\d{4}-\d{2}-\d{2}|\d{8})(?:[T ](\d{2}:\d{2}(?::\d{2})?)(?:\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"
VOTED = ["EST", "EDT", "CST", "CDT", "MST", "MDT", "PST", "PDT"]


def zone_of(abbreviation: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv]), F.nullif(abbreviation, F.lit("")))


def _try(text: Column, formats: list[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _iso_parts(text: Column) -> Column:
    day, time, offset = (F.regexp_extract(text, ISO, i) for i in (1, 2, 3))
    wall = _try(F.concat(F.replace(day, F.lit("-"), F.lit("")), F.lit(" "), F.when(time == "", "00:00").otherwise(time)), ["yyyyMMdd HH:mm:ss", "yyyyMMdd HH:mm"])

    def minutes(o: Column) -> Column:
        digits = F.regexp_replace(o, r"[^\d]", "")
        return F.when(o == "Z", 0).when(o != "", F.when(F.substring(o, 1, 1) == "-", -1).otherwise(1) * (F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")))

    return F.when(text.rlike(ISO), let(wall, lambda w: F.when(w.isNotNull(), F.struct(w.alias("wall"), let(offset, minutes).cast("int").alias("offset_min")))))


def _written_parts(text: Column, default: Column) -> Column:
    zone = zone_of(F.regexp_extract(text, r"\s*\b([A-Z]{2,4})\s*$", 1))
    bare = F.when(zone.isNotNull(), strip(F.regexp_replace(text, r"\s*\b[A-Z]{2,4}\s*$", ""))).otherwise(text)
    tidy = squish(F.regexp_replace(F.regexp_replace(bare, r"(?i)(\d{1,2}:\d{2})\s*(AM|PM)", "$1 $2"), r"(?i)(?<=[0-9])\s*at\s+", " "))

    def parts(w: Column) -> Column:
        minutes = F.timestamp_diff("MINUTE", F.convert_timezone(F.coalesce(zone, default), F.lit("UTC"), w), w).cast("int")
        return F.when(w.isNotNull(), F.struct(w.alias("wall"), minutes.alias("offset_min")))

    # What holds no digit is no date and is not tried.
    return F.when(text.rlike(r"\d"), let(let(tidy, lambda x: _try(x, FORMATS)), parts))


def parse_datetime(c: Column, default_zone: str | Column | None = None) -> Column:
    """Struct of wall (timestamp_ntz) and offset_min; null if c is no date, offset null if it names no zone and there is no default."""
    default = F.lit(default_zone) if isinstance(default_zone, str) else F.lit(None).cast("string") if default_zone is None else default_zone
    return let(strip(c), lambda t: F.coalesce(_iso_parts(t), _written_parts(t, default)))


def iso(parsed: Column) -> Column:
    """T5: ISO 8601 with the value's own offset, if it has one."""

    def written(p: Column) -> Column:
        m = p["offset_min"]
        offset = F.when(m.isNull(), "").otherwise(F.concat(F.when(m < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(m) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(m) % 60).cast("string"), 2, "0")))
        return F.concat(F.date_format(p["wall"], "yyyy-MM-dd'T'HH:mm:ss"), offset)

    return let(parsed, written)


def normalize_datetime(c: Column, default_zone: str | Column | None = None) -> Column:
    return iso(parse_datetime(c, default_zone))


def instant(parsed: Column) -> Column:
    """T4: the same moment in UTC (timestamp_ntz); values without an offset count as UTC."""
    return let(parsed, lambda p: F.timestamp_add("MINUTE", -F.coalesce(p["offset_min"], F.lit(0)), p["wall"]))


def iso_instant(c: Column) -> Column:
    return F.date_format(instant(parse_datetime(c)), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def value_signature(text: Column) -> Column:
    """T7 for strings: lower-cased and squished, and the instant if that reads as a date."""
    low = squish(F.lower(text))
    return F.coalesce(iso_instant(low), low)


def list_signature(items: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(items, lambda x: F.lower(squish(x)))), "|")


def map_signature(m: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")


def zone_votes(docs, package: str = "package_id", text: str = "text", doc_type: str = "doc_type", order: str = "doc_ord", portal: str = "portal_notice"):
    """Package, zone abbreviation and IANA zone that most of the package's text names.

    Portal documents have no vote unless the package has no others. Ties go to
    the abbreviation that comes first. Packages that name none are absent.
    """
    from pyspark.sql import Window

    only_portal = F.min((F.col(doc_type) == portal).cast("int")).over(Window.partitionBy(package))
    voters = docs.withColumn("_only", only_portal).where((F.col("_only") == 1) | (F.coalesce(F.col(doc_type), F.lit("")) != portal))
    hits = voters.select(package, F.col(order).alias("_ord"), F.posexplode(F.regexp_extract_all(text, F.lit(rf"\b({'|'.join(VOTED)})\b"), 1)).alias("_pos", "zone"))
    tally = hits.groupBy(package, "zone").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_ord", "_pos")).alias("first"))
    best = tally.groupBy(package).agg(F.max_by("zone", F.struct("n", (-F.col("first._ord")).alias("o"), (-F.col("first._pos")).alias("p"))).alias("zone"))
    return best.withColumn("iana", zone_of(F.col("zone")))
