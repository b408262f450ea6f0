"""Helpers shared by the training-data operators: staged tables and text normalisation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.ship import ship
from docloom.stages import shared_dir, stage, stage_path, unstage

__all__ = ["ascii_lower", "bitmap", "mark", "marked", "only_marked", "shared_dir", "spread_join", "stage", "stage_path", "table", "unstage"]

#: The white space of the line and word contracts: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of a bitmap of marks: 8 MB, whatever the input.
MARKS = 1 << 26


def mark(*columns) -> Column:
    """The bit that stands for some columns in a bitmap of marks."""
    return F.pmod(F.xxhash64(*columns), F.lit(MARKS))


def bitmap(df: DataFrame, *columns):
    """A broadcast bitmap of fixed size in which the marks of all rows of df are set.

    Rows without a partner in df can be passed over with it where they are
    read. Some rows without one pass it, so a join still decides.
    """
    page = 8 * 4096
    pages = df.select(mark(*columns).alias("m")).groupBy(F.floor(F.col("m") / page).alias("page")).agg(F.bitmap_construct_agg(F.col("m") % page).alias("bits")).collect()
    out = np.zeros(MARKS // 8, np.uint8)
    for r in pages:
        out[r["page"] * 4096 : (r["page"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return df.sparkSession.sparkContext.broadcast(out.tobytes())


def marked(bits: bytes, at: np.ndarray) -> np.ndarray:
    """Which marks are set."""
    return np.frombuffer(bits, np.uint8)[at >> 3] >> (at & 7) & 1 == 1


def only_marked(bits, at: int, set_: bool = True):
    """For mapInArrow: the rows whose mark, in column `at`, is set or, with set_ false, is not."""

    def run(batches):
        for batch in batches:
            keep = marked(bits.value, batch.column(at).to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(keep == set_))

    return run


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII values take the faster built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


#: Groups with so large a share of all rows are joined by broadcast; there are HOT_GROUPS at most.
HOT_GROUPS = 1024


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: str, total: int) -> DataFrame:
    """rows left-joined with groups, which have one row for each value of keys and a column `size` with its number of rows.

    Very large groups would put their rows into one task. Those with more than
    total / HOT_GROUPS rows, HOT_GROUPS at most, are broadcast, and their rows
    are spread over all tasks by the column `spread`, where they meet no one.
    """
    hot = F.col(size) * HOT_GROUPS > F.lit(total)
    given = [c for c in groups.columns if c not in keys]
    few = groups.where(hot).select(*keys, F.struct(*given).alias("_hot"))
    salted = rows.join(F.broadcast(few), keys, "left").withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(1 << 20)) + 1).otherwise(0))
    rest = groups.where(~hot).select(*keys, F.struct(*given).alias("_cold"), F.lit(0).cast("long").alias("_salt"))
    both = salted.join(rest, [*keys, "_salt"], "left")
    return both.select(*rows.columns, *[F.coalesce(F.col("_hot")[c], F.col("_cold")[c]).alias(c) for c in given])
