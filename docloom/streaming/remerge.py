"""Incremental merging: a landing folder of candidates is a stream, and each batch merges again only the packages it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docloom.operators import merge


def remerge(spark: SparkSession, landing: str, store: str, out: str, checkpoint: str, specs: DataFrame, schema) -> StreamingQuery:
    """Reads Parquet candidates that land in `landing`, appends them to `store`, and writes resolved rows to `out`/batch_id=n.

    A batch that is run again overwrites its own folders, so each is counted
    once. The latest batch of a package holds its current values.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")
        every = session.read.schema(schema).option("basePath", store).parquet(store).where(f"batch_id <= {batch_id}").drop("batch_id")
        touched = batch.select("package_id").distinct()
        resolved, _ = merge.merge(every.join(touched, "package_id", "left_semi"), specs)
        resolved.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The resolved rows of each package from the last batch that touched it."""
    rows = spark.read.parquet(out)
    last = rows.groupBy("package_id").agg({"batch_id": "max"}).withColumnRenamed("max(batch_id)", "batch_id")
    return rows.join(last, ["package_id", "batch_id"], "left_semi").drop("batch_id")
