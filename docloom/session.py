"""The session that tests and the benchmark run in. On a cluster, the caller brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    conf = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.master(f"local[{cores}]").appName("docloom").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
