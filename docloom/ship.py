"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if not getattr(sc, "_docloom_shipped", False):
        home = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="docloom-src-")) / "docloom.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(home.rglob("*.py")):
                z.write(p, p.relative_to(home.parent))
        sc.addPyFile(str(path))
        sc._docloom_shipped = True
    return spark
