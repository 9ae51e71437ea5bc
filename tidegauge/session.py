"""Sessions, and making the package known to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def get_session(name: str = "tidegauge", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the queries are tested under; conf overrides them."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.shuffle.partitions": "8" if cores == "*" else str(cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = builder.config(map=settings | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a context: they import what Python functions refer to."""
    context = spark.sparkContext
    if getattr(context, "_tidegauge_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="tidegauge-ship-")) / "tidegauge.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(ROOT.rglob("*.py")):
            out.write(file, file.relative_to(ROOT.parent))
    context.addPyFile(str(path))
    context._tidegauge_shipped = True
