"""Sessions for local use, and the package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, with adaptive execution and UTC times."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors' Python once a session; without it they need it installed."""
    sc, top = spark.sparkContext, Path(__file__).parent
    if not getattr(sc, "_voxlake_shipped", False) and top.is_dir():
        to = os.path.join(tempfile.mkdtemp(prefix="voxlake-ship-"), "voxlake.zip")
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, f"voxlake/{p.relative_to(top)}")
        sc.addPyFile(to)
        sc._voxlake_shipped = True
    return spark
