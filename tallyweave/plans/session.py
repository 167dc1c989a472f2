"""Session settings and shipping of the package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()


def session(name: str = "tallyweave", master: str = "local[8]", partitions: int = 8) -> SparkSession:
    """A local session with adaptive planning; a cluster brings its own settings."""
    conf = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
    }
    return SparkSession.builder.master(master).appName(name).config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once per application.

    The archive is read by the driver's file server alone, which hands it to every executor.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    target = Path(tempfile.mkdtemp(prefix="tallyweave-")) / "tallyweave.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in (ROOT / "tallyweave").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)
