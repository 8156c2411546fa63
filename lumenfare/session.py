"""Session helpers: the recommended builder, and shipping this package to executors."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def build(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects: UTC, adaptive execution, Arrow."""
    b = SparkSession.builder.appName("lumenfare").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    if master:
        b = b.master(master)
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once for each application; where it is installed on them this changes nothing."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="lumenfare-")) / "lumenfare_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(top.rglob("*.py")):
            out.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode (tests), and an error on a cluster, whose machines share none."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        got = "file://" + tempfile.mkdtemp(prefix="lumenfare-")
        spark.sparkContext.setCheckpointDir(got)
    return got
