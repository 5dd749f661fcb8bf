"""Session settings the engine expects.

A cluster brings its own session; ``local_session`` is for tests and the
benchmark. Nothing in the operators depends on these values for its result.
"""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers need it and may run from any folder. Once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    content = data.getvalue()
    # the driver serves the file, so it may lie where only the driver sees it
    target = Path(tempfile.mkdtemp(prefix="tidemill-")) / f"tidemill-{hashlib.sha256(content).hexdigest()[:12]}.zip"
    target.write_bytes(content)
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def local_session(cores: int = 8, shuffle_partitions: int | None = None, memory: str = "8g", name: str = "tidemill") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", os.path.join(tempfile.gettempdir(), f"tidemill-checkpoints-{os.getpid()}"))
        .getOrCreate()
    )
    ship(spark)
    return spark
