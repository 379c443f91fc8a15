"""Makes this package importable on executors, wherever the driver found it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ensure(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once an application."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        _sent.add(app)
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="arborel-src-")) / "arborel_sources.zip"
        with zipfile.ZipFile(path, "w") as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, str(Path(root.name) / file.relative_to(root)))
        spark.sparkContext.addPyFile(str(path))
    return spark
