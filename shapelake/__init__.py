"""shapelake: geometric and statistical shape analytics on Spark DataFrames."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession, *more: str) -> None:
    """Makes this package (and further modules beside it) importable by the session's Python workers, once a session.

    Needed where executors have no copy of the package installed; the archive goes out with addPyFile.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="shapelake-")) / "shapelake.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
        for name in more:
            if (path := root.parent / name).exists():
                z.write(path, name)
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
