"""Sends this package to the Python workers of sessions that cannot import it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session's files, once, unless PYTHONPATH has its folder."""
    sc = spark.sparkContext
    paths = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(ROOT) in paths or sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    with tempfile.TemporaryDirectory() as folder:
        where = Path(folder) / "src" / "leafline"
        shutil.copytree(ROOT / "leafline", where, ignore=shutil.ignore_patterns("__pycache__"))
        kept = tempfile.mkdtemp()  # the driver serves the file from here for as long as it runs
        atexit.register(shutil.rmtree, kept, ignore_errors=True)
        sc.addPyFile(shutil.make_archive(str(Path(kept) / "leafline"), "zip", where.parent))
