"""Getting this package to Python workers that can't see its folder."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application.

    The driver's PYTHONPATH and working folder say nothing about other machines, so only a local master, whose workers
    start in the driver's environment, is left alone, and only if the package can be found there.
    """
    seen = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [Path.cwd().resolve()]
    app = spark.sparkContext.applicationId
    if app in _done or ROOT in seen and re.match(r"local(\[|$)", spark.sparkContext.master):
        return
    path = Path(tempfile.mkdtemp(prefix="clausewright-")) / "clausewright.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((ROOT / "clausewright").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
    _done.add(app)
