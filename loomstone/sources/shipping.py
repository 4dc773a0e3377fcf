"""The package for Python workers that would not find it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a session, unless their search path has it already."""
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if str(ROOT) in paths or context.applicationId in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="loomstone-")) / "loomstone.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in [*ROOT.glob("loomstone/**/*.py"), *ROOT.glob("corpus_pipeline.py")]:
            z.write(f, f.relative_to(ROOT))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
