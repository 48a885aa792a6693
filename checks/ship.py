"""Send the package to the Python workers of a session, as ``--py-files`` would."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import keytide

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session once, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(keytide.__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="keytide-")) / "keytide.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    # Helper processes of stateful streams run beside the driver and look only here.
    paths = [str(root.parent), context.environment.get("PYTHONPATH", "")]
    context.environment["PYTHONPATH"] = os.pathsep.join(p for p in paths if p)
    _shipped.add(context.applicationId)
