"""Making the package known to executors that were not started with it on their path."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package to the executors as a zip, once for each application.

    Where PYTHONPATH or the working folder already has it, as on workers that share the driver's
    environment, nothing is sent.
    """
    home = str(ROOT.parent)
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if home in (os.path.realpath(p) for p in known if p) or (Path(os.getcwd()) / ROOT.name).exists():
        return
    name = f"{ROOT.name}-{spark.sparkContext.applicationId}.zip"
    if any(f.endswith(name) for f in spark.sparkContext._python_includes):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, str(f.relative_to(ROOT.parent)))
    path = os.path.join(tempfile.mkdtemp(), name)
    Path(path).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(path)
