"""Shipping this package to the Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Ship this package to the Python workers, once an application; no setting is changed.

    A package that is not a folder on the driver came as a file that Spark ships already.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or not os.path.isdir(os.path.join(_ROOT, "tidemark")):
        return
    folder = tempfile.mkdtemp(prefix="tidemark-package-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "tidemark_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(os.path.join(_ROOT, "tidemark")):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(top, name), os.path.relpath(os.path.join(top, name), _ROOT))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
