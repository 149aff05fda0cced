"""What a session needs so that executors can run this package's Python."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application.

    Nothing is sent where the package itself came in an archive, as with --py-files: executors have it then.
    """
    sc = spark.sparkContext
    here = os.path.dirname(os.path.abspath(__file__))
    if sc.applicationId in _SHIPPED or not os.path.isdir(here):
        return
    with tempfile.TemporaryDirectory() as d:
        shutil.copytree(here, f"{d}/tree/scriptorium", ignore=shutil.ignore_patterns("__pycache__"))
        # The driver's file server hands it out from its own copy.
        keep = os.path.join(tempfile.mkdtemp(prefix="scriptorium-"), "scriptorium_package")
        sc.addPyFile(shutil.make_archive(keep, "zip", f"{d}/tree"))
    _SHIPPED.add(sc.applicationId)
