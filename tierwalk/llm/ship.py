"""Sending this package to the executors, for sessions whose workers do not have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import tierwalk

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application; Spark serves the archive to every executor, also to those that start later."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    root = os.path.dirname(tierwalk.__file__)
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "tierwalk.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    archive.write(file, os.path.join("tierwalk", os.path.relpath(file, root)))
    spark.sparkContext.addPyFile(path)
    _SENT.add(app)
