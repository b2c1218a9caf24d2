"""Sending this library to the Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

import weft

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Let every Python worker import the library, as ``--py-files`` would; once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        root = os.path.dirname(os.path.dirname(os.path.abspath(weft.__file__)))
        folder = tempfile.mkdtemp()  # the driver serves the file as long as the application runs
        atexit.register(shutil.rmtree, folder, True)
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "weft"), "zip", root, "weft"))
        _sent.add(sc.applicationId)
    return spark
