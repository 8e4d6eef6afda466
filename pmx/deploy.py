"""Sends the package to the executors, so that their Python finds it wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: the package as a zip, which executors fetch from the driver."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    _sent.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(here):  # imported from such a zip
        return
    top = os.path.dirname(here)
    path = os.path.join(tempfile.mkdtemp(prefix="pmx-"), "pmx_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), top))
    sc.addPyFile(path)


def shipped(query):
    """The query, with the package sent first."""

    def run(spark: SparkSession, sf_dir: str):
        ship(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__, run.__module__ = getattr(query, "__name__", "query"), query.__doc__, query.__module__
    return run
