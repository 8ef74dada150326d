"""Make this package importable in Python workers, whatever their PYTHONPATH is."""

from __future__ import annotations

import os
import tempfile
import zipfile

_shipped: set[str] = set()


def ship(spark) -> None:
    """Send the package's sources to the executors once per Spark application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), "tessera_src.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
