"""What a session needs before Python kernels run on its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()
#: Kernels take rows of whole files, so a batch is bounded by its bytes, too; a session that sets this itself keeps its own.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python workers, once for each application, and bounds their batches."""
    context = spark.sparkContext
    if not spark._jsparkSession.conf().contains(BATCH):
        spark.conf.set(BATCH, BATCH_BYTES)
    if context.applicationId not in _sent:
        here = os.path.dirname(os.path.abspath(__file__))
        at = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
        with zipfile.ZipFile(at, "w") as out:
            for folder, _, names in os.walk(here):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.join("tessera", os.path.relpath(path, here)))
        context.addPyFile(at)
        _sent.add(context.applicationId)
    return spark
