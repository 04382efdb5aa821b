"""Send this package's code, and texts in small batches, to the Python workers of executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch. Executor and worker hold a batch several times over: as rows, as vectors on both sides, as what comes of it.
BATCH_BYTES = 4 << 20

_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Let Spark's file server deal this package to the executors, once per application.

    Workers that have the package installed are not disturbed: it is the same code.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(path.relative_to(root.parent)))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def small_batches(spark: SparkSession) -> None:
    """Let whole texts go to Python in batches of ``BATCH_BYTES``; a size the session was given is left alone.

    Spark's own bound is 64 MB, so that a task's share of texts is often a single batch.
    """
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size, None) is None:
        spark.conf.set(size, str(BATCH_BYTES))
