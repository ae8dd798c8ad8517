"""Sends this package's code to the executors."""

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from counterloom.shared import shared_folder

_PACKAGE = Path(__file__).resolve().parent.parent


def _archive() -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as out:
        for source in sorted(_PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(_PACKAGE.parent))
    return data.getvalue()


def ship(spark: SparkSession) -> None:
    """Once per application, so Python tasks can import it without an installation.

    The archive lies in the shared folder, from which Spark hands it out. Tasks then
    share what a worker process keeps between them: tokenizers and their caches.
    """
    context = spark.sparkContext
    if getattr(context, "counterloom_shipped", False):
        return
    # Kept as long as the application: executors may come later.
    path = f"{shared_folder(spark)}/code-{uuid.uuid4().hex}/counterloom.zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(_archive()))
    stream.close()
    context.addPyFile(path)
    context.counterloom_shipped = True
