"""Incremental ingest as a stream of new files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from counterloom.operators.runs import new_runs
from counterloom.schema import DEFAULT_BASELINE, DEFAULT_PATTERNS
from counterloom.shared import settled_scope
from counterloom.sources.counter_logs import ROUND_FILES
from counterloom.sources.store import VERSION, claims, ingest_files

# The columns of Spark's binary file source.
_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_logs(
    spark: SparkSession,
    root: str,
    store: str,
    checkpoint: str,
    patterns: list[str] = DEFAULT_PATTERNS,
    baseline: str = DEFAULT_BASELINE,
    headers: DataFrame | None = None,
    time_column: str | None = None,
    round_files: int = ROUND_FILES,
) -> StreamingQuery:
    """Ingest all files that arrived since the last call, then stop.

    The stream carries file names, not contents. The checkpoint remembers which
    files were seen; the manifest of the store decides which of them are new, so a
    micro-batch that runs again, a lost checkpoint, a second stream or
    ``ingest_new`` on the same store neither lose nor repeat a file.
    """

    def ingest(files: DataFrame, batch: int) -> None:
        fresh = new_runs(files, claims(files.sparkSession, store, files), VERSION)
        # At most round_files rows.
        found = [tuple(row) for row in fresh.select(*VERSION).collect()]
        with settled_scope(spark):
            ingest_files(spark, store, found, headers, patterns, baseline, time_column)

    return (
        spark.readStream.format("binaryFile")
        .schema(_FILE_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .option("maxFilesPerTrigger", round_files)
        .load(root)
        .select(
            F.col("_metadata.file_path").alias("run_id"),
            F.col("length").alias("size_bytes"),
            F.unix_micros("modificationTime").alias("modified_us"),
        )
        .writeStream.foreachBatch(ingest)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
