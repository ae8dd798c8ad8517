"""Directories of wide counter exports as long samples.

Every file has its own header, so a directory cannot be read as one CSV table.
Headers are read on their own; the data lines are then read as text, split once,
and each line gives up the cells that its own file's header asks for. What other
files want does not matter to a line, and no line is shuffled.
"""

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from counterloom.functions.lines import csv_cells, quoted_cells, time_position
from counterloom.functions.numbers import is_finite, plain_double
from counterloom.functions.paths import contains_any
from counterloom.functions.times import parse_time
from counterloom.operators.select import describe_counters
from counterloom.schema import NO_DATA, TICK

# Files per scan. Their layouts are broadcast, at most this many rows of four bytes
# per header column.
ROUND_FILES = 2000

_GLOB = re.compile(r"[\\{}\[\]*?]")
_HEADERS = "run_id string, size_bytes long, header string, error string"
# Schemes under which the header reader knows a store that Spark names otherwise.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def list_logs(spark: SparkSession, root: str) -> DataFrame:
    """All ``*.csv`` files under ``root``; the content of the files is not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .load(root)
        .select(
            F.col("_metadata.file_path").alias("run_id"),
            F.col("length").alias("size_bytes"),
            F.unix_micros("modificationTime").alias("modified_us"),
        )
    )


def _header_reader(schemes: dict[str, str]):
    """Reader of first lines; a closure travels whole, so executors need no package."""

    def first_line(uri: str) -> str:
        scheme, colon, rest = uri.partition(":")
        system, path = fs.FileSystem.from_uri(schemes.get(scheme, scheme) + colon + rest)
        blocks = []
        with system.open_input_stream(path) as stream:
            while block := stream.read(1024 * 1024):
                blocks.append(block)
                if b"\n" in block:
                    break
        line = b"".join(blocks).split(b"\n", 1)[0]
        return line.decode("utf-8-sig").rstrip("\r")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run_id, size in zip(*[column.to_pylist() for column in batch.columns]):
                header = error = None
                try:
                    header = first_line(run_id)
                except (OSError, ValueError, pa.ArrowException) as problem:
                    error = f"{type(problem).__name__}: {problem}"
                columns = [pa.array([run_id]), pa.array([size], pa.int64())]
                columns += [pa.array([text], pa.string()) for text in (header, error)]
                names = ["run_id", "size_bytes", "header", "error"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return read


def read_headers(logs: DataFrame) -> DataFrame:
    """``run_id, size_bytes, header, error``: opens each file, stops after its first line.

    A file that cannot be opened or is not UTF-8 has an ``error`` and no header.
    Files in stores that only Spark reaches take ``scan_headers`` instead.
    """
    return logs.select("run_id", "size_bytes").mapInArrow(_header_reader(_SCHEMES), _HEADERS)


def known_headers(logs: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """Headers of the logs: the ``given`` ones, or those that their files begin with."""
    if given is None:
        return read_headers(logs)
    own = logs.join(given.drop("size_bytes"), "run_id", "left")
    if "error" not in given.columns:
        own = own.withColumn("error", F.lit(None).cast("string"))
    missing = F.col("header").isNull() & F.col("error").isNull()
    return own.withColumn("error", F.when(missing, "no header given").otherwise(F.col("error")))


def scan_headers(spark: SparkSession, logs: DataFrame, root: str) -> DataFrame:
    """The same through Spark's own file systems; reads the files once to their end.

    Of the first block of each file the first line counts.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .text(root)
        .filter(F.col("_metadata.file_block_start") == 0)
        .select(
            F.col("_metadata.file_path").alias("run_id"),
            F.monotonically_increasing_id().alias("place"),
            F.col("value").alias("header"),
        )
    )
    first = lines.groupBy("run_id").agg(F.min_by("header", "place").alias("header"))
    return logs.join(first, "run_id", "left").select(
        "run_id",
        "size_bytes",
        F.coalesce("header", F.lit("")).alias("header"),
        F.lit(None).cast("string").alias("error"),
    )


def layouts(
    headers: DataFrame, patterns: list[str], time_column: str | None = None
) -> DataFrame:
    """What to take from the lines of each run: one row per run, one pass, no join.

    ``wanted`` lists the positions of the counters that contain a pattern. The time
    column is found by its form unless ``time_column`` names it.
    """
    cells = F.when(F.col("header") == "", F.array().cast("array<string>"))
    named = headers.select(
        "run_id", "size_bytes", cells.otherwise(csv_cells(F.col("header"))).alias("names")
    )
    place = time_position(F.col("names"))
    if time_column is not None:
        stated = F.array_position("names", F.lit(time_column)).cast("int")
        place = F.when(stated > 0, stated - 1)
    timed = named.withColumn("time_pos", place)
    spots = F.transform("names", lambda name, i: F.struct(i.alias("pos"), name.alias("path")))
    wanted = F.filter(
        spots, lambda s: (s.pos != F.col("time_pos")) & contains_any(s.path, patterns)
    )
    return timed.select(
        "run_id",
        "size_bytes",
        F.size("names").alias("columns"),
        "time_pos",
        F.get("names", F.col("time_pos")).alias("time_column"),
        wanted.alias("wanted"),
    )


def counter_dictionary(layout: DataFrame) -> DataFrame:
    """``run_id, pos, counter_path, server, metric`` of the wanted counters."""
    rows = layout.select("run_id", F.inline("wanted")).withColumnRenamed("path", "counter_path")
    return describe_counters(rows)


def _readings(celled: DataFrame) -> DataFrame:
    """Samples of rows that hold the cells of a line and the plan of its run.

    A filter on a column made from cells would be moved below the step that makes
    them and repeat it; an inner explode implies such a filter. So every such
    column, the time stamp included, leaves through the explode, and rows are
    dropped after it. Header lines and blank ones become null arrays; where lines
    carry their ``bytes``, a row at ``NO_DATA`` keeps theirs.
    """
    time_cell = F.get("cells", F.col("time_pos"))
    texts = F.transform("positions", lambda pos: F.when(pos >= 0, F.get("cells", pos)))
    readings = F.arrays_zip(
        F.array_repeat(parse_time(time_cell), F.size("positions")).alias("ts"),
        F.col("positions").alias("pos"),
        F.transform(texts, plain_double).alias("value"),
    )
    is_data = ~F.equal_null(time_cell, F.col("time_column")) & (F.trim("line") != "")
    known = F.col("ts").isNotNull() & is_finite(F.col("value"))
    accounted = ["bytes"] if "bytes" in celled.columns else []
    place = F.coalesce("pos", F.lit(NO_DATA)) if accounted else F.col("pos")
    rows = (
        celled.select("run_id", *accounted, F.when(is_data, readings).alias("readings"))
        .select("run_id", *accounted, F.inline_outer("readings").alias("ts", "pos", "value"))
        .withColumn("pos", place)
        .filter((F.col("pos") <= TICK) | known)
    )
    if accounted:
        # A line's bytes count once, at its tick.
        rows = rows.withColumn("bytes", F.when(F.col("pos") <= TICK, F.col("bytes")))
    return rows.select("run_id", "ts", "pos", "value", *accounted)


def _plan(layout: DataFrame) -> DataFrame:
    positions = F.concat(F.array(F.lit(TICK)), F.col("wanted.pos"))
    return layout.filter(F.col("time_pos").isNotNull()).select(
        "run_id", "columns", "time_pos", "time_column", positions.alias("positions")
    )


def parse_lines(lines: DataFrame, layout: DataFrame) -> DataFrame:
    """Log lines from any source (``run_id, line``) to samples, by the layout of their run."""
    return _parsed(lines, _plan(layout))


def _parsed(lines: DataFrame, plan: DataFrame) -> DataFrame:
    split = lines.join(plan, "run_id").withColumn("fast", quoted_cells(F.col("line")))
    whole = F.when(F.size("fast") == F.col("columns"), F.col("fast"))
    return _readings(split.withColumn("cells", whole.otherwise(csv_cells(F.col("line")))))


def file_paths(run_ids: list[str]) -> list[str]:
    """Runs as paths for a reader: run names are URL-encoded, readers take globs."""
    return [_GLOB.sub(r"\\\g<0>", unquote(run_id)) for run_id in run_ids]


def read_samples(
    spark: SparkSession, files: list[str], layout: DataFrame, accounted: bool = False
) -> DataFrame:
    """Data lines of one round of files to samples, by the layout of each.

    The layouts go to the lines; a round has a fixed number of files, which bounds
    what is broadcast.

    With ``accounted`` a file that cannot be read to its end stops no scan. Every
    line then counts its ``bytes`` in one row (its tick, or one at ``NO_DATA``), and
    a store finds the files whose bytes do not add up.
    """
    if not files:
        columns = "run_id string, line string" + (", bytes int" if accounted else "")
        return _parsed(spark.createDataFrame([], columns), F.broadcast(_plan(layout)))
    reader = spark.read
    if accounted:
        reader = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
        # Only then does a line keep every byte before the break.
        reader = reader.option("lineSep", "\n")
    lines = reader.text(file_paths(files)).select(
        F.col("_metadata.file_path").alias("run_id"), F.col("value").alias("line")
    )
    if accounted:
        cut = F.substring("line", F.lit(1), F.length("line") - 1)
        lines = lines.select(
            "run_id",
            F.when(F.endswith("line", F.lit("\r")), cut).otherwise(F.col("line")).alias("line"),
            (F.octet_length("line") + 1).alias("bytes"),
        )
    return _parsed(lines, F.broadcast(_plan(layout)))
