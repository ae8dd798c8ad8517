"""Ingested logs as parquet tables.

``samples``, ``bins`` (their five-minute statistics, which is what reports read),
``counters`` and ``runs`` hold one folder per batch, named by a random id that no
other writer can have. A batch claims its files in ``claims``, by path, size and
modification time, in folders by the hash of the path. Its ``commits`` record is
written last: a batch that failed half-way has none and stays invisible, and what
is visible is never written again.

Writers do not wait for each other. Each takes the files that no visible batch
claims in their present version; where two took the same file at once, both commit
and readers go by the claims: of one file the newest version counts, of one version
the earliest claim, then the smallest batch id. A log that has grown or was exported
again is a new version and replaces the old one for readers.

``compact_store`` rewrites small batches as one. Its commit names the batches that it
replaces, so readers see either those or the new one.

``failures`` lists files that could not be read; they are tried again at the next
call. A file whose bytes were not all read has rows in its batch, but its claim there
is withdrawn (it names no version), so that no reader sees them.
"""

import uuid
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from counterloom.operators.runs import new_runs, run_status
from counterloom.operators.select import baseline_counters
from counterloom.operators.series import find_cut
from counterloom.operators.stats import baseline_bins, bin_samples, binned_bounds
from counterloom.schema import (
    BINS,
    CLAIMS,
    COMMITS,
    COUNTERS,
    FAILURES,
    RUNS,
    SAMPLES,
    TICK,
    UNREADABLE,
)
from counterloom.shared import delete_folder, settle, settled_scope
from counterloom.sources.counter_logs import (
    ROUND_FILES,
    counter_dictionary,
    known_headers,
    layouts,
    list_logs,
    read_samples,
)

_TABLES = {"samples": SAMPLES, "bins": BINS, "counters": COUNTERS, "runs": RUNS}

# Folders of claims by the hash of the path.
BUCKETS = 64
# Batches of fewer files are compacted.
SMALL_BATCH = 1000

# What a batch has read, counted by its scan: no table is read again for that.
TELEMETRY = ["files", "bytes", "rows", "bad_rows", "readings"]

File = tuple[str, int, int]
_FILES = "run_id string, size_bytes long, modified_us long"
VERSION = ["run_id", "size_bytes", "modified_us"]


class Store(NamedTuple):
    samples: DataFrame
    bins: DataFrame
    counters: DataFrame
    runs: DataFrame


class Summary(NamedTuple):
    """Files of one ingest call: all, not yet ingested, already ingested, unreadable."""

    found: int
    new: int
    skipped: int
    failed: int


def _read(spark: SparkSession, path: str, columns: str) -> DataFrame:
    try:
        return spark.read.schema(columns).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], columns)


def _all_commits(spark: SparkSession, store: str) -> DataFrame:
    return _read(spark, f"{store}/commits", f"{COMMITS}, batch string")


def commits(spark: SparkSession, store: str) -> DataFrame:
    """One row per committed batch that no other batch replaces, with its telemetry."""
    known = _all_commits(spark, store)
    gone = known.select(F.explode("replaces").alias("batch"))
    return known.join(gone, "batch", "left_anti")


def bucket_of(run_id: Column) -> Column:
    return F.pmod(F.xxhash64(run_id), F.lit(BUCKETS)).cast("int")


def claims(spark: SparkSession, store: str, files: DataFrame | None = None) -> DataFrame:
    """Claims of all visible batches.

    With ``files`` only the buckets of those are read; at most ``BUCKETS`` numbers
    come to the driver for that.
    """
    found = _read(spark, f"{store}/claims", f"{CLAIMS}, batch string, bucket int")
    if files is not None:
        touched = files.select(bucket_of(F.col("run_id")).alias("bucket")).distinct()
        found = found.filter(F.col("bucket").isin([row.bucket for row in touched.collect()]))
    return found.join(commits(spark, store).select("batch"), "batch", "left_semi")


def outdated(claimed: DataFrame) -> DataFrame:
    """``run_id, batch`` of claims that lose: withdrawn ones, older versions, later takers."""
    order = F.struct(-F.col("modified_us"), -F.col("size_bytes"), F.col("taken_us"), F.col("batch"))
    held = claimed.filter(F.col("size_bytes").isNotNull())
    winners = held.groupBy("run_id").agg(F.min_by("batch", order).alias("batch"))
    return claimed.join(winners, ["run_id", "batch"], "left_anti").select("run_id", "batch").distinct()


def _visible(spark: SparkSession, store: str, known: DataFrame) -> dict[str, DataFrame]:
    """The tables of the batches in ``known``, without rows of claims that lost."""
    # Few rows as a rule, and a settled table has a known size.
    lost = settle(outdated(claims(spark, store)), "outdated")
    none_lost = lost.isEmpty()
    tables = {}
    for name, columns in _TABLES.items():
        table = _read(spark, f"{store}/{name}", f"{columns}, batch string")
        table = table.join(known.select("batch"), "batch", "left_semi")
        if name in ("samples", "bins"):
            table = table.filter(F.col("pos") >= TICK)
        if not none_lost:
            table = table.join(lost, ["run_id", "batch"], "left_anti")
        tables[name] = table
    return tables


def open_store(spark: SparkSession, store: str) -> Store:
    """The tables of all committed batches: one version of every run, once."""
    tables = _visible(spark, store, commits(spark, store))
    return Store(*[table.drop("batch") for table in tables.values()])


def failures(spark: SparkSession, store: str) -> DataFrame:
    """Files that could not be read, once per attempt, with the error."""
    return _read(spark, f"{store}/failures", f"{FAILURES}, attempt string").drop("attempt")


def run_table(
    bins: DataFrame, bad: DataFrame, layout: DataFrame, baseline: str
) -> DataFrame:
    """Manifest rows: size, row and cell counts, baseline, cut and status of each run."""
    is_tick = F.col("pos") == TICK
    counts = bins.groupBy("run_id").agg(
        F.sum(F.when(is_tick & F.col("bin").isNotNull(), F.col("rows"))).alias("rows"),
        F.sum("n").alias("readings"),
    )
    baselines = baseline_counters(counter_dictionary(layout), baseline)
    cuts = find_cut(baseline_bins(bins, baselines), binned_bounds(bins))
    cells = F.coalesce(F.col("rows"), F.lit(0)) * F.size("wanted")
    runs = (
        layout.join(counts, "run_id", "left")
        .join(bad, "run_id", "left")
        .select(
            "run_id",
            "size_bytes",
            F.coalesce("rows", F.lit(0)).alias("rows"),
            F.coalesce("bad_rows", F.lit(0)).alias("bad_rows"),
            F.size("wanted").alias("counters"),
            (cells - F.coalesce("readings", F.lit(0))).alias("null_cells"),
            "time_column",
        )
    )
    return run_status(runs, baselines, cuts)


def _bad_rows(bins: DataFrame) -> DataFrame:
    """Lines without a readable time stamp: tick rows outside every bin."""
    lost = bins.filter((F.col("pos") == TICK) & F.col("bin").isNull())
    return lost.groupBy("run_id").agg(F.sum("rows").alias("bad_rows"))


def _observed(samples: DataFrame, seen: Observation) -> DataFrame:
    """The samples; whoever scans them leaves line and reading counts in ``seen``."""
    line = F.col("pos") == TICK
    return samples.observe(
        seen,
        F.count(F.when(line & F.col("ts").isNotNull(), 1)).alias("rows"),
        F.count(F.when(line & F.col("ts").isNull(), 1)).alias("bad_rows"),
        F.count("value").alias("readings"),
    )


def _commit(spark: SparkSession, store: str, batch: str, record: DataFrame) -> None:
    """Telemetry and ``replaces`` of a batch in a folder of its own; one file appears at once."""
    record = record.select(
        *[F.col(c).cast("long").alias(c) for c in TELEMETRY],
        F.col("replaces").cast("array<string>").alias("replaces"),
        F.current_timestamp().alias("committed_at"),
    )
    record.coalesce(1).write.parquet(f"{store}/commits/batch={batch}")


def _write_claims(store: str, batch: str, claimed: DataFrame) -> None:
    placed = claimed.select(*VERSION, "taken_us", bucket_of(F.col("run_id")).alias("bucket"))
    placed.coalesce(1).write.partitionBy("bucket").parquet(f"{store}/claims/batch={batch}")


def unread_files(layout: DataFrame, bins: DataFrame) -> DataFrame:
    """Runs whose scan stopped before the end, with what it read of them.

    ``bins`` are those of accounted samples. A reader that stops loses whole lines,
    and a byte order mark is not read as part of a line: up to three bytes may be
    missing, in which no line with a time stamp fits.
    """
    is_tick, timed = F.col("pos") == TICK, F.col("bin").isNotNull()
    read = bins.groupBy("run_id").agg(
        F.sum("bytes").alias("bytes"),
        F.sum(F.when(is_tick & timed, F.col("rows"))).alias("rows"),
        F.sum(F.when(is_tick & ~timed, F.col("rows"))).alias("bad_rows"),
        F.sum("n").alias("readings"),
    )
    scanned = layout.filter(F.col("time_pos").isNotNull()).select("run_id", "size_bytes")
    counted = scanned.join(read, "run_id", "left").fillna(0)
    return counted.filter(F.col("bytes") < F.col("size_bytes") - 3)


def _ingest_batch(
    spark: SparkSession,
    store: str,
    files: list[File],
    headers: DataFrame,
    patterns: list[str],
    baseline: str,
    time_column: str | None,
    keep_samples: bool,
) -> dict[str, str]:
    """All tables of one batch, its claims, then its commit record.

    Returns the files that could not be read to their end, which it does not claim.
    """
    batch = uuid.uuid4().hex
    written = []

    def write(table: str, df: DataFrame) -> DataFrame:
        path = f"{store}/{table}/batch={batch}"
        written.append(path)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        layout = settle(layouts(headers, [*patterns, baseline], time_column), "layouts")
        seen = Observation()
        scan = read_samples(spark, [file[0] for file in files], layout, accounted=True)
        samples = _observed(scan, seen)
        if keep_samples:
            # Straight from the scan: its tasks hold the lines of few files, in order.
            samples = write("samples", samples)
        bins = write("bins", bin_samples(samples))
        # At most a round of files.
        unread = unread_files(layout, bins).collect()
        short = {row.run_id: f"{row.bytes} of {row.size_bytes} bytes read" for row in unread}
        if short:
            layout = layout.filter(~F.col("run_id").isin(list(short)))
        write("counters", counter_dictionary(layout))
        runs = run_table(bins, _bad_rows(bins), layout, baseline)
        write("runs", runs.withColumn("ingested_at", F.current_timestamp()))
        whole = [file for file in files if file[0] not in short]
        taken = spark.createDataFrame(whole + [(name, None, None) for name in short], _FILES)
        written.append(f"{store}/claims/batch={batch}")
        _write_claims(store, batch, taken.withColumn("taken_us", F.unix_micros(F.current_timestamp())))
    except BaseException:
        for path in written:
            delete_folder(spark, path)
        raise
    counts = {"files": len(whole), "bytes": sum(file[1] for file in whole)}
    counts |= {c: n - sum(row[c] for row in unread) for c, n in seen.get.items()}
    record = spark.range(1).select(
        F.array().alias("replaces"), *[F.lit(counts[c]).alias(c) for c in TELEMETRY]
    )
    _commit(spark, store, batch, record)
    return short


def _is_read_error(error: PySparkException) -> bool:
    text = str(error)
    return any(name in text for name in ("FAILED_READ_FILE", "FileNotFoundException", "PATH_NOT_FOUND"))


def ingest_files(
    spark: SparkSession,
    store: str,
    files: list[File],
    headers: DataFrame | None = None,
    patterns: list[str] = (),
    baseline: str = "",
    time_column: str | None = None,
    keep_samples: bool = True,
) -> int:
    """Ingest one round of files (path, size, modification time); returns how many failed.

    Files whose header cannot be read are set aside first. The scan passes over what
    it cannot read; files whose bytes do not add up afterwards have failed, and the
    others need no second scan. Only an error that Spark does not pass over (a refused
    access, a lost block) halves the round until its file stands alone.
    """
    if not files:
        return 0
    logs = spark.createDataFrame(files, _FILES).drop("modified_us")
    own = settle(known_headers(logs, headers), "headers")
    # At most a round of files.
    broken = {row.run_id: row.error for row in own.filter("error is not null").collect()}
    good = [file for file in files if file[0] not in broken]
    rest = own.filter("error is null").drop("error")
    if good:
        _ingest_scanned(
            spark, store, good, rest, patterns, baseline, time_column, keep_samples, broken
        )
    if broken:
        rows = [(run_id, UNREADABLE, error) for run_id, error in broken.items()]
        table = spark.createDataFrame(rows, "run_id string, status string, error string")
        table = table.withColumn("failed_at", F.current_timestamp()).coalesce(1)
        table.write.parquet(f"{store}/failures/attempt={uuid.uuid4().hex}")
    return len(broken)


def _ingest_scanned(spark, store, files, headers, patterns, baseline, time_column, keep, broken):
    try:
        broken |= _ingest_batch(
            spark, store, files, headers, patterns, baseline, time_column, keep
        )
    except PySparkException as error:
        if not _is_read_error(error):
            raise
        if len(files) == 1:
            broken[files[0][0]] = str(error).split("\n", 1)[0]
            return
        middle = len(files) // 2
        for half in (files[:middle], files[middle:]):
            names = spark.createDataFrame([(file[0],) for file in half], "run_id string")
            own = headers.join(names, "run_id", "left_semi")
            _ingest_scanned(
                spark, store, half, own, patterns, baseline, time_column, keep, broken
            )


def _rounds(pending: DataFrame, size: int) -> Iterator[list[File]]:
    """Files in rounds of fixed size; names come from one pass, one partition at a time."""
    rows = (tuple(row) for row in pending.select(*VERSION).toLocalIterator())
    while batch := list(islice(rows, size)):
        yield batch


def ingest_new(
    spark: SparkSession,
    root: str,
    store: str,
    patterns: list[str],
    baseline: str,
    headers: DataFrame | None = None,
    time_column: str | None = None,
    round_files: int = ROUND_FILES,
    keep_samples: bool = True,
) -> Summary:
    """Ingest the files under ``root`` that are not in the store yet, round by round.

    A file that has changed since it was ingested is new.
    ``headers`` (``run_id, header``) replaces the reading of first lines, for
    stores that only Spark reaches.
    """
    with settled_scope(spark):
        listed = settle(list_logs(spark, root), "listed")
        known = claims(spark, store, listed)
        pending = settle(new_runs(listed, known, VERSION), "pending")
        found, new = listed.count(), pending.count()
        failed = 0
        for files in _rounds(pending, round_files):
            failed += ingest_files(
                spark, store, files, headers, patterns, baseline, time_column, keep_samples
            )
    return Summary(found, new, found - new, failed)


def compact_store(spark: SparkSession, store: str, files_below: int = SMALL_BATCH) -> int:
    """Rewrite all batches of fewer files as one batch; returns how many there were.

    Rows of outdated claims are left behind. The old batches stay on disk for readers
    that have opened them; ``remove_replaced`` deletes them.
    """
    with settled_scope(spark):
        small = settle(commits(spark, store).filter(F.col("files") < files_below), "small")
        count = small.count()
        if count < 2:
            return 0
        batch = uuid.uuid4().hex
        written = []
        try:
            for name, table in _visible(spark, store, small).items():
                written.append(f"{store}/{name}/batch={batch}")
                # Even files, whatever the sizes of runs.
                table.drop("batch").hint("rebalance").write.parquet(written[-1])
            claimed = claims(spark, store)
            kept = claimed.join(small.select("batch"), "batch", "left_semi").join(
                outdated(claimed), ["run_id", "batch"], "left_anti"
            )
            kept = settle(kept, "kept")
            written.append(f"{store}/claims/batch={batch}")
            _write_claims(store, batch, kept)
        except BaseException:
            for path in written:
                delete_folder(spark, path)
            raise
        files = kept.count()
        counts = [F.sum(c).alias(c) for c in TELEMETRY if c != "files"]
        record = small.agg(F.collect_list("batch").alias("replaces"), *counts)
        _commit(spark, store, batch, record.withColumn("files", F.lit(files)))
    return count


def remove_replaced(spark: SparkSession, store: str) -> int:
    """Delete the files of batches that a compaction replaced; returns how many."""
    known = _all_commits(spark, store)
    gone = known.select(F.explode("replaces").alias("batch")).distinct()
    held = known.select("batch").join(gone, "batch", "left_semi")
    removed = 0
    for row in held.toLocalIterator():
        for name in (*_TABLES, "claims"):
            delete_folder(spark, f"{store}/{name}/batch={row.batch}")
        removed += 1
    return removed
