"""Every operator as a query over the relational tables.

Each query takes (spark, folder) and reads its tables whole.
"""

import contextvars
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterloom.functions.lines import is_time_header
from counterloom.functions.numbers import exact_mean, round_half_even, to_number
from counterloom.functions.paths import file_name, path_metric, path_server
from counterloom.functions.times import clock_label, column_label, day_label, duration_label, parse_time
from counterloom.operators import report as reports
from counterloom.operators import reshape, runs, select, series, stats
from counterloom.plans.report import (
    bin_cuts,
    found_report,
    log_statistics,
    place_report,
    report_cells,
    run_statistics,
    store_statistics,
)
from counterloom.schema import AVG, TICK
from counterloom.shared import new_folder, settle
from counterloom.sources.counter_logs import counter_dictionary, layouts, list_logs, parse_lines
from counterloom.sources.extraction import extract_rounds
from counterloom.sources.sinks import read_aligned_report, write_aligned_report, write_report
from counterloom.sources.store import (
    VERSION,
    commits,
    compact_store,
    ingest_files,
    ingest_new,
    open_store,
)
from counterloom.sources.tables import (
    EVENT_COUNTERS,
    LINE_COUNTERS,
    day_of,
    event_samples,
    hundredths,
    line_samples,
    read_table,
    sample_counters,
)
from counterloom.streaming.ingest import stream_logs

BASELINE = "Request Execution Time"
BASELINE_METRIC = "App(click)\\Request Execution Time"
PATTERNS = ["Request", "Bytes Total/sec", "App(view)", "Queue Length", "No Such Counter"]
KEY = ["run_id", "pos", "counter_path"]


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    return event_samples(read_table(spark, folder, "events"))


def _counters(spark: SparkSession, folder: str) -> DataFrame:
    return sample_counters(_samples(spark, folder))


# Selection


def select_by_substring(spark, folder):
    return select.select_by_substring(_counters(spark, folder), "Bytes Total/sec")


def match_patterns(spark, folder):
    return select.match_patterns(_counters(spark, folder), PATTERNS)


def match_counts(spark, folder):
    return select.match_counts(_counters(spark, folder), PATTERNS)


def dedupe_counters(spark, folder):
    return select.dedupe_counters(_counters(spark, folder), PATTERNS)


def baseline_first_match(spark, folder):
    return select.baseline_counters(_counters(spark, folder), BASELINE)


def extract_counters(spark, folder):
    return select.extract_counters(_samples(spark, folder), PATTERNS)


def _quoted(cell):
    return F.concat(F.lit('"'), cell, F.lit('"'))


def _day_headers(spark, folder) -> DataFrame:
    """Header line of each day: the time column differs by weekday."""
    weekday = F.dayofweek(F.col("run_id").cast("date"))
    first = (
        F.when(weekday == 1, "Sample")
        .when(weekday == 7, "(PDH-CSV 4.0) (Zulu)(0)")
        .otherwise("(PDH-CSV 4.0) (GMT Standard Time)(0)")
    )
    last = F.when(weekday == 1, "(PDH-CSV 4.0) (Pacific Daylight Time)(420)").otherwise("Note")
    names = F.transform(F.array_sort(F.collect_list(F.struct("pos", "counter_path"))), lambda c: c.counter_path)
    return (
        _counters(spark, folder)
        .groupBy("run_id")
        .agg(names.alias("names"))
        .select(
            "run_id",
            F.lit(0).cast("long").alias("size_bytes"),
            F.array_join(
                F.transform(F.concat(F.array(first), "names", F.array(last)), _quoted), ","
            ).alias("header"),
        )
    )


def detect_time_column(spark, folder):
    found = layouts(_day_headers(spark, folder), PATTERNS)
    return found.select(
        "run_id",
        "columns",
        "time_pos",
        "time_column",
        is_time_header(F.col("time_column")).alias("marked"),
        F.size("wanted").alias("wanted"),
    )


# Scalars


def coerce_numeric(spark, folder):
    """Words of all documents read as numbers."""
    words = read_table(spark, folder, "documents").select(
        "doc_id", F.explode(F.split("text", "[ \t\r\n]+")).alias("word")
    )
    number = to_number(F.col("word"))
    return (
        words.select("doc_id", number.alias("number"))
        .groupBy("doc_id")
        .agg(
            F.count("*").alias("words"),
            F.count("number").alias("numbers"),
            F.min("number").alias("smallest"),
            F.max("number").alias("largest"),
        )
    )


def parse_timestamps(spark, folder):
    """Time text in the layout of counter logs, ISO text and other text."""
    ts = F.col("ts").cast("string")
    day = F.concat(F.substring(ts, 6, 2), F.lit("/"), F.substring(ts, 9, 2), F.lit("/"), F.substring(ts, 1, 4))
    text = (
        F.when(F.col("event_type") == "error", F.col("props"))
        .when(F.col("event_type") == "view", ts)
        .otherwise(F.concat(day, F.lit(" "), F.substring(ts, 12, 12)))
    )
    return read_table(spark, folder, "events").select("event_id", parse_time(text).alias("parsed"))


def _paths(spark, folder) -> DataFrame:
    """Counter paths of every event, some without server or with more parts."""
    path = F.col("counter_path")
    kind = F.col("pos") % 5
    return _samples(spark, folder).select(
        F.when(kind == 0, path_metric(path))
        .when(kind == 1, F.concat(path, F.lit("\\"), F.col("run_id")))
        .when(kind == 2, F.col("run_id"))
        .otherwise(path)
        .alias("path")
    ).groupBy("path").agg(F.count("*").alias("n"))


def path_server_query(spark, folder):
    return _paths(spark, folder).withColumn("server", path_server(F.col("path")))


def path_metric_query(spark, folder):
    return _paths(spark, folder).withColumn("metric", path_metric(F.col("path")))


def run_name(spark, folder):
    """File names of log paths with either kind of slash."""
    server = (F.col("user_id") % 3).cast("string")
    name = F.concat(day_of(F.col("ts")), F.lit("_"), F.col("event_type"), F.lit(".csv"))
    path = F.when(
        F.col("user_id") % 2 == 0, F.concat(F.lit("file:/logs/SRV"), server, F.lit("/"), name)
    ).otherwise(F.concat(F.lit("C:\\logs\\SRV"), server, F.lit("\\"), name))
    paths = read_table(spark, folder, "events").select(path.alias("path")).groupBy("path")
    return paths.agg(F.count("*").alias("n")).withColumn("name", file_name(F.col("path")))


def report_label(spark, folder):
    """Labels for the span of each event type and day."""
    spans = (
        read_table(spark, folder, "events")
        .groupBy(day_of(F.col("ts")).alias("run_id"), "event_type")
        .agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    )
    start, end = F.col("start_ts"), F.col("end_ts")
    return spans.select(
        "run_id",
        "event_type",
        day_label(end).alias("day"),
        clock_label(start).alias("clock"),
        duration_label(start, end).alias("duration"),
        column_label(end, F.col("event_type"), F.lit(AVG), start, end).alias("label"),
    )


def round_report_query(spark, folder):
    """Prices in halves and signed tenths, rounded half to even."""
    price = F.round(F.col("l_extendedprice") * 2) / 2
    return (
        read_table(spark, folder, "lineitem")
        .select(price.alias("price"), (F.col("l_quantity") / 2 - 10).alias("signed"))
        .groupBy("price", "signed")
        .agg(F.count("*").alias("n"))
        .withColumn("rounded_price", round_half_even(F.col("price")))
        .withColumn("rounded_signed", round_half_even(F.col("signed")))
    )


# Reshaping


def unpivot_wide(spark, folder):
    wide = line_samples(read_table(spark, folder, "lineitem"))
    return reshape.unpivot_wide(
        wide, ["run_id", "ts", "l_orderkey", "l_linenumber"], list(LINE_COUNTERS)
    )


def union_runs(spark, folder):
    orders = read_table(spark, folder, "orders").select(
        F.lit("orders").alias("run_id"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("orderkey"),
        F.col("o_totalprice").alias("Total Price"),
    )
    lines = read_table(spark, folder, "lineitem").select(
        F.lit("lineitem").alias("run_id"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_quantity").alias("Quantity"),
        F.col("l_tax").alias("Tax"),
    )
    return reshape.union_runs(orders, lines)


def _line_readings(spark, folder) -> DataFrame:
    """Discount and tax per order line; a missing discount is null, tax has zeros."""
    return read_table(spark, folder, "lineitem").select(
        F.concat("l_returnflag", F.lit("-"), "l_linestatus", F.lit("-"), "l_linenumber").alias("run_id"),
        F.col("l_shipdate").alias("ts"),
        "l_orderkey",
        "l_linenumber",
        F.nullif(hundredths(F.col("l_discount")), F.lit(0.0)).alias("discount"),
        hundredths(F.col("l_tax")).alias("tax"),
    )


def drop_all_null_rows(spark, folder):
    rows = _line_readings(spark, folder).withColumn("tax", F.nullif("tax", F.lit(0.0)))
    return stats.drop_all_null_rows(rows, ["discount", "tax"])


# Series and cuts


def resample_mean_5m(spark, folder):
    return series.resample_mean(_samples(spark, folder), KEY)


def nonzero_bins(spark, folder):
    taxes = _line_readings(spark, folder).withColumnRenamed("tax", "value")
    return series.nonzero(series.resample_mean(taxes, ["run_id"]), "v")


def nonzero_min(spark, folder):
    taxes = _line_readings(spark, folder).withColumnRenamed("tax", "value")
    return series.nonzero_min(taxes, ["run_id", "ts"])


def run_bounds(spark, folder):
    return stats.run_bounds(_samples(spark, folder))


def _day_bins(spark, folder) -> DataFrame:
    return stats.bin_samples(_samples(spark, folder))


def pct_change(spark, folder):
    bins = _day_bins(spark, folder)
    first = select.baseline_counters(stats.binned_counters(bins), BASELINE)
    return series.pct_change(stats.baseline_bins(bins, first))


def _day_cuts(spark, folder) -> DataFrame:
    """All branches of this plan read bins; Spark makes that exchange once."""
    bins = _day_bins(spark, folder)
    return bin_cuts(bins, stats.binned_counters(bins), BASELINE)


def find_cut(spark, folder):
    return _day_cuts(spark, folder).drop("end_ts")


def find_cut_gaps_and_zeros(spark, folder):
    """Cuts of tax series: zero bins, gaps, and a wide bin."""
    taxes = _line_readings(spark, folder).withColumnRenamed("tax", "value")
    bins = series.resample_mean(taxes, ["run_id"], 24 * 60)
    return series.find_cut(bins, stats.run_bounds(taxes), 24 * 60).drop("end_ts")


def _ok_cuts(spark, folder) -> DataFrame:
    """Settled, so that samples meet them without a shuffle while they are small."""
    return settle(_day_cuts(spark, folder).filter(F.col("status") == "ok"), "cuts")


def filter_to_cut(spark, folder):
    return stats.keep_rows(_samples(spark, folder), _ok_cuts(spark, folder), stats.HEAD)


def filter_after_cut(spark, folder):
    return stats.keep_rows(_samples(spark, folder), _ok_cuts(spark, folder), stats.TAIL)


# Statistics


def counter_stats(spark, folder):
    return stats.counter_stats(_samples(spark, folder), KEY)


def _uneven_samples(spark, folder) -> DataFrame:
    """Readings that are no round numbers: their sums depend on the order of additions."""
    value = F.col("value") / 7 - F.sqrt("value")
    return event_samples(read_table(spark, folder, "events"), value=value)


def exact_means(spark, folder):
    """Means of uneven values by counter and by run, straight and merged from bins."""
    samples = _uneven_samples(spark, folder)
    by_counter = stats.counter_stats(samples, KEY).select("run_id", "pos", "avg", "max")
    by_run = stats.counter_stats(samples, ["run_id"]).select(
        "run_id", F.lit(None).cast("int").alias("pos"), "avg", "max"
    )
    bins = stats.bin_samples(samples)
    merged = stats.baseline_bins(bins, _counters(spark, folder)).groupBy("run_id").agg(
        F.lit(-1).alias("pos"), exact_mean(F.col("v")).alias("avg"), F.max("v").alias("max")
    )
    return by_counter.unionByName(by_run).unionByName(merged)


def counter_stats_nonnull(spark, folder):
    discounts = _line_readings(spark, folder).withColumnRenamed("discount", "value")
    return stats.counter_stats(discounts, ["run_id", "ts"])


def pooled_stats(spark, folder):
    return stats.pooled_stats(_samples(spark, folder), PATTERNS)


def mbps_rows(spark, folder):
    found = stats.counter_stats(_samples(spark, folder), KEY)
    return stats.add_mbps_rows(select.describe_counters(found))


def _statistics(spark, folder, keep=stats.HEAD) -> DataFrame:
    samples = select.tick_others(_samples(spark, folder), [*PATTERNS, BASELINE])
    return run_statistics(samples, baseline=BASELINE, keep=keep)


def pattern_statistics(spark, folder):
    """Byte rates of each day, labelled with the span of their samples."""
    start, end = F.col("start_ts"), F.col("end_ts")
    return reports.pattern_statistics(_samples(spark, folder), "Bytes Total/sec", end, start, end)


def run_counts(spark, folder):
    return stats.run_counts(_statistics(spark, folder))


# Reports


def first_by_label(spark, folder):
    return reports.first_by_label(_statistics(spark, folder))


def report_long(spark, folder):
    return report_cells(_statistics(spark, folder))


# The events span the first thirty days of a January, on three servers.
REPORT_COLUMNS = [
    f"{day:02d}-Jan SRV{server} {stat}"
    for day in range(1, 31)
    for server in range(3)
    for stat in ("Avg", "Max")
]


def report(spark, folder):
    """Metrics by day, server and statistic, the baseline row marked and on top."""
    return place_report(_statistics(spark, folder), REPORT_COLUMNS, BASELINE_METRIC)


def report_places(spark, folder):
    """In which order the metrics stand in the report."""
    return reports.row_places(report_cells(_statistics(spark, folder)), BASELINE_METRIC)


def report_roundtrip(spark, folder):
    """The same report, written as CSV and read back."""
    path = new_folder(spark, "report")
    write_report(report(spark, folder), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(
        "metric",
        *[F.col(f"`{c}`").cast("double").alias(c) for c in REPORT_COLUMNS],
        F.col("is_baseline").cast("boolean").alias("is_baseline"),
    )


def report_found_columns(spark, folder):
    """The report with all labels that the data has, written and read back cell by cell."""
    path = new_folder(spark, "report")
    rows, labels = found_report(_statistics(spark, folder), BASELINE_METRIC)
    write_aligned_report(rows, labels, path)
    labels, cells = read_aligned_report(spark, path)
    return cells.join(labels, "column").select("metric", "column", "label", "value")


def report_unlisted_cells(spark, folder):
    """What a report of the first ten days leaves out, by label."""
    placed = _statistics(spark, folder).withColumn("label", reports.label_place(F.col("label")))
    return reports.unlisted_cells(report_cells(placed), REPORT_COLUMNS[:60])


def report_empty_not_written(spark, folder):
    """Reports of all days and of none: whether they were written."""
    found = []
    for name, days in (("all", "value is not null"), ("none", "value is null and value is not null")):
        statistics = _statistics(spark, folder).filter(days)
        plain = place_report(statistics, REPORT_COLUMNS, BASELINE_METRIC)
        written = write_report(plain, new_folder(spark, "report"))
        aligned = write_aligned_report(
            *found_report(statistics, BASELINE_METRIC), new_folder(spark, "report")
        )
        found.append((name, plain.count(), written, aligned))
    return spark.createDataFrame(found, "report string, rows long, written boolean, aligned boolean")


def first_of_head_and_tail(spark, folder):
    """Two runs a day, before and after its cut, under one label; the first one counts."""
    samples = select.tick_others(_samples(spark, folder), [*PATTERNS, BASELINE])
    head = run_statistics(samples, baseline=BASELINE, keep=stats.HEAD)
    tail = run_statistics(samples, baseline=BASELINE, keep=stats.TAIL)
    tail = tail.withColumn("run_id", F.concat("run_id", F.lit("/tail")))
    placed = head.unionByName(tail).withColumn("label", reports.label_place(F.col("label")))
    return reports.first_by_label(placed)


def report_tail(spark, folder):
    return report_cells(_statistics(spark, folder, stats.TAIL))


def report_filter_sort(spark, folder):
    """Rows of one server, largest first."""
    cells = report_cells(_statistics(spark, folder))
    return cells.filter(F.contains("label", F.lit("SRV1\n"))).orderBy(F.desc("value"), "metric", "label")


# Runs


def _user_days(spark, folder) -> DataFrame:
    """One run per user and day, values in whole tens so that small ones are zero."""
    tens = F.floor(F.col("value") / 10).cast("double")
    samples = event_samples(read_table(spark, folder, "events"), "user_id", value=tens)
    user_day = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("run_id"))
    return samples.withColumn("run_id", user_day).drop("user_id")


def _listed_runs(spark, folder) -> DataFrame:
    """Runs known by name: user days and order days; the latter have no samples."""
    users = _user_days(spark, folder).select("run_id", F.lit("Time").alias("time_column"))
    orders = read_table(spark, folder, "orders").select(
        F.concat(F.col("o_custkey").cast("string"), F.lit("/"), day_of(F.col("o_orderdate"))).alias("run_id"),
        F.when(F.col("o_orderstatus") != "P", F.lit("Time")).alias("time_column"),
    )
    return reshape.union_runs(users, orders).groupBy("run_id").agg(
        F.max("time_column").alias("time_column")
    )


def _run_status(spark, folder) -> DataFrame:
    bins = stats.bin_samples(_user_days(spark, folder))
    bins = settle(bins, "bins")
    counters = stats.binned_counters(bins)
    rows = bins.groupBy("run_id").agg(F.sum("rows").alias("rows"))
    listed = _listed_runs(spark, folder).join(rows, "run_id", "left")
    baselines = select.baseline_counters(counters, BASELINE)
    return runs.run_status(listed, baselines, bin_cuts(bins, counters, BASELINE))


def run_status(spark, folder):
    return _run_status(spark, folder)


def ingest_report(spark, folder):
    return runs.ingest_report(_run_status(spark, folder))


def new_files_antijoin(spark, folder):
    """Listed runs without those ingested before 16 January."""
    found = _listed_runs(spark, folder)
    manifest = _user_days(spark, folder).filter(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    return runs.new_runs(found, manifest.select("run_id").distinct())


# Logs


def _month_first(ts):
    """``MM/dd/yyyy HH:mm:ss.SSS``, cut from the text so that no time zone shifts it."""
    text = F.rpad(F.concat(ts.cast("string"), F.when(F.length(ts.cast("string")) == 19, ".").otherwise("")), 23, "0")
    slash = F.lit("/")
    day = F.concat(F.substring(text, 6, 2), slash, F.substring(text, 9, 2), slash, F.substring(text, 1, 4))
    return F.concat(day, F.lit(" "), F.substring(text, 12, 12))


def _spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores: a few row groups become text many times their size."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def _wide_lines(spark, folder) -> DataFrame:
    """Order lines as data lines of a log per ship year, all cells quoted."""
    wide = line_samples(_spread(read_table(spark, folder, "lineitem")))
    cells = [_month_first(F.col("ts"))] + [
        F.coalesce(F.nullif(F.col(name), F.lit(0.0)).cast("string"), F.lit(" ")) for name in LINE_COUNTERS
    ]
    line = F.concat(F.lit('"'), F.concat_ws('","', *cells), F.lit('"'))
    return wide.select("run_id", line.alias("line"))


def scan_counter_lines(spark, folder):
    """Text lines to samples by the header of their run, then statistics."""
    lines = _wide_lines(spark, folder)
    names = ["(PDH-CSV 4.0) (GMT Standard Time)(0)"]
    header = F.lit(",".join(f'"{n}"' for n in names))
    columns = [
        F.concat(F.lit(',"\\\\SRV'), F.col("run_id"), F.lit(f'\\Lines\\{name}"')) for name in LINE_COUNTERS
    ]
    headers = lines.select("run_id").distinct().select(
        "run_id",
        F.lit(0).cast("long").alias("size_bytes"),
        F.concat(header, *columns).alias("header"),
    )
    layout = settle(layouts(headers, ["\\Quantity", "\\Extended Price", "\\Discount"]), "layouts")
    samples = parse_lines(lines, layout)
    found = samples.groupBy("run_id", "pos").agg(
        F.count("ts").alias("rows"),
        F.count("value").alias("readings"),
        F.sum("value").alias("total"),
        F.max("value").alias("top"),
        F.min("ts").alias("start_ts"),
    )
    return found.join(counter_dictionary(layout), ["run_id", "pos"], "left")


def _write_logs(lineitem: DataFrame, path: str) -> None:
    """Order lines as CSV files with their own headers, one per task."""
    wide = _spread(lineitem).select(
        _month_first(F.col("l_shipdate")).alias("(PDH-CSV 4.0) (GMT Standard Time)(0)"),
        *[
            F.coalesce(F.nullif(hundredths(F.col(c)), F.lit(0.0)).cast("string"), F.lit(" ")).alias(
                f"\\\\SRV1\\Lines(a, b)\\{name}"
            )
            for name, c in LINE_COUNTERS.items()
        ],
    )
    wide.write.option("header", True).option("quoteAll", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)


def _per_counter(samples: DataFrame, counters: DataFrame) -> DataFrame:
    """Readings of all files per counter; files are summed up before names are added."""
    per_run = (
        samples.filter(F.col("pos") != TICK)
        .groupBy("run_id", "pos")
        .agg(
            F.count("*").alias("n"),
            F.sum("value").alias("total"),
            F.max("value").alias("top"),
            F.min("ts").alias("first_ts"),
        )
    )
    return (
        per_run.join(counters, ["run_id", "pos"])
        .groupBy("server", "metric")
        .agg(
            F.sum("n").alias("readings"),
            F.sum("total").alias("total"),
            F.max("top").alias("top"),
            F.min("first_ts").alias("start_ts"),
        )
    )


LINE_PATTERNS = ["\\Quantity", "\\Extended Price", "\\Discount"]


def read_counter_files(spark, folder):
    """Logs written by Spark, read back by their own headers."""
    path = new_folder(spark, "logs")
    _write_logs(read_table(spark, folder, "lineitem"), path)
    found = extract_rounds(spark, path, LINE_PATTERNS)
    return _per_counter(found.samples, found.counters)


def _two_deliveries(spark, folder, path, take) -> None:
    """Write the logs in two parts and call ``take`` after each, and once more."""
    lineitem = read_table(spark, folder, "lineitem")
    returned = F.col("l_returnflag") == "R"
    _write_logs(lineitem.filter(returned), f"{path}/first")
    take()
    _write_logs(lineitem.filter(~returned), f"{path}/second")
    take()
    take()


def incremental_ingest(spark, folder):
    """Logs that arrive in two deliveries, ingested by manifest."""
    path, store = new_folder(spark, "logs"), new_folder(spark, "store")
    _two_deliveries(
        spark, folder, path, lambda: ingest_new(spark, path, store, LINE_PATTERNS, "\\Quantity")
    )
    tables = open_store(spark, store)
    return _per_counter(tables.samples, tables.counters)


def streaming_ingest(spark, folder):
    """Logs that arrive in two deliveries, ingested as a stream of new files."""
    path, store = new_folder(spark, "logs"), new_folder(spark, "store")
    checkpoint = new_folder(spark, "stream")

    def take():
        stream_logs(spark, path, store, checkpoint, LINE_PATTERNS, "\\Quantity").awaitTermination()

    _two_deliveries(spark, folder, path, take)
    tables = open_store(spark, store)
    return _per_counter(tables.samples, tables.counters)


def _write_day_logs(events: DataFrame, path: str) -> None:
    """One wide log per day; fillers put the counters at other positions every day.

    Every event is a line with one cell filled. A day is one file, so it is written
    by one task.
    """
    samples = event_samples(events)
    day = F.substring("run_id", 9, 2).cast("int")
    wide = len(EVENT_COUNTERS) * 3
    filler = F.transform(
        F.sequence(F.lit(1), day % 7 + 1), lambda i: F.concat(F.lit("\\\\SRV0\\Filler\\"), i.cast("string"))
    )
    names = F.transform(
        F.sequence(F.lit(1), F.lit(wide)),
        lambda i: F.coalesce(F.try_element_at("names", i), F.concat(F.lit("None"), i.cast("string"))),
    )
    pairs = F.collect_set(F.struct("pos", "counter_path"))
    headers = (
        samples.groupBy("run_id")
        .agg(F.map_from_entries(pairs).alias("names"))
        .select(
            "run_id",
            F.lit(0).alias("place"),
            F.array_join(
                F.transform(
                    F.concat(F.array(F.lit("Time")), filler, names),
                    _quoted,
                ),
                ",",
            ).alias("line"),
        )
    )
    blank = F.lit('" "')
    cells = F.concat(
        F.array(_quoted(F.col("ts").cast("string"))),
        F.transform(filler, lambda i: F.lit('"7"')),
        F.transform(
            F.sequence(F.lit(1), F.lit(wide)),
            lambda i: F.when(i == F.col("pos"), _quoted(F.coalesce(F.col("value").cast("string"), F.lit(" ")))).otherwise(blank),
        ),
    )
    lines = samples.select("run_id", F.lit(1).alias("place"), F.array_join(cells, ",").alias("line"))
    whole = headers.unionByName(lines).repartition("run_id").sortWithinPartitions("run_id", "place")
    # Lines as they are: the writer must not quote them again.
    whole.select("line", "run_id").write.partitionBy("run_id").option("quote", "\u0000").option(
        "sep", "\u0001"
    ).option("escape", "\u0000").option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)


EVENT_PATTERNS = PATTERNS


def report_from_logs(spark, folder):
    """The report of one log per day, straight from the files."""
    path = new_folder(spark, "day-logs")
    _write_day_logs(read_table(spark, folder, "events"), path)
    return report_cells(log_statistics(spark, path, EVENT_PATTERNS, BASELINE))


def _store_of_days(spark, folder) -> str:
    path, store = new_folder(spark, "day-logs"), new_folder(spark, "store")
    _write_day_logs(read_table(spark, folder, "events"), path)
    ingest_new(spark, path, store, EVENT_PATTERNS, BASELINE, round_files=7)
    return store


def report_from_store(spark, folder):
    """The report of one log per day, ingested in rounds."""
    return report_cells(store_statistics(spark, _store_of_days(spark, folder), BASELINE))


def mixed_ingest(spark, folder):
    """Days that arrive one after the other, by batch and by two streams, in one store."""
    events = read_table(spark, folder, "events")
    path, store = new_folder(spark, "day-logs"), new_folder(spark, "store")
    day = F.substring(day_of(F.col("ts")), 9, 2).cast("int")

    def stream():
        # A new checkpoint each time, as after its loss: all files are seen again.
        checkpoint = new_folder(spark, "stream")
        stream_logs(spark, path, store, checkpoint, EVENT_PATTERNS, BASELINE).awaitTermination()

    def batch():
        ingest_new(spark, path, store, EVENT_PATTERNS, BASELINE)

    for number, take in enumerate((batch, stream, stream)):
        _write_day_logs(events.filter(day % 3 == number), f"{path}/{number}")
        take()
    return report_cells(store_statistics(spark, store, BASELINE))


def ingest_summary(spark, folder):
    """What three calls found, took, skipped and failed on, as days arrive."""
    events = read_table(spark, folder, "events")
    path, store = new_folder(spark, "day-logs"), new_folder(spark, "store")
    first = F.substring(day_of(F.col("ts")), 9, 2).cast("int") <= 10
    rows = []
    for number, part in enumerate((events.filter(first), events.filter(~first), None), 1):
        if part is not None:
            _write_day_logs(part, f"{path}/{number}")
        summary = ingest_new(spark, path, store, EVENT_PATTERNS, BASELINE)
        rows.append((number, *summary))
    columns = "call int, found long, new long, skipped long, failed long"
    return spark.createDataFrame(rows, columns)


def ingest_telemetry(spark, folder):
    """What all batches of a store have read, as their scans counted it."""
    found = commits(spark, _store_of_days(spark, folder))
    return found.agg(
        F.count("*").alias("batches"),
        *[F.sum(c).alias(c) for c in ("files", "rows", "bad_rows", "readings")],
        (F.min("bytes") > 0).alias("bytes_known"),
    )


def concurrent_ingest(spark, folder):
    """Two writers that have both seen the same new files take all of them at once."""
    path, store = new_folder(spark, "day-logs"), new_folder(spark, "store")
    _write_day_logs(read_table(spark, folder, "events"), path)
    # One file a day; both writers hold the list before either has committed.
    files = [tuple(row) for row in list_logs(spark, path).select(*VERSION).collect()]

    def take():
        return ingest_files(spark, store, files, None, EVENT_PATTERNS, BASELINE)

    with ThreadPoolExecutor(2) as writers:
        for writer in [writers.submit(contextvars.copy_context().run, take) for _ in range(2)]:
            writer.result()
    return report_cells(store_statistics(spark, store, BASELINE))


def _replace_files(spark, source, target) -> None:
    """Give every file of ``target`` the content of the one file in the same folder of ``source``."""
    names = {row.run_id.rsplit("/", 2)[1]: row.run_id for row in list_logs(spark, source).collect()}
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    for row in list_logs(spark, target).collect():
        old, new = to_path(row.run_id), to_path(names[row.run_id.rsplit("/", 2)[1]])
        system = old.getFileSystem(spark._jsc.hadoopConfiguration())
        system.delete(old, False)
        system.rename(new, old)


def grown_logs(spark, folder):
    """Logs of the mornings are ingested, grow to whole days, and are ingested again."""
    events = read_table(spark, folder, "events")
    path, store = new_folder(spark, "day-logs"), new_folder(spark, "store")
    staged = new_folder(spark, "grown")
    _write_day_logs(events.filter(F.hour("ts") < 12), path)
    ingest_new(spark, path, store, EVENT_PATTERNS, BASELINE)
    _write_day_logs(events, staged)
    _replace_files(spark, staged, path)
    ingest_new(spark, path, store, EVENT_PATTERNS, BASELINE)
    return report_cells(store_statistics(spark, store, BASELINE))


def compacted_store(spark, folder):
    """The report of a store of several batches, before and after they became one."""
    store = _store_of_days(spark, folder)
    before = settle(report_cells(store_statistics(spark, store, BASELINE)), "cells")
    compact_store(spark, store)
    after = report_cells(store_statistics(spark, store, BASELINE))
    return before.withColumn("store", F.lit("before")).unionByName(
        after.withColumn("store", F.lit("after"))
    )


QUERIES = {
    "select_by_substring": select_by_substring,
    "match_patterns": match_patterns,
    "match_counts": match_counts,
    "dedupe_counters": dedupe_counters,
    "baseline_first_match": baseline_first_match,
    "extract_counters": extract_counters,
    "detect_time_column": detect_time_column,
    "coerce_numeric": coerce_numeric,
    "parse_timestamps": parse_timestamps,
    "path_server": path_server_query,
    "path_metric": path_metric_query,
    "run_name": run_name,
    "report_label": report_label,
    "round_report": round_report_query,
    "unpivot_wide": unpivot_wide,
    "union_runs": union_runs,
    "drop_all_null_rows": drop_all_null_rows,
    "resample_mean_5m": resample_mean_5m,
    "nonzero_bins": nonzero_bins,
    "nonzero_min": nonzero_min,
    "run_bounds": run_bounds,
    "pct_change": pct_change,
    "find_cut": find_cut,
    "find_cut_gaps_and_zeros": find_cut_gaps_and_zeros,
    "filter_to_cut": filter_to_cut,
    "filter_after_cut": filter_after_cut,
    "counter_stats": counter_stats,
    "exact_means": exact_means,
    "counter_stats_nonnull": counter_stats_nonnull,
    "pooled_stats": pooled_stats,
    "mbps_rows": mbps_rows,
    "pattern_statistics": pattern_statistics,
    "run_counts": run_counts,
    "first_by_label": first_by_label,
    "report_long": report_long,
    "report": report,
    "report_places": report_places,
    "report_roundtrip": report_roundtrip,
    "report_found_columns": report_found_columns,
    "report_unlisted_cells": report_unlisted_cells,
    "report_empty_not_written": report_empty_not_written,
    "report_from_logs": report_from_logs,
    "report_from_store": report_from_store,
    "first_of_head_and_tail": first_of_head_and_tail,
    "report_tail": report_tail,
    "report_filter_sort": report_filter_sort,
    "run_status": run_status,
    "ingest_report": ingest_report,
    "new_files_antijoin": new_files_antijoin,
    "scan_counter_lines": scan_counter_lines,
    "read_counter_files": read_counter_files,
    "incremental_ingest": incremental_ingest,
    "streaming_ingest": streaming_ingest,
    "mixed_ingest": mixed_ingest,
    "ingest_summary": ingest_summary,
    "ingest_telemetry": ingest_telemetry,
    "concurrent_ingest": concurrent_ingest,
    "grown_logs": grown_logs,
    "compacted_store": compacted_store,
}
