"""Report files."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from counterloom.functions.lines import csv_cells
from counterloom.shared import settle


def write_report(report: DataFrame, path: str, form: str = "csv") -> bool:
    """Overwrite ``path`` with the wide report; an empty report is not written.

    Files are written by the tasks of the report's sort, so their names follow the
    order of rows; each has the header.
    """
    if report.isEmpty():
        return False
    writer = report.write.mode("overwrite")
    if form == "csv":
        writer.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    else:
        writer.format(form).save(path)
    return True


def _csv_line(cells: Column) -> Column:
    quoted = F.transform(
        cells, lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    )
    return F.array_join(quoted, ",", "")


def write_aligned_report(rows: DataFrame, labels: DataFrame, path: str) -> bool:
    """Overwrite ``path`` with the report of ``aligned_rows``; an empty one is not written.

    The labels go to a file of their own, ``path/columns``: one CSV line, as long as
    there are labels. The rows go to ``path/rows`` as CSV lines without header, the
    baseline first; file names follow the order of rows. The header and the rows,
    one after the other, are one CSV file. Nothing passes through the driver, and
    the number of columns is bounded by no plan.
    """
    rows = settle(rows, "report-rows")
    if rows.isEmpty():
        return False
    names = F.transform(F.array_sort(F.collect_list(F.struct("column", "label"))), lambda c: c.label)
    header = labels.agg(_csv_line(F.concat(F.array(F.lit("metric")), names)).alias("value"))
    header.write.mode("overwrite").text(f"{path}/columns")
    cells = F.concat(F.array("metric"), F.transform("values", lambda v: v.cast("string")))
    ordered = rows.orderBy(F.desc("is_baseline"), "metric")
    ordered.select(_csv_line(cells).alias("value")).write.mode("overwrite").text(f"{path}/rows")
    return True


def read_aligned_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``label, column`` and ``metric, column, value`` of a report written so."""
    # Labels hold line breaks, so the header is read as one text.
    header = spark.read.text(f"{path}/columns", wholetext=True)
    labels = header.select(F.posexplode(csv_cells(F.col("value"))).alias("column", "label"))
    rows = spark.read.text(f"{path}/rows").select(csv_cells(F.col("value")).alias("cells"))
    cells = rows.select(
        F.get("cells", F.lit(0)).alias("metric"), F.posexplode("cells").alias("column", "value")
    )
    value = F.nullif("value", F.lit("")).cast("double")
    return (
        labels.filter("column > 0").select("label", F.col("column").cast("long").alias("column")),
        cells.filter("column > 0").select(
            "metric", F.col("column").cast("long").alias("column"), value.alias("value")
        ),
    )
