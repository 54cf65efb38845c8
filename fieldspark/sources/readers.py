"""Text and CSV readers for series and curves, and a file listing.

Every reader takes a path or glob and keeps the file name, so one read covers
all cases. Values stay lazy; the ``require_*`` helpers run the checks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspark.functions import finite
from fieldspark.operators.series import relative_to_initial, require_valid
from fieldspark.plans.scale import attach, spooled

# The columns of an energy-budget series file and of a front file.
ENERGY_COLUMNS = ("time", "E_k", "E_p", "E_total", "epsilon")
FRONT_COLUMNS = ("time", "x_front")


def _case_of(path: Column, pattern: str) -> Column:
    return F.regexp_extract(path, pattern, 1)


def read_columns(
    spark: SparkSession, path: str, columns: Sequence[str], case_pattern: str = r"case_([^/]+)/"
) -> DataFrame:
    """Whitespace-separated numbers; ``#`` starts a comment, surplus columns are ignored.

    A row with too few or unreadable numbers fails the job.
    """
    lines = spark.read.text(path).select(
        _case_of(F.input_file_name(), case_pattern).alias("case"),
        F.trim(F.regexp_replace(F.regexp_replace("value", "#.*$", ""), r"\s+", " ")).alias("_line"),
    )
    parts = F.split("_line", " ")
    numbers = lines.filter(F.col("_line") != "").withColumn("_parts", parts)
    short = F.size("_parts") < len(columns)
    message = F.lit(f"A line has fewer than {len(columns)} columns.")

    def number(position: int) -> Column:
        text = F.get("_parts", F.lit(position))
        # Python's spellings of non-finite numbers differ from the cast's only in case.
        return F.when(short, F.raise_error(message)).otherwise(text.cast("double"))

    return numbers.select("case", *(number(i).alias(c) for i, c in enumerate(columns)))


def read_energy_series(spark: SparkSession, path: str, case_pattern: str = r"case_([^/]+)/") -> DataFrame:
    """Energy series by case; fewer than two samples, a value that is not finite or a repeated time is an error."""
    return _checked(read_columns(spark, path, ENERGY_COLUMNS, case_pattern), ENERGY_COLUMNS)


def read_front(spark: SparkSession, path: str, case_pattern: str = r"case_([^/]+)/") -> DataFrame:
    """Front positions by case, under the same rules as the energy series."""
    return _checked(read_columns(spark, path, FRONT_COLUMNS, case_pattern), FRONT_COLUMNS)


def _checked(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows are read and parsed once, then kept; an empty file has no case that could be named."""
    rows = spooled(rows)
    if rows.isEmpty():
        raise ValueError("No samples were read.")
    return require_valid(rows, ["case"], columns[0], columns[1:])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, _line_no, _line): the lines of text files with their physical numbers from 1, blank ones counted.

    Lines of a split are numbered where they are read; the line counts of the splits before give the offset. The
    written table fixes which rows a split held.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("_line")
    )
    lines = spooled(lines)
    splits = lines.groupBy("file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_offset", F.coalesce(F.sum("_lines").over(before), F.lit(0)))
    placed = attach(lines, offsets.select("file", "_start", "_first", "_offset"), ["file", "_start"])
    return placed.select("file", (F.col("_id") - F.col("_first") + F.col("_offset") + 1).alias("_line_no"), "_line")


def read_curve(spark: SparkSession, path: str, require_positive: bool = True) -> DataFrame:
    """A two-column CSV curve: comments, blank and short rows and a first header line are skipped.

    A later non-numeric row, fewer than two finite rows, a repeated time and (if
    asked) the lack of a positive row are errors, for each file. A file may be cut into several splits.
    """
    text = numbered_lines(spark, path)
    cells = text.select("file", "_line_no", "_line", F.split("_line", ",").alias("_c"))
    first = F.trim(F.get("_c", F.lit(0)))
    cells = cells.filter((first != "") & ~first.startswith("#") & (F.size("_c") >= 2))
    t = F.trim(F.col("_c")[0]).try_cast("double")
    x = F.trim(F.col("_c")[1]).try_cast("double")
    parsed = cells.select("file", "_line_no", "_line", t.alias("time"), x.alias("x"))
    unreadable = F.col("time").isNull() | F.col("x").isNull()
    bad = parsed.filter(unreadable & (F.col("_line_no") > 1)).limit(5).collect()
    if bad:
        raise ValueError("Non-numeric curve rows: " + "; ".join(f"line {r['_line_no']}: {r['_line']}" for r in bad))
    rows = parsed.filter(~unreadable & finite("time", "x")).select("file", "time", "x")
    rows = rows.withColumn("is_positive", (F.col("time") > 0.0) & (F.col("x") > 0.0))
    require_valid(rows, ["file"], "time", ["x"])
    # Counted over all parsed lines, so that a file whose rows are all non-finite is seen too.
    counts = parsed.groupBy("file").agg(
        F.count_if(~unreadable & finite("time", "x")).alias("rows"),
        F.count_if((F.col("time") > 0.0) & (F.col("x") > 0.0) & finite("time", "x")).alias("positive"),
    )
    if few := counts.filter("rows < 2").select("file").first():
        raise ValueError(f"A curve needs at least two finite rows: {few['file']}")
    if require_positive and (none := counts.filter("positive = 0").select("file").first()):
        raise ValueError(f"The curve has no positive row for log-log use: {none['file']}")
    return rows.select("file", "time", "x", "is_positive")


def read_processed(
    spark: SparkSession, path: str, case_pattern: str = r"([^/]+)_front_kinematics_timeseries"
) -> DataFrame:
    """Processed kinematics tables: position from its first value, and that value as the shift."""
    raw = spark.read.option("header", True).csv(path)
    missing = sorted({"time", "x_reconstructed"} - set(raw.columns))
    if missing:
        raise ValueError("Missing required column(s): " + ", ".join(missing))
    rows = raw.select(
        _case_of(F.input_file_name(), case_pattern).alias("case"),
        F.col("time").cast("double").alias("time"),
        F.col("x_reconstructed").cast("double").alias("x_reconstructed"),
    )
    require_valid(rows, ["case"], "time", ["x_reconstructed"])
    return relative_to_initial(rows, ["case"], "time", "x_reconstructed", "x_processed", "processed_x0_shift")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet point table, partitioned by comparison set and case when written here."""
    return spark.read.parquet(path)


def list_files(spark: SparkSession, path: str, pattern: str, names: Sequence[str] = ("case", "index")) -> DataFrame:
    """Paths under ``path`` with the pattern's groups as columns; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    )
    groups = {n: F.regexp_extract("path", pattern, i + 1) for i, n in enumerate(names)}
    found = files.filter(F.col("path").rlike(pattern)).withColumns(groups)
    return found.withColumn("index", F.col("index").cast("int")) if "index" in names else found
