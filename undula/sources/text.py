"""Recordings and window matrices from text files.

Files are read as splittable text. Line order inside a file comes from the block offset and the row
order inside a block, so one huge file is parsed by many tasks. A "file" may also be a directory of
part files (``D01_SA01_R01.txt/part-00000.txt`` or ``name=D01_SA01_R01.txt/part-00000.txt``), as
Spark writes it; parts count in name order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.functions.scalar import base_name
from undula.operators.sequence import Run, prefixes, sequence_number
from undula.session import ship_package, stage

# Sensor columns in a recording line, activity codes per class, class names.
ACC_COLUMNS = {"ADXL345": (0, 1, 2), "MMA8451Q": (6, 7, 8)}
GYRO_COLUMNS = (3, 4, 5)
DYNAMIC_CODES = ("D01", "D02", "D03", "D04", "D05", "D06", "D18", "D19")
STATIC_CODES = ("D07", "D08", "D09", "D10", "D11", "D12", "D13", "D14", "D15", "D16", "D17")
CLASS_NAMES = {0: "FALL", 1: "NORMAL_DYNAMIC", 2: "NORMAL_STATIC"}
FILE_PATTERN = r"(?i)^(D\d{2}|F\d{2})_(SA\d{2}|SE\d{2})_(R\d{2})\.txt$"
INTEGER = r"([-+]?\d+)"
ACTIVITY_NAMES = {
    0: "WALKING",
    1: "WALKING_UPSTAIRS",
    2: "WALKING_DOWNSTAIRS",
    3: "SITTING",
    4: "STANDING",
    5: "LAYING",
}
SIGNALS = ("body_gyro_x_", "body_gyro_y_", "body_gyro_z_", "total_acc_x_", "total_acc_y_", "total_acc_z_")
MARK = "@ "  # begins the line that names a recording in a bundle
CHANNELS = ("c0", "c1", "c2", "c3", "c4", "c5")


def logical_path(path: Column) -> Column:
    """Path of the file, or of the directory whose part file this is."""
    whole = F.regexp_replace(F.regexp_replace(path, r"(\.[A-Za-z]+)/part-[^/]*$", "$1"), r"/[^/=]+=([^/]*)$", "/$1")
    return F.when(path.contains("/part-"), whole).otherwise(path)


def text_lines(spark: SparkSession, path: str | Sequence[str], glob: str = "*.[tT][xX][tT]", tolerant: bool = False) -> DataFrame:
    """Lines with ``path``, ``block`` (part file and offset of the file block) and ``__id`` (order inside it).

    With ``tolerant``, a file that cannot be read on gives the lines before that place and the others go on.
    """
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("ignoreCorruptFiles", tolerant)
        .option("ignoreMissingFiles", tolerant)
        .option("pathGlobFilter", glob)
        .text(path)
        .select(
            logical_path(F.col("_metadata.file_path")).alias("path"),
            F.struct(F.col("_metadata.file_name").alias("piece"), F.col("_metadata.file_block_start").alias("at")).alias("block"),
            F.monotonically_increasing_id().alias("__id"),
            "value",
        )
    )


def write_bundle(lines: DataFrame, path: str, name: str = "name", order: Sequence[str] = ("idx",), files: int | None = None) -> None:
    """Many recordings in few files: rows (``name``, ``order``, value) as text below ``path``.

    Rows are cut by ranges of name and order, so recordings stay whole or go on in the next file. Wherever a recording
    begins or goes on in a file, a line ``@ name`` comes before its lines; values must not begin like that.
    """
    n = files or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = lines.repartitionByRange(n, name, *order).sortWithinPartitions(name, *order)
    ship_package(lines.sparkSession)
    cut.select(F.col(name).alias("name"), "value").mapInArrow(_marked, "value string").write.text(path)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The values of a file in order, with a mark wherever the name changes."""
    last = None
    for b in batches:
        names = b.column(0).to_pylist()
        new = [i for i, n in enumerate(names) if n != (names[i - 1] if i else last)]
        last = names[-1] if names else last
        marks = pa.array([MARK + names[i] for i in new], pa.string())
        place = np.insert(np.arange(len(names)), new, len(names) + np.arange(len(new)))
        yield pa.record_batch([pa.concat_arrays([b.column(1).cast(pa.string()), marks]).take(pa.array(place))], names=["value"])


def bundle_lines(spark: SparkSession, path: str | Sequence[str], glob: str = "*.[tT][xX][tT]", tolerant: bool = False) -> DataFrame:
    """Like ``text_lines`` for bundles: ``path`` is a recording's name below its bundle.

    A file is cut into blocks, and the name that a block goes on with comes from the last mark before it.
    """
    lines = text_lines(spark, path, glob, tolerant).withColumn("path", F.regexp_replace("path", "/part-[^/]*$", ""))
    named = F.when(F.col("value").startswith(MARK), F.substring("value", len(MARK) + 1, 4096))
    lines = stage(lines.withColumn("__mark", named), "bundle_lines")  # read twice: marks of blocks, then lines
    lines = prefixes(lines, ["path"], ["__id"], F.col("block"), {"__name": Run("last", F.col("__mark"))})
    lines = lines.filter("__mark IS NULL AND __name IS NOT NULL")
    return lines.select(F.concat_ws("/", "path", "__name").alias("path"), "block", "__id", "value")


def number_lines(lines: DataFrame, name: str = "idx") -> DataFrame:
    """Zero-based position of the remaining lines in their file."""
    return sequence_number(lines, ["path"], ["__id"], F.col("block"), name).drop("block", "__id")


def decode_name(df: DataFrame, path: Column) -> DataFrame:
    """Adds ``file``, ``code``, ``subject``, ``trial`` (upper case) and ``y`` (null when rejected).

    The pattern has fixed widths, so one match per row is enough and the parts are substrings.
    """
    out = df.withColumn("file", base_name(path)).withColumn("__ok", F.col("file").rlike(FILE_PATTERN))
    part = lambda at, size: F.when(F.col("__ok"), F.upper(F.substring("file", at, size)))
    out = out.withColumns({"code": part(1, 3), "subject": part(5, 4), "trial": part(10, 3)}).drop("__ok")
    code = F.col("code")
    y = F.when(code.startswith("F"), 0).when(code.isin(*DYNAMIC_CODES), 1).when(code.isin(*STATIC_CODES), 2)
    return out.withColumn("y", y)


def reject_reason(df: DataFrame, samples: Column, unread: Column | None = None) -> Column:
    """Why a listed file is not used: ignored, bad_name, unknown_code, unreadable (where ``unread`` holds), empty, or
    null when it is."""
    low = F.lower("file")
    return (
        F.when((low == "desktop.ini") | ~low.endswith(".txt"), "ignored")
        .when(F.col("code").isNull(), "bad_name")
        .when(F.col("y").isNull(), "unknown_code")
        .when(F.lit(False) if unread is None else unread, "unreadable")
        .when(F.coalesce(samples, F.lit(0)) == 0, "empty")
    )


def parse_samples(lines: DataFrame) -> DataFrame:
    """Lines with at least nine integers, as ``v`` = their first nine."""
    nums = F.regexp_extract_all("value", F.lit(INTEGER), 1)
    return lines.withColumn("__n", nums).filter(F.size("__n") >= 9).withColumn(
        "v", F.transform(F.slice("__n", 1, 9), lambda s: s.cast("int"))
    ).drop("__n", "value")


def pick_channels(df: DataFrame, v: str = "v", acc: str = "ADXL345") -> DataFrame:
    """Columns c0..c5: the chosen accelerometer triplet, then the gyroscope."""
    if acc not in ACC_COLUMNS:
        raise ValueError(f"acc must be one of {sorted(ACC_COLUMNS)}")
    cols = [*ACC_COLUMNS[acc], *GYRO_COLUMNS]
    return df.withColumns({c: F.col(v)[i] for c, i in zip(CHANNELS, cols)}).drop(v)


def read_recordings(spark: SparkSession, path: str, acc: str = "ADXL345", report: DataFrame | None = None, bundled: bool = False) -> DataFrame:
    """Samples of all valid recordings: path, file, code, subject, trial, y, idx, c0..c5.

    ``bundled``: the files are bundles (see ``write_bundle``), not one recording each.

    The parsed lines are written once: numbering reads them twice, and text is costly to parse. A file that
    cannot be read stops the job, unless the ``file_report`` of the folder is given: then unreadable files are left out.
    """
    lines = (bundle_lines if bundled else text_lines)(spark, path, tolerant=report is not None)
    lines = decode_name(lines, F.col("path")).filter("y IS NOT NULL")
    if report is not None:
        lines = lines.join(report.filter("reject = 'unreadable'").select("path"), "path", "left_anti")
    parsed = pick_channels(parse_samples(lines), "v", acc)
    return number_lines(stage(parsed, "parsed_lines"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """All files below ``path`` (only names and sizes are read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = files.select(logical_path(F.col("_metadata.file_path")).alias("path"), "length")
    return decode_name(named.groupBy("path").agg(F.sum("length").alias("length")), F.col("path"))


def file_report(spark: SparkSession, path: str) -> DataFrame:
    """Every file with its number of samples and its reject reason.

    A file is unreadable if reading it breaks off: then its lines, with two bytes for the end of each and three for a
    byte order mark, cannot make up its length. Bytes that are no UTF-8 do not make a file unreadable.
    """
    lines = text_lines(spark, path, tolerant=True)
    full = F.size(F.regexp_extract_all("value", F.lit(INTEGER), 1)) >= 9
    got = lines.groupBy("path").agg(F.count_if(full).alias("samples"), F.sum(F.octet_length("value") + 2).alias("__read"))
    joined = list_files(spark, path).join(got, "path", "left")
    unread = F.col("length") > F.coalesce("__read", F.lit(0)) + 3
    return joined.withColumn("reject", reject_reason(joined, F.coalesce("samples", F.lit(0)), unread)).drop("__read")


def reject_counts(report: DataFrame) -> DataFrame:
    """Files per reject reason; ignored files are not counted."""
    return report.filter("reject IS NOT NULL AND reject <> 'ignored'").groupBy("reject").agg(F.count(F.lit(1)).alias("n"))


def read_window_set(
    spark: SparkSession, root: str, split: str, signals: Sequence[str] = SIGNALS, length: int = 128, zero_based: bool = True
) -> DataFrame:
    """Fixed windows of one official split: win_id (line), split, y, domain, x (channel-major).

    All signal, label and subject lines meet in one aggregation on the line number. A line missing
    from any file, or of another length, stops the job.
    """
    root = root.rstrip("/")
    names = [*signals, "y_", "subject_"]
    paths = [f"{root}/{split}/Inertial Signals/{s}{split}.txt" for s in signals]
    paths += [f"{root}/{split}/{s}{split}.txt" for s in ("y_", "subject_")]
    lines = text_lines(spark, paths).filter(F.trim("value") != "")
    part = F.regexp_extract(base_name(F.col("path")), rf"^(.*){split}\.txt$", 1)
    rows = number_lines(lines.withColumn("part", part), "line").select(
        "line", "part", F.split(F.trim("value"), r"\s+").alias("v")
    )
    wide = rows.groupBy("line").agg(
        *[F.any_value(F.when(F.col("part") == n, F.col("v")), True).alias(n) for n in names]
    )
    good = F.lit(True)
    for n in names:
        good = good & F.coalesce(F.size(F.col(n)) == (length if n in signals else 1), F.lit(False))
    checked = wide.filter(
        F.when(good, True).otherwise(F.raise_error(F.lit(f"window files of split {split} do not line up")).cast("boolean"))
    )
    less = 1 if zero_based else 0
    return checked.select(
        F.col("line").alias("win_id"),
        F.lit(split).alias("split"),
        (F.col("y_")[0].cast("int") - less).alias("y"),
        (F.col("subject_")[0].cast("int") - less).alias("domain"),
        F.array(*[F.col(s).cast("array<float>") for s in signals]).alias("x"),
    )


def read_official(spark: SparkSession, root: str, **kw) -> DataFrame:
    """Both official splits with their name in ``split``; window ids stay unique."""
    both = read_window_set(spark, root, "train", **kw).unionByName(read_window_set(spark, root, "test", **kw))
    return both.withColumn("win_id", F.concat_ws(":", "split", "win_id"))


def drop_unit_axis(x: Column, length: int) -> Column:
    """(T, 1, C) or (1, T, C) nested arrays to (T, C)."""
    flat = F.when(F.size(x) == 1, x[0]).otherwise(F.transform(x, lambda r: r[0]))
    ok = F.size(flat) == length
    return F.when(ok, flat).otherwise(F.raise_error(F.lit("unexpected window shape")).cast("array<array<float>>"))


def add_unit_axis(x: Column) -> Column:
    """(T, C) to (T, 1, C)."""
    return F.transform(x, lambda r: F.array(r))
