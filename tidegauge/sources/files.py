"""Series from CSV, tab-separated and ZIP files, and files merged and sampled.

Columns are given by position and read as text, so nothing is inferred. Rows get their position from their
place in their split of a file, and from the rows in the splits before it: a row a split is summed up in one
task, but no file is, nor all of them.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What counts as a number's text, and texts dropped when sampling.
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"
INFINITE = r"(?i)^[+-]?inf(inity)?$"
NAN_TEXTS = ["NaN", "nan", "NAN"]
COUNTRIES = [("USA", "USA"), ("United Kingdom", "UK"), ("Germany", "Germany")]


def parsed(text: Column) -> Column:
    """The double that the text is, or null: no blanks around it, and no finite text out of range."""
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(value.isNotNull() & (F.abs(value) == float("inf")) & ~text.rlike(INFINITE), F.lit(None)).otherwise(value)


def file_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


#: What tells splits of files apart, and a record's number that grows along a split.
SPLIT = ["path", "block"]


def _split_columns() -> list[Column]:
    return [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, block, at, line of text files."""
    return spark.read.text(paths).select(*_split_columns(), F.col("value").alias("line"))


def _records(spark: SparkSession, paths: str | list[str], columns: int, quoted_breaks: bool) -> DataFrame:
    """path, block, at, _c0, _c1, ... of CSV files, all of them text."""
    reader = spark.read.schema(", ".join(f"_c{k} string" for k in range(columns))).option("escape", '"').option("multiLine", quoted_breaks)
    return reader.csv(paths).select(*_split_columns(), *[f"_c{k}" for k in range(columns)])


def _placed(rows: DataFrame, group: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """rows (path, block, at, ...) with their number, from 0, among those of a group: by splits in the
    given order, which are counted first, and by place within a split."""
    keys = [*group, *[c for c in [*order, *SPLIT] if c not in group]]
    own = F.row_number().over(W.partitionBy(*keys).orderBy("at")) - 1
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("there"))
    earlier = W.partitionBy(*(group or [F.lit(0)])).orderBy(*keys[len(group) :]).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("there").over(earlier), F.lit(0)).alias("start"))
    return rows.withColumn(out, own).join(starts, keys).withColumn(out, (F.col(out) + F.col("start")).cast("long")).drop("start")


def csv_column(spark: SparkSession, path: str | list[str], *, column: int, skip: int = 0, limit: int | None = None, raw: bool = False, quoted_breaks: bool = True) -> DataFrame:
    """pos, value and, if asked, raw: a column of CSV files by its ordinal, in order of files and records.

    The first ``skip`` records of a file are left out; so are records that are too short and cells that
    aren't numbers. limit counts the rows that are left. quoted_breaks=False: no field holds a line feed,
    so a large file is read by as many tasks as it has splits, and not by one.
    """
    rows = _records(spark, path, column + 1, quoted_breaks).withColumnRenamed(f"_c{column}", "raw")
    if skip:
        # a file's first records are in its first split
        nth = F.row_number().over(W.partitionBy(*SPLIT).orderBy("at"))
        rows = rows.withColumn("nth", nth).where((F.col("block") > 0) | (F.col("nth") > skip))
    rows = rows.withColumn("value", parsed(F.col("raw"))).where("value is not null").select(*SPLIT, "at", "value", "raw")
    rows = _placed(rows, [], [])
    if limit is not None:
        rows = rows.where(F.col("pos") < limit)
    return rows.select("pos", "value", *["raw"] * raw)


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """pos, value of series one after another (each pos, value)."""
    rows = None
    for k, part in enumerate(parts):
        part = part.select(F.lit(k).alias("part_no"), "pos", "value")
        rows = part if rows is None else rows.unionByName(part)
    sizes = rows.groupBy("part_no").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(W.partitionBy(F.lit(0)).orderBy("part_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(sizes.select("part_no", before.alias("start"))), "part_no").select((F.col("start") + F.col("pos")).alias("pos"), "value")


def big_data(spark: SparkSession, folder: str) -> DataFrame:
    """The three training files' six columns, one after another."""
    # Files, limits, records to skip, columns.
    plan = [("air_sensor.csv", 10_000, 1, [4]), ("city_temp.csv", 2_900_000, 1, [7]), ("migration_original.csv", 89_000, 1, [3]), ("wind_temp.csv", 750_000, 10, [1, 2, 3])]
    return concatenated([csv_column(spark, f"{folder}/{name}", column=c, skip=skip, limit=limit) for name, limit, skip, columns in plan for c in columns])


def labelled_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, block, at, field, text: the fields after the class label, split at tabs or else at blanks."""
    line = F.trim(F.col("line"))
    by_tab = F.split(line, "\t")
    fields = F.when(F.size(by_tab) >= 2, by_tab).otherwise(F.split(line, r"\s+"))
    rows = _lines(spark, paths).where(F.length(F.trim("line")) > 0)
    rows = rows.select(*SPLIT, F.col("at").alias("line_at"), F.posexplode(F.slice(fields, 2, 1_000_000_000)).alias("field", "text"))
    return rows.withColumn("at", F.struct("line_at", "field")).drop("line_at", "field").where(F.length(F.trim("text")) > 0)


def ucr_values(spark: SparkSession, base: str) -> DataFrame:
    """dataset, pos, text: every data set's folder <name>/<name>_TRAIN.tsv, then _TEST.tsv."""
    rows = labelled_lines(spark, f"{base}/*/*_T[RE][AS][IT]*.tsv")
    name, dataset = (F.element_at(F.split("path", "/"), -k) for k in (1, 2))
    rows = rows.withColumns({"dataset": dataset, "file": name}).where((F.col("file") == F.concat("dataset", F.lit("_TRAIN.tsv"))) | (F.col("file") == F.concat("dataset", F.lit("_TEST.tsv"))))
    rows = rows.withColumn("test", F.col("file").endswith("_TEST.tsv"))
    return _placed(rows, ["dataset"], ["test"]).select("dataset", "pos", "text")


def all_values(spark: SparkSession, base: str) -> DataFrame:
    """dataset, pos, text of every <name>/all_values.txt: trimmed, blank lines left out."""
    rows = _lines(spark, f"{base}/*/all_values.txt").withColumn("text", F.trim("line")).where(F.length("text") > 0)
    rows = rows.withColumn("dataset", F.element_at(F.split("path", "/"), -2))
    return _placed(rows, ["dataset"], []).select("dataset", "pos", "text")


def value_counts(values: DataFrame) -> DataFrame:
    return values.groupBy("dataset").agg(F.count(F.lit(1)).alias("c"))


def merge_csvs(spark: SparkSession, folder: str, pattern: str, numbered: bool = False, quoted_breaks: bool = True) -> DataFrame:
    """The records of all CSV files below folder whose name contains pattern, under the first one's header.

    Files come in order of their paths; columns go by position, whatever the other files' headers say.
    numbered adds pos, the record's place among all. An empty selection has no columns.
    """
    found = {"recursiveFileLookup": True, "pathGlobFilter": f"*{pattern}*.csv"}
    first = spark.read.options(**found).format("binaryFile").load(folder).agg(F.min("path")).first()[0]
    if first is None:
        return spark.createDataFrame([], "")
    names = [f"`{c}`" for c in spark.read.option("header", True).option("escape", '"').csv(first).columns]
    reader = spark.read.options(**found).schema(", ".join(f"{c} string" for c in names)).option("header", True).option("escape", '"').option("multiLine", quoted_breaks)
    rows = reader.csv(folder)
    if not numbered:
        return rows
    return _placed(rows.select(*_split_columns(), F.struct(*names).alias("record")), [], []).select("pos", "record.*")


def sample_windows(values: DataFrame, *, datasets: int, size: int, seed: int) -> DataFrame:
    """dataset, pos, text: ``size`` consecutive values, or all if there are fewer, of some data sets.

    NaN texts are left out first. The same seed gives the same data sets and windows: both are drawn by
    hashes of the data set's name.
    """
    rows = values.where(~F.trim("text").isin("", *NAN_TEXTS))
    order = W.partitionBy("dataset").orderBy("pos")
    rows = rows.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))
    sizes = rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    drawn = lambda what: F.md5(F.concat(F.lit(f"{seed} {what} "), "dataset").cast("binary"))
    chosen = sizes.orderBy(drawn("data set"), "dataset").limit(datasets)
    start = F.conv(F.substring(drawn("start"), 1, 8), 16, 10).cast("long") % F.greatest(F.lit(1), F.col("n") - size + 1)
    rows = rows.join(chosen.withColumn("start", start), "dataset").where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + size))
    return rows.select("dataset", (F.col("pos") - F.col("start")).alias("pos"), "text")


#: Lines of a ZIP member that are held at once.
LINES_AT_ONCE = 50_000


def zip_members(spark: SparkSession, folder: str, *, contains: str = "Stocks", suffix: str = ".his") -> DataFrame:
    """archive, country, member, row_no, line: lines of the archives' members ending in suffix.

    Archives are taken whose name contains ``contains`` and a country; a member that can't be read
    ends there, and the others go on.
    """

    kinds = {"path": pa.string(), "member": pa.string(), "row_no": pa.int64(), "line": pa.string()}

    def lines(archive: zipfile.ZipFile) -> Iterator[tuple[str, int, str]]:
        for member in archive.namelist():
            if member.lower().endswith(suffix):
                try:
                    with archive.open(member) as file:
                        for k, line in enumerate(io.TextIOWrapper(file, "utf-8", newline="")):
                            yield member, k, line.rstrip("\r\n")
                except (UnicodeDecodeError, zipfile.BadZipFile):
                    continue

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    found = ((path, *line) for line in lines(archive))
                    while rows := list(islice(found, LINES_AT_ONCE)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], list(kinds))

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{contains}*.zip").load(folder)
    rows = files.select("path", "content").mapInArrow(run, "path string, member string, row_no long, line string")
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    country = F.coalesce(*[F.when(name.contains(key), F.lit(code)) for key, code in COUNTRIES])
    return rows.select(name.alias("archive"), country.alias("country"), "member", "row_no", "line").where("country is not null")


def country_rows(members: DataFrame) -> DataFrame:
    """country, header, line_no, line: a country's data lines in order, under its first member's header."""
    first = members.where("row_no = 0").groupBy("country").agg(F.min_by("line", F.struct("archive", "member")).alias("header"))
    order = W.partitionBy("country").orderBy("archive", "member", "row_no")
    rows = members.where("row_no > 0").withColumn("line_no", F.row_number().over(order) - 1)
    return rows.join(first, "country").select("country", "header", "line_no", "line")


def features_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Feature records, an object a file, or a line."""
    part = "struct<min: double, max: double, mean: double, std_dev: double, range: double, zero_ratio: double, unique_count: bigint, unique_ratio: double>"
    schema = (
        "min double, max double, mean double, median double, std_dev double, variance double, skewness double, kurtosis double, range double, iqr double, q1 double, q3 double, "
        "unique_count bigint, unique_ratio double, zero_count bigint, zero_ratio double, integer_count bigint, integer_ratio double, "
        f"diff_stats {part}, second_diff_stats {part}, monotonicity double, smoothness double, change_points bigint, "
        "run_length struct<max_run_length: bigint, avg_run_length: double, run_count: bigint, constant_run_ratio: double, InRunRatio: double>, "
        "bit_stats struct<avg_set_bits: double, sign_changes: bigint, mantissa_entropy: double, exponent_range: bigint, common_exponent: bigint>, "
        "entropy double, percentile_95 double, percentile_5 double, auto_correlation array<double>, periodicity bigint, periodic_score double"
    )
    return spark.read.option("multiLine", not lines).schema(schema).json(path)


def training_csvs(spark: SparkSession, features: str, labels: str) -> DataFrame:
    """row_no, features, ranged, scale, del, algo from two headerless CSV files of as many rows."""
    def lines(path: str, kind: str) -> DataFrame:
        rows = _placed(_lines(spark, path), [], [], "row_no")
        return rows.select("row_no", F.transform(F.split("line", ","), lambda t: t.try_cast(kind)).alias("fields"))

    x, y = lines(features, "double"), lines(labels, "int").withColumnRenamed("fields", "y")
    if x.count() != y.count():
        raise ValueError("features and labels differ in their number of rows")
    names = ["ranged", "scale", "del", "algo"]
    return x.join(y, "row_no").select("row_no", F.col("fields").alias("features"), *[F.get("y", F.lit(k)).alias(c) for k, c in enumerate(names)])
