"""Results written out."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import binary_text, double_bits
from ..storage import new_path, remove


def append_benchmark(results: DataFrame, path: str) -> None:
    """Codec results added to the CSV files of a folder."""
    results.write.mode("append").option("header", True).csv(path)


def training_files(training: DataFrame, features: str, labels: str) -> None:
    """Features with six decimals, and labels, as headerless CSV in one order of segments."""
    rows = training.orderBy("series_id", "segment_id")
    text = F.array_join(F.transform("features", lambda x: F.format_string("%.6f", x)), ",")
    rows.select(text).write.mode("overwrite").text(features)
    rows.select("ranged", "scale", "del", "algo").write.mode("overwrite").csv(labels)


def features_json(profiles: DataFrame, path: str) -> None:
    profiles.write.mode("overwrite").json(path)


def bit_dump(series: DataFrame) -> DataFrame:
    """line: the value with ten decimals, a tab, and its 64 bits."""
    bits = double_bits(F.col("value"))
    rows = series.select("series_id", "pos", "value", bits.alias("bits"))
    return rows.select("series_id", "pos", F.concat_ws("\t", F.format_string("%.10f", F.col("value")), binary_text(F.col("bits"))).alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def country_files(rows: DataFrame, path: str) -> None:
    """A folder a country: its header, then its lines in order."""
    head = rows.select("country", F.lit(-1).cast("long").alias("line_no"), F.col("header").alias("line")).distinct()
    lines = head.unionByName(rows.select("country", F.col("line_no").cast("long").alias("line_no"), "line"))
    lines.repartition("country").sortWithinPartitions("country", "line_no").select("country", "line").write.mode("overwrite").partitionBy("country").text(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def predictions_csv(predicted: DataFrame, path: str) -> None:
    predicted.write.mode("overwrite").option("header", True).csv(path)


def predictions_json(predicted: DataFrame) -> DataFrame:
    """series_id, segment_id, labels: the four labels as a JSON array."""
    return predicted.select("series_id", "segment_id", F.to_json(F.array("ranged", "scale", "del", "algo")).alias("labels"))


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A file of what the driver holds."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def one_text_file(rows: DataFrame, order: str, text: str, path: str) -> None:
    """The texts as lines of one file, by order: for readers that want a file and not a folder of parts."""
    spark = rows.sparkSession
    parts = new_path(spark, "lines")
    rows.select(order, text).coalesce(1).sortWithinPartitions(order).select(text).write.text(parts)
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = Path(parts).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(Path(path).getParent())
    fs.rename(fs.globStatus(Path(f"{parts}/part-*"))[0].getPath(), Path(path))
    remove(spark, parts)
