from pyspark.sql import functions as F

from tidegauge.operators import constraints as cons
from tidegauge.streaming import validation


def run(stream, name, spark):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return sorted(map(tuple, spark.table(name).collect()))


def batches(spark, path, *parts):
    for k, part in enumerate(parts):
        rows = spark.createDataFrame(part, "series_id string, pos long, value double").coalesce(1)
        rows.write.mode("append").parquet(f"{path}/batch{k}")


def test_order_is_kept_between_batches(spark, tmp_path):
    rising = spark.createDataFrame([("s", k, float(k)) for k in range(200)] + [("t", k, 1.0) for k in range(200)], "series_id string, pos long, value double")
    known = cons.detect(rising)
    batches(spark, tmp_path, [("s", 0, 1.0), ("s", 1, 5.0), ("x", 0, 1.0)], [("s", 2, 4.0), ("s", 3, 9.0), ("t", 0, 1.0)], [("s", 4, 9.0), ("t", 1, 0.0)])
    stream = validation.read_series(spark, f"{tmp_path}/batch*", files_per_batch=1)
    assert run(validation.broken_orders(stream, known), "orders", spark) == [("s", 2, 4.0, 3), ("s", 4, 9.0, 3), ("t", 1, 0.0, 3)]


def test_values_alone(spark, tmp_path):
    known = cons.detect(spark.createDataFrame([("s", k, 0.5 * (k % 7)) for k in range(60)], "series_id string, pos long, value double"))
    batches(spark, tmp_path, [("s", 0, 0.5), ("s", 1, 9.0), ("s", 2, 0.75), ("s", 3, -1.0)])
    stream = validation.read_series(spark, f"{tmp_path}/batch*")
    assert run(validation.broken_values(stream, known), "alone", spark) == [("s", 1, 9.0, 1), ("s", 2, 0.75, 5), ("s", 3, -1.0, 1)]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    for k, rows in enumerate([[("s", 0, 1.0, 0), ("s", 1, 3.0, 60)], [("s", 2, 5.0, 50_000)], [("s", 5, 6.0, 50_001)], [("s", 3, 100.0, 30)], [("s", 4, 7.0, 100_000)]]):
        df = spark.createDataFrame(rows, "series_id string, pos long, value double, sec long")
        df.withColumn("ts", F.timestamp_seconds("sec")).coalesce(1).write.parquet(f"{tmp_path}/{k}")
    stream = spark.readStream.schema("series_id string, pos long, value double, sec long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    rows = run(validation.windowed_profile(stream), "windows", spark)
    assert (rows[0][0], rows[0][3], rows[0][6]) == ("s", 2, 2.0)
