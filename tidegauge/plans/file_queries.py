"""Queries over files: they write tables of the shared inputs as files of each format, and read them back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import constraints as cons
from ..operators import learn
from ..operators import profile as prof
from ..operators.series import to_series
from ..sources import files, sinks
from ..storage import new_path

Query = Callable[[SparkSession, str], DataFrame]
#: Values of a line, and of an unlabelled line, in the text files that are made.
PER_LINE = 8
#: Which part of the windows query's data sets and values is taken.
WINDOWS = {"datasets": 2, "size": 50, "seed": 7}


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def price() -> Column:
    return F.col("o_totalprice").cast("decimal(20,2)").cast("string")


def in_key_order(rows: DataFrame, key: str) -> DataFrame:
    """Sorted over files too: their names are in the order of their rows."""
    return rows.repartitionByRange(key).sortWithinPartitions(key)


def orders_csv(spark: SparkSession, sf_dir: str) -> str:
    """Order keys, a text with a line feed and quotes, and totals, some of which are no number."""
    path = new_path(spark, "orders-csv")
    odd = F.when(F.col("o_orderkey") % 7 == 0, "n/a").when(F.col("o_orderkey") % 11 == 0, "1e999").otherwise(price())
    rows = orders(spark, sf_dir).select("o_orderkey", F.concat(F.lit('a "note",\nand '), "o_orderstatus").alias("note"), odd.alias("total"))
    in_key_order(rows, "o_orderkey").write.option("header", True).option("escape", '"').csv(path)
    return path


def csv_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.csv_column(spark, orders_csv(spark, sf_dir), column=2, skip=1)


def csv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.csv_column(spark, orders_csv(spark, sf_dir), column=2, skip=1, limit=5000, raw=True)


def training_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three training files, made of orders and lines: some columns of each, one after another."""
    folder = new_path(spark, "mix")
    blank = lambda n: [F.lit("-").alias(f"x{k}") for k in range(n)]
    rows = orders(spark, sf_dir)
    totals = in_key_order(rows.select("o_orderkey", *blank(3), price().alias("v")), "o_orderkey")
    totals.write.option("header", True).csv(f"{folder}/air_sensor.csv")
    keys = in_key_order(rows.select("o_orderkey", *blank(6), F.col("o_custkey").cast("string").alias("v")), "o_orderkey")
    keys.write.option("header", True).csv(f"{folder}/city_temp.csv")
    third = in_key_order(rows.select("o_orderkey", *blank(2), (F.col("o_custkey") % 100).cast("string").alias("v")), "o_orderkey")
    third.write.option("header", True).csv(f"{folder}/migration_original.csv")
    # ten records to skip: the ten parts with the smallest keys
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", F.col("p_partkey") % 10, F.col("p_partkey") % 1000)
    parts.coalesce(1).sortWithinPartitions("p_partkey").write.csv(f"{folder}/wind_temp.csv")
    return files.big_data(spark, folder)


def labelled_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder an order status: lines of a label and PER_LINE totals, even ones to train and odd to test."""
    base = new_path(spark, "labelled")
    rows = to_series(orders(spark, sf_dir), ["o_orderkey"], "o_totalprice", "o_orderstatus", raw=price())
    line = F.floor(F.col("pos") / PER_LINE)
    rows = rows.groupBy("series_id", line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("pos", "raw"))).alias("told"))
    text = F.concat_ws("\t", F.lit("1"), F.array_join("told.raw", "\t"))
    for name in sorted(r[0] for r in rows.select("series_id").distinct().collect()):
        for part, odd in (("TRAIN", 0), ("TEST", 1)):
            own = rows.where((F.col("series_id") == name) & (F.col("line") % 2 == odd)).select("line", text.alias("text"))
            sinks.one_text_file(own, "line", "text", f"{base}/{name}/{name}_{part}.tsv")
    return base


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.ucr_values(spark, labelled_files(spark, sf_dir))


def value_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """all_values.txt a status, with blank lines and NaN texts between."""
    base = new_path(spark, "values")
    text = F.when(F.col("o_orderkey") % 13 == 0, "").when(F.col("o_orderkey") % 17 == 0, "NaN").otherwise(F.concat(F.lit(" "), price()))
    rows = orders(spark, sf_dir).select("o_orderstatus", "o_orderkey", text.alias("text"))
    for name in sorted(r[0] for r in rows.select("o_orderstatus").distinct().collect()):
        sinks.one_text_file(rows.where(F.col("o_orderstatus") == name), "o_orderkey", "text", f"{base}/{name}/all_values.txt")
    return files.all_values(spark, base)


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.value_counts(value_files(spark, sf_dir))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.sample_windows(value_files(spark, sf_dir), **WINDOWS)


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders of CSV files with other headers, and one whose name doesn't fit."""
    base = new_path(spark, "merge")
    for folder, name, odd in (("a", "rain", 0), ("b", "rain", 1), ("c", "wind", 0)):
        own = orders(spark, sf_dir).where(F.col("o_custkey") % 2 == odd).select(F.col("o_orderkey").alias("key" if folder == "a" else "other"), F.col("o_orderstatus").alias("status"))
        text = F.concat_ws(",", F.col(own.columns[0]).cast("string"), "status")
        head = spark.createDataFrame([(-1, ",".join(own.columns))], "k long, text string")
        sinks.one_text_file(head.unionByName(own.select(F.col(own.columns[0]).alias("k"), text.alias("text"))), "k", "text", f"{base}/{folder}/{name}_{folder}.csv")
    return files.merge_csvs(spark, base, "rain", numbered=True)


def country_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of nations by region, written and read back by country."""
    base = new_path(spark, "zips")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()  # 25 rows at any scale
    for region, name in ((0, "Stocks USA"), (1, "Stocks United Kingdom"), (2, "Stocks Germany"), (3, "Stocks Mars"), (4, "Bonds USA")):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            for half in (0, 1):
                own = [r for r in rows if r["n_regionkey"] == region and r["n_nationkey"] % 2 == half]
                archive.writestr(f"m{half}.his", "key,name\n" + "".join(f"{r['n_nationkey']},{r['n_name']}\n" for r in own))
            archive.writestr("readme.txt", "no")
        sinks.write_bytes(spark, f"{base}/{name}.zip", out.getvalue())
    found = files.country_rows(files.zip_members(spark, base))
    path = new_path(spark, "countries")
    sinks.country_files(found, path)
    return spark.read.text(path).select("country", F.col("value").alias("line"))


def feature_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles as JSON, and what is in the records that are read back."""
    path = new_path(spark, "features")
    series = to_series(spark.read.parquet(f"{sf_dir}/events.parquet"), ["ts", "event_id"], "value", "event_type")
    sinks.features_json(prof.profile(series), path)
    return files.features_json(spark, path, lines=True).select(*[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "median")], "unique_count", F.round("diff_stats.mean", 6).alias("diff_mean"), F.col("run_length.run_count").alias("run_count"))


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three features and four labels an order."""
    key = F.col("o_orderkey")
    labels = [(key % n).cast("int").alias(c) for c, n in (("ranged", 1), ("scale", 2), ("del", 3), ("algo", 5))]
    features = F.array(F.col("o_totalprice"), F.col("o_custkey").cast("double"), (key % 9).cast("double"))
    return orders(spark, sf_dir).select(F.col("o_orderstatus").alias("series_id"), key.alias("segment_id"), features.alias("features"), *labels)


def training_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = new_path(spark, "training-x"), new_path(spark, "training-y")
    sinks.training_files(training_rows(spark, sf_dir), x, y)
    rows = files.training_csvs(spark, x, y)
    return rows.select("row_no", *[F.col("features")[k].alias(f"f{k}") for k in range(3)], "ranged", "scale", "del", "algo")


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.label_counts(training_rows(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as JSON, and as CSV read back."""
    path = new_path(spark, "predictions")
    told = training_rows(spark, sf_dir).drop("features")
    sinks.predictions_csv(told, path)
    back = spark.read.option("header", True).schema(told.schema).csv(path)
    return sinks.predictions_json(back)


def benchmark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results appended twice to one folder of CSV files."""
    path = new_path(spark, "benchmark")
    rows = orders(spark, sf_dir).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("segments"))
    for _ in range(2):
        sinks.append_benchmark(rows, path)
    back = spark.read.option("header", True).schema("codec string, segments long").csv(path)
    return back.groupBy("codec").agg(F.count(F.lit(1)).alias("rows"), F.sum("segments").alias("segments"))


def existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["orders.parquet", "no_such.parquet"]
    return spark.createDataFrame([(n, files.file_exists(spark, f"{sf_dir}/{n}")) for n in names], "name string, there boolean")


def bit_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dump of values and bits as a text file, read back."""
    path = new_path(spark, "bits")
    rows = to_series(orders(spark, sf_dir), ["o_orderkey"], "o_totalprice", "o_orderstatus")
    sinks.write_lines(sinks.bit_dump(rows), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of the quantities of lines, as text."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    series = to_series(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), order, "l_quantity", "l_returnflag")
    return cons.report(cons.detect(series))


QUERIES: dict[str, Query] = {
    "src_csv_column": csv_column,
    "src_csv_text": csv_text,
    "src_training_mix": training_mix,
    "src_labelled": labelled,
    "src_all_values": value_files,
    "src_value_counts": value_counts,
    "src_windows": windows,
    "src_merged_csvs": merged,
    "src_country_files": country_files,
    "src_feature_records": feature_records,
    "src_training_files": training_files,
    "src_exists": existing,
    "label_counts": label_counts,
    "sink_predictions": predictions,
    "sink_benchmark": benchmark_rows,
    "sink_bit_file": bit_file,
    "cons_report": constraint_report,
}

P = "CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS VARCHAR)"
CSV = f"c AS (SELECT o_orderkey, {P} AS raw FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0)"
#: Lines of PER_LINE totals: even ones first, then odd ones.
LINES = f"s AS (SELECT o_orderstatus AS dataset, {P} AS text, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS k FROM orders WHERE o_totalprice IS NOT NULL)"
VALUES = f"v AS (SELECT o_orderstatus AS dataset, o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'NaN' ELSE {P} END AS text FROM orders WHERE o_orderkey % 13 <> 0)"
HASHED = "CAST('0x' || substr(md5('{seed} start ' || dataset), 1, 8) AS BIGINT)".format(**WINDOWS)

ORACLE_SQL: dict[str, str] = {
    "src_csv_column": f"WITH {CSV} SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, CAST(raw AS DOUBLE) AS value FROM c",
    "src_csv_text": f"WITH {CSV} SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, CAST(raw AS DOUBLE) AS value, raw FROM c ORDER BY pos LIMIT 5000",
    "src_training_mix": f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders), p AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS k FROM part),
        a AS (SELECT 0 AS part, k, CAST({P} AS DOUBLE) AS value FROM o WHERE k <= 10000 UNION ALL SELECT 1, k, o_custkey FROM o WHERE k <= 2900000 UNION ALL SELECT 2, k, o_custkey % 100 FROM o WHERE k <= 89000
              UNION ALL SELECT 3, k, p_size FROM p WHERE k BETWEEN 11 AND 750010 UNION ALL SELECT 4, k, p_partkey % 10 FROM p WHERE k BETWEEN 11 AND 750010 UNION ALL SELECT 5, k, p_partkey % 1000 FROM p WHERE k BETWEEN 11 AND 750010)
        SELECT row_number() OVER (ORDER BY part, k) - 1 AS pos, value FROM a""",
    "src_labelled": f"WITH {LINES} SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY k // {PER_LINE} % 2, k) - 1 AS pos, text FROM s",
    "src_all_values": f"WITH {VALUES} SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY o_orderkey) - 1 AS pos, text FROM v",
    "src_value_counts": f"WITH {VALUES} SELECT dataset, count(*) AS c FROM v GROUP BY dataset",
    "src_windows": f"""WITH {VALUES}, n AS (SELECT dataset, text, row_number() OVER (PARTITION BY dataset ORDER BY o_orderkey) - 1 AS k FROM v WHERE text <> 'NaN'),
        t AS (SELECT dataset, {HASHED} % greatest(1, count(*) - {WINDOWS['size']} + 1) AS start FROM n GROUP BY dataset ORDER BY md5('{WINDOWS['seed']} data set ' || dataset) LIMIT {WINDOWS['datasets']})
        SELECT dataset, k - start AS pos, text FROM n JOIN t USING (dataset) WHERE k >= start AND k < start + {WINDOWS['size']}""",
    "src_merged_csvs": "SELECT row_number() OVER (ORDER BY o_custkey % 2, o_orderkey) - 1 AS pos, CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS status FROM orders",
    "src_country_files": """WITH c AS (SELECT *, CASE n_regionkey WHEN 0 THEN 'USA' WHEN 1 THEN 'UK' WHEN 2 THEN 'Germany' END AS country FROM nation)
        SELECT country, n_nationkey || ',' || n_name AS line FROM c WHERE country IS NOT NULL UNION ALL SELECT DISTINCT country, 'key,name' FROM c WHERE country IS NOT NULL""",
    "src_training_files": """SELECT row_number() OVER (ORDER BY o_orderstatus, o_orderkey) - 1 AS row_no, CAST(printf('%.6f', o_totalprice) AS DOUBLE) AS f0, CAST(o_custkey AS DOUBLE) AS f1, CAST(o_orderkey % 9 AS DOUBLE) AS f2,
        CAST(0 AS INTEGER) AS ranged, CAST(o_orderkey % 2 AS INTEGER) AS scale, CAST(o_orderkey % 3 AS INTEGER) AS del, CAST(o_orderkey % 5 AS INTEGER) AS algo FROM orders""",
    "src_exists": "SELECT 'orders.parquet' AS name, count(*) >= 0 AS there FROM orders UNION ALL SELECT 'no_such.parquet', false",
    "label_counts": " UNION ALL ".join(f"SELECT '{c}' AS label, CAST(o_orderkey % {n} AS INTEGER) AS value, count(*) AS c FROM orders GROUP BY ALL" for c, n in (("ranged", 1), ("scale", 2), ("del", 3), ("algo", 5))),
    "sink_predictions": "SELECT o_orderstatus AS series_id, o_orderkey AS segment_id, '[0,' || o_orderkey % 2 || ',' || o_orderkey % 3 || ',' || o_orderkey % 5 || ']' AS labels FROM orders",
    "sink_benchmark": "SELECT o_orderpriority AS codec, 2::BIGINT AS rows, CAST(2 * count(*) AS BIGINT) AS segments FROM orders GROUP BY o_orderpriority",
    "sink_bit_file": "SELECT printf('%.10f', o_totalprice) || chr(9) || CAST((o_totalprice::DOUBLE)::BIT AS VARCHAR) AS line FROM orders WHERE o_totalprice IS NOT NULL",
}
