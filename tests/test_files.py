import zipfile

import pytest

from tidegauge.operators import learn
from tidegauge.operators.series import packed, to_series
from tidegauge.sources import files, sinks


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_csv_column_skips_what_is_no_number(spark, tmp_path):
    (tmp_path / "a.csv").write_text('head,x\n1,1.5\n2\n3,abc\n4,1e400\n5, 1.5\n6,"2.25"\n7,NaN\n8,-3\n')
    got = files.csv_column(spark, str(tmp_path / "a.csv"), column=1, skip=1, raw=True)
    assert [(r[0], r[2]) for r in rows(got, "pos")] == [(0, "1.5"), (1, "2.25"), (2, "NaN"), (3, "-3")]
    assert files.csv_column(spark, str(tmp_path / "a.csv"), column=1, skip=1, limit=2).count() == 2


def test_quoted_line_feeds_and_many_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.csv").write_text('h,"a\nb"\n"x\ny, ""z""",1\n\n,2\n')
    (tmp_path / "in/a.csv").write_text("h,h\n0,3\n0,4\n" + "0,5\n" * 3000)
    got = files.csv_column(spark, str(tmp_path / "in"), column=1, skip=1)
    assert [r["value"] for r in got.orderBy("pos").collect()] == [3.0, 4.0, *[5.0] * 3000, 1.0, 2.0]
    assert [r["pos"] for r in got.orderBy("pos").collect()] == list(range(3004))


def test_splits_of_a_file_stay_in_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("h\n" + "".join(f"{k}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = files.csv_column(spark, str(tmp_path / "a.csv"), column=0, skip=1, limit=4000, quoted_breaks=False).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["pos"], r["value"]) for r in rows) == [(k, float(k)) for k in range(4000)]


def test_file_exists(spark, tmp_path):
    (tmp_path / "a").write_text("")
    assert files.file_exists(spark, str(tmp_path / "a")) and not files.file_exists(spark, str(tmp_path / "b"))


def test_merged_csvs_go_under_the_first_header(spark, tmp_path):
    for name, text in (("rain_b.csv", "x,y\n3,4\n"), ("rain_a.csv", "p,q\n2,1\n1,2\n"), ("wind.csv", "p,q\n9,9\n")):
        (tmp_path / name).write_text(text)
    got = files.merge_csvs(spark, str(tmp_path), "rain", numbered=True)
    assert got.columns == ["pos", "p", "q"] and rows(got, "pos") == [(0, "2", "1"), (1, "1", "2"), (2, "3", "4")]
    assert files.merge_csvs(spark, str(tmp_path), "snow").count() == 0


def test_ucr_folders(spark, tmp_path):
    for name in ("A", "B"):
        (tmp_path / name).mkdir()
    (tmp_path / "A/A_TRAIN.tsv").write_text("1\t1.0\t2.0\n\n2\t3.0\t4.0\n")
    (tmp_path / "A/A_TEST.tsv").write_text("1\t5.0\t6.0\n")
    (tmp_path / "B/B_TEST.tsv").write_text("1 7.0 NaN\n")
    got = files.ucr_values(spark, str(tmp_path))
    assert rows(got, "dataset", "pos") == [("A", k, f"{k + 1}.0") for k in range(6)] + [("B", 0, "7.0"), ("B", 1, "NaN")]
    one = files.sample_windows(got, datasets=1, size=3, seed=4)
    assert 1 <= one.count() <= 3 and rows(one, "pos") == rows(files.sample_windows(got, datasets=1, size=3, seed=4), "pos")
    everything = files.sample_windows(got, datasets=9, size=99, seed=1)
    assert everything.count() == 7


def test_all_values_and_merged_csvs(spark, tmp_path):
    (tmp_path / "D").mkdir()
    (tmp_path / "D/all_values.txt").write_text(" 1.0 \n\n2.0\n")
    assert rows(files.all_values(spark, str(tmp_path)), "pos") == [("D", 0, "1.0"), ("D", 1, "2.0")]
    assert rows(files.value_counts(files.all_values(spark, str(tmp_path))), "dataset") == [("D", 2)]
    (tmp_path / "D/rain_1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "rain_2.csv").write_text("a,b\n3,4\n")
    (tmp_path / "wind.csv").write_text("a,b\n5,6\n")
    assert rows(files.merge_csvs(spark, str(tmp_path), "rain"), "a") == [("1", "2"), ("3", "4")]


def test_zip_members_by_country(spark, tmp_path):
    for name, lines in (("Stocks USA 1.zip", "h,v\n1,2\n"), ("Stocks Germany.zip", "h,v\n3,4\n"), ("Bonds USA.zip", "h,v\n5,6\n"), ("Stocks Mars.zip", "h,v\n7,8\n")):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("x.HIS", lines)
            z.writestr("y.txt", "no")
    got = files.country_rows(files.zip_members(spark, str(tmp_path)))
    assert rows(got, "country") == [("Germany", "h,v", 0, "3,4"), ("USA", "h,v", 0, "1,2")]
    sinks.country_files(got, str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out/country=USA")).collect()) == ["1,2", "h,v"]


def test_big_data_in_order(spark, tmp_path):
    head = "\n".join(["h"] * 10)
    (tmp_path / "air_sensor.csv").write_text("h\n0,0,0,0,1\n")
    (tmp_path / "city_temp.csv").write_text("h\n0,0,0,0,0,0,0,2\n0,0,0,0,0,0,0,3\n")
    (tmp_path / "migration_original.csv").write_text("h\n0,0,0,4\n")
    (tmp_path / "wind_temp.csv").write_text(f"{head}\n0,5,6,7\n")
    assert rows(files.big_data(spark, str(tmp_path)), "pos") == [(k, float(k + 1)) for k in range(7)]


def test_training_files_and_models(spark, tmp_path):
    values = [(k, float((k * 7) % 13 if k < 600 else k * 0.37 % 5)) for k in range(1200)]
    series = to_series(spark.createDataFrame(values, "t int, v double"), ["t"], "v")
    training = learn.training_set(series, 100).cache()
    assert training.count() == 12 and len(training.first()["features"]) == 61
    sinks.training_files(training, str(tmp_path / "x"), str(tmp_path / "y"))
    again = files.training_csvs(spark, str(tmp_path / "x"), str(tmp_path / "y"))
    assert again.count() == 12 and len(again.first()["features"]) == 61
    assert {r["label"] for r in learn.label_counts(training).collect()} == set(learn.LABELS)
    forest = learn.train_forest(training, "algo", trees=3, depth=3)
    network = learn.train_network(training, "del", layers=(4,), rounds=5)
    told = learn.predict(training.select("series_id", "segment_id", "features"), {"algo": forest, "del": network})
    assert told.count() == 12 and told.where("algo between 0 and 4 and del between 0 and 1 and ranged = 0").count() == 12
    scored = learn.evaluate(training.join(told.withColumnRenamed("algo", "pred_algo").drop("ranged", "scale", "del"), ["series_id", "segment_id"]), "algo")
    assert 0 <= scored["accuracy"] <= 1
    sinks.save_model(forest, str(tmp_path / "model"))
    a, b = learn.split(training, 0.5)
    assert a.count() + b.count() == 12
    assert sinks.predictions_json(told).first()["labels"].startswith("[")
    from tidegauge.operators import encoding

    segments = packed(series, 100)
    back = encoding.decode_chosen(encoding.encode_chosen(segments, told)).count()
    assert back == 12


def test_unequal_training_files_are_refused(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1,2\n3,4\n")
    (tmp_path / "y.csv").write_text("0,0,0,1\n")
    with pytest.raises(ValueError):
        files.training_csvs(spark, str(tmp_path / "x.csv"), str(tmp_path / "y.csv"))


def test_feature_records(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"min": 1.0, "diff_stats": {"mean": 2.0}, "run_length": {"run_count": 3}, "auto_correlation": [0.5]}')
    row = files.features_json(spark, str(tmp_path / "f.json")).first()
    assert (row["min"], row["diff_stats"]["mean"], row["run_length"]["run_count"], row["auto_correlation"]) == (1.0, 2.0, 3, [0.5])
