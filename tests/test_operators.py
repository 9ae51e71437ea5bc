import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import bits as B
from tidegauge.functions.decimals import decimal_places, text_decimals, value_decimals
from tidegauge.operators import constraints as cons
from tidegauge.operators import encoding as enc
from tidegauge.operators import profile as prof
from tidegauge.operators import transforms as xf
from tidegauge.operators.series import packed, segmented, to_series, unpacked


def series(spark, values, raw=None, name="s"):
    rows = [(name, k, float(v), None if raw is None else raw[k]) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series_id string, pos long, value double, raw string")
    return df if raw is not None else df.drop("raw")


def values_of(df, column="value"):
    return [r[column] for r in df.orderBy("series_id", "pos").collect()]


def test_to_series_drops_nulls_and_numbers_rows(spark):
    df = spark.createDataFrame([(3, "a", 1.0), (1, "a", 2.0), (2, "a", None), (1, "b", 5.0)], "t int, k string, v double")
    rows = to_series(df, ["t"], "v", "k").orderBy("series_id", "pos").collect()
    assert [tuple(r) for r in rows] == [("a", 0, 2.0), ("a", 1, 1.0), ("b", 0, 5.0)]
    assert to_series(df.limit(0), ["t"], "v").count() == 0


def test_profile_of_a_small_series(spark):
    x = [1.0, 2.0, 2.0, 2.0, 5.0, 5.0, 3.0, 0.0, 0.0, 1.5, 7.0, 7.0]
    p = prof.profile(series(spark, x)).first()
    a, d = np.array(x), np.diff(x)
    assert p["min"] == 0 and p["max"] == 7 and p["range"] == 7 and p["n"] == 12
    assert math.isclose(p["variance"], a.var()) and math.isclose(p["std_dev"] ** 2, p["variance"])
    assert math.isclose(p["kurtosis"], ((a - a.mean()) ** 4).mean() / a.var() ** 2)
    assert [p["q1"], p["median"], p["q3"]] == np.quantile(a, [0.25, 0.5, 0.75]).tolist()
    assert p["unique_count"] == 7 and p["zero_count"] == 2 and p["integer_count"] == 11
    assert math.isclose(p["diff_stats"]["mean"], d.mean()) and math.isclose(p["diff_stats"]["std_dev"], d.std())
    assert p["diff_stats"]["zero_ratio"] == (d == 0).sum() / 11
    assert math.isclose(p["second_diff_stats"]["std_dev"], np.diff(d).std()) and p["smoothness"] == p["second_diff_stats"]["std_dev"]
    assert p["monotonicity"] == (4 - 2) / 6 and p["change_points"] == 2
    run = p["run_length"]
    assert (run["max_run_length"], run["run_count"]) == (3, 7) and math.isclose(run["in_run_ratio"], 1 - 3 / 12) and math.isclose(run["constant_run_ratio"], 4 / 7)
    c = a - a.mean()
    assert np.allclose(p["auto_correlation"], [(c[k:] * c[:-k]).mean() / a.var() for k in range(1, 11)])
    assert p["percentile_95"] == 0
    vector = prof.flatten(prof.profile(series(spark, x))).first()["features"]
    assert len(vector) == len(prof.VECTOR) == 61 and vector[2] == p["mean"]


def test_last_single_run_is_not_a_single(spark):
    r = prof.runs(series(spark, [1.0, 2.0, 3.0])).first()
    assert math.isclose(r["in_run_ratio"], 1 - 2 / 3)


def test_profile_of_odd_series(spark):
    same = prof.profile(series(spark, [4.0] * 12)).first()
    assert same["skewness"] == 0 and same["kurtosis"] == 0 and same["entropy"] == 0 and same["auto_correlation"] is None and same["periodicity"] == 0
    one = prof.profile(series(spark, [4.0])).first()
    assert one["diff_stats"]["mean"] == 0 and one["monotonicity"] == 0 and len(prof.flatten(prof.profile(series(spark, [4.0]))).first()[1]) == 61
    odd = prof.basic(series(spark, [1.0, float("nan"), 3.0, float("inf")])).first()
    assert (odd["n"], odd["n_finite"], odd["min"], odd["max"]) == (4, 2, 1.0, 3.0)
    assert prof.profile(series(spark, [])).count() == 0
    ten = prof.autocorrelation(series(spark, range(10))).first()
    assert ten["auto_correlation"] is None


def test_periodicity(spark):
    p = prof.periodicity(series(spark, [0, 1, 5, 1] * 20)).first()
    assert p["periodicity"] == 4 and p["periodic_score"] > 0.9
    assert prof.periodicity(series(spark, [0, 1, 5, 1] * 2)).first()["periodicity"] == 0


@pytest.mark.parametrize(
    "forward, back",
    [(xf.delta, xf.delta_recover), (xf.delta2, xf.delta2_recover), (xf.ranged, xf.ranged_recover), (xf.logged, xf.logged_recover), (xf.minmax, xf.minmax_recover), (xf.zscore, xf.zscore_recover), (xf.identity, xf.identity)],
)
def test_transforms_come_back(spark, forward, back):
    x = [3.0, 1.0, 4.0, 1.0, 5.0, -9.0]
    assert np.allclose(values_of(back(forward(series(spark, x)))), x)
    assert back(forward(series(spark, []))).count() == 0
    assert np.allclose(values_of(back(forward(series(spark, [2.5])))), [2.5])


def test_whole_number_transforms(spark):
    assert values_of(xf.precision(series(spark, [1.15, -1.15]), 2)) == [114, -114]
    assert values_of(xf.precision(series(spark, [1.25, -1.25]), 1, rounded=True)) == [13, -13]
    assert values_of(xf.precision_recover(xf.precision(series(spark, [1.5, -2.5]), 1), 1)) == [1.5, -2.5]
    s = series(spark, [10.0, 13.0, 17.0])
    assert values_of(xf.steps_recover(xf.steps(s), 10.0)) == [13.0, 17.0]
    falling = series(spark, [9.0, 4.0, 3.0])
    assert values_of(xf.steps(falling, falling=True)) == [5, 1] and values_of(xf.steps_recover(xf.steps(falling, falling=True), 9.0, falling=True)) == [4.0, 3.0]
    assert values_of(xf.discrete_recover(xf.discrete(series(spark, [1.0, 1.5, 3.0]), 0.5), 0.5)) == [1.0, 1.5, 3.0]
    assert values_of(xf.plus_min(xf.less_min(s, 10.0), 10.0)) == [10.0, 13.0, 17.0]


def test_enumeration_index_takes_the_nearest(spark):
    table = spark.createDataFrame([("s", [5.0, 1.0, 3.0])], "series_id string, enumeration array<double>")
    assert values_of(xf.enum_index(series(spark, [1.0, 5.0, 2.0, 9.0]), table)) == [1, 0, 1, 0]
    assert values_of(xf.enum_recover(xf.enum_index(series(spark, [3.0, 5.0]), table), table)) == [3.0, 5.0]
    assert values_of(xf.enum_recover(series(spark, [7]), table)) == [0.0]


def test_detected_constraints(spark):
    row = cons.detect(series(spark, [0.5 * k for k in range(300)])).first()
    assert (row["precision"], row["monotonicity"], row["min_value"], row["max_value"]) == (1, 2, 0.0, 149.5)
    assert row["enumeration"] is None and not row["allow_negative"] and row["sign"]
    few = cons.detect(series(spark, [3.0, 1.0, 3.0] * 100)).first()
    assert few["enumeration"] == [3.0, 1.0] and few["discrete_step"] == 2.0
    assert cons.detect(series(spark, [7.0])).first()["monotonicity"] == 2
    assert cons.detect(series(spark, [7.0, 7.0])).first()["monotonicity"] == 1
    assert cons.detect(series(spark, [0.0] * 95 + [1.0] * 5)).first()["sparse"]
    assert cons.detect(series(spark, [])).count() == 0
    text = cons.detect(series(spark, [1.0, 2.0, 3.0, 5.0], ["1.00", "2.125", "3", "5"]), use_text=True).first()
    assert text["precision"] == 3 and text["discrete_step"] == 0.0 and text["sign"]
    even = cons.detect(series(spark, [1.0, 2.0, 3.0, 4.0], list("1234")), use_text=True).first()
    assert even["discrete_step"] == 1.0


def test_long_decimals_are_outliers(spark):
    raw = ["1.25"] * 97 + ["1.123456789012"] * 3
    assert cons.precision(series(spark, [1.0] * 100, raw), use_text=True).first()["precision"] == 2


def test_validation_reports_the_first_failure(spark):
    known = cons.detect(series(spark, [1.0, 2.0, 3.0, 4.0] * 30, ["1", "2", "3", "4"] * 30), use_text=True)
    rows = cons.validate(series(spark, [2.0, 9.0, 3.0, 3.5, -1.0], ["2", "9", "3", "3.5", "-1"]), known).orderBy("pos").collect()
    assert [(r["pos"], r["constraint_type"]) for r in rows] == [(1, 1), (3, 0), (4, 1)]
    rising = cons.detect(series(spark, range(200)))
    assert [r["constraint_type"] for r in cons.validate(series(spark, [5.0, 4.0]), rising).collect()] == [3]
    thin = cons.detect(series(spark, [0.0] * 99 + [1.0]))
    found = cons.validate(series(spark, [0.0, 1.0]), thin).where("pos = -1").first()
    assert found["constraint_type"] == 6 and found["value"] == 0.5
    assert cons.report(known).count() >= 3
    assert "[range]" in cons.anomaly_report(cons.validate(series(spark, [9.0]), rising.withColumn("max_value", F.lit(1.0)))).first()["line"]


def test_decimals(spark):
    df = spark.createDataFrame([("1.50", 1.5), ("-3", -3.0), ("1.5e3", 1500.0), (" 2.125 ", 2.125), (None, None)], "raw string, v double")
    rows = df.select(text_decimals(F.col("raw")), value_decimals(F.col("v"))).collect()
    assert [r[0] for r in rows] == [1, 0, 3, 3, None] and [r[1] for r in rows] == [1, 0, 0, 3, None]
    assert decimal_places(float("nan")) == 0 and decimal_places(0.1) == 1


def test_bits(spark):
    df = spark.createDataFrame([(1.5,), (-0.0,), (None,), (float("nan"),)], "v double")
    got = [r[0] for r in df.select(B.double_bits(F.col("v"))).collect()]
    assert got[0] == 0x3FF8000000000000 and got[1] == -(1 << 63) and got[2] is None
    word = spark.createDataFrame([(12, -1), ((1 << 63) - 1, 1), (-(1 << 63), -1)], "a long, b long")
    rows = word.select(B.leading_zeros(F.col("a")), B.trailing_zeros(F.col("a")), B.wrapping_add(F.col("a"), F.col("b")), B.wrapping_sub(F.col("a"), F.col("b")), B.reverse_bits(F.col("a"))).collect()
    assert tuple(rows[0]) == (60, 2, 11, 13, int(f"{12:064b}"[::-1], 2))
    assert rows[1][2] == -(1 << 63) and rows[2][2] == (1 << 63) - 1 and rows[1][3] == (1 << 63) - 2
    assert df.select(B.bits_double(B.double_bits(F.col("v")))).first()[0] == 1.5


def test_segments(spark):
    s = series(spark, range(25))
    assert segmented(s, 10).count() == 20 and segmented(s, 10, keep_rest=True).count() == 25
    assert [r["n"] for r in packed(s, 10).orderBy("segment_id").collect()] == [10, 10, 5]
    assert values_of(unpacked(packed(s, 10), 10)) == [float(k) for k in range(25)]


def test_nan_survives_blocks(spark):
    odd = [1.0, float("nan"), -0.0, float("inf")]
    rows = enc.round_trip(packed(series(spark, odd), 10), "elf").collect()
    assert [(r["n"], r["round_trip_ok"]) for r in rows] == [(4, True)]
    back = enc.decode(enc.encode(packed(series(spark, odd), 10), "chimp128"), "chimp128").first()["values"]
    assert math.isnan(back[1]) and math.copysign(1, back[2]) < 0


def test_best_combo_and_runs(spark):
    same = packed(series(spark, [2.5] * 50), 50)
    best = enc.best_combo(same).first()
    sizes = {r["combo"]["ordinal"]: r["combo"]["bytes"] for r in enc.all_sizes(same, [(a, k, a) for k in range(2) for a in enc.CHOICE]).collect()}
    first = min(sizes, key=lambda k: (sizes[k], k))
    assert (best["del"], best["algo"], best["bytes"]) == (first // 5, first % 5, sizes[first])
    runs = enc.rle(series(spark, [1, 1, 2, float("nan"), float("nan")])).orderBy("run").collect()
    assert [r["length"] for r in runs] == [2, 1, 2]
    costs = enc.bit_costs(packed(series(spark, [1.0, 1.0, 2.0]), 10)).orderBy("at").collect()
    assert [r["xor_bits"] for r in costs][:2] == [64, 1]


@pytest.fixture(params=[1, 2, 3, 12])
def small_chunks(request, monkeypatch):
    from tidegauge.operators import series as module

    monkeypatch.setattr(module, "CHUNK", request.param)
    return request.param


def test_chunks_do_not_change_results(spark, small_chunks):
    """Runs, trends and differences go on over the ends of chunks, and over values that aren't finite."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, 40).astype(float)
    x[[0, 5, 6, 7, 20, 39]] = np.nan
    v = x[~np.isnan(x)]
    s = series(spark, x)
    d, d2 = np.diff(v), np.diff(v, 2)
    got = prof.diff(s).first()
    assert got["unique_count"] == len(set(d)) and math.isclose(got["mean"], d.sum() / 39) and got["zero_ratio"] == (d == 0).sum() / 39
    assert prof.second_diff(s).first()["max"] == d2.max()
    signs = [t for t in np.sign(d) if t]
    assert prof.trend(s).first()["change_points"] == sum(a != b for a, b in zip(signs, signs[1:]))
    lengths = np.diff(np.r_[0, np.flatnonzero(d) + 1, len(v)])
    run = prof.runs(s).first()
    assert (run["run_count"], run["max_run_length"]) == (len(lengths), lengths.max())
    assert math.isclose(run["in_run_ratio"], 1 - (lengths[:-1] == 1).sum() / 40)
    whole = series(spark, v)
    assert np.allclose(values_of(xf.delta2_recover(xf.delta2(whole))), v)
    assert values_of(enc.rle_decode(enc.rle(whole))) == v.tolist()
    assert len(values_of(enc.adjacent_bits(whole), "bits_xor")) == len(v) - 1
    if small_chunks == 12:
        c = x - np.nanmean(x)
        want = [np.nanmean(c[k:] * c[:-k]) / np.nanvar(x) for k in range(1, 11)]
        assert np.allclose(prof.autocorrelation(s).first()["auto_correlation"], want)
        assert prof.periodicity(series(spark, [0, 1, 5, 1] * 20), 12).first()["periodicity"] == 4
    else:
        with pytest.raises(ValueError):
            prof.autocorrelation(s, 4)


def test_spread_numbering_is_the_plain_one(spark):
    rng = np.random.default_rng(7)
    rows = [(int(k), "ab"[int(rng.random() < 0.8)], float(k)) for k in rng.permutation(2000)]
    df = spark.createDataFrame(rows, "t int, k string, v double").repartition(7)
    plain, spread = (sorted(map(tuple, to_series(df, ["t"], "v", "k", spread=s).collect())) for s in (False, True))
    assert plain == spread
    assert to_series(df.limit(0), ["t"], "v", spread=True).count() == 0


def test_parts_of_doubles(spark):
    from tidegauge.functions import floats

    df = spark.createDataFrame([(3.25,), (-3.25,), (0.3,), (0.0,), (float("inf"),), (None,)], "v double")
    v = F.col("v")
    got = df.select(floats.split_mantissa(v), floats.split_exponent(v), floats.whole_part(v)).collect()
    assert tuple(got[0]) == (0.8125, 2, 3.0) and tuple(got[1]) == (-0.8125, 2, -3.0) and tuple(got[2])[:2] == (0.3, 0)
    assert got[4][1] is None and got[5][0] is None
    assert df.select(floats.fraction_part(v)).collect()[1][0] == -0.25
    word = lambda x: int(np.float64(x).view(np.uint64))
    # 3.25: sign, exponent and one bit of the whole part, then 25 = 0b11001, lowest bit first
    assert f"{word(floats.with_decimal_fraction(3.25)):064b}" == f"{word(3.0):064b}"[:13] + "10011" + "0" * 46
    assert floats.with_decimal_fraction(1e300) == 1e300
    assert df.select(floats.decimal_fraction(v)).collect()[5][0] is None


def test_erased_bits(spark):
    rows = enc.erased_bits(packed(series(spark, [1.1, 1.1, 1.2]), 10)).orderBy("at").collect()
    assert [r["at"] for r in rows] == [1, 2] and rows[0]["direct_xor"] == 0
    trailing = lambda x: (x & -x).bit_length()
    assert trailing(rows[1]["erased_xor"]) > trailing(rows[1]["direct_xor"])
