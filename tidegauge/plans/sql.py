"""The series queries in DuckDB's SQL."""

from __future__ import annotations

from ..codecs import CODECS
from . import file_queries

EVENTS = "s AS (SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos, value FROM events WHERE value IS NOT NULL)"
PRICES = "s AS (SELECT o_orderstatus AS series_id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS pos, o_totalprice AS value, CAST(CAST(o_totalprice AS DECIMAL(20,4)) AS VARCHAR) AS raw FROM orders WHERE o_totalprice IS NOT NULL)"
KEYS = "s AS (SELECT 'all' AS series_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, CAST(o_orderkey AS DOUBLE) AS value FROM orders)"
WAVES = "s AS (SELECT 'all' AS series_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 12 AS DOUBLE) AS value FROM orders)"
W = "OVER (PARTITION BY series_id ORDER BY pos)"
UPTO = "OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
EARLIER = "OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
ALL = "OVER (PARTITION BY series_id)"


def lines(value: str) -> str:
    return f"s AS (SELECT l_returnflag AS series_id, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS pos, {value} AS value FROM lineitem WHERE {value} IS NOT NULL)"


SPARSE = lines("CASE WHEN l_discount = 0.1 THEN l_tax ELSE 0.0 END")
DIFFS = f"d AS (SELECT *, value - lag(value) {W} AS d1 FROM s), e AS (SELECT *, d1 - lag(d1) {W} AS d2 FROM d)"
BITS = "b AS (SELECT *, (value::DOUBLE)::BIT::BIGINT AS bits FROM s)"


def each(source: str, columns: str, more: str = "") -> str:
    """columns over every value."""
    return f"WITH {source}{more} SELECT series_id, pos, {columns} FROM s"


def per_series(source: str, columns: str, frm: str = "s", more: str = "") -> str:
    return f"WITH {source}{more} SELECT series_id, {columns} FROM {frm} GROUP BY series_id"


def difference_stats(d: str, short_by: int) -> str:
    n = f"(count(*) - {short_by})"
    return per_series(EVENTS, f"""round(min({d}), 6) AS min, round(max({d}), 6) AS max, round(sum({d}) / {n}, 6) AS mean, round(stddev_pop({d}), 6) AS std_dev,
        round(max({d}) - min({d}), 6) AS range, round(count(*) FILTER (WHERE abs({d}) < 1e-10) / {n}, 6) AS zero_ratio,
        count(DISTINCT {d}) AS unique_count, round(count(DISTINCT {d}) / count(*), 6) AS unique_ratio""", "e", f", {DIFFS}")  # fmt: skip


def wrapped(operator: str) -> str:
    """bits and the bits before added or subtracted modulo 2^64."""
    x = f"((CAST(bits AS HUGEINT) {operator} before) % 18446744073709551616 + 18446744073709551616) % 18446744073709551616"
    return f"CAST(CASE WHEN {x} >= 9223372036854775808 THEN {x} - 18446744073709551616 ELSE {x} END AS BIGINT)"


RUNS = f"""f AS (SELECT *, CASE WHEN lag(value) {W} = value THEN 0 ELSE 1 END AS new FROM s), g AS (SELECT *, sum(new) {UPTO} AS run FROM f),
    r AS (SELECT series_id, CAST(run AS BIGINT) AS run, min(pos) AS start, any_value(value) AS value, count(*) AS length FROM g GROUP BY series_id, run)"""
LAGS = range(1, 11)
CENTRED = f"c AS (SELECT *, value - avg(value) {ALL} AS c FROM s)"
#: Lags up to 100, of which 99 can be a maximum.
PEAKS = 101


def basic(source: str) -> str:
    return per_series(source, """count(*) AS n, count(*) AS n_finite, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
        round(stddev_pop(value), 6) AS std_dev, round(var_pop(value), 6) AS variance, round(avg((value - m) ** 3) / stddev_pop(value) ** 3, 6) AS skewness, round(avg((value - m) ** 4) / var_pop(value) ** 2, 6) AS kurtosis,
        round(max(value) - min(value), 6) AS range, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3""",
        "t", f", t AS (SELECT *, avg(value) {ALL} AS m FROM s)")


def value_props(source: str) -> str:
    return per_series(source, """count(DISTINCT value) AS unique_count, round(count(DISTINCT value) / count(*), 6) AS unique_ratio, count(*) FILTER (WHERE value = 0) AS zero_count,
        round(count(*) FILTER (WHERE value = 0) / count(*), 6) AS zero_ratio, count(*) FILTER (WHERE value = floor(value)) AS integer_count, round(count(*) FILTER (WHERE value = floor(value)) / count(*), 6) AS integer_ratio""")


def trend(source: str) -> str:
    return per_series(source, "round(coalesce(sum(t) / nullif(count(t), 0), 0), 6) AS monotonicity, count(*) FILTER (WHERE t <> before) AS change_points", "u",
        f", d AS (SELECT *, nullif(sign(value - lag(value) {W}), 0) AS t FROM s), u AS (SELECT *, last_value(t IGNORE NULLS) {EARLIER} AS before FROM d)")


def runs(source: str) -> str:
    return per_series(source, """max(length) AS max_run_length, round(avg(length), 6) AS avg_run_length, count(*) AS run_count, round(count(*) FILTER (WHERE length > 1) / count(*), 6) AS constant_run_ratio,
        round(1 - count(*) FILTER (WHERE length = 1 AND run < runs) / sum(length), 6) AS in_run_ratio""", "q", f", {RUNS}, q AS (SELECT *, max(run) {ALL} AS runs FROM r)")


def bits(source: str) -> str:
    return f"""WITH {source}, {BITS}, x AS (SELECT *, ((bits >> 52) & 2047) - 1023 AS e, bits & 4503599627370495 AS m, (lag(value) {W} < 0) <> (value < 0) AS flip FROM b),
        c AS (SELECT series_id, e, count(*) AS n FROM x GROUP BY ALL), k AS (SELECT series_id, arg_min(e, (-n, e)) AS common_exponent FROM c GROUP BY series_id),
        m AS (SELECT series_id, m, count(*) AS n FROM x GROUP BY ALL), h AS (SELECT series_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS mantissa_entropy FROM m GROUP BY series_id)
        SELECT series_id, round(avg(bit_count(bits)), 6) AS avg_set_bits, CAST(count(*) FILTER (WHERE flip) AS BIGINT) AS sign_changes, CAST(max(e) - min(e) AS BIGINT) AS exponent_range,
        CAST(any_value(common_exponent) AS BIGINT) AS common_exponent, round(any_value(mantissa_entropy), 6) AS mantissa_entropy FROM x JOIN k USING (series_id) JOIN h USING (series_id) GROUP BY series_id"""


def entropy(source: str) -> str:
    return per_series(source, "round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy", "c",
        f", x AS (SELECT series_id, value, min(value) {ALL} AS low, max(value) {ALL} AS high FROM s), y AS (SELECT series_id, CASE WHEN high > low THEN least(99, CAST(trunc((value - low) / ((high - low) / 100)) AS INTEGER)) ELSE 0 END AS bin FROM x), c AS (SELECT series_id, bin, count(*) AS n FROM y GROUP BY ALL)")


def autocorr(source: str) -> str:
    return per_series(source, ", ".join(f"round(avg(c * c{k}) / var_pop(c), 6) AS r{k}" for k in LAGS), "x",
        f", {CENTRED}, x AS (SELECT *, {', '.join(f'lag(c, {k}) {W} AS c{k}' for k in LAGS)} FROM c)")


def periodicity(source: str) -> str:
    return f"""WITH {source}, {CENTRED}, x AS (SELECT *, {', '.join(f'lag(c, {k}) {W} AS c{k}' for k in range(1, PEAKS))} FROM c),
        y AS (SELECT series_id, [{', '.join(f'avg(c * c{k}) / var_pop(c)' for k in range(1, PEAKS))}] AS r FROM x GROUP BY series_id),
        z AS (SELECT series_id, unnest(range(2, {PEAKS - 1})) AS k, r FROM y)
        SELECT series_id, min(k) AS periodicity, round(arg_min(r[k], k), 6) AS periodic_score FROM z WHERE r[k] > r[k - 1] AND r[k] > r[k + 1] AND r[k] > 0.5 GROUP BY series_id"""


def vector() -> str:
    """The features in the vector's order, a row each, from the families' own queries."""
    parts = {"b": basic(EVENTS), "u": value_props(EVENTS), "d": difference_stats("d1", 1), "e": difference_stats("d2", 2), "t": trend(EVENTS), "r": runs(EVENTS), "i": bits(EVENTS), "h": entropy(EVENTS), "a": autocorr(EVENTS)}
    names = [f"b.{c}" for c in ("min", "max", "mean", "median", "std_dev", "variance", "skewness", "kurtosis", "range", "iqr", "q1", "q3")]
    names += [f"u.{c}_{x}" for c in ("unique", "zero", "integer") for x in ("count", "ratio")]
    names += [f"{p}.{c}" for p in "de" for c in ("min", "max", "mean", "std_dev", "range", "zero_ratio", "unique_count", "unique_ratio")]
    names += ["t.monotonicity", "e.std_dev", "t.change_points"] + [f"r.{c}" for c in ("max_run_length", "avg_run_length", "run_count", "constant_run_ratio")]
    names += [f"i.{c}" for c in ("avg_set_bits", "sign_changes", "mantissa_entropy", "exponent_range", "common_exponent")] + ["h.entropy", "0", "0"]
    names += [f"a.r{k}" for k in LAGS] + ["coalesce(p.periodicity, 0)", "coalesce(p.periodic_score, 0)"]
    joined = " JOIN ".join(f"({q}) {k}" + (" USING (series_id)" if k != "b" else "") for k, q in parts.items())
    values = ", ".join(f"CAST({n} AS DOUBLE)" for n in names)
    return f"SELECT series_id, unnest(range({len(names)})) AS k, unnest([{values}]) AS value FROM {joined} LEFT JOIN ({periodicity(EVENTS)}) p USING (series_id)"


FALLING = "s AS (SELECT 'all' AS series_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, -CAST(o_orderkey AS DOUBLE) AS value FROM orders)"
SHIFTED = lines("l_quantity - 25")
TEXT = "t AS (SELECT *, CAST((value::DOUBLE)::BIT AS VARCHAR) AS t FROM s)"
#: The whole digits and the decimals of a value's text.
DIGITS = "d AS (SELECT *, split_part(CAST(abs(value) AS VARCHAR), '.', 1) AS whole, rtrim(split_part(CAST(abs(value) AS VARCHAR), '.', 2), '0') AS fraction FROM s)"


def gorilla_costs() -> str:
    """Bits by both forms, value by value: the window of leading and trailing zeros is carried along."""
    zeros = lambda x: f"CASE WHEN {x} = 0 THEN 64 ELSE strpos(CAST(({x})::BIT AS VARCHAR), '1') - 1 END AS {x}_lead, CASE WHEN {x} = 0 THEN 64 ELSE strpos(reverse(CAST(({x})::BIT AS VARCHAR)), '1') - 1 END AS {x}_trail"
    fits = lambda x: f"w.{x}_l IS NOT NULL AND n.{x}_lead >= w.{x}_l AND n.{x}_trail >= w.{x}_t"
    cost = lambda x: f"CASE WHEN n.{x} = 0 THEN 1 WHEN {fits(x)} THEN 66 - w.{x}_l - w.{x}_t ELSE 78 - n.{x}_lead - n.{x}_trail END"
    kept = lambda x, c, full: f"CASE WHEN n.{x} = 0 OR ({fits(x)}) THEN w.{x}_{c} ELSE n.{x}_{full} END"
    states = ", ".join(kept(x, c, full) for x in ("o", "u") for c, full in (("l", "lead"), ("t", "trail")))
    # two words that differ have neither all bits alike nor a difference of 0
    return f"""WITH RECURSIVE {EVENTS}, {BITS}, g AS (SELECT series_id, pos // 1000 AS segment_id, CAST(pos % 1000 AS INTEGER) AS k, bits, lag(bits) OVER (PARTITION BY series_id, pos // 1000 ORDER BY pos) AS before FROM b),
        x AS (SELECT *, xor(bits, before) AS o, {wrapped('-')} AS u FROM g), n AS MATERIALIZED (SELECT *, {zeros('o')}, {zeros('u')} FROM x),
        w AS (SELECT series_id, segment_id, k, 64 AS xor_bits, 64 AS sub_bits, CAST(NULL AS BIGINT) AS o_l, CAST(NULL AS BIGINT) AS o_t, CAST(NULL AS BIGINT) AS u_l, CAST(NULL AS BIGINT) AS u_t FROM n WHERE k = 0
            UNION ALL SELECT n.series_id, n.segment_id, n.k, {cost('o')}, {cost('u')}, {states} FROM w JOIN n ON n.series_id = w.series_id AND n.segment_id = w.segment_id AND n.k = w.k + 1)
        SELECT series_id, segment_id, k AS "at", CAST(xor_bits AS BIGINT) AS xor_bits, CAST(sub_bits AS BIGINT) AS sub_bits FROM w"""


ORACLE_SQL: dict[str, str] = {
    "profile_basic": basic(EVENTS),
    "profile_quantiles": per_series(EVENTS, ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p:02d}" for p in (5, 25, 50, 75, 95))),
    "profile_value_props": value_props(lines("l_discount")),
    "profile_diff": difference_stats("d1", 1),
    "profile_second_diff": difference_stats("d2", 2),
    "profile_trend": trend(lines("l_quantity")),
    "profile_runs": runs(lines("l_discount")),
    "profile_bits": bits(EVENTS),
    "profile_entropy": entropy(EVENTS),
    "profile_mantissa_entropy": per_series(lines("l_quantity"), "round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS mantissa_entropy", "c",
        f", {BITS}, c AS (SELECT series_id, bits & 4503599627370495 AS m, count(*) AS n FROM b GROUP BY ALL)"),
    "profile_autocorr": autocorr(EVENTS),
    "profile_periodicity": periodicity(WAVES),
    "profile_vector": vector(),
    "xf_delta": each(EVENTS, f"round(value - coalesce(lag(value) {W}, 0), 6) AS value"),
    "xf_delta_recover": each(KEYS, "value"),
    "xf_delta2": f"WITH {EVENTS}, d AS (SELECT series_id, pos, value - coalesce(lag(value) {W}, 0) AS value FROM s) SELECT series_id, pos, round(value - coalesce(lag(value) {W}, 0), 6) AS value FROM d",
    "xf_delta2_recover": each(KEYS, "value"),
    "xf_ranged": each(EVENTS, f"round(value - min(value) {ALL}, 6) AS value, round(min(value) {ALL}, 6) AS base"),
    "xf_ranged_recover": each(EVENTS, "round(value, 6) AS value"),
    "xf_log": each(EVENTS, f'round(ln(value + 1 - min(value) {ALL}), 6) AS value, round(1 - min(value) {ALL}, 6) AS "offset"'),
    "xf_log_recover": each(EVENTS, "round(value, 6) AS value"),
    "xf_minmax": each(EVENTS, f"round((value - min(value) {ALL}) / (max(value) {ALL} - min(value) {ALL}), 6) AS value, round(min(value) {ALL}, 6) AS low, round(max(value) {ALL}, 6) AS high"),
    "xf_minmax_recover": each(EVENTS, "round(value, 6) AS value"),
    "xf_zscore": each(EVENTS, f"round((value - avg(value) {ALL}) / stddev_pop(value) {ALL}, 6) AS value, round(avg(value) {ALL}, 6) AS mean, round(stddev_pop(value) {ALL}, 6) AS std"),
    "xf_zscore_recover": each(EVENTS, "round(value, 6) AS value"),
    "xf_precision": each(EVENTS, "CAST(trunc(value * 10.0::DOUBLE) AS BIGINT) AS value"),
    "xf_precision_round": each(EVENTS, "CAST(trunc(value * 10.0::DOUBLE + CASE WHEN value >= 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END) AS BIGINT) AS value"),
    "xf_discrete": each(lines("l_quantity"), f"CAST(trunc(value - min(value) {ALL} + 0.5) AS BIGINT) AS value, min(value) {ALL} AS base"),
    "xf_discrete_recover": each(lines("l_quantity"), "value"),
    "xf_enum_index": f"WITH {lines('l_quantity')}, f AS (SELECT series_id, value, row_number() OVER (PARTITION BY series_id ORDER BY min(pos)) - 1 AS k FROM s GROUP BY series_id, value), n AS (SELECT series_id, count(*) AS kinds FROM f GROUP BY series_id), t AS (SELECT series_id, count(*) AS n FROM s GROUP BY series_id) SELECT series_id, pos, k AS value FROM s JOIN f USING (series_id, value) JOIN n USING (series_id) JOIN t USING (series_id) WHERE kinds <= greatest(1, t.n // 100)",
    "xf_enum_recover": each(lines("l_quantity"), "value") + " WHERE series_id IN (SELECT series_id FROM s GROUP BY series_id HAVING count(DISTINCT value) <= greatest(1, count(*) // 100))",
    "xf_steps": f"WITH {KEYS}, d AS (SELECT *, CAST(value - lag(value) {W} AS BIGINT) AS d FROM s) SELECT series_id, pos, d AS value FROM d WHERE d IS NOT NULL",
    "xf_identity": each(EVENTS, "round(value, 6) AS value"),
    "xf_precision_recover": each(EVENTS, "round(CAST(trunc(value * 10.0::DOUBLE + CASE WHEN value >= 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END) AS BIGINT) / 10.0::DOUBLE, 6) AS value"),
    "xf_less_min": each(EVENTS, "round(value - 5.0::DOUBLE, 6) AS value"),
    "xf_less_min_recover": each(EVENTS, "round(value, 6) AS value"),
    "xf_steps_recover": f"WITH {KEYS}, d AS (SELECT series_id, pos, 100 + value - first_value(value) {W} AS value FROM s) SELECT * FROM d WHERE pos > 0",
    "xf_steps_falling": f"WITH {FALLING}, d AS (SELECT series_id, pos, CAST(lag(value) {W} - value AS BIGINT) AS value FROM s) SELECT * FROM d WHERE pos > 0",
    "xf_enum_nearest": f"""WITH {lines('l_quantity')}, f AS (SELECT series_id, value AS e, row_number() OVER (PARTITION BY series_id ORDER BY min(pos)) - 1 AS k FROM s WHERE value % 10 = 5 GROUP BY series_id, value)
        SELECT s.series_id, pos, arg_min(k, (abs(e - value), k)) AS value FROM s JOIN f USING (series_id) GROUP BY s.series_id, pos""",
    "cons_range": per_series(PRICES, "round(min(value), 6) AS min_value, round(max(value), 6) AS max_value"),
    "cons_precision": f"""WITH {PRICES}, p AS (SELECT series_id, length(rtrim(regexp_extract(raw, '[.](.*)$', 1), '0')) AS places FROM s), c AS (SELECT series_id, places, count(*) AS n FROM p GROUP BY ALL)
        SELECT series_id, CAST(max(places) AS INTEGER) AS precision, '{{' || string_agg('"' || places || '":' || n, ',' ORDER BY places) || '}}' AS precision_distribution FROM c GROUP BY series_id""",
    "cons_enum": f"""WITH {lines('l_discount')}, f AS (SELECT series_id, value, min(pos) AS first, count(*) AS c FROM s GROUP BY series_id, value)
        SELECT series_id, string_agg(printf('%.2f', value), ' ' ORDER BY first) AS enumeration FROM f GROUP BY series_id HAVING count(*) <= greatest(1, sum(c) // 100)""",
    "cons_monotonic": per_series(KEYS, "CAST(CASE WHEN coalesce(bool_and(d > 0), true) THEN 2 WHEN bool_and(d < 0) THEN -2 WHEN bool_and(d >= 0) THEN 1 WHEN bool_and(d <= 0) THEN -1 ELSE 0 END AS INTEGER) AS monotonicity", "d", f", d AS (SELECT *, value - lag(value) {W} AS d FROM s)"),
    "cons_sign": per_series(PRICES, "bool_or(value > 0) AS allow_positive, bool_or(value < 0) AS allow_negative, NOT (bool_or(value > 0) AND bool_or(value < 0)) AS sign"),
    "cons_discrete_min": f"""WITH {lines('l_quantity')}, d AS (SELECT *, abs(value - lag(value) {W}) AS a FROM s), k AS (SELECT DISTINCT series_id, round(a, 10) AS a FROM d WHERE a >= 1e-10),
        l AS (SELECT series_id, min(a) AS least, count(*) AS kinds FROM k GROUP BY series_id), o AS (SELECT series_id, bool_and(abs(a / least - floor(a / least + 0.5)) <= 1e-10) AS whole FROM k JOIN l USING (series_id) GROUP BY series_id),
        t AS (SELECT series_id, max(value) - min(value) AS rng, count(*) AS n FROM s GROUP BY series_id)
        SELECT series_id, CASE WHEN rng > 0 AND least > rng / 10000 AND (whole AND kinds > 1 OR kinds <= 2 AND kinds < n // 5) THEN round(least, 6) ELSE 0.0 END AS discrete_step FROM t JOIN l USING (series_id) JOIN o USING (series_id)""",
    "cons_discrete_mode": f"""WITH {KEYS}, d AS (SELECT *, abs(value - lag(value) {W}) AS a FROM s), k AS (SELECT series_id, round(a, 10) AS a, count(*) AS c FROM d WHERE a >= 1e-10 GROUP BY ALL),
        t AS (SELECT series_id, count(*) AS n FROM s GROUP BY series_id), b AS (SELECT series_id, arg_min(a, (-c, a)) AS a, max(c) AS c FROM k GROUP BY series_id)
        SELECT series_id, CASE WHEN c > n // 2 THEN round(a, 6) ELSE 0.0 END AS discrete_step FROM t JOIN b USING (series_id)""",
    "cons_sparse": per_series(SPARSE, "round(count(*) FILTER (WHERE value = 0) / count(*), 6) AS zero_ratio, count(*) FILTER (WHERE value = 0) / count(*) >= 0.9 AS sparse"),
    "cons_validate": f"""WITH {PRICES}, q AS (SELECT series_id, quantile_cont(value, 0.05) AS low, quantile_cont(value, 0.95) AS high, count(*) FILTER (WHERE value = 0) / count(*) AS zeros FROM s GROUP BY series_id),
        x AS (SELECT s.*, low, high, lag(value) {W} AS before, length(rtrim(regexp_extract(raw, '[.](.*)$', 1), '0')) AS places FROM s JOIN q USING (series_id)),
        y AS (SELECT series_id, pos, round(value, 6) AS value, CASE WHEN value < low OR value > high THEN 1 WHEN places > 1 THEN 0 WHEN value < before THEN 3 WHEN value < 0 THEN 4 END AS constraint_type FROM x)
        SELECT * FROM y WHERE constraint_type IS NOT NULL UNION ALL SELECT series_id, -1, round(zeros, 6), 6 FROM q WHERE zeros < 0.9""",
    "cons_detect": f"""WITH {lines('l_quantity')}, d AS (SELECT *, value - lag(value) {W} AS d FROM s), f AS (SELECT series_id, value, min(pos) AS first, count(*) AS c FROM s GROUP BY series_id, value),
        e AS (SELECT series_id, string_agg(printf('%.2f', value), ' ' ORDER BY first) AS enumeration FROM f GROUP BY series_id HAVING count(*) <= greatest(1, sum(c) // 100)),
        k AS (SELECT DISTINCT series_id, round(abs(d), 10) AS a FROM d WHERE abs(d) >= 1e-10), l AS (SELECT series_id, min(a) AS least, count(*) AS kinds FROM k GROUP BY series_id),
        o AS (SELECT series_id, bool_and(abs(a / least - floor(a / least + 0.5)) <= 1e-10) AS whole FROM k JOIN l USING (series_id) GROUP BY series_id),
        t AS (SELECT series_id, count(*) AS n, min(value) AS min_value, max(value) AS max_value, CAST(CASE WHEN bool_and(value = floor(value)) THEN 0 END AS INTEGER) AS precision,
            CAST(CASE WHEN coalesce(bool_and(d > 0), true) THEN 2 WHEN bool_and(d < 0) THEN -2 WHEN bool_and(d >= 0) THEN 1 WHEN bool_and(d <= 0) THEN -1 ELSE 0 END AS INTEGER) AS monotonicity,
            bool_or(value > 0) AS allow_positive, bool_or(value < 0) AS allow_negative, round(count(*) FILTER (WHERE value = 0) / count(*), 6) AS zero_ratio FROM d GROUP BY series_id)
        SELECT series_id, precision, min_value, max_value, enumeration, monotonicity, allow_positive, allow_negative, NOT (allow_positive AND allow_negative) AS sign,
            CASE WHEN max_value > min_value AND least > (max_value - min_value) / 10000 AND (whole AND kinds > 1 OR kinds <= 2 AND kinds < n // 5) THEN least ELSE 0.0 END AS discrete_step, zero_ratio, zero_ratio >= 0.9 AS sparse
        FROM t LEFT JOIN e USING (series_id) LEFT JOIN l USING (series_id) LEFT JOIN o USING (series_id)""",
    "cons_detect_text": f"""WITH {PRICES}, d AS (SELECT *, value - lag(value) {W} AS d, length(rtrim(regexp_extract(raw, '[.](.*)$', 1), '0')) AS places FROM s),
        k AS (SELECT series_id, round(abs(d), 10) AS a, count(*) AS c FROM d WHERE abs(d) >= 1e-10 GROUP BY ALL), m AS (SELECT series_id, arg_min(a, (-c, a)) AS a, max(c) AS c FROM k GROUP BY series_id),
        f AS (SELECT series_id, value, min(pos) AS first, count(*) AS c FROM s GROUP BY series_id, value), e AS (SELECT series_id, string_agg(printf('%.2f', value), ' ' ORDER BY first) AS enumeration FROM f GROUP BY series_id HAVING count(*) <= greatest(1, sum(c) // 100)),
        t AS (SELECT series_id, count(*) AS n, min(value) AS min_value, max(value) AS max_value, CAST(max(places) AS INTEGER) AS precision,
            CAST(CASE WHEN coalesce(bool_and(d > 0), true) THEN 2 WHEN bool_and(d < 0) THEN -2 WHEN bool_and(d >= 0) THEN 1 WHEN bool_and(d <= 0) THEN -1 ELSE 0 END AS INTEGER) AS monotonicity,
            bool_or(value > 0) AS allow_positive, bool_or(value < 0) AS allow_negative, round(count(*) FILTER (WHERE value = 0) / count(*), 6) AS zero_ratio FROM d GROUP BY series_id)
        SELECT series_id, precision, round(min_value, 6) AS min_value, round(max_value, 6) AS max_value, enumeration, monotonicity, allow_positive, allow_negative, allow_positive OR allow_negative AS sign,
            CASE WHEN c > n // 2 THEN round(a, 6) ELSE 0.0 END AS discrete_step, zero_ratio, zero_ratio >= 0.9 AS sparse FROM t LEFT JOIN e USING (series_id) LEFT JOIN m USING (series_id)""",
    "cons_validate_enum": each(lines("l_quantity"), "value, CAST(2 AS INTEGER) AS constraint_type") + " WHERE NOT (value = floor(value) AND value BETWEEN 1 AND 40)",
    "cons_validate_sign": each(SHIFTED, "value, CAST(4 AS INTEGER) AS constraint_type") + " WHERE value < 0",
    "cons_validate_step": f"WITH {lines('l_quantity')}, x AS (SELECT *, lag(value) {W} AS before, min(value) {ALL} AS low FROM s) SELECT series_id, pos, value, CAST(5 AS INTEGER) AS constraint_type FROM x WHERE before IS NOT NULL AND (value - low) % 2 <> 0",
    "cons_validate_falling": each(FALLING, "value, CAST(3 AS INTEGER) AS constraint_type") + " WHERE pos > 0",
    "cons_validate_relaxed": f"WITH {SHIFTED}, x AS (SELECT *, lag(value) {W} AS before FROM s), y AS (SELECT series_id, pos, value, CAST(CASE WHEN value < before THEN 3 WHEN value < 0 THEN 4 END AS INTEGER) AS constraint_type FROM x) SELECT * FROM y WHERE constraint_type IS NOT NULL",
    "cons_flags": f"""WITH {lines('l_quantity')}, f AS (SELECT series_id, value, count(*) AS c FROM s GROUP BY series_id, value), e AS (SELECT series_id, count(*) <= greatest(1, sum(c) // 100) AS enumeration FROM f GROUP BY series_id)
        SELECT series_id, true AS precision, false AS range, enumeration, false AS monotonicity, true AS sign, true AS discrete, false AS sparse, true AS any FROM e""",
    "cons_anomalies": f"""WITH {SHIFTED} SELECT series_id, pos, CASE WHEN abs(value) > 20 THEN printf('[range] %d: %.6f (out of range [-20.000000, 20.000000])', pos, value)
        ELSE printf('[sign] %d: %.6f (negative values not allowed)', pos, value) END AS line FROM s WHERE abs(value) > 20 OR value < 0""",
    "cons_report": f"""WITH {lines('l_quantity')}, f AS (SELECT series_id, value, min(pos) AS first, count(*) AS c FROM s GROUP BY series_id, value),
        e AS (SELECT series_id, 'enumeration: [' || string_agg(printf('%.1f', value), ',' ORDER BY first) || ']' AS line FROM f GROUP BY series_id HAVING count(*) <= greatest(1, sum(c) // 100))
        SELECT series_id, unnest(['precision: 0 decimals', printf('range: [%.6f, %.6f]', min(value), max(value)), 'sign: positive true, negative false', 'discrete: step 1.000000']) AS line FROM s GROUP BY series_id UNION ALL SELECT * FROM e""",
    "precision_distribution": f"WITH {PRICES}, p AS (SELECT series_id, CAST(length(rtrim(regexp_extract(raw, '[.](.*)$', 1), '0')) AS INTEGER) AS places FROM s), c AS (SELECT series_id, places, count(*) AS c FROM p GROUP BY ALL) SELECT *, round(100 * c / sum(c) {ALL}, 6) AS percent FROM c",
    "text_decimals": f"WITH {PRICES} SELECT series_id, pos, length(rtrim(regexp_extract(raw, '[.](.*)$', 1), '0')) AS places FROM s",
    "rle_encode": f"WITH {lines('l_discount')}, {RUNS} SELECT series_id, run, start, round(value, 6) AS value, length FROM r",
    "rle_decode": each(lines("l_discount"), "round(value, 6) AS value"),
    "freq_value": f"WITH {lines('l_quantity')} SELECT series_id, value, count(*) AS c FROM s GROUP BY series_id, value",
    "freq_byte": f"""WITH {lines('l_quantity')}, {BITS}, y AS (SELECT series_id, CAST((bits >> (8 * k)) & 255 AS INTEGER) AS byte FROM b, range(8) t(k)), c AS (SELECT series_id, byte, count(*) AS n FROM y GROUP BY ALL),
        e AS (SELECT series_id, CAST(byte AS INTEGER) AS byte FROM (SELECT DISTINCT series_id FROM s), range(256) t(byte)), f AS (SELECT series_id, byte, coalesce(n, 0) + 1 AS c FROM e LEFT JOIN c USING (series_id, byte))
        SELECT *, CAST(coalesce(sum(c) OVER (PARTITION BY series_id ORDER BY byte ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS below FROM f""",
    "bits_adjacent": f"WITH {EVENTS}, {BITS}, x AS (SELECT *, lag(bits) {W} AS before FROM b) SELECT series_id, pos, bits, xor(bits, before) AS bits_xor, {wrapped('+')} AS bits_add, {wrapped('-')} AS bits_sub FROM x WHERE before IS NOT NULL",
    "bits_text": each(EVENTS, "printf('%.10f', value) || chr(9) || CAST((value::DOUBLE)::BIT AS VARCHAR) AS line"),
    "bit_counts": f"WITH {EVENTS}, {TEXT} SELECT series_id, pos, CAST(CASE WHEN strpos(t, '1') = 0 THEN 64 ELSE strpos(t, '1') - 1 END AS INTEGER) AS leading, CAST(CASE WHEN strpos(t, '1') = 0 THEN 64 ELSE strpos(reverse(t), '1') - 1 END AS INTEGER) AS trailing, CAST(CAST(reverse(t) AS BIT) AS BIGINT) AS reversed FROM t",
    "digit_counts": f"""WITH {EVENTS}, {DIGITS}, a AS (SELECT *, length(fraction) AS alpha, CASE WHEN abs(value) >= 1 THEN length(whole) - 1 ELSE length(ltrim(fraction, '0')) - length(fraction) - 1 END AS sp FROM d)
        SELECT series_id, pos, CAST(CASE WHEN value <> 0 THEN alpha END AS INTEGER) AS alpha, CAST(CASE WHEN value <> 0 THEN sp + alpha + 1 END AS INTEGER) AS beta,
            CAST(CASE WHEN value = 0 THEN NULL WHEN abs(value) < 1 AND ltrim(fraction, '0') = '1' THEN 0 ELSE sp + alpha + 1 END AS INTEGER) AS beta_star, CAST(CASE WHEN value <> 0 THEN ceil(alpha * log2(10)) END AS INTEGER) AS fraction_bits FROM a""",
    "bit_costs": gorilla_costs(),
    # decimals of what is left of the whole part, which may have more digits than the value's text
    "decimal_fractions": f"""WITH {EVENTS}, {TEXT}, x AS (SELECT *, rtrim(split_part(CAST(abs(value) - floor(abs(value)) AS VARCHAR), '.', 2), '0') AS fraction, 12 + CAST(((value::DOUBLE)::BIT::BIGINT >> 52) & 2047 AS INTEGER) - 1023 AS keep FROM t)
        SELECT series_id, pos, value, CASE WHEN keep BETWEEN 1 AND 63 THEN CAST(CAST(substr(t, 1, keep) || substr(reverse(CAST(CAST(coalesce(nullif(fraction, ''), '0') AS UBIGINT)::BIT AS VARCHAR)), 1, 64 - keep) AS BIT) AS DOUBLE) ELSE value END AS rewritten FROM x""",
    "float_parts": f"""WITH {EVENTS}, {BITS}, e AS (SELECT *, CASE WHEN abs(value) < 1 THEN 0 ELSE ((bits >> 52) & 2047) - 1022 END AS exponent FROM b)
        SELECT series_id, pos, value / pow(2.0, exponent) AS mantissa, exponent, trunc(value) AS whole, value - trunc(value) AS fraction FROM e""",
    "segment_tumbling": f"WITH {EVENTS} SELECT series_id, pos // 1000 AS segment_id, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high FROM s GROUP BY ALL HAVING count(*) = 1000",
    **{f"codec_roundtrip_{name}": f"WITH {EVENTS} SELECT series_id, pos // 1000 AS segment_id, CAST(count(*) AS INTEGER) AS n, true AS round_trip_ok FROM s GROUP BY ALL" for name in [*CODECS, "chosen"]},
    **file_queries.ORACLE_SQL,
    "src_feature_records": f"""SELECT min, max, mean, median, unique_count, diff_mean, run_count FROM ({basic(EVENTS)}) b JOIN ({value_props(EVENTS)}) u USING (series_id)
        JOIN (SELECT series_id, mean AS diff_mean FROM ({difference_stats('d1', 1)})) d USING (series_id) JOIN ({runs(EVENTS)}) r USING (series_id)""",
}
