import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.codecs import CODECS, constrained, dictionary, erasing
from tidegauge.codecs.words import words_of

RNG = np.random.default_rng(114514)
CASES = {
    "uniform": RNG.random(3000),
    "ramp": 20.0 + 0.01 * np.arange(1000),
    "constant": np.full(250, 3.5),
    "zeros": np.zeros(250),
    "special": np.array([0, 1, -1, 100, 0.001, 1e10, 1e-10, -0.0, np.nan, np.inf, -np.inf, 5e-324, 1.7e308, 1e17, -1e300]),
    "eight": np.array([1.23, 1.23, 2.5, 3.14159, 2.71828, 1.23, 0.57721, 1.41421]),
    "prices": np.round(RNG.normal(500, 30, 2000).cumsum() / 100, 2),
    "few": RNG.choice([1.0, 2.5, 7.25], 800),
    "rising": np.sort(np.round(RNG.random(500) * 100, 3)),
    "words": np.array([11123, 2123123, 12312313], np.uint64).view(np.float64),
    "bits": RNG.integers(0, 2**63, 300, dtype=np.uint64).view(np.float64),
    "one": np.array([1.23]),
    "none": np.zeros(0),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("name", CODECS)
def test_every_bit_comes_back(name, case):
    values = CASES[case]
    block = CODECS[name].encode(values)
    assert words_of(CODECS[name].decode(block, len(values))) == words_of(values)


@pytest.mark.parametrize("name", CODECS)
@settings(max_examples=25, deadline=None)
@given(values=st.lists(st.one_of(st.floats(width=64), st.decimals(-999, 999, places=2).map(float), st.sampled_from([0.0, 1.5])), max_size=60))
def test_any_doubles_come_back(name, values):
    array = np.array(values, np.float64)
    assert words_of(CODECS[name].decode(CODECS[name].encode(array), len(array))) == words_of(array)


def test_decimals_compress_better_by_what_is_known_of_them():
    size = {name: len(CODECS[name].encode(CASES["prices"])) for name in ("zstd", "numerical_zstd", "gorilla", "elf")}
    assert size["numerical_zstd"] < size["zstd"] and size["elf"] < size["gorilla"]


def test_constraints_round_trip_in_the_header():
    c = constrained.Constraints(3, -1.5, 7.25, (1.0, 2.0), -2, True, False, True, 0.25, True)
    assert constrained.Constraints.unpack(c.pack()) == (c, len(c.pack()))


def test_detection_of_a_block():
    c = constrained.detect(np.arange(500) * 0.5)
    assert (c.precision, c.monotonicity, c.step, c.min_value, c.max_value) == (1, 2, 0.5, 0.0, 249.5)
    assert constrained.detect(CASES["few"]).enumeration == tuple(dict.fromkeys(CASES["few"].tolist()))


def test_wrong_constraints_do_not_lose_bits():
    wrong = constrained.Constraints(precision=1, monotonicity=2)
    encode, decode = (lambda b: b), (lambda b: b)
    block = constrained.encode(CASES["special"], encode, wrong)
    assert words_of(constrained.decode(block, decode)) == words_of(CASES["special"])


def test_erased_values_are_restored():
    for value in CASES["prices"][:200].tolist():
        word = erasing.to_bits(value)
        short, places = erasing.erase(word)
        assert places is None or erasing.restore(short, places) == word


def test_simple8b_runs_and_limits():
    ones = [1] * 500 + [0, 3, 1 << 59]
    assert dictionary.simple8b_decode(dictionary.simple8b_encode(ones))[: len(ones)] == ones
    assert len(dictionary.simple8b_encode([0] * 240)) == 4
    with pytest.raises(ValueError):
        dictionary.simple8b_encode([1 << 60])


def test_odd_run_blocks_are_refused():
    with pytest.raises(ValueError):
        dictionary.rle_decode(b"12345678", 1)
