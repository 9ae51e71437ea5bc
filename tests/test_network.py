"""The network for all labels: its gradients against differences, what it learns, odd rows, files."""

import numpy as np
import pytest

from tidegauge.operators import network
from tidegauge.operators.learn import LABELS
from tidegauge.operators.profile import VECTOR

FIELDS = "series_id string, segment_id long, features array<double>, ranged int, scale int, del int, algo int"


def case(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(VECTOR)))
    y = np.stack([x[:, 0] > 0, x[:, 1] > 0, x[:, 2] > 0, 2 * (x[:, 3] > 0)], axis=1).astype(float)
    return x, y


def test_gradients_against_differences():
    x, y = case(24)
    rng = np.random.default_rng(1)
    net = network.Network.new(x, 4, (7, 5, 3), rng)
    scaled = net.scaled(x)
    loss = lambda: net.gradients(scaled, y, 0.0, rng)[0]
    for p, g in zip(net.params, net.gradients(scaled, y, 0.0, rng)[1]):
        for at in zip(*(rng.integers(0, s, 4) for s in p.shape)):
            kept, step = p[at], 1e-5
            p[at] = kept + step
            up = loss()
            p[at] = kept - step
            down = loss()
            p[at] = kept
            assert g[at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-6)


def test_a_rule_is_learnt():
    x, y = case(1500)
    new, right = case(400, 1)
    # the first two labels' tables hold one entry, so that outputs are compared and not clipped labels
    alike = lambda net: (np.rint(net.outputs(new)) == right)[:, :3].mean()
    assert alike(network.fit(x, y, *case(100, 2), hidden=(32, 16), thinned=0.1, rounds=60, batch=32)) > 0.85


def test_stopping_keeps_the_best_round():
    x, y = case(200)
    held = case(100, 2)
    loss = lambda net: ((net.outputs(held[0]) - held[1]) ** 2).mean()
    by_round = [loss(network.fit(x, y, *held, hidden=(16,), batch=32, rounds=k)) for k in range(1, 31)]
    assert loss(network.fit(x, y, *held, hidden=(16,), batch=32, rounds=30, stop_after=31)) == min(by_round)
    least = stopped = 0
    while stopped < len(by_round) and stopped - least < 2:
        stopped += 1
        least = stopped if stopped < len(by_round) and by_round[stopped] < by_round[least] else least
    assert loss(network.fit(x, y, *held, hidden=(16,), batch=32, rounds=30, stop_after=2)) == by_round[least]


def test_labels_are_rounded_and_clipped():
    x = np.zeros((1, len(VECTOR)))
    net = network.Network(np.zeros(len(VECTOR)), np.ones(len(VECTOR)), [np.zeros((len(VECTOR), 4)), np.array([-3.0, 0.5, 0.6, 99.0])])
    assert net.labels(x).tolist() == [[0, 0, 1, LABELS["algo"] - 1]]


def test_training_prediction_and_files(spark, tmp_path):
    x, y = case(300)
    rows = [("s", k, x[k].tolist(), *map(int, y[k])) for k in range(300)]
    odd = [("s", 900, None, 0, 0, 0, 0), ("s", 901, [None, float("nan"), float("inf"), *[0.0] * 58], 0, 0, 0, 0), (None, None, [0.0] * 61, None, 0, 0, 0)]
    training = spark.createDataFrame([*rows, *odd], FIELDS)
    net = network.train_regressor(training, hidden=(8, 4), rounds=3)
    again = network.train_regressor(training.repartition(5), hidden=(8, 4), rounds=3)
    assert all((a == b).all() for a, b in zip(net.params, again.params))
    told = network.predict_labels(training, net).collect()
    assert len(told) == 303
    assert all(0 <= r[c] < n for r in told for c, n in LABELS.items())
    network.save_network(spark, net, str(tmp_path / "network"))
    loaded = network.load_network(spark, str(tmp_path / "network"))
    assert (loaded.outputs(x) == net.outputs(x)).all()
    assert network.predict_labels(training.limit(0), net).count() == 0
    few = network.train_regressor(training, most_rows=100, hidden=(), rounds=1)
    assert few.depth == 0 and few.params[0].shape == (61, 4)
    with pytest.raises(ValueError):
        network.train_regressor(training.limit(0))
