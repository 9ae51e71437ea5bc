"""A network that predicts all four labels of a segment at once, as numbers that are rounded.

Hidden layers are linear, normalised over the batch, cut at zero and, but for the last, thinned at random.
Training is in memory on a bounded sample of the training rows; prediction runs where the rows are.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import write_bytes
from .learn import LABELS, SEED, split
from .profile import VECTOR

# Sizes of hidden layers, the share thinned out, and how the network is trained.
HIDDEN, THINNED, ROUNDS, RATE, BATCH, DECAY = (256, 128, 64, 32), 0.3, 500, 0.001, 256, 1e-5
#: Rounds without a lower loss on held-back rows after which the rate is halved; their share; rows learnt from at most.
PATIENCE, HELD_BACK, MOST_ROWS = 5, 0.2, 100_000
TINY, KEEP, BETAS = 1e-5, 0.9, (0.9, 0.999)


@dataclass
class Network:
    """Parameters in order: weights, bias, scale and shift of each hidden layer, then weights and bias."""

    middle: np.ndarray
    spread: np.ndarray
    params: list[np.ndarray]
    usual: list[np.ndarray] = field(default_factory=list)  # mean and variance of each hidden layer's sums

    @staticmethod
    def new(x: np.ndarray, outputs: int, hidden: tuple[int, ...], rng: np.random.Generator) -> Network:
        spread = x.std(axis=0)
        params, usual, width = [], [], x.shape[1]
        for size in (*hidden, outputs):
            bound = 1 / np.sqrt(width)
            params += [rng.uniform(-bound, bound, (width, size)), rng.uniform(-bound, bound, size)]
            if len(usual) < 2 * len(hidden):
                params += [np.ones(size), np.zeros(size)]
                usual += [np.zeros(size), np.ones(size)]
            width = size
        return Network(x.mean(axis=0), np.where(spread > 0, spread, 1.0), params, usual)

    @property
    def depth(self) -> int:
        return len(self.usual) // 2

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.middle) / self.spread

    def outputs(self, x: np.ndarray) -> np.ndarray:
        a = self.scaled(x)
        for k in range(self.depth):
            weights, bias, scale, shift = self.params[4 * k : 4 * k + 4]
            mean, var = self.usual[2 * k : 2 * k + 2]
            a = np.maximum(0, (a @ weights + bias - mean) / np.sqrt(var + TINY) * scale + shift)
        return a @ self.params[-2] + self.params[-1]

    def labels(self, x: np.ndarray) -> np.ndarray:
        """Outputs rounded (halves to even) and clipped to the labels' tables."""
        return np.clip(np.rint(self.outputs(x)), 0, np.array(list(LABELS.values())) - 1).astype(np.int32)

    def gradients(self, a: np.ndarray, y: np.ndarray, thinned: float, rng: np.random.Generator) -> tuple[float, list[np.ndarray]]:
        """The mean squared error over a batch of scaled rows, and its gradient by each parameter."""
        steps = []
        for k in range(self.depth):
            weights, bias, scale, shift = self.params[4 * k : 4 * k + 4]
            z = a @ weights + bias
            mean, var = z.mean(axis=0), z.var(axis=0)
            for kept, now in zip(self.usual[2 * k : 2 * k + 2], (mean, var * len(z) / max(1, len(z) - 1))):
                kept *= KEEP
                kept += (1 - KEEP) * now
            root = np.sqrt(var + TINY)
            norm = (z - mean) / root
            cut = norm * scale + shift
            gate = (cut > 0).astype(float)
            if k < self.depth - 1 and thinned:
                gate *= (rng.random(cut.shape) >= thinned) / (1 - thinned)
            steps.append((a, norm, root, gate))
            a = cut * gate
        gap = a @ self.params[-2] + self.params[-1] - y
        d = 2 * gap / gap.size
        found = [a.T @ d, d.sum(axis=0)]
        d = d @ self.params[-2].T
        for k in reversed(range(self.depth)):
            a, norm, root, gate = steps[k]
            d = d * gate
            by_scale, by_shift = (d * norm).sum(axis=0), d.sum(axis=0)
            d = d * self.params[4 * k + 2]
            d = (d - d.mean(axis=0) - norm * (d * norm).mean(axis=0)) / root
            found = [a.T @ d, d.sum(axis=0), by_scale, by_shift, *found]
            d = d @ self.params[4 * k].T
        return float((gap**2).mean()), found

    def to_bytes(self) -> bytes:
        file = io.BytesIO()
        np.savez(file, *self.params, *self.usual, self.middle, self.spread, depth=self.depth)
        return file.getvalue()

    @staticmethod
    def from_bytes(content: bytes) -> Network:
        with np.load(io.BytesIO(content)) as file:
            depth = int(file["depth"])
            every = [file[f"arr_{k}"] for k in range(len(file.files) - 1)]
        n = 4 * depth + 2
        return Network(every[-2], every[-1], every[:n], every[n : n + 2 * depth])


def fit(x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray, *, hidden: tuple[int, ...] = HIDDEN, thinned: float = THINNED, rounds: int = ROUNDS, rate: float = RATE, batch: int = BATCH, decay: float = DECAY, stop_after: int | None = None, seed: int = SEED) -> Network:
    """Adam on the mean squared error. The rate is halved when the loss on the held-back rows hasn't fallen
    for more than PATIENCE rounds. stop_after: so many rounds without a lower one end training, with the
    network of the best round; None trains all rounds and keeps the last."""
    rng = np.random.default_rng(seed)
    net = Network.new(x, y.shape[1], hidden, rng)
    if not len(held_x):
        held_x, held_y = x, y
    scaled, first, second, t = net.scaled(x), [np.zeros_like(p) for p in net.params], [np.zeros_like(p) for p in net.params], 0
    best, kept, since, waited = np.inf, net.to_bytes(), 0, 0
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            at = order[a : a + batch]
            _, found = net.gradients(scaled[at], y[at], thinned, rng)
            t += 1
            for p, g, m, v in zip(net.params, found, first, second):
                g = g + decay * p
                m += (1 - BETAS[0]) * (g - m)
                v += (1 - BETAS[1]) * (g * g - v)
                p -= rate * (m / (1 - BETAS[0] ** t)) / (np.sqrt(v / (1 - BETAS[1] ** t)) + 1e-8)
        loss = float(((net.outputs(held_x) - held_y) ** 2).mean())
        if loss < best:
            best, since, waited = loss, 0, 0
            kept = net.to_bytes() if stop_after else kept
        else:
            since, waited = since + 1, waited + 1
            if waited > PATIENCE:
                rate, waited = rate / 2, 0
            if stop_after and since >= stop_after:
                break
    return Network.from_bytes(kept) if stop_after else net


def known(features: list[list[float | None] | None]) -> np.ndarray:
    """Rows of features as numbers: 0 for what is missing or not finite."""
    rows = [[0.0] * len(VECTOR) if f is None else [0.0 if v is None else v for v in f] for f in features]
    return np.nan_to_num(np.array(rows, np.float64).reshape(-1, len(VECTOR)), nan=0.0, posinf=0.0, neginf=0.0)


def train_regressor(training: DataFrame, *, most_rows: int = MOST_ROWS, **options) -> Network:
    """A network for all LABELS, from training rows (series_id, segment_id, features and labels).

    At most about most_rows rows come to the driver, drawn by a hash of the segment; HELD_BACK of them are
    held back. Rows without a label take no part; without any row, training fails.
    """
    rows = training.where(" and ".join(f"`{c}` is not null" for c in LABELS)).select("series_id", "segment_id", "features", *LABELS)
    there = rows.count()
    if there > most_rows:
        draw = F.pmod(F.xxhash64(F.lit("network"), "series_id", "segment_id"), F.lit(1 << 30))
        rows = rows.where(draw < F.lit(int((1 << 30) * (most_rows / there))))
    parts = []
    for part in split(rows, HELD_BACK):
        table = part.select("series_id", "segment_id", "features", *LABELS).toArrow().sort_by([("series_id", "ascending"), ("segment_id", "ascending")])
        parts += [known(table["features"].to_pylist()), np.stack([table[c].to_numpy().astype(np.float64) for c in LABELS], axis=1)]
    if not len(parts[0]):
        parts = [*parts[2:], *parts[:2]]
    if not len(parts[0]):
        raise ValueError("there are no labelled rows to learn from")
    return fit(*parts, **options)


def predict_labels(features: DataFrame, network: Network) -> DataFrame:
    """series_id, segment_id and the four labels of each row of features, rounded and clipped."""
    shared = features.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = shared.value.labels(known(batch["features"].to_pylist()))
            yield pa.RecordBatch.from_arrays([batch["series_id"], batch["segment_id"], *map(pa.array, told.T.copy())], ["series_id", "segment_id", *LABELS])

    kinds = ", ".join(f"{c} {features.schema[c].dataType.simpleString()}" for c in ("series_id", "segment_id"))
    return features.select("series_id", "segment_id", "features").mapInArrow(run, f"{kinds}, " + ", ".join(f"`{c}` int" for c in LABELS))


def save_network(spark: SparkSession, network: Network, path: str) -> None:
    """A file that load_network reads; it holds numbers only."""
    write_bytes(spark, path, network.to_bytes())


def load_network(spark: SparkSession, path: str) -> Network:
    return Network.from_bytes(bytes(spark.read.format("binaryFile").load(path).first()["content"]))
