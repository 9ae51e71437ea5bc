"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of lexicon words (a short fixed list of insults, and words and stems whose
log-odds in toxic documents are learnt), how near they are to second-person words, capitals, punctuation,
obfuscation (digits or signs inside a word, letters drawn out) and lengths. Everything is learnt from a
bounded sample of the labelled documents that aren't held out.

The lexicon is learnt by folds: what trees see of a document's words comes from the other folds, as it does
for a new document; a lexicon learnt from the document itself would look better than it is. An eighth of the
sample is left out of both and calibrates the trees' margins.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import held_out, slices, write_table

#: The sample's bound: documents of each label; learnt lexicon words and stems; documents one must be in.
SAMPLE_DOCS, LEXICON, LEAST_DOCS = 4000, 2000, 4
#: Parts of the sample: one calibrates, the others are the folds that a lexicon is learnt from.
PARTS = 8
#: Letters of a stem, and of a word that has one.
STEM, HAS_STEM = 4, 6
TREES, DEPTH, RATE, BINS = 80, 3, 0.1, 64
#: Tokens whose class a worker remembers; words around a hit that are near it.
REMEMBER, NEAR = 300_000, 5

# Insults of general use, second-person words, and signs that stand for letters.
INSULTS = "idiot idiots moron morons stupid dumb fool loser losers trash garbage scum clown pathetic worthless disgusting ugly hate kill die shut imbecile jerk creep vermin filth filthy".split()
YOU = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes".split()
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "+": "t", "|": "l"})

EDGES, STAND_INS = string.punctuation + "«»„“”‚‘’…–—¡¿", "!@$|+*"
INSIDE = re.compile(r"\w[^\w\s'’-]+\w|[^\W\d_]\d|\d[^\W\d_]")
DRAWN = re.compile(r"(\w)\1\1")
NAMES = ["insults", "learnt", "weight", "top_weight", "any_insult", "hits", "hidden_hits", "near_you", "you", "window_hits", "caps", "upper", "marks", "bangs", "odd_tail", "obfuscated", "drawn_out", "digits", "words", "word_length", "first_hit", "unlike", "stems", "top_stem", "any_stem"]


def plain(token: str) -> str:
    return token.strip(EDGES).lower()


def stem(word: str) -> str | None:
    """The word's first letters with a mark that no word has: what inflected forms share."""
    return f"{word[:STEM]}*" if len(word) >= HAS_STEM else None


def folded(token: str) -> str:
    """The token with signs read as letters and drawn-out letters shortened."""
    return DRAWN.sub(r"\1", re.sub(r"[^\w]", "", token.lower().translate(SIGNS)))


class Features:
    """Turns texts into rows of NAMES. weights: learnt log-odds of words."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.insults, self.you = weights, set(INSULTS), set(YOU)
        self.known: dict[str, tuple[float, ...]] = {}

    def token(self, t: str) -> tuple[float, ...]:
        """insult, learnt, weight, hidden, you, capital, marks, bangs, odd tail, obfuscated, drawn out, digit, letters, stem weight"""
        word = core = t.strip(EDGES)
        word = word.lower()
        whole, tail = core.isalpha(), t[-2:]
        hidden = False
        if (not whole or t[0] in STAND_INS) and word not in self.insults and word not in self.weights:
            other = folded(t)
            hidden = other != word and other in self.insults
            word = other if hidden else word
        weight = self.weights.get(word, 0.0)
        marks = 0 if whole and core == t else len(t) - sum(map(str.isalnum, t))
        return (
            word in self.insults, weight > 1.0, max(weight, 0.0), hidden, word in self.you,
            len(word) > 1 and t.isupper(), marks / len(t), t.count("!") + t.count("?") if marks else 0, marks > 0 and len(tail) == 2 and not tail[0].isalnum() and not tail[1].isalnum(),
            not whole and bool(INSIDE.search(t)), bool(DRAWN.search(t)), not whole and any(map(str.isdigit, t)), len(word),
            max(self.weights.get(stem(word) or "", 0.0), 0.0),
        )

    def row(self, text: str | None) -> list[float]:
        tokens = (text or "").split()
        if not tokens:
            return [0.0] * len(NAMES)
        if len(self.known) > REMEMBER:
            self.known.clear()
        for t in set(tokens).difference(self.known):
            self.known[t] = self.token(t)
        x = np.array(list(map(self.known.__getitem__, tokens)), np.float32)
        n = len(tokens)
        hit = (x[:, 0] > 0) | (x[:, 1] > 0) | (x[:, 3] > 0)
        at, you = np.flatnonzero(hit), np.flatnonzero(x[:, 4] > 0)
        near = 0.0
        if len(at) and len(you):
            k = np.searchsorted(you, at)
            gap = np.minimum(np.abs(at - you[np.minimum(k, len(you) - 1)]), np.abs(at - you[np.maximum(k - 1, 0)]))
            near = float((gap <= NEAR).mean())
        window = 0
        if len(at):
            window = int((np.searchsorted(at, at + 40) - np.arange(len(at))).max())
        mean = x.mean(axis=0)
        return [
            mean[0], mean[1], mean[2], float(x[:, 2].max()), float(x[:, 0].any()), float(len(at)), float(x[:, 3].sum()), near, mean[4], float(window),
            mean[5], sum(map(str.isupper, text)) / len(text), mean[6], mean[7], mean[8], mean[9], mean[10], mean[11],
            float(np.log1p(n)), mean[12], float(at[0]) / n if len(at) else 1.0, float(x[:, 2].sum()) / (1 + len(at)),
            mean[13], float(x[:, 13].max()), float((x[:, 13] > 1).sum()),
        ]

    def rows(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.row(t) for t in texts], np.float64).reshape(-1, len(NAMES))


@dataclass
class Trees:
    """Gradient-boosted trees on the logistic loss, over binned features, level by level."""

    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    splits: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # feature and bin of each inner node
    leaves: list[np.ndarray] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    @staticmethod
    def node(b: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(DEPTH):
            at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
        return at - (2**DEPTH - 1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS)[1:-1])) for k in range(x.shape[1])]
        b = self.binned(x)
        rate = np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6)
        self.base = float(np.log(rate / (1 - rate)))
        out = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-out))
            g, h = weight * (p - y), weight * p * (1 - p)
            feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS)
            at = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                first, n = 2**level - 1, 2**level
                best = np.full(n, 1e-6)
                for k in range(b.shape[1]):
                    cell = (at - first) * BINS + b[:, k]
                    gs = np.bincount(cell, g, n * BINS).reshape(n, BINS).cumsum(axis=1)
                    hs = np.bincount(cell, h, n * BINS).reshape(n, BINS).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < 1) | (ht - hs < 1)] = -1
                    c = gain.argmax(axis=1)
                    better = gain[np.arange(n), c] > best
                    best[better] = gain[np.arange(n), c][better]
                    feature[first : first + n][better], cut[first : first + n][better] = k, c[better]
                at = 2 * at + 1 + (b[np.arange(len(b)), feature[at]] > cut[at])
            leaf = at - (2**DEPTH - 1)
            value = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
            self.splits.append((feature, cut))
            self.leaves.append(value)
            out += value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out = self.binned(x), np.full(len(x), self.base)
        for (feature, cut), value in zip(self.splits, self.leaves):
            out += value[self.node(b, feature, cut)]
        return out


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the middles and levels of the blocks of a non-decreasing fit of y on x."""
    blocks: list[list[float]] = []
    for k in np.argsort(x, kind="stable"):
        blocks.append([x[k] * weight[k], y[k] * weight[k], weight[k]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


@dataclass
class Model:
    weights: dict[str, float]
    trees: Trees | None = None
    points: tuple[np.ndarray, np.ndarray] | None = None
    rate: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.rate)
        margin = self.trees.margin(x)
        # a little of the margin keeps the order within a level
        return 0.99 * np.interp(margin, *self.points) + 0.01 / (1 + np.exp(-margin))


def sample_of(docs: DataFrame, labels: DataFrame, label: Column, per_label: int) -> DataFrame:
    """doc_id, text, label, weight, part of at most per_label documents of each label, none held out.

    A row stands for weight rows of its label. The sample's ids are chosen among the labels alone and
    are few enough to broadcast.
    """
    told = labels.where(label.isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", label.cast("int").alias("label")).where("label in (0, 1)")
    told = told.groupBy("doc_id").agg(F.max("label").alias("label"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30))
    counts = told.groupBy("label").agg(F.count(F.lit(1)).alias("there"))
    some = told.withColumn("draw", draw).join(F.broadcast(counts), "label").where(F.col("draw") / float(1 << 30) < 2.0 * per_label / F.col("there"))
    some = some.withColumn("nth", F.row_number().over(W.partitionBy("label").orderBy("draw", "doc_id"))).where(F.col("nth") <= per_label)
    some = some.select("doc_id", "label", (F.col("there") / F.least(F.col("there"), F.lit(per_label))).alias("weight"), ((F.col("nth") + PARTS - 2) % PARTS).cast("long").alias("part"))
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model of ``label`` (0 or 1) from docs (doc_id, text) and labels (doc_id, label).

    To the driver come at most PARTS times LEXICON words, and sample_docs rows of features a label. Labels that
    are null or something else are left out; without both labels every score is the label's rate.
    """
    sample, _ = write_table(sample_of(docs, labels, F.col(label), sample_docs), "toxicity-sample")
    sizes: dict[int, dict[int, tuple[float, int]]] = {0: {}, 1: {}}
    for r in sample.groupBy("label", "part").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("c")).collect():
        sizes[r["label"]][r["part"]] = r["weight"], r["c"]
    weight_of = {y: sum(w for w, _ in own.values()) for y, own in sizes.items()}
    rate = weight_of[1] / max(1e-9, sum(weight_of.values()))
    learning = {y: [own.get(part, (0, 0))[1] for part in range(1, PARTS)] for y, own in sizes.items()}
    if min(map(sum, learning.values())) < 2 or any(0 not in own for own in sizes.values()):
        return Model({}, rate=float(rate))

    lexicons = learn_lexicons(sample.where("part > 0"), learning)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = [Features(lexicon) for lexicon in lexicons]
        for batch in slices(batches):
            x = [features[part].row(text) for part, text in zip(batch["part"].to_pylist(), batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "label", "weight", "part")), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "label", "weight", "part", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    table = sample.select("doc_id", "label", "weight", "part", "text").mapInArrow(rows, f"doc_id {kind}, label int, weight double, part long, x array<double>").toArrow()
    table = table.sort_by([("doc_id", "ascending"), ("label", "ascending")])
    x, y = np.array(table["x"].to_pylist(), np.float64), table["label"].to_numpy().astype(np.float64)
    weight, late = table["weight"].to_numpy(), table["part"].to_numpy() == 0
    trees = Trees().fit(x[~late], y[~late], weight[~late])
    return Model(lexicons[0], trees, isotonic(trees.margin(x[late]), y[late], weight[late]), float(rate))


def learn_lexicons(sample: DataFrame, learning: dict[int, list[int]]) -> list[dict[str, float]]:
    """The log-odds of words and stems: at 0 from all parts (1..) of the sample, at k from all but part k.

    learning: the documents of each label, by part. LEXICON words at most are taken each time.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for text, y, part in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), batch["part"].to_pylist()):
                own = {plain(t) for t in (text or "").split()}
                found += [(w, y, part) for w in own | {stem(w) for w in own} if w]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64()))], ["word", "label", "part"])

    cells = sample.select("text", "label", "part").mapInArrow(words, "word string, label int, part long").groupBy("word")
    seen, _ = write_table(cells.agg(*[F.count_if((F.col("label") == y) & (F.col("part") == part)).alias(f"c{y}_{part}") for y in (0, 1) for part in range(1, PARTS)]), "toxicity-words")
    out = []
    for fold in range(PARTS):
        parts = [part for part in range(1, PARTS) if part != fold]
        good, bad = (sum((F.col(f"c{y}_{part}") for part in parts), F.lit(0)) for y in (0, 1))
        n_good, n_bad = (sum(learning[y][part - 1] for part in parts) for y in (0, 1))
        odds = F.log((bad + 0.5) / (n_bad + 1.0)) - F.log((good + 0.5) / (n_good + 1.0))
        # words whose log-odds are two deviations above none
        sure = odds - 2 * F.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
        top = seen.where(good + bad >= LEAST_DOCS).select("word", odds.alias("odds"), sure.alias("sure")).where("sure > 0")
        out.append({r["word"]: float(r["odds"]) for r in top.orderBy(F.col("sure").desc(), "word").limit(LEXICON).collect()})
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs (doc_id, text), whole texts; null counts as empty.

    Nothing but the text goes into a score. Repeated rows give repeated rows; an empty table gives an
    empty result. Other columns of docs are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(shared.value.weights)
        for batch in slices(batches):
            x = features.rows(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.clip(shared.value.scores(x), 0, 1))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
