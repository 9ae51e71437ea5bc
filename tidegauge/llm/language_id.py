"""Language ID by interpolated Kneser-Ney character models, one for each language.

A text is reduced to lower-case letters with single spaces between runs of them. Each language has a
model of ORDER characters, trained on a bounded sample of its labelled documents: top-order counts,
continuation counts below, one discount an order. The models of a block of languages share sorted arrays
of n-gram hashes, one an order, with a row of log-probabilities (a column a language) for each n-gram; an
n-gram that no language has falls back over its context's weights to the order below. The language with
the lowest cross-entropy a character is the answer. Its score is the calibrated probability that it is
right; a text that is too unlikely even in it, for its length, is rejected: beyond the deviations that a
stated share of clean texts is expected to reach, by the tail of held-back ones.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import held_out, join_groups, slices, write_table

ORDER = 4
#: The sample's bound: documents a language to train and to calibrate on, and characters of a document.
#: A language with fewer documents is split in the same ratio; one without a document so short learns
#: from one that is longer.
TRAIN_DOCS, CALIBRATE_DOCS, MOST_CHARS = 240, 60, 50_000
#: Languages of a block: how many a row of log-probabilities holds. There is no bound on blocks.
LANG_BLOCK = 64
#: So many languages' counts are broadcast at most; of more, only the common ones' are.
COUNTS_AT_ONCE = 100_000
#: Lengths of the snippets that calibration adds to whole texts.
SNIPPETS = (4, 8, 16, 32, 64)
#: The share of clean texts that may be rejected as too unlikely (one of a billion); the upper share of held-back texts whose
#: tail it is read from; deviations that stand in where there are fewer than so many in the tail.
REJECT_SHARE, TAIL_SHARE, TOO_FEW, REJECT_Z = 1e-9, 0.1, 20, 10.0
#: A text is rejected too if the probability that its language is right is lower.
REJECT_SCORE = 0.3
#: Characters scored at once.
CHUNK = 1 << 17
SPACE, UNKNOWN = np.uint32(32), "und"
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point: its lower case if it is a letter, else a space."""
    if not _letters:
        table = np.full(0x110000, SPACE, np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                table[cp] = ord(low) if len(low) == 1 else cp
        _letters.append(table)
    return _letters[0]


def reduced(text: str | None) -> np.ndarray:
    """Lower-case letters of the text, with one space before, between and after runs of them."""
    cps = letters()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    cps = np.concatenate([[SPACE], cps, [SPACE]])
    return cps[np.r_[True, (cps[1:] != SPACE) | (cps[:-1] != SPACE)]]


def gram_hashes(cps: np.ndarray, order: int) -> list[np.ndarray]:
    """hashes[k][i]: of the k characters up to and with i; what lies before the start is spaces."""
    padded = np.concatenate([np.full(order - 1, SPACE, np.uint32), cps]).astype(np.uint64) + np.uint64(1)
    n, raw, out = len(cps), np.zeros(len(cps), np.uint64), [np.zeros(len(cps), np.uint64)]
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(order):
            raw = raw + padded[order - 1 - k : order - 1 - k + n] * power
            power = power * STEP
            h = (raw ^ (raw >> np.uint64(29))) * MIX
            out.append(h ^ (h >> np.uint64(32)) ^ np.uint64(k + 1))
    return out


def count_grams(texts: list[str | None], order: int) -> list[dict[str, np.ndarray]]:
    """For each order 1..: n-grams, their counts, and hashes of their contexts and suffixes.

    Counts are of occurrences at the top order, and of different characters before it below.
    """
    per_text = [gram_hashes(r, order) for r in map(reduced, texts) if len(r) > 1]
    if not per_text:
        return []
    # the first place of a text is its leading space: nothing is predicted there
    now = [np.concatenate([h[k][1:] for h in per_text]) for k in range(order + 1)]
    before = [np.concatenate([h[k][:-1] for h in per_text]) for k in range(order)]
    out, at = [], np.arange(len(now[0]))
    for k in range(order, 0, -1):
        grams, first, counts = np.unique(now[k][at], return_index=True, return_counts=True)
        at = at[first]
        context = before[k - 1][at] if k > 1 else np.zeros(len(at), np.uint64)
        out.append({"gram": grams, "count": counts, "context": context, "suffix": now[k - 1][at]})
    return out[::-1]


@dataclass
class Block:
    """langs; for each order: sorted n-grams with log-probabilities, sorted contexts with log-weights.

    alphabet: the characters of all languages, of other blocks too.
    """

    langs: list[str]
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    logw: list[np.ndarray]
    alphabet: int

    @property
    def order(self) -> int:
        return len(self.grams)

    def log_probs(self, hashes: list[np.ndarray], before: list[np.ndarray], k: int) -> np.ndarray:
        """Rows of log-probabilities of the k-grams; a miss goes to the order below."""
        at = np.minimum(np.searchsorted(self.grams[k - 1], hashes[k]), len(self.grams[k - 1]) - 1)
        out = self.logp[k - 1][at]
        if len(miss := np.flatnonzero(self.grams[k - 1][at] != hashes[k])):
            out[miss] = self.weights(before[k - 1][miss], k)
            if k > 1:
                out[miss] += self.log_probs([h[miss] for h in hashes[:k]], [h[miss] for h in before[: k - 1]], k - 1)
            else:
                out[miss] -= np.log(self.alphabet + 1)
        return out

    def weights(self, contexts: np.ndarray, k: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.contexts[k - 1], contexts), len(self.contexts[k - 1]) - 1)
        return np.where((self.contexts[k - 1][at] == contexts)[:, None], self.logw[k - 1][at], np.float32(0))

    def entropies(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character of each reduced text in each language, and the characters."""
        sums, sizes = np.zeros((len(texts), len(self.langs))), np.array([len(t) - 1 for t in texts])
        held: list[tuple[int, list, list]] = []
        n = 0

        def flush() -> None:
            now = [np.concatenate([h[1][k] for h in held]) for k in range(self.order + 1)]
            before = [np.concatenate([h[2][k] for h in held]) for k in range(self.order)]
            logp = self.log_probs(now, before, self.order)
            starts = np.cumsum([0, *(len(h[1][0]) for h in held[:-1])])
            np.add.at(sums, [h[0] for h in held], np.add.reduceat(logp, starts, axis=0, dtype=np.float64))

        for doc, text in enumerate(texts):
            for a in range(1, len(text), CHUNK):
                lead = max(0, a - self.order)
                h = gram_hashes(text[lead : a + CHUNK], self.order)
                held.append((doc, [x[a - lead :] for x in h], [x[a - lead - 1 : -1] for x in h[:-1]]))
                n += len(held[-1][1][0])
                if n >= CHUNK:
                    flush()
                    held.clear()
                    n = 0
        if held:
            flush()
        return -sums / np.maximum(sizes, 1)[:, None], np.maximum(sizes, 0)


@dataclass
class Model:
    """Blocks of languages, and what calibration has found."""

    blocks: list[Block]
    slope: tuple[float, float] = (0.0, 1.0)
    usual: np.ndarray | None = None  # a row a language: mean, variance between texts, variance a character
    most: float = REJECT_Z  # deviations from what is usual

    @property
    def langs(self) -> list[str]:
        return [lang for block in self.blocks for lang in block.langs]

    @property
    def alphabet(self) -> int:
        return self.blocks[0].alphabet

    def entropies(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character of each reduced text in each language, and the characters."""
        found = [block.entropies(texts) for block in self.blocks]
        return np.hstack([entropy for entropy, _ in found]), found[0][1]

    def predict(self, texts: list[np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, of each reduced text."""
        entropy, sizes = self.entropies(texts)
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(texts)), best]
        rest = np.where(np.arange(len(self.langs)) == best[:, None], np.inf, entropy).min(axis=1) if len(self.langs) > 1 else low + 1
        lead = np.log1p(np.maximum(0, (rest - low) * sizes))
        score = 1 / (1 + np.exp(-(self.slope[0] + self.slope[1] * lead)))
        reject = score < REJECT_SCORE
        if self.usual is not None:
            mean, between, per_char = self.usual[best].T
            reject |= low > mean + self.most * np.sqrt(between + per_char / np.maximum(sizes, 1))
        empty = sizes == 0
        langs = [UNKNOWN if e else self.langs[b] for b, e in zip(best, empty)]
        return langs, np.where(empty, 0.0, score), reject | empty


def estimate(tables: dict[str, list[dict[str, np.ndarray]]], lang_block: int = LANG_BLOCK) -> Model:
    """Interpolated Kneser-Ney over the n-gram counts of each language."""
    langs = sorted(tables)
    alphabet = len(np.unique(np.concatenate([t[0]["gram"] for t in tables.values()])))
    cuts = [langs[a : a + lang_block] for a in range(0, len(langs), lang_block)]
    return Model([estimate_block({lang: tables[lang] for lang in cut}, alphabet) for cut in cuts])


def estimate_block(tables: dict[str, list[dict[str, np.ndarray]]], alphabet: int) -> Block:
    langs = list(tables)
    order = max(len(t) for t in tables.values())
    grams, logp, contexts, logw = [], [], [], []
    lower = None
    for k in range(1, order + 1):
        own = [tables[lang][k - 1] for lang in langs]
        every, first = np.unique(np.concatenate([t["gram"] for t in own]), return_index=True)
        context = np.concatenate([t["context"] for t in own])[first]
        suffix = np.concatenate([t["suffix"] for t in own])[first]
        all_contexts = np.unique(context)
        at_context = np.searchsorted(all_contexts, context)
        if k == 1:
            below = np.full((len(every), len(langs)), 1 / (alphabet + 1))
        else:
            below = lower[np.searchsorted(grams[-1], suffix)]
        p, w = np.empty((len(every), len(langs))), np.ones((len(all_contexts), len(langs)))
        for j, t in enumerate(own):
            ones, twos = (t["count"] == 1).sum(), (t["count"] == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            mine = np.searchsorted(all_contexts, t["context"])
            total = np.bincount(mine, t["count"], len(all_contexts))
            kinds = np.bincount(mine, minlength=len(all_contexts))
            seen = total > 0
            w[seen, j] = discount * kinds[seen] / total[seen]
            p[:, j] = w[at_context, j] * below[:, j]
            p[np.searchsorted(every, t["gram"]), j] += (t["count"] - discount) / total[mine]
        lower = p
        grams.append(every)
        logp.append(np.log(p).astype(np.float32))
        contexts.append(all_contexts)
        logw.append(np.log(w).astype(np.float32))
    return Block(langs, grams, logp, contexts, logw, alphabet)


def calibrate(model: Model, cases: list[tuple[str, int, bool, np.ndarray]]) -> None:
    """Fit the score and what is usual, from (language, characters, whole text, cross-entropies)."""
    index = {lang: k for k, lang in enumerate(model.langs)}
    cases = [c for c in cases if c[0] in index and c[1] > 1]
    # with too few cases of its own, a language takes what is likelier than letters drawn evenly
    model.usual = np.tile([np.log(model.alphabet + 1), 0.01, 1.0], (len(model.langs), 1))
    if not cases:
        return
    truth = np.array([index[c[0]] for c in cases])
    sizes, whole = np.array([c[1] for c in cases]), np.array([c[2] for c in cases])
    entropy = np.array([c[3] for c in cases])
    if len(model.langs) > 1:
        ranked = np.sort(entropy, axis=1)
        x = np.log1p((ranked[:, 1] - ranked[:, 0]) * sizes)
        y = (entropy.argmin(axis=1) == truth).astype(float)
        a, b = 0.0, 1.0
        for _ in range(30):  # Newton's steps on the logistic loss, held near (0, 1)
            p = 1 / (1 + np.exp(-(a + b * x)))
            g = np.array([(p - y).sum() + 0.1 * a, ((p - y) * x).sum() + 0.1 * (b - 1)])
            v = p * (1 - p)
            h = np.array([[v.sum() + 0.1, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 0.1]])
            a, b = np.array([a, b]) - np.linalg.solve(h, g)
        model.slope = (float(a), max(0.05, float(b)))
    own = entropy[np.arange(len(cases)), truth]
    for k in range(len(model.langs)):
        mine, short = (truth == k) & whole, (truth == k) & ~whole
        if mine.sum() >= 5:
            mean = own[mine].mean()
            per_char = ((own[short] - mean) ** 2 * sizes[short]).mean() if short.any() else own[mine].var() * sizes[mine].mean()
            model.usual[k] = mean, own[mine].var() + 0.01, per_char
    mean, between, per_char = model.usual[truth].T
    model.most = tail_bound((own - mean) / np.sqrt(between + per_char / sizes))


def tail_bound(z: np.ndarray, share: float = REJECT_SHARE) -> float:
    """The deviations that this share of texts is expected to be beyond, by an exponential tail over the
    upper TAIL_SHARE of those given: clean texts that nothing was learnt from."""
    start = np.quantile(z, 1 - TAIL_SHARE)
    over = z[z > start] - start
    if len(over) < TOO_FEW:
        return REJECT_Z
    return float(start + over.mean() * np.log(TAIL_SHARE / share))


def sample_of(docs: DataFrame, per_lang: int) -> DataFrame:
    """At most per_lang documents of each language, of those that may be learnt from and have a letter:
    of at most MOST_CHARS characters, or one, if there is none so short.

    A threshold on a hash of the id brings the rows near the bound, so that a window orders only about
    twice as many as are taken. The counts that it rests on are a row a language, and texts meet them
    where they are: no language is gathered in a task. Beyond COUNTS_AT_ONCE languages, texts of those
    that hold less than a thousandth of all are shuffled by language.
    """
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    labelled = labelled.withColumn("long", F.length("text") > MOST_CHARS)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30))
    # short ones are wanted, so they count; where there are only long ones, those do
    counts = labelled.groupBy("lang").agg(F.count_if(~F.col("long")).alias("short"), F.count(F.lit(1)).alias("there"))
    counts = counts.select("lang", (F.col("short") == 0).alias("long"), F.when(F.col("short") > 0, F.col("short")).otherwise(F.col("there")).alias("there"))
    counts, _ = write_table(counts, "language-counts")
    rows, keys = labelled.withColumn("draw", draw), ["lang", "long"]
    some = rows.join(F.broadcast(counts), keys) if counts.count() <= COUNTS_AT_ONCE else join_groups(rows, counts, keys, "there")
    some = some.where(F.col("draw") / float(1 << 30) < 2.0 * per_lang / F.col("there"))
    some = some.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("draw", "doc_id", "text")))
    return some.where((F.col("nth") <= per_lang) & (~F.col("long") | (F.col("nth") == 1)))


def train(docs: DataFrame, *, order: int = ORDER, train_docs: int = TRAIN_DOCS, calibrate_docs: int = CALIBRATE_DOCS) -> Model | None:
    """A model from docs (doc_id, text, lang); None if no document has a language to learn.

    Every language's documents are split by share, calibrate_docs of each train_docs + calibrate_docs;
    the first one trains, so a language with one document is learnt too.
    What comes to the driver is bounded for each language: the n-grams of at most train_docs whole texts
    (see sample_of), then a few numbers for each of at most calibrate_docs.
    """
    spark = docs.sparkSession
    per_lang = train_docs + calibrate_docs
    sample, _ = write_table(sample_of(docs, per_lang), "language-sample")
    calibrates = F.floor(F.col("nth") * calibrate_docs / per_lang) > F.floor((F.col("nth") - 1) * calibrate_docs / per_lang)

    def count(table: pa.Table) -> pa.Table:
        grams = pickle.dumps(count_grams(table["text"].to_pylist(), order))
        return pa.table({"lang": table["lang"].slice(0, 1), "grams": pa.array([grams], pa.binary())})

    parts = sample.where(~calibrates).groupBy("lang").applyInArrow(count, "lang string, grams binary").collect()
    tables = {r["lang"]: g for r in parts if (g := pickle.loads(r["grams"]))}
    if not tables:
        return None
    model = estimate(tables)
    shared = spark.sparkContext.broadcast(model)

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, texts, whole = [], [], []
            for lang, text in zip(batch["lang"].to_pylist(), map(reduced, batch["text"].to_pylist())):
                cuts = [text, *(np.r_[SPACE, text[len(text) // 3 :][:n]] for n in SNIPPETS if len(text) > n)]
                langs += [lang] * len(cuts)
                texts += cuts
                whole += [True] + [False] * (len(cuts) - 1)
            entropy, sizes = shared.value.entropies(texts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "size": sizes.astype(np.int64), "whole": whole, "entropy": pa.array(entropy.tolist(), pa.list_(pa.float64()))})

    fields = "lang string, size long, whole boolean, entropy array<double>"
    cases = sample.where(calibrates).select("lang", "text").mapInArrow(entropies, fields).collect()
    calibrate(model, [(r["lang"], r["size"], r["whole"], np.array(r["entropy"])) for r in cases])
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs' columns with lang_pred, lang_score and lang_rejected; such columns of docs are replaced.

    lang_pred is a learned language, or ``und`` with score 0 for a text that is null or has no letter,
    and for every text if model is None; those are rejected. Every row gives one row.
    """
    names = ["lang_pred", "lang_score", "lang_rejected"]
    rest = [c for c in docs.columns if c.lower() not in names]
    rows = docs.select([F.col(f"`{c}`") for c in rest])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [reduced(t) for t in batch["text"].to_pylist()]
            n = len(texts)
            langs, score, reject = shared.value.predict(texts) if shared.value and n else ([UNKNOWN] * n, np.zeros(n), np.ones(n, bool))
            columns = [*batch.columns[: len(kept)], pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(reject, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *names])

    kept = [c for c in rows.columns]
    added = StructType().add("lang_pred", "string").add("lang_score", "double").add("lang_rejected", "boolean")
    schema = StructType([*rows.schema.fields, *added.fields])
    return rows.mapInArrow(run, schema)
