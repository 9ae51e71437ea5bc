"""Language ID and toxicity."""

import binascii
import math
import random
from collections import Counter

import numpy as np
import pytest

from tidegauge.llm import language_id, toxicity

WORDS = {
    "en": "the of and to in that was for is on with he as his at by this had not are but from or have an they".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec".split(),
}


def held_out(i):
    return binascii.crc32(("" if i is None else str(i)).encode()) % 5 == 0


def corpus(n=300):
    rng = random.Random(6)
    out = []
    for k in range(n):
        lang = rng.choice(list(WORDS))
        out.append((k, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(3, 80))), lang, "s"))
    return out


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, lang) for i, t, lang, _ in corpus()]
    return language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_held_out_accuracy(documents, model):
    rows = corpus()
    got = {r["doc_id"]: r for r in language_id.predict(documents(rows), model).collect()}
    out = [(got[i]["lang_pred"] == lang) for i, _, lang, _ in rows if held_out(i)]
    assert len(out) > 30 and np.mean(out) > 0.97
    assert all(0 <= r["lang_score"] <= 1 for r in got.values())


def test_held_out_labels_are_never_read(documents, model):
    changed = [(i, t, "xx" if held_out(i) else lang, s) for i, t, lang, s in corpus()]
    again = language_id.train(documents(changed).select("doc_id", "text", "lang"))
    assert again.langs == model.langs == ["de", "en", "fr"]
    assert all((a == b).all() for a, b in zip(again.blocks[0].logp, model.blocks[0].logp))


def test_texts_without_letters_and_odd_tables(documents, model):
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, "12 ;; 34", "en", "s"), (None, "the of and to", None, None), (5, "der die und " * 40_000, "de", "s"), (5, "der", "de", "s")]
    df = documents(rows).withColumnRenamed("kept", "lang_pred")
    got = language_id.predict(df, model)
    assert got.columns == [*(c for c in df.columns if c != "lang_pred"), "lang_pred", "lang_score", "lang_rejected"]
    told = [(r["lang_pred"], r["lang_rejected"]) for r in got.collect()]
    assert told[:3] == [("und", True)] * 3 and told[3] == ("en", False) and told[4] == ("de", False)
    assert language_id.train(documents([])) is None and language_id.train(documents([(1, "a", None, "s")])) is None
    assert language_id.predict(documents(rows), None).where("lang_pred = 'und'").count() == 6
    assert language_id.predict(documents([]), model).count() == 0


def test_strange_texts_are_rejected_and_clean_ones_kept(documents, model):
    rng = random.Random(1)
    strange = [(1000 + k, " ".join("".join(rng.choice("xqzjkw") for _ in range(9)) for _ in range(60)), None, "s") for k in range(20)]
    told = language_id.predict(documents([*strange, *corpus(200)]), model).collect()
    assert all(r["lang_rejected"] for r in told if r["doc_id"] >= 1000)
    assert sum(r["lang_rejected"] for r in told if r["doc_id"] < 1000) <= 2


@pytest.mark.parametrize("rare", [1, 3, 30, 70])
def test_rare_languages_are_learnt_beside_a_common_one(documents, rare):
    rng = random.Random(3)
    told = lambda lang, n=60: " ".join(rng.choice(WORDS[lang]) for _ in range(n))
    learnt = [i for i in range(2000) if not held_out(i)]
    rows = [(i, told("en"), "en", "s") for i in learnt[:300]] + [(i, told("de"), "de", "s") for i in learnt[300 : 300 + rare]]
    rows += [(i, "12 34", "fr", "s") for i in learnt[400:420]] + [(learnt[420], told("fr"), "fr", "s")]
    model = language_id.train(documents(rows).select("doc_id", "text", "lang"))
    assert model.langs == ["de", "en", "fr"]
    new = [(3000 + k, told(lang), lang, "s") for k, lang in enumerate(["de", "en", "fr"] * 15)]
    strange = [(4000 + k, " ".join("".join(rng.choice("xqzjkw") for _ in range(9)) for _ in range(60)), None, "s") for k in range(5)]
    got = {r["doc_id"]: r for r in language_id.predict(documents([*new, *strange]), model).collect()}
    assert all(got[i]["lang_pred"] == lang and not got[i]["lang_rejected"] for i, _, lang, _ in new)
    assert all(got[i]["lang_rejected"] for i, *_ in strange)


def test_probabilities_add_up():
    """Over all characters after a context, seen or not."""
    model = language_id.estimate({"x": language_id.count_grams(["abab abb", "ba"], 3), "y": language_id.count_grams(["bbb"], 3)})
    alphabet = [ord(c) for c in " ab"]
    for context in ([ord("a"), ord("b")], [ord("b"), ord("b")], [32, ord("z")]):
        total = np.zeros(2)
        for c in alphabet:
            h = language_id.gram_hashes(np.array([*context, c], np.uint32), 3)
            total += np.exp(model.blocks[0].log_probs([x[-1:] for x in h], [x[-2:-1] for x in h[:-1]], 3)[0])
        # what is missing is the share of characters that no text has
        assert (total <= 1 + 1e-6).all() and (total > 0.7).all()


class KneserNey:
    """Interpolated Kneser-Ney by its definition, with dicts of strings."""

    def __init__(self, texts, order, alphabet):
        self.order, self.alphabet = order, alphabet
        self.counts = [Counter() for _ in range(order)]
        top = Counter()
        for t in texts:
            padded = " " * (order - 1) + t
            for i in range(1, len(t)):  # the leading space isn't predicted
                top[padded[i : i + order]] += 1
        self.counts[order - 1] = top
        for k in range(order - 1, 0, -1):
            for gram in self.counts[k]:
                self.counts[k - 1][gram[1:]] += 1
        self.discount = []
        for c in self.counts:
            ones, twos = (sum(n == k for n in c.values()) for k in (1, 2))
            self.discount.append(ones / (ones + 2 * twos) if ones and twos else 0.5)

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / (self.alphabet + 1)
        after = {g: n for g, n in self.counts[k - 1].items() if g[:-1] == gram[:-1]}
        total, d = sum(after.values()), self.discount[k - 1]
        if not total:
            return self.p(gram[1:])
        return max(after.get(gram, 0) - d, 0) / total + d * len(after) / total * self.p(gram[1:])

    def entropy(self, text):
        padded = " " * (self.order - 1) + text
        return -sum(math.log(self.p(padded[i : i + self.order])) for i in range(1, len(text))) / (len(text) - 1)


@pytest.mark.parametrize("lang_block", [1, 2, 64])
def test_kneser_ney_by_its_definition(lang_block):
    """However languages are cut into blocks."""
    texts = {"x": ["The cat, the hat.", "a cat sat"], "y": ["der Hut und", "die Katze", "ß"], "z": ["zzz"], "w": ["l'été été"]}
    plain = {lang: ["".join(map(chr, language_id.reduced(t))) for t in own] for lang, own in texts.items()}
    alphabet = len({c for own in plain.values() for t in own for c in t[1:]})
    model = language_id.estimate({lang: language_id.count_grams(own, 3) for lang, own in texts.items()}, lang_block)
    asked = ["the cat", "Katze und Hut", "q", "été zz", "unseen Ω"]
    entropy, sizes = model.entropies([language_id.reduced(t) for t in asked])
    assert model.langs == ["w", "x", "y", "z"] and model.alphabet == alphabet
    for t, found, n in zip(asked, entropy, sizes):
        text = "".join(map(chr, language_id.reduced(t)))
        assert n == len(text) - 1
        assert found == pytest.approx([KneserNey(plain[lang], 3, alphabet).entropy(text) for lang in model.langs], rel=1e-4)


def test_more_languages_than_a_block_holds(documents):
    """A language a letter pair, each learnt and told, however rare."""
    pairs = [a + b for a in "abcdefgh" for b in "ijklmnopqrstuvwxyz"]
    learnt = [i for i in range(4000) if not held_out(i)]
    rows = [(learnt[2 * k + j], " ".join([pair, pair[::-1], pair * 2] * 9), pair, "s") for k, pair in enumerate(pairs) for j in range(2)]
    model = language_id.train(documents(rows).select("doc_id", "text", "lang"), order=3)
    assert model.langs == sorted(pairs) and len(model.blocks) == -(-len(pairs) // language_id.LANG_BLOCK) > 1
    told = language_id.predict(documents([(9000 + k, " ".join([pair * 2, pair] * 5), None, "s") for k, pair in enumerate(pairs)]), model)
    assert {r["doc_id"]: r["lang_pred"] for r in told.collect()} == {9000 + k: pair for k, pair in enumerate(pairs)}


def test_long_documents_are_sampled_only_where_there_are_no_others(documents, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_CHARS", 40)
    learnt = [i for i in range(200) if not held_out(i)]
    rows = [(i, "short one", "a", "s") for i in learnt[:5]] + [(i, "long text " * 9, "a", "s") for i in learnt[5:9]] + [(i, "long only " * (9 + i), "b", "s") for i in learnt[9:20]]
    sample = language_id.sample_of(documents(rows), 100).collect()
    assert sorted((r["lang"], r["long"]) for r in sample) == [("a", False)] * 5 + [("b", True)]


def test_sample_is_the_same_with_more_languages_than_are_broadcast(documents, monkeypatch):
    rows = [(i, f"text {i} " * (1 + i % 3), "common" if i % 4 else f"rare {i % 64}", "s") for i in range(1500)]
    rows += [(i, f"again {i}", "common", "s") for i in range(0, 1500, 5)] + [(None, "no id", "common", "s")] * 3
    sample = lambda: sorted((r["lang"], r["nth"], str(r["doc_id"]), r["text"]) for r in language_id.sample_of(documents(rows), 20).collect())
    at_once = sample()
    monkeypatch.setattr(language_id, "COUNTS_AT_ONCE", 3)
    assert sample() == at_once and len({lang for lang, *_ in at_once}) == 17


def test_rejection_is_read_from_the_tail():
    z = np.random.default_rng(0).exponential(size=4000)
    assert language_id.tail_bound(z, 1e-4) == pytest.approx(-np.log(1e-4), rel=0.1)
    assert language_id.tail_bound(z[:50]) == language_id.REJECT_Z


def test_long_texts_are_scored_in_chunks(model, monkeypatch):
    texts = [language_id.reduced(t) for _, t, _, _ in corpus(20)] + [language_id.reduced("der die das " * 300)]
    whole, sizes = model.entropies(texts)
    monkeypatch.setattr(language_id, "CHUNK", 37)
    parts, again = model.entropies(texts)
    assert np.allclose(whole, parts) and (sizes == again).all()


def toxic_rows(n=900):
    rng = random.Random(9)
    out = []
    for k in range(n):
        words = [rng.choice(WORDS["en"]) for _ in range(rng.randrange(8, 60))]
        bad = k % 6 == 0
        for _ in range(3 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "zorkface", "st*pid", "you MORON!!"]))
        out.append((k, " ".join(words), int(bad)))
    return out


@pytest.fixture(scope="module")
def judged(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return toxicity.train(docs, labels)


def test_toxicity_held_out(spark, documents, judged):
    rows = toxic_rows()
    got = {r["doc_id"]: r["score"] for r in toxicity.score(documents([(i, t, "en", "s") for i, t, _ in rows]), judged).collect()}
    held = [(got[i], y) for i, _, y in rows if held_out(i)]
    assert sum((s >= 0.5) == bool(y) for s, y in held) / len(held) > 0.95
    assert "zorkface" in judged.weights


def test_toxicity_of_odd_rows(documents, judged):
    rows = [(1, None, None, None), (2, "", "en", "s"), (None, "the of", "en", "s"), (4, "idiot " * 30_000, "en", "s"), (4, "x", "en", "s")]
    got = [r["score"] for r in toxicity.score(documents(rows), judged).collect()]
    assert len(got) == 5 and all(0 <= s <= 1 for s in got) and got[3] > 0.5 > got[2]
    assert toxicity.score(documents([]), judged).count() == 0


def test_toxicity_without_labels(spark, documents):
    docs, none = documents([(1, "a", "en", "s")]), spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, toxic int")):
        assert toxicity.score(docs, toxicity.train(docs, labels)).first()["score"] in (0.0, 1.0)


def test_scores_rest_on_the_text_alone(documents, judged):
    a, b = documents([(1, "you idiot of the", "en", "s")]), documents([(77, "you idiot of the", None, None)])
    assert toxicity.score(a, judged).first()["score"] == toxicity.score(b, judged).first()["score"]


def test_isotonic_fit():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert x.tolist() == [1, 2.5, 4] and y.tolist() == [0, 0.5, 1]


def test_isotonic_fit_against_every_way_to_cut():
    """The best non-decreasing step function, of all cuts of the points into blocks of their means."""
    rng = np.random.default_rng(7)
    for _ in range(30):
        n = int(rng.integers(2, 8))
        x, y, w = np.sort(rng.random(n)), rng.integers(0, 2, n).astype(float), rng.integers(1, 4, n).astype(float)
        best = None
        for cuts in range(1 << (n - 1)):
            block = np.cumsum([0, *((cuts >> k) & 1 for k in range(n - 1))])
            level = np.bincount(block, w * y) / np.bincount(block, w)
            loss = (w * (y - level[block]) ** 2).sum()
            if (np.diff(level) >= 0).all() and (best is None or loss < best[0] - 1e-12):
                best = loss, level[block]
        at, level = toxicity.isotonic(x, y, w)
        spread, k, left = [], 0, n
        # a block's middle is the weighted mean of its points: walk through them in order
        for m, v in zip(at, level):
            size = next(s for s in range(1, left + 1) if abs(np.average(x[k : k + s], weights=w[k : k + s]) - m) < 1e-12)
            spread += [v] * size
            k, left = k + size, left - size
        assert left == 0
        assert (w * (y - np.array(spread)) ** 2).sum() == pytest.approx(best[0]) and np.allclose(spread, best[1])


def test_first_tree_against_exhaustive_splits(monkeypatch):
    """One tree, level by level: each node takes the split of the greatest gain of all features and cuts."""
    monkeypatch.setattr(toxicity, "TREES", 1)
    monkeypatch.setattr(toxicity, "DEPTH", 2)
    rng = np.random.default_rng(11)
    x = np.round(rng.random((60, 4)), 2)
    y = ((x[:, 1] > 0.4) & (x[:, 3] < 0.7) | (x[:, 0] > 0.9)).astype(float)
    w = rng.integers(1, 4, 60).astype(float)
    trees = toxicity.Trees().fit(x, y, w)
    base = np.average(y, weights=w)
    g, h = w * (base - y), w * base * (1 - base)
    part = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 1)

    def grow(rows, depth):
        if depth == 0:
            out = np.zeros(60)
            out[rows] = -toxicity.RATE * g[rows].sum() / (h[rows].sum() + 1)
            return out
        best = (1e-6, rows, rows[:0])
        for k in range(4):
            for edge in trees.edges[k]:
                low, high = rows[x[rows, k] < edge], rows[x[rows, k] >= edge]
                if len(low) and len(high) and min(h[low].sum(), h[high].sum()) >= 1:
                    gain = part(low) + part(high) - part(rows)
                    if gain > best[0] + 1e-12:
                        best = (gain, low, high)
        return grow(best[1], depth - 1) + (grow(best[2], depth - 1) if len(best[2]) else 0)

    assert np.allclose(trees.margin(x), np.log(base / (1 - base)) + grow(np.arange(60), 2))


def test_lexicon_of_a_fold_leaves_out_its_documents(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PARTS", 4)
    rows = [(k, "zork the" if k % 2 else "plain the", k % 2, 1.0, 1 + k % 3) for k in range(120)] + [(500 + k, "glorp", 1, 1.0, 2) for k in range(20)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int, weight double, part long")
    learning = {y: [sum(r[2] == y and r[4] == p for r in rows) for p in (1, 2, 3)] for y in (0, 1)}
    every, one, two, three = toxicity.learn_lexicons(sample, learning)
    assert {"zork", "glorp"} <= set(every) and "glorp" in one and "glorp" in three and "glorp" not in two and "zork" in two
    bad, good = 60, 0
    assert every["zork"] == pytest.approx(math.log((bad + 0.5) / (80 + 1)) - math.log((good + 0.5) / (60 + 1)))


def test_trees_learn_a_rule():
    x = np.random.default_rng(2).random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    margin = toxicity.Trees().fit(x, y, np.ones(600)).margin(x)
    assert ((margin > 0) == (y > 0)).mean() > 0.95
