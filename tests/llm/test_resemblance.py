"""Near copies by shingle sets, against brute force."""

import random

import numpy as np
import pytest

from tidegauge.llm import resemblance, simhash
from test_simhash import fingerprint, roots


def shingles(text, n=5):
    words = text.lower().split()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a and b else 0


def edited(n=150):
    rng = random.Random(21)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 40, 150, 400]))] for _ in range(30)]
    out = []
    for k in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(1 + len(words) // 40)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(999)}"
        out.append((k, " ".join(words)))
    return [*out, (500, None), (501, ""), (502, "one two"), (503, "One  two")]


def wanted(rows):
    fps, sets = {i: fingerprint(t) for i, t in rows}, {i: shingles(t or "") for i, t in rows}
    near = lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4
    both = roots(sorted(fps), lambda a, b: near(a, b) or similarity(sets[a], sets[b]) >= 0.8)
    return both, roots(sorted(fps), near)


def test_what_shares_shingles_is_joined(texts):
    rows = edited()
    want, by_bits = wanted(rows)
    left = {r["doc_id"] for r in simhash.drop_near_duplicates(texts(*rows), similarity=0.8).collect()}
    assert left == set(want.values()) and len(left) < len(set(by_bits.values()))


@pytest.mark.parametrize("chunk", [1, 900])
def test_components_of_candidates_are_compared_in_chunks(texts, chunk):
    rows = edited(60)
    docs = texts(*rows)
    fps = simhash.fingerprints(docs)
    edges = resemblance.resembling(docs, fps, simhash.components, chunk=chunk)
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    sets, fp_of = {i: shingles(t or "") for i, t in rows}, {r["doc_id"]: r["fp"] for r in fps.collect()}
    want = roots(sorted(sets), lambda a, b: fp_of[a] == fp_of[b] or similarity(sets[a], sets[b]) >= 0.8)
    got = roots(sorted(sets), lambda a, b: found.get(fp_of[a], fp_of[a]) == found.get(fp_of[b], fp_of[b]))
    assert got == want


def test_links_are_of_similar_sets_alone():
    sets = [np.arange(a, a + 90, dtype=np.uint64) for a in (0, 10, 20, 200)]
    assert resemblance.alike(sets, 0.8) == [(0, 1), (1, 2)]
    assert resemblance.alike([sets[0], sets[2]], 0.8) == []
