import random
import re

import numpy as np
import pytest
import xxhash

from tidegauge.llm import simhash


def fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def near_texts(n=80):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(500)}" for _ in range(120)] for _ in range(12)]
    out = []
    for k in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(120)] = f"new{rng.randrange(99)}"
        out.append((k, " ".join(words).title() if k % 5 == 0 else " ".join(words)))
    return out


def test_against_brute_force(texts):
    rows = [*near_texts(), (90, None), (91, ""), (92, " \n"), (93, "one"), (94, "One two"), (95, "É é É é É")]
    fps = {i: fingerprint(t) for i, t in rows}
    want = roots(sorted(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(texts(*rows)).collect()}
    assert got == {i: (f"{f:016x}", want[i]) for i, f in fps.items()}
    assert len(set(want.values())) < len(rows)


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(radius)
    for _ in range(3000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randrange(radius + 1)))
        assert any(x & m == 0 for m in masks)


@pytest.mark.parametrize("chunk", [2, 5, 1024])
def test_dense_buckets_are_compared_in_chunks(spark, chunk):
    rng = random.Random(1)
    centre, fps = rng.getrandbits(64), set()
    while len(fps) < 60:
        x = centre
        for _ in range(rng.randrange(7)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(40)}
    signed = {x: x - (1 << 64) * (x >> 63) for x in fps}
    df = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 4, chunk)).collect()}
    want = roots(sorted(signed.values()), lambda a, b: bin((a ^ b) % (1 << 64)).count("1") <= 4)
    assert {i: found.get(i, i) for i in want} == want


def test_long_chains_come_together(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1000), (500, 501)], "a long, b long")
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert found == {k: 0 for k in range(201)} | {500: 500, 501: 500}


def test_odd_rows(texts):
    assert simhash.near_duplicates(texts()).count() == 0
    rows = [(None, "x y z"), (4, "x y z"), (4, "x y z"), (5, "w " * 40_000), (None, "quite another text of its own")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(texts(*rows)).collect()), key=repr)
    assert got == [(4, 4), (4, 4), (5, 5), (None, 4), (None, None)]


def test_one_document_of_each_group_stays(texts):
    rows = [*near_texts(40), (100, None), (101, ""), (3, "a third row with a used id"), (102, "alone"), (102, "alone")]
    df = texts(*rows)
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    kept = {r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(kept)
    assert all((r["doc_id"], r["text"]) in rows for r in out.collect())


def test_forest_joins_what_is_near():
    fps = np.array([0, 1, 3, 7 << 40, (7 << 40) + 1], np.uint64)
    assert sorted(simhash.forest(fps, 1)) == [(0, 1), (0, 2), (3, 4)]
