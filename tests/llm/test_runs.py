"""Substring and line dedup, and the index under them."""

import hashlib
import random
import re

import numpy as np
import pytest

from tidegauge.llm import line_dedup, runs, substring_dedup


def got(df):
    return sorted((r["doc_id"], r["n_items"], r["n_removed"], r["kept_text"]) for r in df.collect())


def substrings(rows, window):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i, w in words.items():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words.items():
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


def lines(rows, shortest=10):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\r\x0b\x0c"))
    first = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            first[key(x)] = min(first.get(key(x), i), i)
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if len(key(x)) < shortest or first[key(x)] == i]
        out.append((i, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out)


def passages(n=120):
    rng = random.Random(8)
    pool = [" ".join(rng.choice(["a", "b", "Été", "x1"]) for _ in range(rng.randrange(3, 30))) for _ in range(30)]
    return [(k * 3 % 301, rng.choice([" ", "\n", " \t"]).join(rng.choice(pool) for _ in range(rng.randrange(6)))) for k in range(n)]


@pytest.mark.parametrize("batches", [(1.0,), (0.2, 1.0), (0.2, 0.4, 0.6, 0.8, 1.0)])
def test_substrings_against_brute_force(texts, batches):
    rows = passages()
    assert got(substring_dedup.remove_substrings(texts(*rows), window=5, batches=batches)) == substrings(rows, 5)


def test_small_ranges_buckets_and_blocks(texts, monkeypatch):
    rows = passages(60)
    make = lambda: runs.remove_repeats(texts(*rows), substring_dedup.window_hashes(4), substring_dedup.drop_covered(4), check=np.uint8, chars_per_item=6, batches=(0.5, 1.0), bucket_chars=300, range_items=50)
    assert got(make()) == substrings(rows, 4)


@pytest.mark.parametrize("batches", [(1.0,), (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)])
def test_lines_against_brute_force(texts, batches):
    """Ten batches are merged into a run of the second level twice."""
    rng = random.Random(5)
    pool = ["Short", "", "  A longer line ", "a LONGER line", "ÉÉÉÉÉÉÉÉÉÉ", "éééééééééé", "ninechar9", "\tten chars!", "other line entirely", "x\rinside a line"]
    rows = [(k * 7 % 97, "\n".join(rng.choice(pool) + rng.choice(["", f" {k}"]) for _ in range(rng.randrange(8)))) for k in range(90)]
    assert got(line_dedup.remove_lines(texts(*rows), batches=batches)) == lines(rows)


def test_odd_rows(texts):
    rows = [(1, None), (2, ""), (3, "one two"), (4, "w " * 50_000), (5, "w " * 20), (6, "\n\n")]
    assert got(substring_dedup.remove_substrings(texts(*rows))) == substrings(rows, 13)
    assert got(line_dedup.remove_lines(texts(*rows))) == lines(rows)
    assert got(substring_dedup.remove_substrings(texts())) == [] == got(line_dedup.remove_lines(texts()))


def test_null_and_repeated_ids(texts):
    text = "a line that is long enough\nand another one of some length"
    rows = [(None, text), (None, text), (7, text), (7, text), (7, text + "\nonly here, once or twice"), (8, text)]
    out = sorted(((r["doc_id"], r["n_removed"]) for r in line_dedup.remove_lines(texts(*rows)).collect()), key=repr)
    assert out == [(7, 0), (7, 0), (7, 0), (8, 2), (None, 2), (None, 2)]


@pytest.mark.parametrize("shared_id", [None, 7])
def test_thousands_of_rows_with_one_id(texts, shared_id):
    """Each row loses what it shares with document 1, at places of its own, and nothing else."""
    common = "a line that is in the first document too"
    own = lambda k: [f"row {k} has line {j} of its own" for j in range(k % 9)]
    put = lambda k: [*own(k)[: k % 4], common, *own(k)[k % 4 :]]
    rows = [(1, common), *((shared_id, "\n".join(put(k))) for k in range(4000))]
    want = sorted((len(own(k)) + 1, 1, "\n".join(own(k))) for k in range(4000))
    out = [r for r in line_dedup.remove_lines(texts(*rows)).collect() if r["doc_id"] != 1]
    assert sorted((r["n_items"], r["n_removed"], r["kept_text"]) for r in out) == want
    want = sorted(" ".join(own(k)) for k in range(4000))
    out = [r for r in substring_dedup.remove_substrings(texts(*rows), window=9).collect() if r["doc_id"] != 1]
    assert sorted(r["kept_text"] for r in out) == want


def test_rows_with_one_id_are_spread_over_buckets():
    tags = np.random.default_rng(1).integers(-(2**63), 2**63, 4000)
    counts = np.bincount(runs.bucket_of(np.full(4000, runs.NO_ID), tags, 8), minlength=8)
    assert counts.min() > 400


def test_a_later_batch_is_held_against_the_index(spark, texts):
    index = runs.RunIndex(spark, 3, np.uint64, fanout=2)
    hash_text = line_dedup.line_hashes(10)
    flags = lambda path: sum(r["rows"] for r in runs.read_parts(spark, [path], "flags").collect())
    first = index.add(texts((9, "the first line\nthe second line")), hash_text, 2)
    second = index.add(texts((3, "the first line\na new line here"), (4, "a new line here")), hash_text, 2)
    third = index.add(texts((1, "the second line\na new line here\nnever seen yet")), hash_text, 2)
    assert [flags(p) for p in (first, second, third)] == [0, 2, 2]
    assert [len(level) for level in index.levels] == [1, 1]


def test_an_index_is_opened_again_by_another_session(spark, texts, tmp_path):
    """Batches in two sessions, with ranges that are cut as history grows, and a merge of levels."""
    rows = sorted((i, t) for i, t in dict(passages(150)).items())
    parts = [rows[k::7] for k in range(7)]
    index = substring_dedup.new_index(spark, f"file://{tmp_path}/index", 50, fanout=3)
    out = []
    for k, part in enumerate(parts):
        if k in (2, 5):
            index = runs.RunIndex.open(spark.newSession(), f"file://{tmp_path}/index")
        ranked = [(1000 * k + i, t) for i, t in part]
        index.make_room(200 * k, range_items=300)
        out += got(substring_dedup.remove_substrings(texts(*ranked), window=5, batches=(1.0,), index=index))
    assert out == substrings([(1000 * k + i, t) for k, part in enumerate(parts) for i, t in part], 5)
    assert index.ranges > 1 and [len(level) for level in index.levels] == [1, 2]
    assert index.items == sum(r["rows"] for r in index._read(index._runs(), "run").collect())


def test_a_batch_that_fails_leaves_the_index_as_it_was(spark, texts, tmp_path):
    path = f"file://{tmp_path}/index"
    index = line_dedup.new_index(spark, path, 10)
    line_dedup.remove_lines(texts((5, "a line that is long enough")), index=index).collect()

    def broken(text):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        index.add(texts((6, "a line that is long enough")), broken, 1)
    index = runs.RunIndex.open(spark, path)
    again = line_dedup.remove_lines(texts((1, "A line that is long enough"), (2, "another line")), batches=(1.0,), index=index)
    assert got(again) == [(1, 1, 1, ""), (2, 1, 0, "another line")]


def test_the_queries_batches_reach_the_second_level(spark, texts, monkeypatch):
    made = []
    real = runs.RunIndex.__init__
    monkeypatch.setattr(runs.RunIndex, "__init__", lambda self, *a, **k: (real(self, *a, **k), made.append(self))[0])
    rows = [(k, f"line number {k // 2} of this text") for k in range(400)]
    assert got(line_dedup.remove_lines(texts(*rows))) == lines(rows)
    assert got(substring_dedup.remove_substrings(texts(*rows), window=5)) == substrings(rows, 5)
    assert [[len(level) for level in index.levels] for index in made] == [[2, 1], [1, 1]]


def test_bits_that_verify_grow_with_the_corpus():
    for items in (10, 1e6, 1e9, 1e13):
        bits = 64 + runs.check_bits(items)
        assert items * items / 2 / 2.0**bits <= 2.0**-32
    hashes = substring_dedup.window_hashes(3)
    one, two = hashes(b"a b c d")
    again = substring_dedup.window_hashes(3)(b"x a b c d")
    assert (one == again[0][1:]).all() and (two == again[1][1:]).all() and not (one == two).any()


def test_more_words_than_are_first_made_room_for(texts, monkeypatch):
    rows = [(k, " ".join(f"w{(k // 2) * 100 + j}" for j in range(120))) for k in range(60)]
    assert got(substring_dedup.remove_substrings(texts(*rows))) == substrings(rows, 13)
    monkeypatch.setattr(substring_dedup, "REMEMBER", 50)
    hashes, again = substring_dedup.window_hashes(3), substring_dedup.window_hashes(3)
    every = [hashes(t.encode())[0] for _, t in rows]
    assert all((a == again(t.encode())[0]).all() for a, (_, t) in zip(every, rows))


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    a, b = np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64)), rng.integers(0, 255, 7).astype(np.uint8)
    x, y, z = runs.unpack_arrays(runs.pack_arrays(runs.steps(a), b, np.zeros(0, np.int64)), np.uint64, np.uint8, np.int64)
    assert (runs.sums(x) == a).all() and (y == b).all() and len(z) == 0


def test_check_bits_part_equal_hashes():
    hashes, checks = np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 1, 0], np.uint8)
    late, first = runs.firsts(hashes, checks, np.array([30, 10, 20, 0]), np.arange(4))
    assert late.tolist() == [True, False, False, False] and first.tolist() == [False, True, True, True]


def test_digest_of_the_query(texts):
    from pyspark.sql import functions as F

    row = substring_dedup.remove_substrings(texts((1, "é b\tc"))).select(F.sha2("kept_text", 256)).first()
    assert row[0] == hashlib.sha256("é b c".encode()).hexdigest()
