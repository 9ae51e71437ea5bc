import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import exact_dedup


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    out, used = [], set()
    for i, t in rows:
        chars, _, keep = min(groups[norm(t)], key=lambda g: (g[0], g[1], g[2] or 0))
        kept = (len(t or ""), i) == (-chars, keep) and (i, t) not in used
        used.add((i, t)) if kept else None
        out.append((i, keep, len(groups[norm(t)]), kept, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(df, **options):
    return sorted((tuple(r) for r in exact_dedup.find_copies(df, **options).collect()), key=repr)


def random_rows(n=150):
    rng = random.Random(3)
    pool = ["".join(rng.choice("ab é\n\t") for _ in range(rng.randrange(60))) for _ in range(40)]
    return [(k, rng.choice(pool).replace(" ", " " * rng.randrange(1, 3))) for k in range(n)]


@pytest.mark.parametrize("options", [{}, {"block": 4}, {"block": 1}, {"block": 3, "block_hash": lambda b: F.pmod(F.xxhash64(b), F.lit(3))}])
def test_against_brute_force(texts, options):
    """The last case names blocks by content, as only three hashes are left."""
    rows = random_rows()
    assert run(texts(*rows), **options) == brute(rows)


def test_hashes_that_all_collide_do_not_merge_texts(texts):
    rows = [(k, "x" * k) for k in range(12)] + [(20, "x x x"), (21, "xy" * 9)]
    assert run(texts(*rows), block=2, block_hash=lambda b: F.lit(1).cast("long")) == brute(rows)


def test_odd_rows(texts):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a"), (5, "a"), (6, "é" * 5000), (7, "é" * 4999), (8, "é " * 5000), (9, "same"), (9, "same"), (9, "other")]
    assert run(texts(*rows), block=64) == brute(rows)
    assert run(texts()) == []
    assert [r[1] for r in run(texts((None, "q"), (None, "q ")))] == [None, None]


def test_long_texts_leave_no_trace_on_short_ones(texts):
    rows = [(1, "ab" * 20_000), (2, "ab" * 20_000 + "c"), (3, "b"), (4, " b"), (5, "ab" * 20_000 + "\n")]
    assert run(texts(*rows), block=16) == brute(rows)


def test_drop_copies_keeps_whole_rows(texts):
    rows = [*random_rows(60), (900, "twice"), (900, "twice"), (901, None)]
    df = texts(*rows)
    out = exact_dedup.drop_copies(df, block=8)
    assert out.columns == df.columns
    got = out.collect()
    assert len({norm(r["text"]) for r in got}) == len(got) == len({norm(t) for _, t in rows})
    assert {r["doc_id"] for r in got} == {i for i, _, _, kept, _ in brute(rows) if kept}
    assert all((r["doc_id"], r["text"]) in rows for r in got)


def test_no_python_on_the_executors(texts):
    plan = exact_dedup.find_copies(texts((1, "a"), (2, "a")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
