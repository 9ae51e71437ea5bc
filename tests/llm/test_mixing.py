import re

import pytest

from tidegauge.llm import mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def rows(mixed):
    return {(r["doc_id"], r["source"]): r for r in mixed.collect()}


def water_filled(sizes, share=1.5, cap=2.0):
    """Targets by the rule as it is told: share out, cut at the caps, share the excess out again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, target, full = share * sum(sizes.values()), dict.fromkeys(names, 0.0), set()
    while left > 1e-9 and len(full) < len(names):
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in open_:
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                full.add(s)
    return target


def corpus():
    out, k = [], 0
    for source, n in (("b", 40), ("a", 7), (None, 5), ("é", 3), ("c", 60)):
        for _ in range(n):
            out.append((k, " ".join(f"w{j}" for j in range(k * 7 % 11)) if k % 13 else None, "en", source))
            k += 1
    return out


def test_targets_and_taken_words(documents):
    data = corpus()
    got = rows(mixing.plan_mix(documents(data), rows_per_cell=3))
    sizes = {}
    for i, t, _, s in data:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = water_filled(sizes)
    taken = {}
    for i, t, _, s in data:
        r = got[i, s]
        assert r["size"] == words(t) and r["source_size"] == sizes[s] and 0 <= r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(want[s])
        taken[s] = taken.get(s, 0) + r["taken"]
    assert taken == {s: int(t + 1e-9) for s, t in want.items()}


def test_cells_do_not_change_the_result_and_reruns_agree(documents):
    data = documents(corpus())
    one, many = (sorted((r["doc_id"], r["taken"], r["start"]) for r in mixing.plan_mix(data, rows_per_cell=n).collect()) for n in (1000, 2))
    assert one == many == sorted((r["doc_id"], r["taken"], r["start"]) for r in mixing.plan_mix(data.repartition(5), rows_per_cell=2).collect())


def test_mix_repeats_and_cuts_documents(documents):
    data = documents(corpus())
    plan = rows(mixing.plan_mix(data))
    out = mixing.mix(data)
    assert out.columns == data.columns
    counted = {}
    for r in out.collect():
        counted[r["doc_id"], r["source"]] = counted.get((r["doc_id"], r["source"]), 0) + words(r["text"])
    assert counted == {k: r["taken"] for k, r in plan.items() if r["taken"]}
    texts = {(i, s): t for i, t, _, s in corpus()}
    assert all(texts[r["doc_id"], r["source"]].startswith(r["text"]) for r in out.collect())


def test_curriculum_positions_follow_the_schedules(documents):
    """A source whose weight falls to 0 comes early, one that rises from 0 comes late."""
    early, late = [(0, 2), (0.5, 2), (1, 0)], [(0, 0), (1, 2)]
    data = documents([(k, "a b c d", "en", "early" if k < 200 else "late") for k in range(400)])
    plan = mixing.plan_mix(data, share=1.0, schedules=[early, late]).collect()
    mean = lambda s: sum(r["position"] for r in plan if r["source"] == s and r["taken"]) / sum(r["source"] == s and r["taken"] > 0 for r in plan)
    assert mean("early") < 0.45 < 0.6 < mean("late")
    for r in plan:
        if r["source"] == "late" and r["taken"]:
            assert r["position"] ** 2 == pytest.approx(r["start"] / r["target"])
    out = mixing.mix(data, share=1.0, schedules=[early, late]).rdd.map(lambda r: r["source"]).collect()
    assert out[:50].count("early") > 40 and out[-50:].count("late") > 40


def test_odd_tables(documents):
    assert mixing.plan_mix(documents([])).count() == 0 and mixing.mix(documents([])).count() == 0
    blank = mixing.plan_mix(documents([(1, "", "en", None), (None, None, None, "s")])).collect()
    assert [(r["size"], r["taken"], r["target"], r["position"]) for r in blank] == [(0, 0, 0.0, None)] * 2
    twice = mixing.plan_mix(documents([(1, "a b", "en", "s")] * 2)).collect()
    assert sum(r["taken"] for r in twice) == 6
    assert "kept" in mixing.plan_mix(documents([(1, "a", "en", "s")])).columns
    long = mixing.mix(documents([(1, "a " * 30_000, "en", "s"), (2, "b", "en", "t")])).collect()
    assert sum(words(r["text"]) for r in long if r["doc_id"] == 1) == 44_999 and sum(words(r["text"]) for r in long) == 45_001


def test_null_ids_are_spread_over_cells(documents):
    data = documents([(None, f"a b {k}", "en", "s") for k in range(3000)])
    plan = mixing.plan_mix(data, rows_per_cell=100)
    starts = [r["start"] for r in plan.collect()]
    assert sorted(starts) == list(range(0, 9000, 3))
    heads = mixing.laid_out(data, 1.5, 2.0, mixing.CONSTANT_3_1_2, 100)
    assert heads.select("mix_start").distinct().count() == 3000


def test_words_counted_before(documents):
    data = documents(corpus())
    counted = data.select("doc_id", "source", mixing.words_of().alias("n"))
    pick = lambda df: sorted((r["doc_id"], r["taken"], r["start"], r["position"]) for r in df.collect())
    assert pick(mixing.plan_mix(counted, words="n", schedules=mixing.CURRICULUM_3_1_2)) == pick(mixing.plan_mix(data, schedules=mixing.CURRICULUM_3_1_2))
    assert [mixing.area(s) for s in mixing.CURRICULUM_3_1_2] == [3, 1, 2]
