"""The pipeline's stages, each held against brute force on its own input, and the whole of them."""

import random
import re

import pytest

import corpus_pipeline
from test_exact_dedup import norm
from test_mixing import water_filled, words
from test_packing import check
from test_simhash import fingerprint, roots


@pytest.fixture(scope="module")
def documents_table(spark):
    """Clean documents in two languages, copies of some, near copies of others, and rejects."""
    rng = random.Random(12)
    base = {"en": "the of and to in that was for is on with he as his at by this had".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem".split()}
    rows = []
    for k in range(160):
        lang = rng.choice(["en", "de"])
        text = " ".join(rng.choice(base[lang]) for _ in range(rng.randrange(40, 160)))
        rows.append((k, text, lang, f"src{k % 3}"))
    for k in range(0, 40, 2):
        rows.append((200 + k, rows[k][1].replace(" ", "\n" if k % 4 else "  "), rows[k][2], "src0"))
        rows.append((300 + k, rows[k][1] + " extra", rows[k][2], "src1"))
    rows += [(400, None, None, "src0"), (401, "", "en", "src1"), (402, "123 456 !!", None, None), (403, "the of and to in that", None, None)]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def kept(spark, documents_table, tmp_path_factory):
    """Each stage's input and output rows, in order."""
    docs, out, folder = documents_table, [], tmp_path_factory.mktemp("stages")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = docs.collect()
        stage(spark, docs, None).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == documents_table.columns, name
        out.append((given, docs.collect()))
    return out


def pairs(rows):
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=repr)


def test_language_stage_drops_what_has_no_language(kept):
    given, left = kept[0]
    assert pairs(left) == pairs(r for r in given if r["doc_id"] not in (400, 401, 402))


def test_exact_stage(kept):
    given, left = kept[1]
    best = {}
    for r in given:
        best.setdefault(norm(r["text"]), []).append((-len(r["text"]), r["doc_id"]))
    stay = {min(g)[1] for g in best.values()}
    assert pairs(left) == pairs(r for r in given if r["doc_id"] in stay) and len(left) < len(given)


def shingles(text, n=5):
    told = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(told[k : k + n]) for k in range(max(1, len(told) - n + 1))}


def test_near_stage(kept):
    """Links of fingerprints within 4 bits, and of sets of 5-word shingles with a similarity of 0.8 or more."""
    given, left = kept[2]
    fps = {r["doc_id"]: fingerprint(r["text"]) for r in given}
    sets = {r["doc_id"]: shingles(r["text"]) for r in given}
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    root = roots(sorted(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4 or alike(a, b))
    assert pairs(left) == pairs(r for r in given if root[r["doc_id"]] == r["doc_id"])
    # copies with one word more go; all else is clean and stays
    assert {r["doc_id"] for r in left} == {r["doc_id"] for r in given if not 300 <= r["doc_id"] < 400}


def test_mixing_stage(kept):
    given, left = kept[3]
    sizes, taken, texts = {}, {}, {}
    for r in given:
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
        texts[r["doc_id"]] = r["text"]
    for r in left:
        taken[r["source"]] = taken.get(r["source"], 0) + words(r["text"])
        assert texts[r["doc_id"]].startswith(r["text"])
    assert taken == {s: int(t + 1e-9) for s, t in water_filled(sizes).items()}


def test_packing_stage(kept):
    given, left = kept[4]
    check([(r["doc_id"], r["text"]) for r in given], left)


def test_run_applies_all_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.select("doc_id").distinct().count() > 100
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_empty_documents(spark, documents_table):
    docs = documents_table.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, None).count() == 0
