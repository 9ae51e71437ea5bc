import json
import random
import zlib

import numpy as np
import pytest

from tidegauge.llm import packing
from tidegauge.llm.queries import vocabulary

public_tokenizers = pytest.importorskip("public_tokenizers")


def ids_of(text):
    from tokenizers import Tokenizer

    if not hasattr(ids_of, "t"):
        ids_of.t = Tokenizer.from_file(vocabulary())
    return [*ids_of.t.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, pieces, capacity=2048):
    """Each id in exactly one piece, in order, and each sequence gapless; gives the share of padding."""
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(ids_of(t))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert by_doc.keys() == want.keys()
    for i, own in by_doc.items():
        expected = []
        for ids in want[i]:
            at = 0
            for n in packing.cut_lengths(len(ids), capacity):
                expected.append((at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)))
                at += n
            assert at == len(ids)
        assert sorted((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in own) == sorted(expected)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / sum(p["length"] for p in pieces)


def random_rows(n):
    rng = random.Random(2)
    words = ["the", " of", "Straße", "naïve", "1234", "\n\n", "  ", "<|endoftext|>", "don't", "😀", "x" * 40]
    return [(k, " ".join(rng.choice(words) for _ in range(int(rng.paretovariate(0.7) * 5) % 4000))) for k in range(n)]


@pytest.mark.parametrize("per_bucket", [20_000, 7])
def test_round_trip(texts, per_bucket):
    rows = random_rows(400)
    pieces = packing.pack(texts(*rows), vocabulary=vocabulary(), docs_per_bucket=per_bucket).collect()
    assert check(rows, pieces) < 0.03
    whole = {}
    for p in sorted(pieces, key=lambda p: p["start"]):
        whole.setdefault(p["doc_id"], bytearray()).extend(p["ids"])
    assert all(np.frombuffer(bytes(whole[i]), "<u4").tolist() == ids_of(t) for i, t in rows)


def test_added_tokens(texts):
    """A token by default, as in ``tokenizers``; ordinary text on request."""
    from tokenizers import Tokenizer

    rows = [*random_rows(60), (1000, "a <|endoftext|> b"), (1001, "<|endoftext|><|endoftext|>x"), (1002, "<|endoftext"), (1003, None)]
    for added in (True, False):
        plain = Tokenizer.from_file(vocabulary())
        plain.encode_special_tokens = not added
        want = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
        whole = {}
        options = {} if added else {"added_tokens": False}
        for p in sorted(packing.pack(texts(*rows), vocabulary=vocabulary(), **options).collect(), key=lambda p: p["start"]):
            whole.setdefault(p["doc_id"], bytearray()).extend(p["ids"])
            assert p["doc_tokens"] == len(want[p["doc_id"]])
        assert {i: np.frombuffer(bytes(b), "<u4").tolist() for i, b in whole.items()} == want
        assert (want[1000] == [64, 220, 50256, 275, 1]) == added


def test_sequence_ids_never_run_into_each_other(texts, monkeypatch):
    rows = random_rows(40)
    monkeypatch.setattr(packing, "LEVEL_BITS", 63 - (6).bit_length() - (2048).bit_length())
    with pytest.raises(ValueError):
        packing.pack(texts(*rows), vocabulary=vocabulary(), docs_per_bucket=7)
    monkeypatch.setattr(packing, "LEVEL_BITS", 62 - (6).bit_length() - (2048).bit_length())
    with pytest.raises(Exception, match="63 bits"):
        packing.pack(texts(*rows, (99, "long word " * 9000)), vocabulary=vocabulary(), docs_per_bucket=7).collect()


def test_odd_rows(texts):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (3, "b c"), (None, "null id"), (5, "long word " * 20_000), (6, "y" * 5000)]
    assert check(rows, packing.pack(texts(*rows), vocabulary=vocabulary()).collect()) < 0.1
    assert packing.pack(texts(), vocabulary=vocabulary()).count() == 0


def test_classes():
    for n in [*range(1, 5000), 123_457]:
        cuts = packing.cut_lengths(n)
        assert sum(cuts) == n and all(c in packing.class_lengths() or c < packing.SHORTEST for c in cuts)
        assert len(cuts) - n // packing.CAPACITY <= 5
    assert packing.cut_lengths(0) == []


def test_ids_are_ranks_of_the_vocabulary_file():
    with open(vocabulary(), encoding="utf-8") as file:
        model = json.load(file)["model"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = ["".join(pair) for pair in pairs]
    ids = [model["vocab"][m] for m in made]
    assert ids == sorted(ids)
