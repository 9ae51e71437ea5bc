import gzip

import pytest

from tidegauge.llm import warc


def run(spark, rows, **options):
    pages = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, revisit string")
    records = warc.read_archives(spark, warc.write_archives(pages, **options))
    return records.select("*", warc.page_id_of("record_id").alias("page_id"), warc.page_id_of("refers_to_id").alias("refers_to"))


def brute(rows, min_bytes=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= min_bytes and (h or "") in first and first[h or ""] != i
        out.append((i, len(data), warc.digest(data), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=repr)


ROWS = [(k, f"http://x/{k}", "<p>" + "é" * (k % 5) * 300 + "</p>") for k in range(40)] + [(-7, None, "neg"), (100, "http://x/a b\r\nWARC-Type: no", "neg"), (101, "u", None), (102, "u", ""), (None, "u", "neg"), (None, "u", "alone"), (1 << 62, "u", "big"), (103, "u", "big" * 200_000)]


@pytest.mark.parametrize("options", [{}, {"archive_bytes": 300}, {"min_bytes": 10}])
def test_round_trip(spark, options):
    got = run(spark, ROWS, **options).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == brute(ROWS, options.get("min_bytes", 0))


def test_payloads_come_back(spark):
    got = {r["page_id"]: r for r in run(spark, ROWS).where("page_id is not null").collect()}
    for i, _, h in ROWS:
        if i is not None and got[i]["record_type"] == "response":
            assert bytes(got[i]["payload"]) == (h or "").encode()
    assert got[100]["url"] == "http://x/a%20b%0D%0AWARC-Type:%20no"


def test_odd_tables(spark):
    assert run(spark, []).count() == 0
    twice = run(spark, [(4, "u", "same"), (4, "u", "same"), (9, "u", "same")]).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in twice) == [(4, "response", None), (4, "response", None), (9, "revisit", 4)]


def member(**changes):
    data = warc.record(5, "u", b"hello\r\n\r\nworld", None, False)
    for old, new in changes.get("replace", []):
        assert old in data
        data = data.replace(old, new)
    return gzip.compress(data)


def test_reader_is_incremental():
    whole = member() * 3
    for size in (1, 7, 1 << 16):
        found = list(warc.read_records(whole[k : k + size] for k in range(0, len(whole), size)))
        assert [block.partition(b"\r\n\r\n")[2] for _, block in found] == [b"hello\r\n\r\nworld"] * 3
        assert found[0][0]["warc-type"] == "response"


@pytest.mark.parametrize(
    "bad",
    [
        member()[:-10],
        member(replace=[(b"world", b"w0rld")]),
        member(replace=[(b"WARC/1.1", b"NOPE/1.1")]),
        member(replace=[(b"world\r\n\r\n", b"world\r\n\r\n\r\n")]),
    ],
)
def test_damage_is_noticed(bad):
    with pytest.raises(ValueError):
        list(warc.read_records([bad]))
