import hashlib

import pytest

from codeweave.llm import warc

BIG = "<p>" + "é" * 60
ROWS = [(5, "http://a/1", BIG), (3, "http://a/2\r\nX: y", BIG), (9, None, BIG), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (6, "u", ""), (7, "u", BIG + "!"), (7, "u", BIG + "!"), (None, "u", BIG)]


def archive(spark, rows):
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, digest string, holder string")
    return warc.write_archive(pages)


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_records(spark, monkeypatch, bound):
    monkeypatch.setattr(warc, "BROADCAST_IDS", bound)
    folder = archive(spark, ROWS)
    got = sorted(tuple(r) for r in warc.read_archive(spark, folder).collect())
    want = []
    for i, _, html in ROWS:
        if i is not None:
            raw = (html or "").encode()
            first = min(j for j, _, h in ROWS if j is not None and (h or "") == (html or ""))
            revisit = len(raw) >= 100 and first < i
            want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=lambda r: tuple((x is None, x) for x in r[:4]))
    assert spark.read.parquet(f"{folder}/payloads").count() == 4


def test_reconstructed_records(spark):
    records = {r.page_id: r for r in warc.reconstruct(spark, archive(spark, ROWS[:4])).collect()}
    head, _, block = bytes(records[3].record).partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"\nX:" not in head
    assert block == BIG.encode() + b"\r\n\r\n" and f"Content-Length: {len(BIG.encode())}".encode() in head
    head, _, block = bytes(records[5].record).partition(b"\r\n\r\n")
    assert b"WARC-Type: revisit" in head and b"WARC-Refers-To: <urn:page:3>" in head and block == b"\r\n\r\n"
    assert bytes(records[5].payload) == BIG.encode()


@pytest.mark.parametrize("damage", ["cast('other' as binary) as payload", "substring(payload, 1, 5) as payload", None])
def test_damage_is_found(spark, damage):
    folder = archive(spark, ROWS[:1])
    stored = spark.read.parquet(f"{folder}/payloads").selectExpr("digest", damage).collect() if damage else []
    spark.createDataFrame(stored, "digest string, payload binary").write.mode("overwrite").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="match its header"):
        warc.read_archive(spark, folder).collect()


def test_one_payload_in_many_records(spark, monkeypatch):
    from codeweave.plans import joins

    monkeypatch.setattr(joins.dealt_join, "__defaults__", ("inner", 5))
    monkeypatch.setattr(joins.frequent, "__defaults__", (5,))
    monkeypatch.setattr(warc, "BROADCAST_IDS", 0)
    got = warc.read_archive(spark, archive(spark, [(i, "u", "" if i % 2 else BIG) for i in range(60)])).collect()
    assert len(got) == 60 and sum(r.record_type == "revisit" and r.refers_to == 0 for r in got) == 29


def test_empty(spark):
    assert warc.read_archive(spark, archive(spark, [])).collect() == []
