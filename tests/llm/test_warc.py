"""WARC archives: the contract's columns by SQL, whole round trips, ranges, foreign archives, odd rows."""

from __future__ import annotations

import base64
import gzip
import hashlib

import pytest
from oracle import differences
from pyspark.sql import functions as F

from plumbline.llm import queries as Q
from plumbline.llm.common import shared_folder
from plumbline.llm.warc import entries, index_archives, ranges, read_records, row_id, write_archives

SCHEMA = "page_id long, url string, html string, type string, digest string, head string, copy int"
LONG = "<p>lång</p>\r\n\r\nWARC/1.1\r\n" * 100_000
ROWS = [
    (1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, "same"), (3, None, "same"), (3, "http://b/", "same"), (4, "http://c/\r\nX: y", ""), (5, "http://d/", None),
    (None, "http://e/", "no id"), (None, None, "no id"), (6, "http://f/", LONG), (7, "http://g/", "\r\n\r\n"), (8, "", "é\u0000 \U0001f600"), (9, "u", "twice"), (9, "u", "twice"), (9, "u", "twice"),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], SCHEMA)


def read_back(spark, df, **options):
    folder = shared_folder(spark, "warc-test")
    write_archives(df, f"{folder}/a", **options)
    index_archives(spark, f"{folder}/a").write.parquet(f"{folder}/i")
    index = spark.read.parquet(f"{folder}/i")
    found = read_records(index).withColumn("id", row_id(F.col("record_id"), "long")).withColumn("of", row_id(F.col("refers_to"), "long"))
    return index, found.collect()


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, sf):
    assert differences(Q.op11_warc(spark, f"/root/testdata/{sf}"), Q.OP11_SQL, f"/root/testdata/{sf}") == []


def test_odd_rows_against_sql_and_round_trip(spark, tmp_path):
    pages(spark).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    assert differences(Q.op11_warc(spark, str(tmp_path)), Q.OP11_SQL, str(tmp_path)) == []
    _, found = read_back(spark, pages(spark))
    assert len(found) == len(ROWS) and len({r.record_id for r in found}) == len(ROWS)
    made = {r.id: r for r in found if r.record_type == "response"}
    assert all(r.verified for r in found if r.record_type == "response") and bytes(made[6].payload).decode() == LONG
    assert made[8].payload.decode() == "é\u0000 \U0001f600" and made[8].url == "" and made[7].payload == b"\r\n\r\n"
    again = [r for r in found if r.record_type == "revisit"]
    assert sorted((r.id, r.of) for r in again if r.payload_digest == b32("same")) == [(1, 3), (2, 3), (3, 3), (3, 3)]
    assert sorted((r.id, r.of) for r in again if r.payload_digest == b32("twice")) == [(9, 9), (9, 9)]
    assert all(r.payload is None and r.verified is None and r.payload_bytes == 4 for r in again if r.payload_digest == b32("same"))
    responses = {r.record_id for r in found if r.record_type == "response"}
    assert all(r.refers_to in responses for r in again)
    assert [r.url for r in found if r.id == 4] == ["http://c/%0D%0AX: y"]


def test_small_payloads_are_all_responses(spark):
    _, found = read_back(spark, pages(spark), min_bytes=5)
    kinds = {(r.payload_digest, r.record_type) for r in found}
    assert (b32("same"), "revisit") not in kinds and (b32("twice"), "revisit") in kinds and len({r.record_id for r in found}) == len(ROWS)


def test_empty_table(spark):
    index, found = read_back(spark, pages(spark, []))
    assert index.count() == 0 and found == []


def test_selected_records_only(spark):
    rows = [(k, f"http://h/{k}", f"page {k} " * (k % 50)) for k in range(2000)]
    folder = shared_folder(spark, "warc-test")
    write_archives(pages(spark, rows).repartition(4), f"{folder}/a")
    index_archives(spark, f"{folder}/a").write.parquet(f"{folder}/i")
    wanted = spark.read.parquet(f"{folder}/i").where(F.col("url").rlike("7$"))
    found = read_records(wanted, task_bytes=10_000).collect()
    assert sorted(r.url for r in found) == sorted(u for k, u, _ in rows if k % 10 == 7)
    by_url = {u: t for _, u, t in rows}
    assert all(r.payload is None or bytes(r.payload).decode() == by_url[r.url] for r in found)


def test_ranges_are_coalesced_and_bounded():
    rows = [{"file": f, "offset": o, "length": 10} for f, o in [("a", 0), ("a", 10), ("a", 25), ("a", 100), ("b", 110), ("b", 120), ("b", 130)]]
    assert [[r["offset"] for r in run] for run in ranges(iter(rows), 5, 25)] == [[0, 10], [25], [100], [110, 120], [130]]
    assert [[r["offset"] for r in run] for run in ranges(iter(rows), 5, 1000)] == [[0, 10, 25], [100], [110, 120, 130]]


def test_archives_of_others(spark, tmp_path):
    def one(kind, block, digest=None, more=""):
        head = f"WARC/1.0\nWARC-Type: {kind}\r\nwarc-record-id: <urn:x:{kind}>\r\nLong: a\r\n b\r\n{more}" + (f"WARC-Payload-Digest: sha1:{digest}\r\n" if digest else "")
        return f"{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    big = bytes(range(256)) * 20_000
    made = [one("warcinfo", b"software: x"), one("resource", big, base64.b32encode(hashlib.sha1(big).digest()).decode()), one("metadata", b"", "WRONG")]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "plain.warc").write_bytes(b"".join(made))
    (tmp_path / "a" / "packed.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in made))
    for name in ("plain.warc", "packed.warc.gz"):
        assert [h["warc-type"] for _, _, h in entries(f"{tmp_path}/a/{name}", chunk=1000)] == ["warcinfo", "resource", "metadata"]
    index_archives(spark, f"{tmp_path}/a").write.parquet(f"{tmp_path}/i")
    found = read_records(spark.read.parquet(f"{tmp_path}/i")).collect()
    assert sorted((r.record_type, r.payload_bytes, r.verified) for r in found) == sorted([("warcinfo", 11, None), ("resource", len(big), True), ("metadata", 0, False)] * 2)
    (tmp_path / "cut.warc").write_bytes(b"".join(made)[:-3])
    with pytest.raises(ValueError, match="cut off"):
        list(entries(f"{tmp_path}/cut.warc"))
