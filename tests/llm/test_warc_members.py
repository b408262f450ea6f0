"""Archives with many gzip members, folded headers, other digests, and gaps in our own archives."""

import base64
import hashlib
import time

import pytest

from docloom.llm import warc


def test_members_are_read_in_time_in_proportion():
    member = warc.gzip_member(warc.record(1, "http://a/", bytes(range(256)) * 200))

    def seconds(n):
        began = time.process_time()
        records, gaps = warc.salvage(member * n)
        assert len(records) == n and not gaps
        return time.process_time() - began

    seconds(10)
    assert seconds(1600) < 8 * seconds(400) + 0.5


def test_a_member_larger_than_the_window_and_a_cut_one():
    data = warc.gzip_member(warc.record(1, "http://a/", hashlib.sha512(b"x").digest() * 20_000))
    records, gaps = warc.salvage(data + data[: len(data) // 2])
    assert len(records) == 1 and [g[:2] for g in gaps] == [(len(data), len(data) + len(data) // 2)]


@pytest.mark.parametrize("digest", [hashlib.sha1(b"body").hexdigest(), hashlib.sha1(b"body").hexdigest().upper(), base64.b32encode(hashlib.sha1(b"body").digest()).decode().lower()])
@pytest.mark.parametrize("kind", ["sha1", "SHA-1"])
def test_digests_in_other_notations_hold(kind, digest):
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:1>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Block-Digest: {kind}:{digest}\r\nWARC-Target-URI: http://a/\r\n  b\r\n\tc\r\nContent-Length: 4\r\n\r\n"
    records, gaps = warc.salvage(head.encode() + b"body" + warc.END)
    assert not gaps and records[0][1]["warc-target-uri"] == "http://a/ b c"
    assert warc.salvage(head.encode() + b"bodz" + warc.END)[0] == []


def test_unknown_algorithms_are_not_checked():
    assert warc.digest_holds("xyz:abc", b"") and warc.digest_holds("", b"") and not warc.digest_holds("md5:00", b"")


def test_a_damaged_archive_of_our_own_is_an_error(spark, tmp_path, monkeypatch):
    whole = warc.write_warc

    def damaging(pages, path, **more):
        whole(pages, path, **more)
        file = next(p for p in tmp_path.rglob("part-*.txt"))
        data = file.read_bytes()
        file.write_bytes(data.replace(b"paper", b"vapor"))
        crc = file.with_name(f".{file.name}.crc")
        crc.unlink(missing_ok=True)

    monkeypatch.setattr(warc, "stage_path", lambda spark, name: f"file://{tmp_path}/x/{name}")
    monkeypatch.setattr(warc, "write_warc", damaging)
    spark.createDataFrame([(1, "http://a/", "<p>paper</p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/sf/pages.parquet")
    with pytest.raises(Exception, match="damaged archive"):
        warc.op6_warc(spark, f"file://{tmp_path}/sf").collect()


def test_empty_pages_through_the_query(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op6_warc(spark, str(tmp_path)).count() == 0
