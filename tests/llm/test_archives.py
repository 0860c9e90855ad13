"""op1: WARC round trips, dictionary frame, validation of damaged archives."""
import base64
import hashlib
import struct

import pytest
import zstandard as zstd
from pyspark.sql import types as T

from greenscan.llm import warc
from greenscan.llm.common import shared_folder

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                      T.StructField("html", T.StringType()), T.StructField("digest", T.StringType()),
                      T.StructField("refers_to", T.IntegerType())])


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


@pytest.fixture(scope="module")
def rows():
    same = "<p>copy é &amp; ü</p>" * 5
    out = [(i, f"http://h/{i}", same if i % 3 == 0 else f"<p>page {i} " + "words " * (i % 50) + "</p>") for i in range(400)]
    out += [(500, None, None), (501, "http://h/x y%20z\r\n", ""), (502, "", "x" * 300_000), (None, "n", same), (None, None, "only"),
            (7, "again", "<p>page 7 " + "words " * 7 + "</p>"), (7, "again", "<p>page 7 " + "words " * 7 + "</p>")]
    return [(*r, "clash", 1) for r in out]


def expected(rows, min_bytes):
    first = {}
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= min_bytes:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, u, h, *_ in rows:
        b = (h or "").encode()
        origin = first.get(b)
        revisit = origin is not None and i != origin
        out.append((i, u, len(b), sha(b), "revisit" if revisit else "response", origin if revisit else None,
                    None if revisit else b))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 1000])
def test_pages_come_back(spark, rows, min_bytes):
    got = warc.archive_pages(spark.createDataFrame(rows, PAGES).repartition(3), min_bytes).collect()
    got = sorted(((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"],
                   None if r["payload"] is None else bytes(r["payload"])) for r in got), key=str)
    assert got == expected(rows, min_bytes)


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], PAGES)).count() == 0


def archive(tmp_path, monkeypatch, n=200):
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 20_000)
    w = warc.ArchiveWriter(str(tmp_path), 0)
    for i in range(n):
        b = f"<html>page number {i} with some common words</html>".encode()
        w.add(warc.make_record(i, f"http://h/{i}", b, len(b), sha(b), None))
    return w.close()


def test_layout_is_a_dictionary_then_one_frame_per_record(tmp_path, monkeypatch):
    path, n, size = archive(tmp_path, monkeypatch)
    data = open(path, "rb").read()
    assert len(data) == size
    magic, length = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    given = zstd.ZstdCompressionDict(data[8:8 + length])
    rest, frames = data[8 + length:], 0
    while rest:
        assert zstd.get_frame_parameters(rest[:18]).dict_id == given.dict_id() != 0
        one = zstd.ZstdDecompressor(dict_data=given).decompressobj()
        assert one.decompress(rest).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and one.eof
        rest, frames = one.unused_data, frames + 1
    assert frames == n == len(list(warc.read_archive(path, block=37)))


@pytest.mark.parametrize("n", [0, 1, 3, 15])
def test_few_records_have_a_dictionary_too(tmp_path, monkeypatch, n):
    path, _, _ = archive(tmp_path, monkeypatch, n)
    magic, size = struct.unpack("<II", open(path, "rb").read(8))
    assert magic == warc.SKIPPABLE and size > 0 and len(list(warc.read_archive(path))) == n


def test_damage_is_told(tmp_path, monkeypatch):
    path, *_ = archive(tmp_path, monkeypatch)
    data = open(path, "rb").read()
    for bad in (data[:-5], data + b"junk", data[:len(data) // 2] + b"\x00\x01" + data[len(data) // 2 + 2:], data[8:]):
        other = tmp_path / "bad"
        other.write_bytes(bad)
        with pytest.raises((warc.WarcError, zstd.ZstdError)):
            list(warc.read_archive(str(other)))


@pytest.mark.parametrize("old,new", [(b"WARC/1.1", b"WARC/9.9"), (b"WARC-Date", b"WARC-Datf"), (b"Content-Length: 1", b"Content-Length: 2"),
                                     (b"common", b"cOmmon"), (b"WARC-Type: response", b"WARC-Type: metadata"), (b"\r\n\r\n", b"\r\n")])
def test_records_are_validated(old, new):
    b = b"<html>some common words</html>"
    record = warc.make_record(1, "http://h", b, len(b), sha(b), None)
    assert warc.parse_record(record, "x")["page_id"] == 1
    with pytest.raises(warc.WarcError):
        warc.parse_record(record.replace(old, new, 1), "x")


def test_manifest_counts_are_held_against_the_archive(spark, rows):
    folder = shared_folder(spark, "test-warc")
    m = warc.write_archives(spark.createDataFrame(rows, PAGES), folder)
    wrong = m.selectExpr("path", "n_records + 1 AS n_records", "n_bytes")
    with pytest.raises(Exception, match="the manifest has"):
        warc.read_archives(wrong).count()
