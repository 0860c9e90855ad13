"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

File layout: a skippable frame (magic 0x184D2A5D, 32-bit length) holding the dictionary, then
one Zstandard frame per WARC/1.1 record, each with its content size and the dictionary's id.
Every task writes archives of its own, trains their dictionary on its first records (bounded
bytes) and tells path and counts in its output; the manifest of these rows names the archives
to read, so files of lost attempts are never read.

Records with equal payloads (of ``min_bytes`` at least) are written once: the smallest id is
a ``response``, the others are ``revisit`` records that name it and carry no payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenscan.llm.common import attempt_name, open_fs, shared_folder

# Fixed values of the formats.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20      # records a task holds back to train the dictionary
ARCHIVE_BYTES = 256 << 20   # a task begins another archive beyond this size

MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, payload binary")


class WarcError(ValueError):
    """An archive or a record that breaks the format; the message names file and place."""


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_id(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def _id_of(name: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(none|-?\d+)>", name)
    if not found:
        raise WarcError(f"record id {name!r}")
    return None if found[1] == "none" else int(found[1])


def make_record(page_id: int | None, url: str | None, payload: bytes | None, length: int, digest: str,
                refers_to: int | None) -> bytes:
    """A response record, or a revisit record if ``payload`` is None. The block is an HTTP
    response head, with the payload behind it in a response."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {length}\r\n\r\n").encode("ascii")
    block = http + (payload or b"")
    head = [VERSION, f"WARC-Type: {'response' if payload is not None else 'revisit'}",
            f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
            "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest32(block)}"]
    if url is not None:  # a header field is one line: control characters and % are escaped
        head.append("WARC-Target-URI: " + re.sub(r"[%\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, where: str) -> dict:
    """The fields of one record; raises WarcError unless version, mandatory headers, lengths
    and digests all hold."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise WarcError(f"{where}: no WARC record")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name in fields:
            raise WarcError(f"{where}: header line {line!r}")
        fields[name] = value.strip(" \t")
    if missing := [n for n in MANDATORY if n not in fields]:
        raise WarcError(f"{where}: no {', '.join(missing)}")
    if not fields["Content-Length"].isdigit() or len(rest) != int(fields["Content-Length"]) + 4:
        raise WarcError(f"{where}: Content-Length {fields['Content-Length']} for {len(rest) - 4} bytes")
    if not rest.endswith(b"\r\n\r\n"):
        raise WarcError(f"{where}: no end of record")
    block, kind = rest[:-4], fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        raise WarcError(f"{where}: type {kind!r}")
    if "sha1:" + digest32(block) != fields.get("WARC-Block-Digest"):
        raise WarcError(f"{where}: block digest")
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"\r\nContent-Length: (\d+)(?:\r\n|$)", http)
    if not gap or not length or not http.startswith(b"HTTP/"):
        raise WarcError(f"{where}: no HTTP head")
    size, digest = int(length[1]), fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest32(payload) != digest):
        raise WarcError(f"{where}: payload length or digest")
    if kind == "revisit" and (payload or "WARC-Refers-To" not in fields):
        raise WarcError(f"{where}: revisit with a payload or without its origin")
    url = fields.get("WARC-Target-URI")
    return {"page_id": _id_of(fields["WARC-Record-ID"]),
            "url": None if url is None else re.sub(r"%([0-7][0-9A-F])", lambda m: chr(int(m[1], 16))
                                                   if m[1] == "25" or int(m[1], 16) < 32 or m[1] == "7F"
                                                   else m[0], url),
            "payload_bytes": size, "payload_digest": digest, "record_type": kind,
            "refers_to": _id_of(fields["WARC-Refers-To"]) if kind == "revisit" else None,
            "payload": payload if kind == "response" else None}


class ArchiveWriter:
    """Writes records to one archive; the first ``SAMPLE_BYTES`` train its dictionary."""

    def __init__(self, folder: str, part: int):
        self.fs, root = open_fs(folder)
        self.fs.create_dir(root, recursive=True)
        name = attempt_name("pages", part) + ".warc.zst"
        self.path, self.out = f"{folder}/{name}", self.fs.open_output_stream(f"{root}/{name}", compression=None)
        self.held: list[bytes] | None = []
        self.held_bytes = self.n_records = self.n_bytes = 0

    def add(self, record: bytes) -> None:
        self.n_records += 1
        if self.held is None:
            self._write(self.press.compress(record))
            return
        self.held.append(record)
        self.held_bytes += len(record)
        if self.held_bytes >= SAMPLE_BYTES:
            self._train()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.n_bytes += len(data)

    def _train(self) -> None:
        import zstandard as zstd
        held, self.held = self.held, None
        try:  # k and d given: one pass, no search for them
            data = zstd.train_dictionary(DICTIONARY_BYTES, held, k=512, d=8).as_bytes()
        except zstd.ZstdError:  # too few or too small samples to train on
            data = raw_dictionary(held)
        given = zstd.ZstdCompressionDict(data)
        self._write(struct.pack("<II", SKIPPABLE, len(data)) + data)
        self.press = zstd.ZstdCompressor(level=3, dict_data=given, write_content_size=True,
                                         write_checksum=True, write_dict_id=True)
        for record in held:
            self._write(self.press.compress(record))

    def close(self) -> tuple[str, int, int]:
        if self.held is not None:
            self._train()
        self.out.close()
        return self.path, self.n_records, self.n_bytes


def raw_dictionary(records: list[bytes]) -> bytes:
    """A dictionary of plain content, for archives too small to train one: the records' ends,
    newest last, and the fixed part of a record's header, so it is never empty."""
    content = b"".join(r[-(DICTIONARY_BYTES // max(1, len(records))):] for r in records) + b"WARC/1.1\r\nContent-Length: "
    return content[-DICTIONARY_BYTES:]


def read_archive(path: str, block: int = 1 << 20) -> Iterator[dict]:
    """The records of one archive in order, holding one record and one block at a time."""
    import zstandard as zstd
    fs, root = open_fs(path)
    with fs.open_input_file(root) as f:
        total, given = f.size(), None
        start = f.read(8)
        if len(start) == 8 and struct.unpack("<I", start[:4])[0] == SKIPPABLE:
            size = struct.unpack("<I", start[4:])[0]
            data = f.read(size)
            if len(data) != size:
                raise WarcError(f"{path}: dictionary cut short")
            given = zstd.ZstdCompressionDict(data)
            at, rest = 8 + size, b""
        else:
            at, rest = 0, start
        press = zstd.ZstdDecompressor(dict_data=given)
        while rest or at + len(rest) < total:
            where = f"{path}, byte {at}"
            one, parts, begun = press.decompressobj(), [], 0
            while not one.eof:
                if not rest:
                    rest = f.read(block)
                    if not rest:
                        raise WarcError(f"{where}: frame cut short")
                if begun == 0:
                    if len(rest) < 18 and len(rest) < total - at:
                        rest += f.read(block)
                    if len(rest) < 4 or struct.unpack("<I", rest[:4])[0] != FRAME:
                        raise WarcError(f"{where}: no Zstandard frame")
                    frame = zstd.get_frame_parameters(rest[:18])
                    if frame.dict_id != (given.dict_id() if given else 0):
                        raise WarcError(f"{where}: dictionary {frame.dict_id}")
                try:
                    parts.append(one.decompress(rest))
                except zstd.ZstdError as e:
                    raise WarcError(f"{where}: {e}") from e
                begun += len(rest) - len(one.unused_data)
                rest = one.unused_data
            at += begun
            data = b"".join(parts)
            if frame.content_size not in (zstd.CONTENTSIZE_UNKNOWN, len(data)):
                raise WarcError(f"{where}: {len(data)} bytes for a frame of {frame.content_size}")
            yield parse_record(data, where)


# ---------------------------------------------------------------- Spark

def plan_records(pages: DataFrame, min_bytes: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, payload (null for revisits), n, digest (hex), refers_to.

    Digests are grouped on narrow rows; only the groups of several ids are joined back, first
    by digest, then by (id, digest), so the payloads of a hot group are never in one task."""
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                         F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")) \
        .withColumn("n", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    slim = named.where(F.col("n") >= min_bytes).select("page_id", "digest").distinct()
    groups = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("ids")) \
        .where("ids > 1 and refers_to is not null")
    revisits = slim.join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))) \
        .select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to")
    joined = named.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")),
                        "left")
    return joined.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
                         "n", "digest", "refers_to")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id",
                   url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page as a record into archives under ``folder``; returns their manifest.

    A null html is an empty payload. Of pages with equal payloads the smallest id is the
    response; rows that repeat this id too are responses, and null ids come last. Pages below
    ``min_bytes`` are all responses. A null url writes no target. Extra columns are ignored;
    an empty table writes no archive."""
    rows = plan_records(pages, min_bytes, id_col, url_col, html_col)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, out = TaskContext.get().partitionId(), [], None
        for batch in batches:
            for page_id, url, payload, n, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = ArchiveWriter(folder, part)
                name = base64.b32encode(bytes.fromhex(digest)).decode("ascii")
                out.add(make_record(page_id, url, payload, n, name, refers))
                if out.n_bytes >= ARCHIVE_BYTES:
                    done, out = [*done, out.close()], None
        if out is not None:
            done.append(out.close())
        for path, records, size in done:
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [records], "n_bytes": [size]})

    rows.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the archives, validated. A revisit has no payload of its own; its
    ``payload_bytes`` and digest are those of the full payload."""
    n = manifest.sparkSession.sparkContext.defaultParallelism
    names = [f.split(" ")[0] for f in RECORDS.split(", ")][: 7 if with_payload else 6]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(),
                 "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
                 "payload": pa.binary()}
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, size, seen = [], 0, 0

                def out(rows=rows):
                    return pa.RecordBatch.from_pydict(
                        {c: pa.array([r[c] for r in rows], kinds[c]) for c in names})

                for r in read_archive(path):
                    rows.append(r)
                    seen += 1
                    size += 200 + (len(r["payload"] or b"") if with_payload else 0)
                    if size >= 8 << 20:
                        yield out()
                        rows.clear()
                        size = 0
                if seen != expected:
                    raise WarcError(f"{path}: {seen} records, the manifest has {expected}")
                if rows:
                    yield out()

    schema = RECORDS if with_payload else RECORDS.rpartition(", ")[0]
    return manifest.select("path", "n_records").repartition(n).mapInArrow(read, schema)


def archive_pages(pages: DataFrame, min_bytes: int = 0, with_payload: bool = True, **columns) -> DataFrame:
    """Write the archives into the shared folder, then return their records read back."""
    folder = shared_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, min_bytes, **columns), with_payload)


def _base32(digest: str) -> str:
    """DuckDB expression: base32 of a 40-digit hex string, 5 bits a character."""
    return (f"list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
            f"(((('0x' || substr({digest}, (i // 4)::INTEGER * 5 + 1, 5))::BIGINT) "
            f">> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER + 1, 1)), lambda a, b: a || b)")


def oracle(min_bytes: int = 0) -> str:
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= {min_bytes} THEN min(page_id) OVER (PARTITION BY h) END AS origin FROM p)
SELECT page_id, payload_bytes, {_base32('h')} AS payload_digest,
       CASE WHEN origin IS NULL OR page_id IS NOT DISTINCT FROM origin THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM origin THEN origin END AS refers_to
FROM g"""
