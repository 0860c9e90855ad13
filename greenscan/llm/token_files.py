"""Token-ID / binary output: flat unsigned integer files plus 64-bit document offsets.

``write_token_files`` range-partitions the documents by id, encodes each partition in id
order and appends the ids to one flat file per partition. Beside it lies an index file with
the 64-bit document ids and the 64-bit offsets inside the file. A manifest table has one row
per file; the partition bases are prefix sums of its token counts. ``read_token_files``
memory-maps the files again and returns every document with its global start.

File layout (little-endian):
    part-*.bin   uint16 ids if the vocabulary has at most 65,536 entries, else uint32
    part-*.idx   magic, width, n, n int64 ids, n validity bytes, n + 1 int64 offsets
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from greenscan.llm.common import attempt_name, open_fs, shared_folder
from greenscan.llm.tokenizing import encoder, no_gc

MAGIC = b"GSTOKIDX"
HEADER = "<8sqq"
FLUSH_BYTES = 8 << 20
CACHED_WORDS = 400_000  # a writer holds little else, so its cache may be larger

MANIFEST = "part int, path string, width int, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, vocabulary_path: str, end_id: int, folder: str,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files into ``folder`` and return the manifest with ``base``.

    Every text is encoded whole; ``end_id`` follows each document. Null or empty texts hold
    the end id only. Rows are in ascending id order, null ids first; rows with equal ids
    follow a hash of their texts, so repeated rows are all written. An empty table gives an
    empty manifest. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # the hash splits a hot id; texts themselves are kept out of the range samples
    ordered = rows.repartitionByRange("id", F.xxhash64("text")) \
        .sortWithinPartitions("id", F.xxhash64("text"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary_path, max_words=CACHED_WORDS)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        width = enc.dtype.itemsize
        part = TaskContext.get().partitionId()
        fs, root = open_fs(folder)
        name, out, offset = None, None, 0
        ids: list[np.ndarray] = []
        valid: list[np.ndarray] = []
        sizes: list[int] = []
        held: list[bytes] = []
        held_bytes = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                name = attempt_name("part", part)
                out = fs.open_output_stream(f"{root}/{name}.bin")
            col = batch.column(0)
            valid.append(np.asarray(col.is_valid(), dtype=np.uint8))
            ids.append(col.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            for data in enc.encode_many(batch.column(1).to_pylist()):
                data += end
                sizes.append(len(data) // width)
                held.append(data)
                held_bytes += len(data)
                if held_bytes >= FLUSH_BYTES:
                    out.write(b"".join(held))
                    held, held_bytes = [], 0
        if out is None:
            return
        out.write(b"".join(held))
        out.close()
        offsets = np.concatenate([[0], np.cumsum(np.array(sizes, dtype="<i8"))]).astype("<i8")
        with fs.open_output_stream(f"{root}/{name}.idx") as f:
            f.write(struct.pack(HEADER, MAGIC, width, len(sizes)))
            f.write(np.concatenate(ids).tobytes())
            f.write(np.concatenate(valid).tobytes())
            f.write(offsets.tobytes())
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"],
             "width": pa.array([width], pa.int32()), "n_docs": [len(sizes)],
             "n_tokens": [int(offsets[-1])]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with no_gc():
            yield from write(batches)

    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file, with ``base``: the tokens of all files before it."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def open_tokens(path: str, width: int):
    """(ids of the documents, validity, offsets, tokens) of one file; tokens are
    memory-mapped where the file system is mounted."""
    fs, root = open_fs(path)
    with fs.open_input_file(f"{root}.idx") as f:
        magic, wide, n = struct.unpack(HEADER, f.read(struct.calcsize(HEADER)))
        if magic != MAGIC or wide != width:
            raise ValueError(f"not an index of {width}-byte tokens: {path}.idx")
        ids = np.frombuffer(f.read(8 * n), dtype="<i8")
        valid = np.frombuffer(f.read(n), dtype=np.uint8).astype(bool)
        offsets = np.frombuffer(f.read(8 * (n + 1)), dtype="<i8")
    kind = np.dtype(f"<u{width}")
    if fs.type_name == "local":
        tokens = np.memmap(f"{root}.bin", dtype=kind, mode="r")
    else:
        with fs.open_input_file(f"{root}.bin") as f:
            tokens = np.frombuffer(f.read(), dtype=kind)
    if len(offsets) != n + 1 or int(offsets[-1]) != len(tokens):
        raise ValueError(f"index and tokens differ in length: {path}")
    return ids, valid, offsets, tokens


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document of the files: doc_id, start (tokens of all documents before it),
    n_tokens (with the end id), ids_crc32 (of the ids as little-endian uint32), and the
    ids themselves if ``with_ids``."""
    schema = DIGEST + (", ids array<int>" if with_ids else "")
    n = manifest.sparkSession.sparkContext.defaultParallelism
    files = manifest.select("path", "width", "base").repartition(n)  # one row a file

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, valid, offsets, tokens = open_tokens(row["path"], row["width"])
                for a in range(0, len(ids), 2000):
                    b = min(a + 2000, len(ids))
                    spans = [(int(offsets[i]), int(offsets[i + 1])) for i in range(a, b)]
                    columns = {
                        "doc_id": pa.array(ids[a:b], pa.int64(), mask=~valid[a:b]),
                        "start": pa.array(row["base"] + offsets[a:b], pa.int64()),
                        "n_tokens": pa.array(np.diff(offsets[a:b + 1]), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(tokens[s:e].astype("<u4").tobytes())
                                               for s, e in spans], pa.int64())}
                    if with_ids:
                        columns["ids"] = pa.array([tokens[s:e].astype(np.int32) for s, e in spans],
                                                  pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(columns)

    return files.mapInArrow(read, schema)


def token_files(docs: DataFrame, vocabulary_path: str, end_id: int, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Write the files into the shared folder, then return their documents read back."""
    folder = shared_folder(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, vocabulary_path, end_id, folder, id_col, text_col))
