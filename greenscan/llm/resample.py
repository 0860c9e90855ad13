"""Importance resampling toward a target text collection, on hashed n-gram counts.

Words are cut by one byte translation: a 256-byte table lowers A-Z and blanks every ASCII
byte that is neither a digit nor a letter; bytes above 0x7F stay, so UTF-8 needs no decoding
and ``bytes.split`` gives the words. The bucket of a run of words is the CRC-32 of its bytes:
``crc32(b" " + word, seed)`` extends the CRC of the run before it, so all runs up to ``runs``
words cost one call per run and no run is put together.

1. Each task reduces its features to one Counter (at most ``buckets`` entries); the sums over
   tasks are a table of at most ``buckets`` rows for the documents and one for the target.
2. The gains of all buckets (a fixed-size array) go to every task, which sums them over the
   features of each document.
3. Adding Gumbel noise keyed by the document's id makes "the highest scores" a draw without
   replacement, repeatable on any cluster. Eligible rows are range-sorted and numbered by
   partition offsets; no task sees the whole table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenscan.llm.common import written
from greenscan.operators.ranking import global_row_number

STEP = 1 << 16  # words handled at once, so a very long text needs no list of all its runs


@dataclass(frozen=True)
class ResampleParams:
    runs: int = 3          # longest run of words
    buckets: int = 10_000
    seed: int = 42
    min_words: int = 20    # shorter documents are never drawn
    percent: int = 5       # of the eligible documents


def byte_table() -> bytes:
    """Byte -> byte: A-Z lowered; digits, letters and bytes above 0x7F kept; the rest blank."""
    def of(b: int) -> int:
        if 0x41 <= b <= 0x5A:
            return b + 0x20
        return b if b >= 0x80 or chr(b).isalnum() else 0x20
    return bytes(map(of, range(256)))


TABLE = byte_table()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def run_crcs(words: list[bytes], runs: int) -> Iterator[list[int]]:
    """CRC-32 of every run of 1 to ``runs`` consecutive words, in lists of bounded length."""
    for a in range(0, len(words), STEP):
        part = words[a:a + STEP + runs - 1]
        tails = [b" " + w for w in part]
        crcs = list(map(crc32, islice(part, STEP)))
        yield crcs
        for k in range(1, runs):
            # the run that starts at i grows by word i + k; runs over the end stop here
            crcs = list(map(crc32, islice(tails, k, None), crcs))
            yield crcs


def bucket_counts(texts: DataFrame, params: ResampleParams) -> DataFrame:
    """(bucket, n) over every run of every text of the one-column table."""
    runs, buckets = params.runs, params.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0):
                for crcs in run_crcs(words_of(text.as_py()), runs):
                    counts.update((np.array(crcs, dtype=np.int64) % buckets).tolist())
        if counts:
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(counts), pa.int32()),
                                              "n": pa.array(list(counts.values()), pa.int64())})

    return texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, params: ResampleParams) -> np.ndarray:
    """floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) of every bucket. ``source`` and
    ``target`` are (bucket, n) tables of at most ``buckets`` rows each."""
    def held(counts: DataFrame) -> list[int]:
        out = [0] * params.buckets
        for r in counts.collect():
            out[r["bucket"]] = r["n"]
        return out

    s, t = held(source), held(target)
    s_all, t_all = float(sum(s) + params.buckets), float(sum(t) + params.buckets)
    return np.array([math.floor(1000 * math.log((float(b + 1) * s_all) / (float(a + 1) * t_all)))
                     for a, b in zip(s, t)], dtype=np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, params: ResampleParams) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of (doc_id, text)."""
    runs, buckets = params.runs, params.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weights = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                n = total = 0
                for crcs in run_crcs(words, runs):
                    n += len(crcs)
                    total += int(gains[np.array(crcs, dtype=np.int64) % buckets].sum())
                n_words.append(len(words))
                n_features.append(n)
                weights.append(total)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "n_words": pa.array(n_words, pa.int64()),
                 "n_features": pa.array(n_features, pa.int64()), "weight": pa.array(weights, pa.int64())})

    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel_noise(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))); h: the first 8 hex digits of sha256('seed:key')."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, params: ResampleParams = ResampleParams(),
             id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank (null: not drawn).

    Null and empty texts have no words: weight 0, never drawn. A null id is hashed as ``42:``
    and loses ties. Rows that repeat an id are documents of their own, with equal noise; of
    wholly equal rows any comes first. Long texts are read whole, in steps of bounded length.
    Empty documents give no rows; an empty target counts 0 in every bucket. Other columns are
    ignored."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gains = bucket_gains(bucket_counts(texts.select("text"), params),
                         bucket_counts(target.select(F.col(target_col).alias("text")), params), params)
    scored = written(weigh(texts, gains, params)
                     .withColumn("score", F.col("weight") + gumbel_noise(F.col("doc_id"), params.seed)), "scores")
    able = F.col("n_words") >= params.min_words
    drawn = scored.where(able).count() * params.percent // 100
    placed = global_row_number(scored.where(able), [F.desc("score"), F.asc_nulls_last("doc_id")], "place", start=1)
    ranked = placed.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("place")
    return ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("bigint")))


def drawn_documents(docs: DataFrame, target: DataFrame, params: ResampleParams = ResampleParams(),
                    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose ids were drawn, with all their columns. Rows that share a
    drawn id stay together; rows without an id come if one of them was drawn."""
    ids = resample(docs, target, params, id_col, text_col, target_col).where("rank is not null") \
        .select(F.col("doc_id").alias("_drawn_id")).distinct()
    return docs.join(ids, F.col(id_col).cast("long").eqNullSafe(F.col("_drawn_id")), "left_semi")


ORACLE = """
WITH bits AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)),
         lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (SELECT row_number() OVER () AS r, false AS goal, doc_id, text FROM documents
          UNION ALL SELECT row_number() OVER (), true, NULL, text FROM benchmark),
cut AS (SELECT r, goal, doc_id, regexp_extract_all(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
feature AS (
  SELECT r, goal, unnest(w) AS f FROM cut
{longer}),
bucket AS (
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
           regexp_extract_all(hex(encode(f)), '..'), lambda h: ('0x' || h)::BIGINT)),
           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % {buckets} AS b
  FROM (SELECT DISTINCT f FROM feature), bits),
per AS (SELECT goal, r, b, count(*) AS n FROM feature JOIN bucket USING (f) GROUP BY ALL),
sums AS (SELECT b, coalesce(sum(n) FILTER (goal), 0) AS t, coalesce(sum(n) FILTER (NOT goal), 0) AS s FROM per GROUP BY b),
totals AS (SELECT coalesce(sum(t), 0)::DOUBLE AS t_all, coalesce(sum(s), 0)::DOUBLE AS s_all FROM sums),
gain AS (SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + {buckets})) / ((s + 1)::DOUBLE * (t_all + {buckets}))))::BIGINT AS g
         FROM sums, totals),
weights AS (SELECT r, sum(n) AS n_features, sum(n * g) AS weight FROM per JOIN gain USING (b) WHERE NOT goal GROUP BY r),
scored AS (
  SELECT c.doc_id, len(c.w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln(
           (('0x' || substr(sha256('{seed}:' || coalesce(c.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
           / 4294967296::DOUBLE)))::BIGINT AS score
  FROM cut c LEFT JOIN weights USING (r) WHERE NOT goal),
able AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n
         FROM scored WHERE n_words >= {min_words})
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= n * {percent} // 100 THEN place END::BIGINT AS rank FROM able
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_words < {min_words}
"""


def oracle(params: ResampleParams = ResampleParams()) -> str:
    longer = "\n".join(
        f"  UNION ALL SELECT r, goal, unnest(list_transform(range(1, len(w) - {k - 2}), "
        f"lambda i: array_to_string(w[i:i + {k - 1}], ' '))) FROM cut WHERE len(w) >= {k}"
        for k in range(2, params.runs + 1))
    return ORACLE.format(longer=longer, buckets=params.buckets, seed=params.seed,
                         min_words=params.min_words, percent=params.percent)
