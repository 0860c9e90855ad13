"""Toxicity by compression distance: two Zstandard dictionaries, one trained on toxic text and
one on ordinary text; a window is the more toxic, the shorter the toxic dictionary makes it.

Fitting (on the driver, on a bounded sample of labelled rows: at most ``toxic_rows`` +
``ordinary_rows`` texts of at most ``max_bytes`` bytes, chosen by a hash of their ids):

1. Toxic documents are mostly ordinary text, so the toxic dictionary is trained on their words
   with byte sequences that are rarer in ordinary documents by a factor and either held by a
   share of the toxic ones or, however rare, beyond chance (``toxic_samples``). Every such
   sequence is in the dictionary, which grows with them. The ordinary dictionary is trained on ordinary
   documents as they are.
2. A window is one word (long ones in overlapping parts). So short a window does not compress
   by itself, therefore each is followed by a fixed tail that also ends both dictionaries: the
   tail costs the same with either, and the lengths differ by what the word costs.
3. The numbers of windows at or beyond each length difference, logarithms taken, are weighted
   by a logistic regression on the same sample, which calibrates the thresholds.

Scoring is map-only over whole texts; a worker compresses each distinct word once.
"""

from __future__ import annotations

import math
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenscan.llm.common import free_name

# In both dictionaries, so it costs the same; bytes that no text holds in this order.
TAIL = b"\x01\x02\x03\x04qzxjkvbw0918273645\x05\x06\x07\x08zjqxkwvb5463728190"
WINDOW = 64
LEVELS = range(1, 9)  # length differences, in bytes


@dataclass(frozen=True)
class ToxicityParams:
    toxic_rows: int = 3000
    ordinary_rows: int = 8000
    max_bytes: int = 16_384
    toxic_dictionary: int = 8 << 10  # trained part; sequences that it misses are added
    ordinary_dictionary: int = 32 << 10
    gram: int = 5            # bytes of a contrasted sequence
    min_docs: int = 3        # toxic documents that hold it, at least
    min_share: float = 0.025  # share of toxic documents from which no test is asked for
    false_share: float = 0.01  # chance sequences among those that pass the test, at most
    min_ratio: float = 8.0   # share of toxic over share of ordinary documents
    threshold: float = 0.5


@dataclass
class ToxicityModel:
    toxic: bytes             # empty: nothing was learned, every score is ``prior``
    ordinary: bytes
    weights: np.ndarray
    prior: float


def words_of(text: str | None) -> list[bytes]:
    """The windows of a text: its lower-case words; words over WINDOW bytes in halves that overlap."""
    words = (text or "").lower().encode("utf-8", "replace").split()
    if not any(len(w) > WINDOW for w in words):
        return words
    return [w[i:i + WINDOW] for w in words for i in range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2)]


class Gaps:
    """Length differences of words: bytes with the ordinary less bytes with the toxic dictionary."""

    def __init__(self, model: ToxicityModel, bound: int = 200_000):
        import zstandard as zstd
        self.zstd, self.bound = zstd, bound
        self.press = [self._press(model.ordinary, 14), self._press(model.toxic, max(14, len(model.toxic).bit_length()))]
        self.seen: set[bytes] = set()
        self.positive: dict[bytes, int] = {}

    def _press(self, dictionary: bytes, log: int):
        z = self.zstd
        params = z.ZstdCompressionParameters(
            window_log=max(18, log), hash_log=log, chain_log=log, search_log=5, min_match=4, target_length=32,
            strategy=z.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False,
            write_checksum=False, format=z.FORMAT_ZSTD1_MAGICLESS)
        return z.ZstdCompressor(compression_params=params, dict_data=z.ZstdCompressionDict(dictionary))

    def learn(self, words: set[bytes]) -> None:
        """Compress the words not met yet; only positive differences are kept by word."""
        new = list(words - self.seen)
        if not new:
            return
        if len(self.seen) + len(new) > self.bound:
            self.seen.clear()
            self.positive = {w: g for w, g in self.positive.items() if w in words}
        self.seen.update(new)
        data = b"".join([b" " + w + b" " + TAIL for w in new])
        sizes = np.array([len(w) + 2 + len(TAIL) for w in new], dtype=np.uint64)
        spans = np.stack([np.cumsum(sizes) - sizes, sizes], 1).astype(np.uint64)
        held = self.zstd.BufferWithSegments(data, spans.tobytes())
        lengths = [np.fromiter(map(len, p.multi_compress_to_buffer(held, threads=1)), np.int64, len(new))
                   for p in self.press]
        gap = lengths[0] - lengths[1]
        for i in np.flatnonzero(gap > 0):
            self.positive[new[i]] = int(gap[i])

    def counts(self, texts: list[str | None], portion: int = 100_000) -> np.ndarray:
        """Per text: windows at or beyond each of LEVELS, then all windows."""
        out = np.zeros((len(texts), len(LEVELS) + 1))
        todo: list[tuple[int, list[bytes]]] = []
        size = 0

        def flush() -> None:
            self.learn({w for _, ws in todo for w in ws})
            for k, ws in todo:
                hits = [self.positive[w] for w in ws if w in self.positive]
                for j, level in enumerate(LEVELS):
                    out[k, j] += sum(g >= level for g in hits)
                out[k, -1] += len(ws)

        for i, text in enumerate(texts):
            words = words_of(text)
            for a in range(0, len(words), portion):
                todo.append((i, words[a:a + portion]))
                size += len(todo[-1][1])
                if size >= portion:
                    flush()
                    todo, size = [], 0
        flush()
        return out


def _features(counts: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(counts), 1)), np.log1p(counts)])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the ridge spares the intercept."""
    w = np.zeros(x.shape[1])
    pull = ridge * np.eye(x.shape[1])
    pull[0, 0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + pull,
                               x.T @ (weight * (y - p)) - pull @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(samples: list[bytes], size: int, k: int) -> bytes:
    """A trained dictionary ending in TAIL; where the samples are too few to train one, a
    dictionary of the samples themselves."""
    import zstandard as zstd
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstd.train_dictionary(size, samples, k=k, d=6).as_bytes() + TAIL
    except zstd.ZstdError:
        return b" ".join(samples)[-size:] + b" " + TAIL


def _whole(dictionary: bytes, runs: Counter) -> bytes:
    """The dictionary with the contrasted runs that it misses; the commonest lie next to the end."""
    rest = sorted((r for r in runs if r not in dictionary), key=lambda r: (runs[r], r))
    return dictionary[:-len(TAIL)] + b"".join(rest) + b" " + TAIL if rest else dictionary


def _beyond_chance(held: tuple[Counter, Counter], n: list[int], p: ToxicityParams) -> set[bytes]:
    """Sequences in more toxic documents than labels dealt by chance explain: binomial tail of
    the toxic among the documents that hold one, Benjamini-Hochberg over all sequences held by
    ``min_docs`` documents. The more of them are toxic, the rarer ones pass."""
    tested = [g for g in held[1].keys() | held[0].keys() if held[1][g] + held[0][g] >= p.min_docs]
    q = n[1] / (n[0] + n[1])

    def tail(a: int, b: int) -> float:
        m = a + b
        if a <= m * q:
            return 1.0
        term = math.exp(math.lgamma(m + 1) - math.lgamma(a + 1) - math.lgamma(b + 1)
                        + a * math.log(q) + b * math.log1p(-q))
        total, k = term, a
        while k < m and term > total * 1e-12:
            term *= (m - k) / (k + 1) * q / (1 - q)
            total, k = total + term, k + 1
        return total

    of: dict[tuple[int, int], float] = {}
    chance = np.array([of[c] if (c := (held[1][g], held[0][g])) in of else of.setdefault(c, tail(*c)) for g in tested])
    ordered = np.sort(chance)
    passed = np.flatnonzero(ordered <= p.false_share * np.arange(1, len(ordered) + 1) / max(1, len(ordered)))
    limit = ordered[passed[-1]] if len(passed) else -1.0
    return {tested[i] for i in np.flatnonzero(chance <= limit)}


def toxic_samples(texts: list[str], y: np.ndarray, p: ToxicityParams) -> tuple[list[bytes], Counter]:
    """Per toxic document its words that hold a contrasted byte sequence, and the parts of words
    that such sequences make up, with the toxic documents that hold them. Contrasted is one in ``min_docs``
    toxic documents, ``min_ratio`` times commoner there, that ``min_share`` of them hold or
    that is beyond chance."""
    def grams(word: bytes) -> set[bytes]:
        b = b" " + word
        return {b[i:i + p.gram] for i in range(max(1, len(b) - p.gram + 1))}

    held = (Counter(), Counter())
    for text, label in zip(texts, y):
        held[label].update(set().union(*map(grams, set(words_of(text)))))
    n = [int((y == 0).sum()), int((y == 1).sum())]
    sure = _beyond_chance(held, n, p)
    marks = {g for g, a in held[1].items() if a >= p.min_docs and (a >= p.min_share * n[1] or g in sure)
             and (a + .5) / (n[1] + 1) > p.min_ratio * (held[0][g] + .5) / (n[0] + 1)}
    picked = [[w for w in words_of(text) if not marks.isdisjoint(grams(w))]
              for text, label in zip(texts, y) if label]
    runs = Counter(r for ws in picked for r in set().union(*(_runs(b" " + w, marks, p.gram) for w in set(ws))))
    return [b" ".join(ws) + b" " for ws in picked if ws], runs


def _runs(word: bytes, marks: set[bytes], size: int) -> set[bytes]:
    """The longest parts of a word in which every sequence of that size is among ``marks``."""
    at = [i for i in range(max(1, len(word) - size + 1)) if word[i:i + size] in marks]
    first = [i for i in at if i - 1 not in at]
    last = [i for i in at if i + 1 not in at]
    return {word[i:j + size] for i, j in zip(first, last)}


def fit(texts: list[str], labels: list[int], share: float, params: ToxicityParams) -> ToxicityModel:
    """``share``: toxic rows among all labelled ones; sample weights restore it."""
    y = np.array(labels, dtype=np.int64)
    none = ToxicityModel(b"", b"", np.zeros(0), min(max(share, 0.0), 1.0))
    if len(y) == 0 or y.min() == y.max():
        return none
    toxic, runs = toxic_samples(texts, y, params)
    if not toxic:
        warnings.warn(f"no byte sequence tells the {int(y.sum())} toxic from the {int((1 - y).sum())} ordinary "
                      f"sampled texts: every document gets the share of toxic rows, {none.prior:.4f}", stacklevel=2)
        return none
    plain = (b" ".join(words_of(t)) + b" " for t, label in zip(texts, y) if not label)
    plain = [t[i:i + 200] for t in plain for i in range(0, len(t), 200)]  # whole texts
    model = ToxicityModel(_whole(_dictionary(toxic, params.toxic_dictionary, 16), runs),
                          _dictionary(plain, params.ordinary_dictionary, 32), np.zeros(0), share)
    x = _features(Gaps(model).counts(texts))
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    model.weights = _logistic(x, y.astype(float), weight)
    return model


def held_out(id_col: Column) -> Column:
    """Rows never learned from: crc32 of the id as text divides by 5; a null id counts as ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams(),
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn from labelled rows outside ``held_out``. Null ids, texts and labels are left out;
    an id with several labels is toxic if one of them says so. Without rows of both labels
    every score is the share of toxic rows (0 if there is none); so it is, with a warning, where
    no sequence tells the rows of both apart."""
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).alias("y")) \
        .where("k is not null and y is not null").where(~held_out(F.col("k"))) \
        .groupBy("k").agg(F.max("y").cast("int").alias("y"))
    share = known.agg(F.avg("y").alias("share")).first()["share"] or 0.0
    order = [F.xxhash64("k"), "k"]
    ids = known.where("y = 1").orderBy(*order).limit(params.toxic_rows) \
        .unionByName(known.where("y = 0").orderBy(*order).limit(params.ordinary_rows))
    most = params.toxic_rows + params.ordinary_rows  # bounds both the broadcast and the sample
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")) \
        .where((F.octet_length("t") <= params.max_bytes) & F.col("k").isNotNull()) \
        .join(F.broadcast(ids), "k").orderBy(*order, "t").limit(most).select("t", "y").collect()
    return fit([r["t"] for r in rows], [r["y"] for r in rows], float(share), params)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows with ``score_col`` (0 to 1). A null or empty text has no windows and gets the
    score of that; repeated rows score alike; other columns pass through, and one that is
    named like ``score_col`` is replaced."""
    names = [c for c in docs.columns if c.lower() != score_col.lower()]
    at = names.index(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in names]).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps = Gaps(model) if model.toxic else None
        for batch in batches:
            if gaps is None:
                s = np.full(batch.num_rows, model.prior)
            else:
                x = _features(gaps.counts(batch.column(at).to_pylist()))
                s = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*names, score_col])

    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(run, f"{fields}, `{score_col}` double")


def toxicity_report(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams(),
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 from the threshold on)."""
    model = train(docs, labels, params, id_col, text_col)
    scored = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= params.threshold).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, model: ToxicityModel, params: ToxicityParams = ToxicityParams(),
               text_col: str = "text") -> DataFrame:
    """The rows whose score is below the threshold, with the columns they came with."""
    name = free_name("score", docs.columns)
    return score(docs, model, text_col, name).where(F.col(name) < params.threshold).drop(name)
