"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text's blanks become U+2581, one more is put in front, and the text is cut before every
such mark that follows another character, around line feeds, and
between a Latin letter and a stop or comma: no piece reaches over these cuts (checked on loading), so the lattice of
a text is the product of the lattices of its units. Per distinct unit the forward sums are
computed once; every occurrence then draws its segmentation backwards, piece by piece, with
probability proportional to the product of its pieces' weights.

* Weights: the model is a merge list, so a piece's weight is 1 / (rank + 10), to the power
  ``alpha`` (0: all segmentations alike; larger: nearer to the best).
* Characters without a piece (and U+2581 itself) are their UTF-8 byte pieces.
* The random numbers come from the row's key, the unit's place and the step, so a row is
  segmented alike in every run, batch and partition. Rows with equal keys and texts agree.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE, LITERAL = "▁", "\udc81"  # a blank; U+2581 of the text itself (no text holds a lone surrogate)
# a unit ends before U+2581, around a line feed, and between a Latin letter and . or ,
UNIT = re.compile(f"(?:{SPACE}+|[^{SPACE}\n])(?:[^{SPACE}\n.,]++|(?<![A-Za-zÀ-ÖØ-öø-ſ])[.,])*+|\n")
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _placed(held: np.ndarray, n: int, new: np.ndarray) -> np.ndarray:
    """``held`` with ``new`` behind its first ``n`` values, in place while there is room."""
    if n + len(new) > len(held):
        grown = np.empty(max(n + len(new), len(held) * 3 // 2), dtype=held.dtype)
        grown[:n] = held[:n]
        held = grown
    held[n:n + len(new)] = new
    return held


class PieceSampler:
    """Lattices of units, kept up to ``max_units``, and sampling of whole texts."""

    def __init__(self, path: str, alpha: float = 0.5, max_units: int = 200_000):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        plain = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        rank = {i: k for k, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i)))}
        self.piece = {sp.id_to_piece(i): i for i in plain}
        self.weight = np.ones(self.size)
        for i, k in rank.items():
            self.weight[i] = (k + 10.0) ** -alpha
        whole = [p for p in self.piece if len(UNIT.findall(p)) > 1]
        if whole:
            raise ValueError(f"pieces reach over the cuts between units: {whole[:5]}")
        self.log_weight = np.log(self.weight)
        self._read_backwards()
        self.single = np.array([ord(p) for p in self.piece if len(p) == 1], dtype=np.uint32)
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(self.size) if sp.is_byte(i)}
        self.text = [b""] * self.size
        for i in plain:
            self.text[i] = sp.id_to_piece(i).replace(SPACE, " ").encode("utf-8")
        for b, i in self.bytes.items():
            self.text[i] = bytes([b])
        self.spelled: dict[str, int] = {}   # character without a piece -> number from size on
        self.spelling: list[list[int]] = []
        self.max_units = max_units
        self._empty()

    def _read_backwards(self) -> None:
        """The trie of the reversed pieces as arrays: a step from a node over a character is one
        key (node << 21 | code point) of a hash table with linear probing, a quarter full at most,
        and leads to the node beside it."""
        step: dict[int, int] = {}
        last = [-1]                           # node -> the piece read in full there, or -1
        for p, i in self.piece.items():
            node = 0
            for c in reversed(p):
                key = node << 21 | ord(c)
                if key not in step:
                    step[key] = len(last)
                    last.append(-1)
                node = step[key]
            last[node] = i
        key, to = (np.fromiter(x, np.int64, len(step)) for x in (step.keys(), step.values()))
        self.step_piece = np.array(last)
        roots = key < 1 << 21
        self.first_step = np.zeros(1 << 21, dtype=np.int64)
        self.first_step[key[roots]] = to[roots]
        bits = max(4, (4 * len(key)).bit_length())
        self.slot_shift = U(64 - bits)
        self.slot_key = np.full(1 << bits, -1, dtype=np.int64)
        self.slot_to = np.zeros(1 << bits, dtype=np.int64)
        at = self._slots(key)
        while len(key):  # all keys try their next slot; the first one to name an empty slot gets it
            at &= len(self.slot_key) - 1
            free = np.flatnonzero(self.slot_key[at] < 0)
            slots, who = np.unique(at[free], return_index=True)
            self.slot_key[slots], self.slot_to[slots] = key[free[who]], to[free[who]]
            left = np.ones(len(key), dtype=bool)
            left[free[who]] = False
            key, to, at = key[left], to[left], at[left] + 1

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(U) * U(0x9E3779B97F4A7C15)) >> self.slot_shift).astype(np.int64)

    def _step(self, key: np.ndarray) -> np.ndarray:
        """The node that each step leads to, 0 where there is none."""
        at = self._slots(key)
        held = self.slot_key[at]
        node = np.where(held == key, self.slot_to[at], 0)
        far = np.flatnonzero((held != key) & (held >= 0))
        while len(far):
            at[far] = (at[far] + 1) & (len(self.slot_key) - 1)
            held = self.slot_key[at[far]]
            hit = held == key[far]
            node[far[hit]] = self.slot_to[at[far[hit]]]
            far = far[~hit & (held >= 0)]
        return node

    def _edges(self, chars: np.ndarray, other: np.ndarray, spelled: np.ndarray):
        """From node, to node and id of all edges, by to node and longest first; ``other`` are the
        places of characters without a piece. All places walk back together, a character a step;
        the separators, also the one that place -1 wraps to, lead nowhere."""
        count = np.zeros(len(chars) + 1, dtype=np.int64)
        found = []
        at = np.arange(len(chars))
        node = self.first_step[chars]
        back = 0
        while True:
            live = node > 0
            at, node, back = at[live], node[live], back + 1
            if not len(at):
                break
            piece = self.step_piece[node]
            hit = piece >= 0
            b, k = at[hit] + 1, piece[hit]
            if back == 1:
                b, k = np.concatenate([b, other + 1]), np.concatenate([k, spelled])
            found.append((b, k, count[b]))
            count[b] += 1
            node = self._step(node << 21 | chars[at - back].astype(np.int64))
        if not found:                          # no character is a piece's last one
            found.append((other + 1, spelled, np.zeros(len(other), np.int64)))
            count[other + 1] = 1
        last = np.cumsum(count) - 1
        a, k = (np.empty(int(count.sum()), dtype=np.int64) for _ in range(2))
        for n, (b, piece, shorter) in enumerate(found):
            place = last[b] - shorter
            a[place], k[place] = b - n - 1, piece
        return a, np.repeat(np.arange(len(count)), count), k

    def _empty(self) -> None:
        self.unit: dict[str, int] = {}
        self.n_nodes = self.n_edges = 0       # the arrays below are longer: they grow by doubling
        self.node0 = np.zeros(0, np.int64)    # unit -> its first node
        self.length = np.zeros(0, np.int64)
        self.first = np.zeros(0, np.int64)    # node -> the first edge into it
        self.share = np.zeros(0)              # edge -> share of the node's edges up to it
        self.edge_from = np.zeros(0, np.int32)
        self.edge_id = np.zeros(0, np.int32)

    def _spell(self, char: str) -> int:
        if char not in self.spelled:
            raw = (SPACE if char == LITERAL else char).encode("utf-8")
            self.spelled[char] = self.size + len(self.spelling)
            self.spelling.append([self.bytes[b] for b in raw])
        return self.spelled[char]

    def _learn(self, new: list[str]) -> None:
        """Append the lattices of new units: the edges into each node, longest first,
        with their cumulative backward shares. Nothing here depends on which units come together."""
        lengths = np.array([len(u) for u in new], dtype=np.int64)
        bases = np.cumsum(lengths + 1) - lengths - 1           # one node before each character, one at the end
        joined = "\0".join(new) + "\0"                          # no piece holds the separator
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        bare = ~np.isin(chars, self.single)
        bare[bases + lengths] = False                          # the separators
        at = np.flatnonzero(bare)
        spelled = np.fromiter((self._spell(chr(c)) for c in chars[at]), np.int64, len(at))
        a, b, k = self._edges(chars, at, spelled)
        log_w = np.where(k < self.size, self.log_weight[np.minimum(k, self.size - 1)], 0.0)
        longest = int(lengths.max())
        place = (b - np.repeat(bases, lengths + 1)[b]).astype(np.int16 if longest < 1 << 15 else np.int64)
        forward = np.full(len(chars), -np.inf)
        forward[bases] = 0.0
        arrive = np.zeros(len(a))
        by_place = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[by_place], np.arange(1, longest + 2))
        for p in range(longest):  # forward sums, place by place over all units at once
            e = by_place[bounds[p]:bounds[p + 1]]
            if len(e):
                v = forward[a[e]] + log_w[e]
                head = np.flatnonzero(np.concatenate([[True], b[e[1:]] != b[e[:-1]]]))
                forward[b[e[head]]] = np.logaddexp.reduceat(v, head)
                arrive[e] = np.exp(v - forward[b[e]])
        head = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        width = np.diff(np.append(head, len(b)))
        share = arrive.copy()
        for r in range(1, int(width.max())):
            e = head[width > r] + r
            share[e] += share[e - 1]
        share[head + width - 1] = 2.0                          # the last edge takes what is left
        first = np.zeros(len(chars), dtype=np.int64)
        first[b[head]] = head
        known, nodes, edges = len(self.unit), self.n_nodes, self.n_edges
        self.unit.update(zip(new, range(known, known + len(new))))
        self.node0 = _placed(self.node0, known, nodes + bases)
        self.length = _placed(self.length, known, lengths)
        self.first = _placed(self.first, nodes, edges + first)
        self.share = _placed(self.share, edges, share)
        self.edge_from = _placed(self.edge_from, edges, nodes + a)
        self.edge_id = _placed(self.edge_id, edges, k)
        self.n_nodes, self.n_edges = nodes + len(chars), edges + len(a)

    def encode(self, texts: list[str | None], keys: np.ndarray) -> list[np.ndarray]:
        """The sampled piece ids of every text; null and empty texts have none."""
        out: list[np.ndarray] = []
        todo: list[list[str]] = []
        size = 0
        for i, text in enumerate(texts):
            units = [] if not text else UNIT.findall(
                SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE))
            todo.append(units)
            size += len(units)
            if size >= 300_000:
                out += self._sample(todo, keys[i + 1 - len(todo):i + 1])
                todo, size = [], 0
        return out + self._sample(todo, keys[len(texts) - len(todo):])

    def _sample(self, todo: list[list[str]], keys: np.ndarray) -> list[np.ndarray]:
        counts = np.array([len(t) for t in todo], dtype=np.int64)
        n = int(counts.sum())
        if n == 0:
            return [np.zeros(0, np.int32) for _ in todo]
        words = set().union(*todo)
        new = [w for w in words if w not in self.unit]
        if len(self.unit) + len(new) > self.max_units:
            self._empty()
            new = list(words)
        if new:
            self._learn(new)
        get = self.unit.__getitem__
        unit = np.fromiter(map(get, chain.from_iterable(todo)), np.int64, n)
        row = np.repeat(np.arange(len(todo)), counts)
        place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
        seed = _mix(_mix(keys.astype(np.int64).view(U) + U(0x9E3779B97F4A7C15))[row] + place.astype(U))
        start = self.node0[unit]
        at = start + self.length[unit]
        live = np.arange(n)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        step = 0
        while len(live):
            u = (_mix(seed[live] + U(step) * U(0xD1342543DE82EF95)) >> U(11)).astype(float) * 2.0 ** -53
            here = at[live]
            e = self.first[here]
            behind = np.flatnonzero(self.share[e] <= u)
            while len(behind):
                e[behind] += 1
                behind = behind[self.share[e[behind]] <= u[behind]]
            steps.append((live, self.edge_id[e]))
            moved = self.edge_from[e]
            at[live] = moved
            live = live[moved > start[live]]
            step += 1
        pieces = np.zeros(n, np.int64)
        for who, _ in steps:
            pieces[who] += 1
        end = np.cumsum(pieces)
        ids = np.empty(int(end[-1]), np.int64)
        for k, (who, got) in enumerate(steps):
            ids[end[who] - 1 - k] = got
        bounds = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(counts)])]
        if len(self.spelling) and ids.max() >= self.size:  # byte pieces in place of spelled characters
            width = np.ones(self.size + len(self.spelling), np.int64)
            width[self.size:] = [len(s) for s in self.spelling]
            wide = width[ids]
            to = np.concatenate([[0], np.cumsum(wide)])
            spread = np.repeat(ids, wide)
            nth = np.arange(len(spread)) - np.repeat(to[:-1], wide)
            table = np.zeros((len(self.spelling), 4), np.int64)
            for i, s in enumerate(self.spelling):
                table[i, :len(s)] = s
            far = spread >= self.size
            spread[far] = table[spread[far] - self.size, nth[far]]
            ids, bounds = spread, to[bounds]
        ids = ids.astype(np.int32)
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids: pieces and bytes joined, the blank in front taken off."""
        return b"".join(map(self.text.__getitem__, ids.tolist()))[1:].decode("utf-8")


_SAMPLERS: dict[tuple, PieceSampler] = {}


def sampler(path: str, alpha: float) -> PieceSampler:
    if (path, alpha) not in _SAMPLERS:
        _SAMPLERS[path, alpha] = PieceSampler(path, alpha)
    return _SAMPLERS[path, alpha]


def sample_pieces(docs: DataFrame, model_path: str, alpha: float = 0.5, id_col: str = "doc_id",
                  text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (ids as little-endian uint32), text_crc32 (UTF-8 of the text
    decoded from the ids), and the ids if ``with_ids``; map-only over whole texts.

    The row key is the id (null: 0). Null and empty texts have no pieces and decode to ''.
    Other columns are ignored; an empty table gives no rows."""
    schema = "doc_id long, n_pieces long, ids_crc32 long, text_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        model = sampler(model_path, alpha)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                keys = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                found = model.encode(part.column(1).to_pylist(), keys)
                out = {"doc_id": part.column(0), "n_pieces": pa.array([len(x) for x in found], pa.int64()),
                       "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                       "text_crc32": pa.array([zlib.crc32(model.decode(x).encode("utf-8")) for x in found], pa.int64())}
                if with_ids:
                    out["ids"] = pa.array(found, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)
