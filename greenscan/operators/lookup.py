"""Arrays put through a (key, value) table of any size: dictionary encoding both ways
and word forms (F11).

Rows are packed into blocks of at most some ``BLOCK`` elements. A block is written once, as one
row: the distinct elements of its arrays by frequency, and its rows with every element as its
number among them, compressed. Only the distinct elements of a block meet the table, so a frequent element
costs one row a block and no array is shuffled as it stands; the values come back to the block
as one array, by which its rows are put together again. Rows need no id: repeated and null ids
and equal rows each keep their row.

The most frequent keys (at most ``HEAD`` rows, whatever the table) can be given to be broadcast.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from greenscan.session import kept

try:  # workers get these functions by value: the package need not be on their path
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # older cloudpickle: the package must then be installed on workers
    pass

HEAD = 4096
BLOCK = 1 << 21         # elements of a block, and the last row's
BLOCK_BYTES = 32 << 20  # a block of long elements ends with the batch that goes beyond
CODES = "_codes"


def numbered(lists: pa.ListArray) -> tuple[pa.ListArray, pa.Array]:
    """The arrays with every element as its number among the distinct ones, and these, the most
    frequent first. Null arrays stay null, null elements get the number behind the last. Numbers
    are structs of their bytes, which are compressed apart."""
    coded = lists.flatten().dictionary_encode()
    keys, n = coded.dictionary, len(coded.dictionary)
    codes = coded.indices.fill_null(n).to_numpy()
    order = np.argsort(-np.bincount(codes, minlength=n + 1)[:n], kind="stable")
    rank = np.append(np.empty(n, np.uint32), np.uint32(n))
    rank[order] = np.arange(n)
    codes = rank[codes]
    planes = [pa.array((codes >> k & 255).astype(np.uint8)) for k in range(0, max(n.bit_length(), 1), 8)]
    return lists_of(offsets_of(lists), pa.StructArray.from_arrays(planes, [str(k) for k in range(len(planes))]), lists), \
        keys.take(pa.array(order))


def numbers(coded: pa.ListArray) -> np.ndarray:
    """The numbers of the elements, from the first array's first to the last array's last."""
    out = None
    for k, plane in enumerate(coded.flatten().flatten()):
        part = plane.to_numpy().astype(np.int32) << 8 * k
        out = part if out is None else out | part
    return out


def offsets_of(lists: pa.ListArray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])


def lists_of(offsets: np.ndarray, values: pa.Array, like: pa.Array) -> pa.ListArray:
    """Arrays of ``values`` at ``offsets``, null where ``like`` is."""
    mask = like.is_null() if like.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values, mask=mask)


def blocks(batches: Iterable[pa.RecordBatch], size: int, most: int) -> Iterator[pa.Table]:
    """The rows in order, cut into tables by the elements of the last column. Each row counts
    as one element more, so rows of empty arrays make blocks too."""
    held: list[pa.RecordBatch] = []
    done = number = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        weights = pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 1)), 0).to_numpy().astype(np.int64) + 1
        ends = done + np.cumsum(weights)
        at = (ends - weights) // size
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            if held and (at[start] != number or sum(b.nbytes for b in held) >= most):
                yield pa.Table.from_batches(held)
                held = []
            number = at[start]
            held.append(batch.slice(start, stop - start))
        done = int(ends[-1])
    if held:
        yield pa.Table.from_batches(held)


def _pack(size: int, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for n, rows in enumerate(blocks(batches, size, most)):
            last = rows.num_columns - 1
            codes, keys = numbered(plain(rows.column(last)))
            rows = rows.set_column(last, CODES, codes).combine_chunks()
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, rows.schema, options=options) as writer:
                writer.write_table(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([first + n], pa.int64()), lists_of(np.array([0, len(keys)]), keys, pa.array([0])),
                 pa.array([out.getvalue().to_pybytes()], pa.binary())], ["block", "keys", "body"])

    return run


@dataclass(frozen=True)
class Blocks:
    """A written table whose column ``list_col`` holds arrays, block by block. ``pack``: (block,
    keys, body), a block a row; ``fields``: the columns of the table."""

    pack: DataFrame
    list_col: str
    fields: tuple[T.StructField, ...]

    @classmethod
    def of(cls, df: DataFrame, list_col: str) -> "Blocks":
        """The table written."""
        src = df.select(*[f"`{c}`" for c in df.columns if c != list_col], F.col(list_col).alias(CODES))
        schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("keys", src.schema[CODES].dataType),
                               T.StructField("body", T.BinaryType())])
        pack = kept(src.mapInArrow(_pack(BLOCK, BLOCK_BYTES), schema), "blocks")
        return cls(pack, list_col, tuple(df.schema.fields))

    def rows(self) -> DataFrame:
        """The table as it was."""
        return self.pack.select("body", "keys").mapInArrow(_unpack(self.list_col, [f.name for f in self.fields]),
                                                           T.StructType(list(self.fields)))

    def keys(self) -> DataFrame:
        """(block, pos, key): the distinct elements of each block."""
        return self.pack.select("block", F.posexplode("keys").alias("pos", "key"))

    def rebuilt(self, found: DataFrame, fields: list[T.StructField], rebuild: Callable, told=None) -> DataFrame:
        """The rows with new columns. ``found``: (block, pos, ...) what is known of elements;
        ``told`` (struct -> struct) adds what follows from that and need not be shuffled. ``rebuild`` makes a dict of columns from the arrays' offsets, the place in ``found`` of
        every element (its length where it has none), ``found`` as an Arrow table, and the coded
        arrays. ``fields``: the columns of the result."""
        known = F.struct(*[F.col(c) for c in found.columns if c != "block"])
        dicts = found.groupBy("block").agg(F.collect_list(known).alias("found"))
        if told is not None:
            dicts = dicts.select("block", F.transform("found", told).alias("found"))
        names = [f.name for f in fields]
        keys = ["keys"] if self.list_col in names else []
        return self.pack.select("block", "body", *keys).join(dicts, "block", "left").select("body", *keys, "found") \
            .mapInArrow(_unpack(self.list_col, names, rebuild), T.StructType(fields))


def _unpack(list_col: str, names: list[str], rebuild: Callable | None = None) -> Callable:
    def unpack(body, keys, found) -> dict[str, pa.Array]:
        rows = pa.ipc.open_stream(body).read_all().combine_chunks()
        coded = plain(rows.column(CODES))
        offsets, codes = offsets_of(coded), numbers(coded)
        new = {c: plain(rows.column(c)) for c in names if c in rows.column_names}
        if list_col in names:  # the number behind the last stands for null
            new[list_col] = lists_of(offsets, pa.concat_arrays([keys, pa.nulls(1, keys.type)]).take(pa.array(codes)), coded)
        if rebuild is not None:
            table = pa.Table.from_struct_array(found)
            pos = table.column("pos").to_numpy()
            places = np.full(max(int(codes.max(initial=-1)) + 1, int(pos.max(initial=-1)) + 1), len(pos))
            places[pos] = np.arange(len(pos))
            new.update(rebuild(offsets, places[codes], table, coded))
        return new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                body, *rest = batch.slice(i, 1).columns
                found = rest.pop().flatten() if rebuild is not None else None
                new = unpack(body[0].as_py(), rest[0].flatten() if rest else None, found)
                yield pa.RecordBatch.from_arrays([new[c] for c in names], names)

    return run


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def replaced(df: DataFrame | Blocks, list_col: str, out_col: str, table: DataFrame, key: str, value: str,
             head: DataFrame | None = None, default=None, keep_list: bool = True) -> DataFrame:
    """``df`` with ``out_col``: each element's value; ``default`` for null elements and those that
    ``table`` (key, value; keys distinct) lacks. A null array stays null, an empty one empty.
    ``head``: the table's at most HEAD most frequent rows. Without ``keep_list`` the result lacks
    ``list_col``."""
    store = df if isinstance(df, Blocks) else Blocks.of(df, list_col)
    words = store.keys()
    pairs = table.select(F.col(key).alias("key"), F.col(value).alias("value"))
    if head is None:
        found = words.join(pairs, "key")
    else:
        top = F.broadcast(head.select(F.col(key).alias("key"), F.col(value).alias("value")).limit(HEAD))
        rest = words.join(top.select("key"), "key", "left_anti")
        found = words.join(top, "key").unionByName(rest.join(pairs, "key"))
    kinds = {f.name: f.dataType for f in store.fields if keep_list or f.name != list_col}
    kinds[out_col] = T.ArrayType(table.schema[value].dataType)

    def rebuild(offsets, places, known, coded):
        values = plain(known.column("value"))
        values = pa.concat_arrays([values, pa.array([default], values.type)])
        return {out_col: lists_of(offsets, values.take(pa.array(places)), coded)}

    return store.rebuilt(found.select("block", "pos", "value"), [T.StructField(c, k) for c, k in kinds.items()], rebuild)
