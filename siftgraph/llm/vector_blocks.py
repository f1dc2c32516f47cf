"""Integer vectors in shards of document ranges, and a stated query set that meets every shard in cells of bounded size.

Rows are ordered, cut into shards by a range partitioning and, within a shard, into blocks that hold their rows' vectors as one matrix (a forward
index). The query rows are some of the rows themselves: a row's identity is its shard and its place there, so repeated ids do no harm.
A cell is one shard and at most about QUERIES of the queries: no task holds more than that, however many rows or queries there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgraph.llm.common import materialise

#: Rows of a shard, about; rows of a block; queries of a cell, about.
SHARD, BLOCK, QUERIES = 8192, 128, 2048

_BLOCKS = "shard int, block int, width int, ids array<bigint>, labels array<bigint>, asks array<int>, forward binary"


def quantised(df: DataFrame, vector: Column, scale: int, **columns: Column) -> DataFrame:
    """The given columns and v, each component x as floor(scale * x); rows whose vector is null or holds null or non-finite components go."""
    x = vector.cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))  # NaN is larger than infinity in Spark's order
    return df.filter(sound).select(*(c.alias(n) for n, c in columns.items()), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c)).alias("v"))


def loudest(v: Column) -> Column:
    """The component of the largest magnitude, negative places for negative components: rows that share it score alike."""
    size = F.transform(v, F.abs)
    at = F.array_position(size, F.array_max(size)).cast("int")
    return F.when(F.size(v) == 0, F.lit(0)).otherwise(F.when(F.get(v, at - 1) < 0, -at).otherwise(at))


def _blocked(block: int):  # noqa: ANN202
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("width", pa.int32()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("asks", pa.list_(pa.int32())), ("forward", pa.binary())])

    def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
        lengths, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False), pc.list_flatten(lists).to_numpy(zero_copy_only=False)
        if len(flat) and max(-int(flat.min()), int(flat.max())) >= 2**31:
            raise ValueError("a scaled component doesn't fit 32 bits: choose a smaller scale")
        out = np.zeros((len(lists), width), "<i4")
        out[np.repeat(np.arange(len(lists)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, n, waiting = TaskContext.get().partitionId(), 0, None

        def made(t: pa.Table, n: int) -> pa.RecordBatch:
            t = t.combine_chunks()
            width = t["width"][0].as_py()
            asks = np.flatnonzero(t["asks"].to_numpy(zero_copy_only=False)).astype(np.int32)
            lists = t["v"].chunk(0) if t["v"].num_chunks else t["v"].combine_chunks()
            row = [[shard], [n], [width], [t["id"].to_pylist()], [t["label"].to_pylist()], [asks], [matrix(lists, width).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            waiting = pa.concat_tables([waiting, t]) if waiting is not None else t
            while len(waiting) >= block:
                yield made(waiting.slice(0, block), n)
                waiting, n = waiting.slice(block), n + 1
        if waiting is not None and len(waiting):
            yield made(waiting, n)

    return run


def shards(rows: DataFrame, order: list[Column], rows_of_shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Blocks of rows (id long, label long, asks boolean, v), written to the shared folder; asks says which rows are queries. Vectors of unlike length are filled up with zeros."""
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    keyed = rows.withColumns({f"k{i}_": c for i, c in enumerate(order)} | {"row_": F.monotonically_increasing_id()})
    keys = [*(f"k{i}_" for i in range(len(order))), "row_"]
    ranged = keyed.repartitionByRange(max(1, -(-known["n"] // rows_of_shard)), *keys).sortWithinPartitions(*keys)
    wide = ranged.select("id", "label", F.coalesce("asks", F.lit(False)).alias("asks"), "v", F.lit(known["width"] or 0).alias("width"))
    return materialise(wide.mapInArrow(_blocked(block), _BLOCKS))


class Shard:
    """The rows of a shard: vectors, ids with nulls last in the order of ties, labels, and which rows are queries."""

    def __init__(self, blocks: pa.Table) -> None:
        t = blocks.take(pc.sort_indices(blocks["block"])).combine_chunks()
        width = t["width"][0].as_py()
        parts = [np.frombuffer(x.as_buffer(), "<i4").reshape(-1, width) if width else np.zeros((len(ids), 0), "<i4") for x, ids in zip(t["forward"], t["ids"], strict=True)]
        self.number, self.vectors = t["shard"][0].as_py(), np.concatenate(parts)
        self.starts = np.cumsum([0, *map(len, parts)])
        self.ids, self.known = values(t["ids"])
        self.labels = values(t["labels"])[0]
        self.asking = np.array([int(start) + place for start, places in zip(self.starts, t["asks"].to_pylist(), strict=False) for place in places], np.int64)
        order = np.lexsort((self.ids, ~self.known))
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))

    def id_array(self, places: np.ndarray) -> pa.Array:
        return pa.array(self.ids[places], pa.int64(), mask=~self.known[places])


def values(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of the lists in a row, nulls as 0, and which aren't null."""
    flat = pc.list_flatten(lists)
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return pc.fill_null(flat, 0).to_numpy(zero_copy_only=False), pc.is_valid(flat).to_numpy(zero_copy_only=False)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a and b: by doubles where these hold every sum, else by 64-bit integers."""
    most = int(np.abs(a, dtype=np.int64).max(initial=0)) * int(np.abs(b, dtype=np.int64).max(initial=0)) * max(1, a.shape[1])
    if most >= 2**62:
        raise ValueError("scores don't fit 64 bits: choose a smaller scale")
    kind = np.float64 if most < 2**53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


#: What identifies a query and what a cell needs of it.
ASKED = "q_shard int, q_place int, q_id bigint, q_label bigint, q_v binary"
ASKED_ARROW = [("q_shard", pa.int32()), ("q_place", pa.int32()), ("q_id", pa.int64()), ("q_label", pa.int64()), ("q_v", pa.binary())]


def asked(shard: Shard) -> list[pa.Array]:
    """The shard's query rows, in the columns of ASKED."""
    at = shard.asking
    vectors = shard.vectors[at]
    return [pa.array(np.full(len(at), shard.number), pa.int32()), pa.array(at, pa.int32()), shard.id_array(at), pa.array(shard.labels[at], pa.int64()), pa.array([v.tobytes() for v in vectors], pa.binary())]


def vectors_of(queries: pa.Table, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(queries["q_v"].to_pylist()), "<i4").reshape(len(queries), width)


def in_cells(blocks: DataFrame, queries: DataFrame, f: Callable[[Shard, pa.Table], pa.Table], schema: str, own: bool, queries_of_cell: int = QUERIES) -> DataFrame:
    """f(shard, queries) of every cell. own says whether queries meet their own shard too. blocks and queries should be materialised."""
    n, most = queries.count(), blocks.agg(F.max("shard")).first()[0]
    cells = max(1, -(-n // queries_of_cell))
    left = blocks.withColumn("cell_", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    right = queries.withColumn("cell_", F.pmod(F.xxhash64("q_shard", "q_place"), F.lit(cells)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(most or 0))))
    right = right if own else right.filter("shard != q_shard")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return f(Shard(left) if len(left) and len(right) else None, right)

    return left.groupBy("shard", "cell_").cogroup(right.groupBy("shard", "cell_")).applyInArrow(run, schema)
