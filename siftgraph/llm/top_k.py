"""Exact top-k search by inner product with block-at-a-time pruning.

A vector is a document of the terms (component, sign). Rows are ordered by their loudest term and cut into document ranges, so that like rows share a
block; a block keeps the maxima and minima of its terms. For a query, the sum over its terms of weight times the block's maximum (minimum, for a negative
weight) bounds every score in the block. Blocks are taken by falling bound and scored whole through their forward index, until the bound falls below the
k-th score so far. A query first meets its own shard, where its like are; the k-th score found there bounds its search in all others.

Only blocks that cannot hold a result are skipped, so results are exact whatever the data; where bounds are loose, as with random vectors of
many components, few blocks are skipped and all rows are scored.

Defined results: vectors that are null or hold null or non-finite components take no part; a row with a null id is a candidate, last among ties, and no
query; a query's own row is no candidate, but another row with the same id is; vectors of unlike length are filled up with zeros; fewer candidates
than k give fewer rows; an empty table gives none; extra columns are ignored. A scaled component must fit 32 bits, else the job says so.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftgraph.llm import vector_blocks as vb
from siftgraph.llm.common import materialise

NONE = np.iinfo(np.int64).min


class BlockIndex:
    """A shard's blocks with the extremes of their terms."""

    def __init__(self, shard: vb.Shard) -> None:
        self.shard = shard
        cuts = shard.starts[:-1]
        self.high, self.low = np.maximum.reduceat(shard.vectors, cuts), np.minimum.reduceat(shard.vectors, cuts)
        #: Blocks that were scored, of all queries.
        self.scored = 0

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Of each query and block, the most that a row of the block can score."""
        return vb.products(np.maximum(queries, 0), self.high) + vb.products(np.minimum(queries, 0), self.low)

    def search(self, queries: np.ndarray, least: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places of each query's best k rows that score `least` or more; places are -1 where there are fewer. own: the query's place here."""
        n = len(queries)
        scores, places = np.full((n, k), NONE), np.full((n, k), -1)
        bounds = self.bounds(queries)
        order = np.argsort(-bounds, axis=1, kind="stable")
        kth, active = least.copy(), np.arange(n)
        for step in range(bounds.shape[1]):
            block = order[active, step]
            going = bounds[active, block] >= kth[active]  # an equal score may have the smaller id
            active, block = active[going], block[going]
            if not len(active):
                break
            by = np.argsort(block, kind="stable")
            edges = np.flatnonzero(np.diff(block[by], prepend=-1, append=-1))
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                self._score(int(block[by[start]]), active[by[start:end]], queries, kth, scores, places, own)
            self.scored += len(active)
        return scores, places

    def _score(self, block: int, rows: np.ndarray, queries: np.ndarray, kth: np.ndarray, scores: np.ndarray, places: np.ndarray, own: np.ndarray | None) -> None:
        """Scores a block's rows for some queries, and keeps what is among their best."""
        at = np.arange(self.shard.starts[block], self.shard.starts[block + 1])
        found = vb.products(queries[rows], self.shard.vectors[at])
        good = found >= kth[rows, None]
        if own is not None:
            good &= at[None, :] != own[rows, None]
        some = good.any(axis=1)
        rows, found, good = rows[some], found[some], good[some]
        if not len(rows):
            return
        k = scores.shape[1]
        all_scores = np.concatenate([scores[rows], np.where(good, found, NONE)], axis=1)
        all_places = np.concatenate([places[rows], np.where(good, at[None, :], -1)], axis=1)
        ties = np.where(all_places >= 0, self.shard.rank[all_places], np.iinfo(np.int64).max)
        best = np.lexsort((ties, ~all_scores), axis=1)[:, :k]  # ~x falls as x rises, and can't overflow
        scores[rows], places[rows] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_places, best, 1)
        kth[rows] = np.maximum(kth[rows], scores[rows, -1])


_FOUND = [("vec_id", pa.int64()), ("score", pa.int64())]


def search(df: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = vb.SHARD, block: int = vb.BLOCK, queries_of_cell: int = vb.QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: of every row for which is_query holds, the k other rows of highest inner product, ties by smaller id."""
    rows = vb.quantised(df, F.col(vector_col), scale, id=F.col(id_col).cast("long"), label=F.lit(0).cast("long"), asks=F.col(id_col).isNotNull() & is_query)
    blocks = vb.shards(rows, [vb.loudest(F.col("v")), F.col("id")], shard, block)

    def at_home(table: pa.Table) -> pa.Table:
        here = vb.Shard(table)
        at = here.asking
        scores, places = BlockIndex(here).search(here.vectors[at], np.full(len(at), NONE), k, at)
        hit = places >= 0
        ends = np.cumsum([0, *hit.sum(axis=1)])
        found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([here.id_array(places[hit]), pa.array(scores[hit], pa.int64())], [n for n, _ in _FOUND]))
        columns = [*vb.asked(here), pa.array(scores[:, -1], pa.int64()), found]
        return pa.table(columns, names=[*(n for n, _ in vb.ASKED_ARROW), "least", "found"])

    def elsewhere(here: vb.Shard | None, queries: pa.Table) -> pa.Table:
        names = ["q_shard", "q_place", "q_id"]
        kinds = [*vb.ASKED_ARROW[:3], *_FOUND]
        if here is None:
            return pa.schema(kinds).empty_table()
        scores, places = BlockIndex(here).search(vb.vectors_of(queries, here.vectors.shape[1]), queries["least"].to_numpy(), k)
        hit = places >= 0
        of = np.nonzero(hit)[0]
        return pa.table([*(queries[n].take(pa.array(of)) for n in names), here.id_array(places[hit]), pa.array(scores[hit], pa.int64())], schema=pa.schema(kinds))

    home = materialise(blocks.groupBy("shard").applyInArrow(at_home, f"{vb.ASKED}, least bigint, found array<struct<vec_id:bigint,score:bigint>>"))
    further = vb.in_cells(blocks, home.select(*(n for n, _ in vb.ASKED_ARROW), "least"), elsewhere, "q_shard int, q_place int, q_id bigint, vec_id bigint, score bigint", own=False, queries_of_cell=queries_of_cell)
    found = home.select("q_shard", "q_place", "q_id", F.inline("found")).union(further)
    best = Window.partitionBy("q_shard", "q_place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(F.col("q_id").alias("query_id"), "rank", "vec_id", "score")
