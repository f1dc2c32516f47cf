"""Hard negatives by a full score sort for each anchor.

An anchor's integer scores against all rows are sorted by score and id. Its positives are the first rows of its label. For each positive a binary search in
the sorted scores finds the upper limit, a share of the positive's score, and from there the first rows of another label above the lower limit
are read. No anchor's scores are in one task: each shard of rows sorts the anchor's scores whole and hands on the few entries that may be
among the first; those are ranked over all shards. That is done once for positives and once for negatives, as the limits depend on the former.

Defined results: rows with a null label, a null vector or null or non-finite components take no part; a row with a null id may be a positive or
negative, last among ties, and is no anchor; only the anchor's own row is left out, not others with its id; repeated rows count each;
a positive with a negative score has no negatives, as no score lies between its limits; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftgraph.llm import vector_blocks as vb
from siftgraph.llm.common import materialise

#: Scores that are sorted at once in a task.
AT_ONCE = 4_000_000

_POSITIVE = [*vb.ASKED_ARROW[:2], ("positive_id", pa.int64()), ("positive_score", pa.int64())]
_NEGATIVE = [*vb.ASKED_ARROW[:3], ("nth", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())]
_SQL = {pa.int32(): "int", pa.int64(): "bigint"}


def _sorted(here: vb.Shard, anchors: pa.Table):  # noqa: ANN202
    """For each anchor its number, label, and the shard's other rows by falling score and rising id, with their scores."""
    vectors, labels = vb.vectors_of(anchors, here.vectors.shape[1]), anchors["q_label"].to_numpy()
    own = np.where(anchors["q_shard"].to_numpy() == here.number, anchors["q_place"].to_numpy(), -1)
    step = max(1, AT_ONCE // len(here.vectors))
    for start in range(0, len(anchors), step):
        scores = vb.products(vectors[start : start + step], here.vectors)
        order = np.lexsort((np.broadcast_to(here.rank, scores.shape), -scores), axis=1)
        for i, places in enumerate(order, start):
            rest = places[places != own[i]]
            yield i, labels[i], rest, scores[i - start, rest]


def _table(kinds: list, anchors: pa.Table, of: list[int], columns: list[pa.Array]) -> pa.Table:
    own = [anchors[n].take(pa.array(of, pa.int64())) for n, _ in kinds[: len(kinds) - len(columns)]]
    return pa.table([*own, *columns], schema=pa.schema(kinds))


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def mine(
    df: DataFrame, is_anchor: Column, label: Column, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    id_col: str = "vec_id", vector_col: str = "embedding", shard: int = vb.SHARD, anchors_of_cell: int = vb.QUERIES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor's positives and their negatives.

    A negative's score lies between low and high hundredths of the positive's, both included.
    """

    def first_of_label(here: vb.Shard | None, anchors: pa.Table) -> pa.Table:
        of, places, scores = [], [], []
        for i, own_label, order, sorted_scores in _sorted(here, anchors) if here else ():
            like = np.flatnonzero(here.labels[order] == own_label)[:positives]
            of += [i] * len(like)
            places.append(order[like])
            scores.append(sorted_scores[like])
        ids = here.id_array(_joined(places)) if here else pa.array([], pa.int64())
        return _table(_POSITIVE, anchors, of, [ids, pa.array(_joined(scores), pa.int64())])

    def first_below(here: vb.Shard | None, anchors: pa.Table) -> pa.Table:
        of, given, places, scores = [], [], [], []
        wanted = anchors["positives"].to_pylist() if here else []
        for i, own_label, order, sorted_scores in _sorted(here, anchors) if here else ():
            unlike = here.labels[order] != own_label
            order, fall = order[unlike], -100 * sorted_scores[unlike]  # rises from entry to entry
            for p in wanted[i]:
                start = np.searchsorted(fall, -high * p["positive_score"], "left")
                end = np.searchsorted(fall, -low * p["positive_score"], "right")
                taken = slice(start, min(max(start, end), start + negatives))
                places.append(order[taken])
                scores.append(fall[taken] // -100)
                of += [i] * len(places[-1])
                given += [p] * len(places[-1])
        columns = [pa.array([p[n] for p in given], kind) for n, kind in _NEGATIVE[3:6]]
        ids = here.id_array(_joined(places)) if here else pa.array([], pa.int64())
        return _table(_NEGATIVE, anchors, of, [*columns, ids, pa.array(_joined(scores), pa.int64())])

    def asked(table: pa.Table) -> pa.Table:
        return pa.table(vb.asked(vb.Shard(table)), schema=pa.schema(vb.ASKED_ARROW))

    sql = lambda kinds: ", ".join(f"{n} {_SQL[kind]}" for n, kind in kinds)
    rows = vb.quantised(df, F.col(vector_col), scale, id=F.col(id_col).cast("long"), label=label.cast("long"), asks=F.col(id_col).isNotNull() & is_anchor).filter("label is not null")
    blocks = vb.shards(rows, [F.col("id")], shard)
    anchors = materialise(blocks.groupBy("shard").applyInArrow(asked, vb.ASKED))
    near = vb.in_cells(blocks, anchors, first_of_label, sql(_POSITIVE), own=True, queries_of_cell=anchors_of_cell)
    by_score = Window.partitionBy("q_shard", "q_place").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    first = near.withColumn("nth", F.row_number().over(by_score)).filter(F.col("nth") <= positives)
    with_positives = materialise(anchors.join(first.groupBy("q_shard", "q_place").agg(F.collect_list(F.struct("nth", "positive_id", "positive_score")).alias("positives")), ["q_shard", "q_place"]))
    hard = vb.in_cells(blocks, with_positives, first_below, sql(_NEGATIVE), own=True, queries_of_cell=anchors_of_cell)
    best = Window.partitionBy("q_shard", "q_place", "nth").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    ranked = hard.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    return ranked.select(F.col("q_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
