"""Bounded-space online packing of tokenised documents into sequences of a fixed size.

Each partition keeps a fixed number of open windows. A piece goes where it fits best; if it fits nowhere,
the fullest window is emitted and a new one opened. What is still open at a partition's end is a leftover:
leftovers are dealt into groups of thousands and packed by the same rule as whole items, so that padding
is left only in the last windows of each group. Only places travel, never ids or texts: one row per piece.

Documents longer than a sequence are cut: whole sequences first, the rest is packed. Null and empty texts
are one token (the end mark); repeated rows are packed as rows of their own; an empty table gives no rows;
extra columns are ignored; null ids are kept.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgraph.llm import bpe
from siftgraph.llm.common import materialise, small_or_shuffled

SIZE = 2048
OPEN_WINDOWS = 256
#: Leftover windows that meet in one task of the merge.
GROUP = 20_000
#: Sequences that one task may number.
_STRIDE = 1 << 36


class Windows:
    """At most `most` open windows of `size` tokens; items are opaque."""

    def __init__(self, size: int, most: int) -> None:
        self.size, self.most = size, most
        self.gaps: list[tuple[int, int]] = []  # (room left, window), sorted
        self.held: dict[int, list] = {}
        self.n = 0

    def new(self) -> int:
        self.n += 1
        return self.n - 1

    def put(self, length: int, item: object) -> tuple[int, list] | None:
        """Places an item; returns a window that is done with its (offset, item) list, if one is."""
        done = None
        at = bisect_left(self.gaps, (length, -1))
        if at < len(self.gaps):
            gap, window = self.gaps.pop(at)
        else:
            if len(self.gaps) >= self.most:
                window = self.gaps.pop(0)[1]
                done = window, self.held.pop(window)
            gap, window = self.size, self.new()
            self.held[window] = []
        self.held[window].append((self.size - gap, item))
        if gap > length:
            insort(self.gaps, (gap - length, window))
        elif done is None:
            done = window, self.held.pop(window)
        else:  # both are done; the full one goes with the next call or the rest
            insort(self.gaps, (0, window))
        return done

    def rest(self) -> Iterator[tuple[int, int, list]]:
        """(window, filled, items) of the windows still open."""
        for gap, window in self.gaps:
            yield window, self.size - gap, self.held[window]


_KINDS = dict.fromkeys(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset", "filled"), pa.int64())


def _pieces(path: str, size: int, most: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, words = bpe.packed_ids(path).__getitem__, bpe.encoder_of(path).words
        windows, base, out = Windows(size, most), TaskContext.get().partitionId() * _STRIDE, []
        row = lambda window, offset, item, left: (*item, base + window, offset, left)
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS.values())], list(_KINDS))
        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                data = b"".join([*map(get, words(text.as_py())), b"\1\0\0\0"])
                total = len(data) // 4
                for start in range(0, total, size):
                    length = min(size, total - start)
                    item = doc_id, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), total
                    if length == size:
                        out.append(row(windows.new(), 0, item, None))
                    elif done := windows.put(length, item):
                        out += [row(done[0], offset, x, None) for offset, x in done[1]]
            if len(out) >= 10_000:
                yield made(out)
                out = []
        out += [row(window, offset, x, filled) for window, filled, items in windows.rest() for offset, x in items]
        yield made(out)

    return run


def _merged(size: int, most: int):  # noqa: ANN202
    """Leftover windows as items: (window, sequence_id, shift)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows = Windows(size, most)
        frame = lambda lists: pd.DataFrame([(w, x[0][1], offset) for x in lists for offset, w in x], columns=["window", "sequence_id", "shift"]).astype("int64")
        for pdf in batches:
            done = [windows.put(int(filled), int(window)) for window, filled in zip(pdf["window"], pdf["filled"], strict=True)]
            yield frame([x[1] for x in done if x])
        yield frame([items for _, _, items in windows.rest()])

    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, open_windows: int = OPEN_WINDOWS, group: int = GROUP) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, filled long"
    pieces = materialise(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_pieces(path, size, open_windows), schema))
    open_ = pieces.filter("filled is not null").groupBy("window").agg(F.max("filled").alias("filled"))
    n = -(-open_.count() // group) or 1
    moved = materialise(open_.repartition(n, "window").mapInPandas(_merged(size, open_windows), "window long, sequence_id long, shift long"))
    joined = pieces.join(small_or_shuffled(moved), "window", "left")
    return joined.select(
        F.col("doc_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
        F.coalesce("sequence_id", "window").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
