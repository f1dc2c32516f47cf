"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

p(w | v) = a c(v, w) / c(v) + b c(w) / N + (1 - a - b) / (V + 1), with weights by the frequency bucket of
the context v (powers of two), learned by expectation-maximisation on held-out counts: a tenth of the training
documents is deleted from the counts while the weights are learned, and counted again for the scores.

Documents are read once into blocks of a few million tokens at most: the block's distinct words and, for each token, which of
them it is. Each block sends its distinct words and pairs (64-bit digests, as compressed differences of sorted
numbers, with its counts) to the ranges they fall in; a range adds up what all blocks sent and replies
with totals. Ranges are as many as the counted tokens ask for. Neither the vocabulary nor the pairs ever meet in one place, and a frequent word or pair
costs one entry a block. The weights are learned from a histogram of bounded size.

Defined results: null and empty texts are the end token alone; repeated rows count and score as often as they occur; null ids
learn with the rest and aren't held out; without training documents the base score is 0 for every text; an empty table gives no rows; extra
columns are ignored. Two of n distinct words share a digest with probability n^2 / 2^65.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgraph.llm.common import materialise, mix, shuffle_partitions, word_hashes

#: Tokens at which a block ends.
BLOCK_TOKENS = 1_000_000
#: Tokens of the table for each range of digests: what one group of counts holds, some 100 MB at most, doesn't grow with the table.
RANGE_TOKENS = 2_000_000
FOLDS, ROUNDS = 10, 60
#: Steps of the EM histogram in an octave of probability.
STEPS = 8

_END, _START = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)
_WORD, _PAIR = 0, 1


def _press(a: np.ndarray) -> bytes:
    """An array of numbers, byte plane by byte plane."""
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) if len(a) else b""


def _unpress(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _press_sorted(keys: np.ndarray) -> bytes:
    return _press(np.diff(keys, prepend=np.uint64(0)))


def _unpress_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpress(data, np.uint64), dtype=np.uint64)


def remainder(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(2)).cast("int")


def _blocks(most: int):  # noqa: ANN202
    """(block, deleted, ids, nulls, rems, lengths, words, places): documents of the deleted tenth have blocks of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 28, 0
        held: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}

        def block(deleted: bool) -> pa.RecordBatch:
            nonlocal made
            rows = held[deleted]
            words, places = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)
            made += 1
            values = [base + made, deleted, [r[0] or 0 for r in rows], [r[0] is None for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows], _press_sorted(words), _press(places.astype(np.uint32))]
            kinds = [pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            held[deleted], size[deleted] = [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["block", "deleted", "ids", "nulls", "rems", "lengths", "words", "places"])

        for batch in batches:
            for doc_id, rem, text in zip(batch["id"].to_pylist(), batch["rem"].to_pylist(), batch["text"].to_pylist(), strict=True):
                tokens = np.append(word_hashes((text or "").encode("utf-8", "surrogatepass"))[0], _END)
                held[rem == 1].append((doc_id, rem, tokens))
                size[rem == 1] += len(tokens)
                if size[rem == 1] >= most:
                    yield block(rem == 1)
        for deleted, rows in held.items():
            if rows:
                yield block(deleted)

    return run


class Block:
    """What a block's row says: distinct words and pairs, and where they occur."""

    def __init__(self, rems, lengths, words: bytes, places: bytes) -> None:  # noqa: ANN001
        self.rems, self.lengths = np.asarray(rems), np.asarray(lengths, np.int64)
        self.words, self.places = _unpress_sorted(words), _unpress(places, np.uint32).astype(np.int64)
        self.firsts = np.cumsum(self.lengths) - self.lengths
        n = len(self.words)
        context = np.empty_like(self.places)
        context[1:] = self.places[:-1]
        context[self.firsts] = n  # the start
        self.context = context
        self.learns = np.repeat(self.rems != 0, self.lengths)
        local, self.pair_of = np.unique(context * (n + 1) + self.places, return_inverse=True)
        left = np.append(self.words, _START)[local // (n + 1)]
        with np.errstate(over="ignore"):
            digests = mix(mix(left) + self.words[local % (n + 1)])
        self.order = np.argsort(digests)
        self.pairs = digests[self.order]

    def keys(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted digests, and how often training documents of this block have each."""
        if kind == _WORD:
            return self.words, np.bincount(self.places[self.learns], minlength=len(self.words))
        return self.pairs, np.bincount(self.pair_of[self.learns], minlength=len(self.pairs))[self.order]


def _ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n ranges of digests begins in sorted keys, and their end."""
    which = (keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
    return np.searchsorted(which, np.arange(n + 1, dtype=np.uint64))


def _sent(n: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["rems"], row["lengths"], row["words"], row["places"])
                for kind in (_WORD, _PAIR):
                    keys, counts = block.keys(kind)
                    cut = _ranges(keys, n)
                    parts = [(k, cut[k], cut[k + 1]) for k in range(n) if cut[k] < cut[k + 1]]
                    columns = [
                        pa.array([k * 2 + kind for k, _, _ in parts], pa.int32()), pa.array([row["block"]] * len(parts), pa.int64()), pa.array([row["deleted"]] * len(parts), pa.bool_()),
                        pa.array([_press_sorted(keys[a:b]) for _, a, b in parts], pa.binary()), pa.array([_press(counts[a:b].astype(np.uint32)) for _, a, b in parts], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["range", "block", "deleted", "keys", "counts"])

    return run


def _totals(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one range: to each block the counts of its keys without (main) and with (all) the deleted tenth; to block -1 sums."""
    keys = [_unpress_sorted(x) for x in pdf["keys"]]
    counts = [_unpress(x, np.uint32) for x in pdf["counts"]]
    known, at = np.unique(np.concatenate(keys), return_inverse=True)
    flat = np.concatenate(counts).astype(np.float64)  # exact up to 2^53
    deleted = np.repeat(pdf["deleted"].to_numpy(bool), [len(k) for k in keys])
    all_ = np.bincount(at, flat, len(known)).astype(np.int64)
    main = np.bincount(at, np.where(deleted, 0, flat), len(known)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    which, rows = int(pdf["range"].iloc[0]), []
    for block, start, end in zip(pdf["block"], ends - [len(k) for k in keys], ends, strict=True):
        own = at[start:end]
        rows.append((which, block, _press(main[own]), _press(all_[own] - main[own]), 0, 0, 0, 0))
    rows.append((which, -1, b"", b"", int(all_.sum()), int((all_ > 0).sum()), int(main.sum()), int((main > 0).sum())))
    return pd.DataFrame(rows, columns=["range", "block", "main", "more", "n", "v", "n_main", "v_main"])


def _counted(blocks: pd.DataFrame, replies: pd.DataFrame) -> tuple[Block, pd.Series, dict[tuple[str, int], np.ndarray]]:
    """A block and its totals (main or all, kind), in the order of its words and pairs, the start's count last among the words."""
    row = blocks.iloc[0]
    block = Block(row["rems"], row["lengths"], row["words"], row["places"])
    replies = replies.sort_values("range")
    out = {}
    for kind in (_WORD, _PAIR):
        own = replies[replies["range"] % 2 == kind]
        main = np.concatenate([_unpress(x, np.int64) for x in own["main"]])
        both = main + np.concatenate([_unpress(x, np.int64) for x in own["more"]])
        for name, values in (("main", main), ("all", both)):
            if kind == _WORD:
                out[name, kind] = np.append(values, values[np.searchsorted(block.words, _END)])  # texts begin as often as they end
            else:
                out[name, kind] = np.empty_like(values)
                out[name, kind][block.order] = values
    return block, row, out


def _parts(block: Block, totals: dict, name: str, n: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """For each token: the bucket of its context, the bigram and the unigram estimate; and the uniform one."""
    words, pairs = totals[name, _WORD], totals[name, _PAIR]
    context = words[block.context]
    bucket = np.where(context > 0, np.frexp(context.astype(np.float64))[1], 0)
    bigram = pairs[block.pair_of] / np.maximum(context, 1)
    return bucket, bigram, words[block.places] / max(n, 1), 1 / (v + 1)


def _histogram(n: int, v: int):  # noqa: ANN202
    def run(blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(replies):
            return pd.DataFrame({"bucket": [], "bigram": [], "unigram": [], "n": []}).astype("int64")
        block, _, totals = _counted(blocks, replies)
        bucket, bigram, unigram, _ = _parts(block, totals, "main", n, v)
        step = lambda p: np.where(p > 0, np.round(np.log2(np.maximum(p, 1e-300)) * STEPS), 1).astype(np.int64)
        cells, counts = np.unique(np.stack([bucket, step(bigram), step(unigram)]), axis=1, return_counts=True)
        return pd.DataFrame({"bucket": cells[0], "bigram": cells[1], "unigram": cells[2], "n": counts})

    return run


def mixture(cells: pd.DataFrame, v: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bigram, unigram, uniform) by bucket: EM over held-out counts, each bucket with one token's worth of prior."""
    start = np.array([0.5, 0.4, 0.1])
    weights = np.tile(start, (65, 1))
    for bucket, own in cells.groupby("bucket"):
        p = np.stack([*(np.where(own[c] > 0, 0.0, 2.0 ** (own[c] / STEPS)) for c in ("bigram", "unigram")), np.full(len(own), 1 / (v + 1))], 1)
        n, w = own["n"].to_numpy(np.float64), start
        for _ in range(rounds):
            share = w * p
            share /= share.sum(1, keepdims=True)
            w = (n @ share + start) / (n.sum() + 1)
        weights[int(bucket)] = w
    weights[0] = [0, *weights[0, 1:] / weights[0, 1:].sum()]  # a context never seen has no bigrams
    return weights


def _scores(weights: np.ndarray, n: int, v: int):  # noqa: ANN202
    def run(blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        block, row, totals = _counted(blocks, replies)
        counts = totals["all", _WORD][block.places]
        bucket, bigram, unigram, uniform = _parts(block, totals, "all", n, v)
        w = weights[bucket]
        model = np.log10(w[:, 0] * bigram + w[:, 1] * unigram + w[:, 2] * uniform)
        base = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))
        add = lambda x: np.add.reduceat(x, block.firsts)
        ids = pd.Series(row["ids"], dtype="Int64").mask(pd.Series(row["nulls"], dtype=bool))
        return pd.DataFrame({"doc_id": ids, "held_out": block.rems == 0, "n_tokens": block.lengths, "n_known": add((counts > 0).astype(np.int64)), "train_tokens": n, "base_score": add(base), "score": add(model)})

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), remainder(F.col(id_col)).alias("rem"), F.col(text_col).alias("text"))
    blocks = materialise(rows.mapInArrow(_blocks(block_tokens), "block long, deleted boolean, ids array<long>, nulls array<boolean>, rems array<int>, lengths array<int>, words binary, places binary"))
    size = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("tokens")).first()
    ranges = max(1, math.ceil(size["tokens"] / range_tokens))  # so that a range's part of all blocks stays of one size, however many there are
    least = shuffle_partitions(docs.sparkSession)
    tasks, turns = max(least, 2 * ranges), max(least, size["blocks"])
    sent = blocks.mapInArrow(_sent(ranges), "range int, block long, deleted boolean, keys binary, counts binary")
    replies = materialise(sent.repartition(tasks, "range").groupBy("range").applyInPandas(_totals, "range int, block long, main binary, more binary, n long, v long, n_main long, v_main long"))
    sums = replies.filter("block = -1 and range % 2 = 0").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "n_main", "v_main"))).first()
    replies = replies.filter("block >= 0").select("range", "block", "main", "more").repartition(turns, "block")
    deleted = blocks.filter("deleted").repartition(turns, "block")
    own = replies.join(F.broadcast(deleted.select("block")), "block", "left_semi")  # a number for each block
    cells = deleted.groupBy("block").cogroup(own.groupBy("block")).applyInPandas(_histogram(sums["n_main"], sums["v_main"]), "bucket long, bigram long, unigram long, n long")
    cells = cells.groupBy("bucket", "bigram", "unigram").agg(F.sum("n").alias("n")).toPandas()  # as many as the steps allow
    weights = mixture(cells, sums["v_main"])
    out = blocks.repartition(turns, "block").groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(_scores(weights, sums["n"], sums["v"]), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("doc_id", id_col)


def perplexity(log10_sum: float, n: int) -> float:
    return math.pow(10, -log10_sum / max(n, 1))
