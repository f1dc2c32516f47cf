"""N-gram Jaccard join by chosen paths.

A set is a text's five-word shingles. Sets that are the same meet by digest first. In each of RUNS runs, a
set chooses shingles whose hash is below BRANCHES / size, and again after each of them: sets that share much
choose alike, so a path of two chosen shingles is a bucket. A bucket of more than SMALL sets is split by the
next sampled shingle, twice at most; a small one is brute-forced. What is still large
(mostly near copies of one text) is dealt into chunks that are compared whole; sets that stay outside the largest class of their bucket are
then compared with the whole bucket, in blocks. Of such a bucket only links that join something are kept: a spanning forest, not its pairs.
A pair is first screened by parities: each set has a bit array in which every shingle flips one bit, and the bits that differ are no more than the shingles that do,
so that no link is lost by it. What is left is verified on the whole sets of 64-bit shingle hashes; RUNS is what the target recall asks for.

Links make classes (connected components). A document's n_links counts documents with the same set, and those of sets linked to its own: all of its class, whatever its size,
for a link never leaves its class, and each class that isn't known to link all pairs is compared whole, in pairs of chunks that give sums instead of pairs.

Defined results: null, empty and wordless texts have the empty set, and are linked with nothing (each its own class, named by its own id, n_links 0);
a text of fewer words than a shingle is one shingle; repeated rows are copies of each other; null ids are kept and never name a
class that has another id; an empty table gives no rows; extra columns are ignored by ``join`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgraph.llm.common import components, fresh, materialise, mix, shingles, small_or_shuffled, with_made

THRESHOLD = 0.8
TARGET_RECALL = 0.995
#: Expected shingles chosen at each of the two branching levels.
BRANCHES = 2.0
#: Sets in a bucket that is brute-forced, and in a chunk of a larger one.
SMALL, CHUNK = 24, 256
#: Sets of a bucket that counts as hot: its rows meet its size in a broadcast, not in one task.
HOT = 512
#: Sets in a chunk of a class whose links are counted whole.
WHOLE = 1024


def runs_for(threshold: float = THRESHOLD, recall: float = TARGET_RECALL, branches: float = BRANCHES) -> int:
    """Runs until a pair at the threshold is found with the target probability: two levels, each a Poisson number of shared choices."""
    shared = branches * 2 * threshold / (1 + threshold)
    found = 1 - math.exp(-shared * (1 - math.exp(-shared)))
    return math.ceil(math.log(1 - recall) / math.log(1 - found))


def paths(s: np.ndarray, runs: int, branches: float = BRANCHES) -> np.ndarray:
    """Rows of (two-level path, the same after one more sampled shingle, after two more)."""
    if not len(s):
        return np.zeros((0, 3), np.uint64)
    with np.errstate(over="ignore"):
        limit = np.uint64(min(2**64 - 1, int(branches / len(s) * 2**64)))
        tops = []
        for run in range(runs):
            salt = np.uint64(0x9E3779B97F4A7C15 * (run + 1) % 2**64)
            for first in _below(mix(s ^ salt), limit):
                h = mix(s ^ mix(first + np.uint64(1)))
                tops.append(mix(_below(h, limit) + first))
        top = np.unique(np.concatenate(tops)) if tops else np.zeros(0, np.uint64)
        if not len(top):
            return np.zeros((0, 3), np.uint64)
        out = [top]
        for _ in range(2):
            out.append(mix(out[-1] + mix(s[None, :] ^ mix(out[-1])[:, None]).min(1)))
        return np.stack(out, 1)


def _below(h: np.ndarray, limit: np.uint64) -> np.ndarray:
    return h[h <= limit]


def _sketch(runs: int):  # noqa: ANN202
    def of(texts: list[str | None]) -> tuple[list, list, list, list, list]:
        out = [], [], [], [], []
        for text in texts:
            s = shingles(text)
            p = paths(s, runs).view(np.int64)
            for column, value in zip(out, (hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None, len(s), p[:, 0], p[:, 1], p[:, 2]), strict=True):
                column.append(value)
        return out

    return lambda: of


def _pairs_of_small(rows: DataFrame) -> DataFrame:
    """(a, b) of the sets in each bucket; rows (path, set, size) of small buckets only."""
    lists = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("set", "size"))).alias("x"))
    first = lists.select(F.posexplode("x").alias("k", "a"), "x").select("a", F.explode(F.slice("x", F.col("k") + 2, F.size("x"))).alias("b"))
    return first.filter(F.least("a.size", "b.size") >= THRESHOLD * F.greatest("a.size", "b.size")).select(F.col("a.set").alias("a"), F.col("b.set").alias("b"))


def _wanted_tokens(wanted: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(set, tokens, bits) of the sets in wanted; sets (set, row) names a row of each, docs (text_key, key, text) has the texts: copies of a row's text don't come along."""
    named = materialise(wanted.distinct().join(sets.select("set", "row.text_key", "row.key"), "set"))
    texts = docs.join(small_or_shuffled(named), ["text_key", "key"]).select("set", "text")
    made = materialise(with_made(texts, "text", "tokens binary, bits binary", _tokens_and_bits).drop("text"))
    return made if made.count() == named.count() else materialise(made.dropDuplicates(["set"]))  # only repeated rows make a set twice


def _tokens_and_bits():  # noqa: ANN202
    def of(texts: list[str | None]) -> tuple[list, list]:
        sets = [shingles(t) for t in texts]
        return [s.tobytes() for s in sets], [parities(s).tobytes() for s in sets]

    return of


def parities(s: np.ndarray) -> np.ndarray:
    """Bytes of two to four bits for each shingle of a set: which places an odd number of shingles has."""
    m = max(64, 1 << int(2 * len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((mix(s) % np.uint64(m)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def may_link(x: np.ndarray, n_x: int, y: np.ndarray, n_y: int, threshold: float = THRESHOLD) -> bool:
    """Whether sets of n_x and n_y shingles with these parities may have the threshold. A longer array folds onto a shorter one, as its length is a power of two."""
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= (n_x + n_y) * (1 - threshold) / (1 + threshold) + 1e-6


def _screen(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The pairs whose parities allow the threshold: what false candidates ship is a small part of their sets."""
    held = tokens.select("set", "bits", (F.length("tokens") / 8).cast("long").alias("n"))
    sides = [held.select(*(F.col(c).alias(c + end) for c in held.columns)).withColumnRenamed("set" + end, end) for end in ("a", "b")]
    both = pairs.join(sides[0], "a").join(sides[1], "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in ("bitsa", "na", "bitsb", "nb")), strict=True)
            good = [may_link(np.frombuffer(x, np.uint8), n_x, np.frombuffer(y, np.uint8), n_y) for x, n_x, y, n_y in rows]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return materialise(both.select("a", "b", "bitsa", "na", "bitsb", "nb").mapInArrow(run, "a binary, b binary"))


def _verify(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The pairs whose whole sets have at least the threshold."""
    left, right = (tokens.select(F.col("set").alias(c), F.col("tokens").alias(name)).join(small_or_shuffled(materialise(pairs.select(c).distinct())), c, "left_semi") for c, name in (("a", "left"), ("b", "right")))
    both = small_or_shuffled(pairs).join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for left, right in zip(batch["left"], batch["right"], strict=True):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(shared >= THRESHOLD * (len(x) + len(y) - shared) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return materialise(both.select("a", "b", "left", "right").mapInArrow(run, "a binary, b binary"))


def _linked(tokens: pd.Series) -> np.ndarray:
    """Which sets are linked, as a matrix."""
    tokens = [np.frombuffer(t, np.uint64) for t in tokens]
    n, sizes = len(tokens), np.array([len(t) for t in tokens])
    flat, owner = np.concatenate(tokens), np.repeat(np.arange(n), sizes)
    known, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.zeros((n, n), np.float32)
    often = np.flatnonzero(times > 1)
    column = np.full(len(known), -1)
    column[often] = np.arange(len(often))
    place = column[place]
    for k in range(0, len(often), 4096):
        own = (place >= k) & (place < k + 4096)
        block = np.zeros((n, min(4096, len(often) - k)), np.float32)
        block[owner[own], place[own] - k] = 1
        shared += block @ block.T
    return shared >= THRESHOLD * (sizes[:, None] + sizes[None, :] - shared) - 1e-4


def _degrees(pdf: pd.DataFrame) -> pd.DataFrame:
    """(set, n_near): documents of the sets linked to each; pdf: root, set, n_copies, tokens, own, x, y of whole classes, or of two chunks of one, between which links count."""
    parts = []
    for _, part in pdf.groupby("root"):
        linked, own = _linked(part["tokens"]), part["own"].to_numpy()
        linked &= (own[:, None] != own[None, :]) | (part["x"].iloc[0] == part["y"].iloc[0])
        np.fill_diagonal(linked, False)
        parts.append(pd.DataFrame({"set": part["set"], "n_near": linked @ part["n_copies"].to_numpy(np.int64)}))
    return pd.concat(parts)


def _tree(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the links between the sets of a chunk, those of a spanning forest. With a column "asks", only links of a row that asks to one that doesn't."""
    pdf = pdf.drop_duplicates([c for c in ("set", "asks") if c in pdf.columns])
    sets, linked = pdf["set"].tolist(), _linked(pdf["tokens"])
    n = len(sets)
    same = np.array([{s: i for i, s in enumerate(sets)}[s] for s in sets])
    if "asks" in pdf.columns:
        asks = pdf["asks"].to_numpy(bool)
        linked &= asks[:, None] != asks[None, :]
        linked |= same[:, None] == same[None, :]
    left, right, new = [], [], np.ones(n, bool)
    for start in range(n):
        ring = [start] if new[start] else []
        new[start] = False
        while ring:
            i = ring.pop()
            for j in np.flatnonzero(linked[i] & new):
                new[j] = False
                ring.append(int(j))
                left.append(min(sets[i], sets[j]))
                right.append(max(sets[i], sets[j]))
    return pd.DataFrame({"a": left, "b": right}, dtype=object)


def _links_of_large(large: DataFrame, tokens: DataFrame, good: DataFrame) -> DataFrame:
    """Links that join what the buckets of large (path, set, n) hold, without comparing all their pairs.

    Each bucket is dealt into chunks by hash, and each chunk compared whole; as a set is in several buckets, chunks overlap. What is then
    not in the largest class of its bucket is compared with the whole bucket, in blocks.
    """
    dealt = small_or_shuffled(large).withColumn("chunk", F.pmod(F.xxhash64("path", "set"), F.ceil(F.col("n") / CHUNK))).join(tokens, "set").select("path", "chunk", "set", "tokens")
    first = materialise(dealt.groupBy("path", "chunk").applyInPandas(_tree, "a binary, b binary").distinct())
    roots = components(good.union(first))
    rooted = materialise(large.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set")))
    most = rooted.groupBy("path", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("path").agg(F.max(F.struct("k", "root")).alias("most"), F.sum("k").alias("whole"))
    open_ = rooted.join(most.filter("most.k < whole").select("path", F.col("most.root").alias("main"), F.ceil((F.col("whole") - F.col("most.k")) / CHUNK).alias("n_asking"), F.ceil(F.col("whole") / CHUNK).alias("n_all")), "path")
    deal = lambda n: F.pmod(F.xxhash64("set", "path"), F.col(n))
    asking = open_.filter("root != main").select("path", "set", F.lit(True).alias("asks"), deal("n_asking").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_all") - 1)).alias("y"))
    asked = open_.select("path", "set", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_asking") - 1)).alias("x"), deal("n_all").alias("y"))
    second = small_or_shuffled(materialise(asking.union(asked))).join(tokens, "set").groupBy("path", "x", "y").applyInPandas(_tree, "a binary, b binary").filter("a != b")
    return first.union(materialise(second.distinct()))


def _near(good: DataFrame, roots: DataFrame, copies: DataFrame, tokens: DataFrame) -> DataFrame:
    """(set, n_near): documents of the sets linked to each set of a class.

    A class whose links are all pairs of its sets has no more. Any other is compared whole: one of WHOLE sets or fewer in a task with others, a larger one in pairs of chunks.
    """
    members = materialise(roots.withColumnRenamed("node", "set"))
    held = good.join(members.select(F.col("set").alias("a"), "root"), "a").groupBy("root").agg(F.count(F.lit(1)).alias("n_pairs"))
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n_sets")).join(held, "root")
    open_ = materialise(sizes.filter(2 * F.col("n_pairs") < F.col("n_sets") * (F.col("n_sets") - 1)).select("root", F.ceil(F.col("n_sets") / WHOLE).alias("chunks")))
    found = materialise(members.join(small_or_shuffled(open_), "root", "left"))

    ends = good.union(good.select("b", "a"))
    closed = ends.join(found.filter("chunks is null").select(F.col("set").alias("a")), "a").join(copies.select(F.col("set").alias("b"), "n_copies"), "b")
    near = closed.groupBy(F.col("a").alias("set")).agg(F.sum("n_copies").alias("n_near"))

    some = found.filter("chunks is not null")
    tokens = tokens.join(small_or_shuffled(some.select("set")), "set", "left_semi")
    tasks = max(1, -(-some.count() // WHOLE))
    own = some.withColumn("own", F.pmod(F.xxhash64("set"), F.col("chunks"))).withColumn("task", F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("root"), F.lit(tasks))).otherwise(F.xxhash64("root")))
    dealt = own.join(copies.select("set", "n_copies"), "set").join(tokens, "set").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    dealt = dealt.select("task", "root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "set", "n_copies", "tokens")
    counted = dealt.groupBy("task", "x", "y").applyInPandas(_degrees, "set binary, n_near long").groupBy("set").agg(F.sum("n_near").alias("n_near"))
    return materialise(near.union(counted))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with id_, set and text_key; links (a, b) between different sets, of large buckets a forest; (set, tokens) of the sets compared)."""
    runs = runs_for()
    texts = docs.select(F.col(id_col).cast("long").alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text", F.length("text"))).withColumn("key", F.coalesce("id_", F.lit(-1)))
    made = with_made(texts, "text", "set binary, size long, p1 array<long>, p2 array<long>, p3 array<long>", _sketch(runs)).drop("text")
    rows = materialise(made)
    names = ["p1", "p2", "p3"]
    sets = materialise(rows.filter("set is not null").groupBy("set").agg(F.min(F.struct("text_key", "key")).alias("row"), F.first("size").alias("size"), *(F.first(p).alias(p) for p in names)))
    large = sets.select("set", "size", F.explode(F.arrays_zip(*names)).alias("p")).select("set", "size", *(f"p.{p}" for p in names))
    found = []
    for p in names:  # the shallowest level at which a bucket is small
        counts = large.groupBy(p).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        counts = materialise(counts)
        hot = small_or_shuffled(counts.filter(F.col("n") > HOT))  # a share of 1 / HOT of the rows at most
        cool = large.join(hot, p, "left_anti").join(small_or_shuffled(counts.filter(F.col("n") <= HOT)), p)
        sized = materialise(cool.union(large.join(hot, p).select(cool.columns)).withColumnRenamed(p, "path"))
        found.append(_pairs_of_small(sized.filter(F.col("n") <= SMALL)))
        large = sized.filter(F.col("n") > SMALL).drop("n", "path") if p != names[-1] else sized.filter(F.col("n") > SMALL).select("path", "set", "n")
    pairs = materialise(found[0].union(found[1]).union(found[2]).distinct())
    tokens = _wanted_tokens(pairs.select(F.col("a").alias("set")).union(pairs.select("b")).union(large.select("set")), sets, texts.select("text_key", "key", "text"))
    good = _verify(_screen(pairs, tokens), tokens)
    if not large.isEmpty():
        good = materialise(good.union(_links_of_large(large, tokens, good)).distinct())
    return rows.select("id_", "set"), good, tokens


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counted: bool = True) -> DataFrame:
    """One row per document: id, class_id (the least id of its class), n_links, n_copies. Where links needn't be counted, n_links has only copies."""
    members, good, tokens = links(docs, id_col, text_col)
    roots = components(good)
    copies = members.groupBy("set").agg(F.count(F.lit(1)).alias("n_copies"), F.min("id_").alias("least_id"))
    degree = _near(good, roots, copies, tokens) if counted else members.select("set", F.lit(None).cast("long").alias("n_near")).limit(0)
    known = materialise(copies.filter("set is not null").join(roots.withColumnRenamed("node", "set"), "set", "left").join(degree, "set", "left").withColumn("root", F.coalesce("root", "set")))
    classes = known.groupBy("root").agg(F.min("least_id").alias("class_id"))
    per_set = materialise(known.join(classes, "root").select("set", "class_id", (F.col("n_copies") - 1 + F.coalesce("n_near", F.lit(0))).alias("n_links"), "n_copies"))
    out = members.join(small_or_shuffled(per_set, 200_000), "set", "left")
    alone = F.col("set").isNull()
    return out.select(
        F.col("id_").alias(id_col), F.when(alone, F.col("id_")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without all but one row of each class, with all their columns: the one with the least id, if ids are unique and known."""
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("d")).first()
    if ids["n"] == ids["d"]:
        out, key = docs, id_col
    else:
        key = fresh(docs.columns, "row_")
        out = materialise(docs.withColumn(key, F.monotonically_increasing_id()))
    found = join(out, key, text_col, counted=False)
    losers = materialise(found.filter(F.col(key) != F.col("class_id")).select(key))
    return out.join(small_or_shuffled(losers), key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
