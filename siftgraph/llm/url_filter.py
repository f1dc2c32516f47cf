"""URL filters over a sorted digest array: 64-bit xxhash keys in a memory-mapped file.

An entry is a host and a path prefix; it fits the host, its subdomains and every path that starts so. The
keys of host + path strings are sorted; all candidate strings of a batch of URLs (each host suffix with each
prefix length that occurs) are probed by one vectorised binary search, and a hit counts only if the
stored full string is the same, so colliding digests do no harm. The file goes to each machine once.

A list of more than MOST_ENTRIES entries isn't sent to every machine: candidates and entries then meet in a
shuffled join on the digest, confirmed by the full string.

Defined results: a null URL or one without "://" has empty host and path and fits nothing; the longest entry
wins, then the longest host; of equal entries the one that blocks; an empty table gives no rows; repeated rows are judged alike;
extra columns are ignored; ids pass through as they are, nulls too.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftgraph.llm.common import materialise

#: Entries up to which the array is sent to every machine (some 300 MB of short strings).
MOST_ENTRIES = 5_000_000

# The rules that come first, and the hosts that the method's own list blocks.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
SPAM_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
BLOCKED = [(f"{name}.example.{top}", "/", "block") for name in SPAM_NAMES for top in ("com", "net", "org")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def digests(strings: Iterable[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) for s in strings), np.uint64)


class DigestArray:
    """Entries (host, path, verdict) in a file: count, sorted digests, places of the strings, verdicts, strings."""

    def __init__(self, path: str) -> None:
        n, most = (int(x) for x in np.fromfile(path, np.uint64, 2))
        self.keys = np.memmap(path, np.uint64, "r", 16, (n,)) if n else np.zeros(0, np.uint64)
        self.ends = np.memmap(path, np.uint64, "r", 16 + 8 * n, (n + 1,))
        self.host_chars = np.memmap(path, np.uint32, "r", 24 + 16 * n, (n,)) if n else np.zeros(0, np.uint32)
        self.blocks = np.memmap(path, np.uint8, "r", 24 + 20 * n, (n,)) if n else np.zeros(0, np.uint8)
        at = 24 + 21 * n
        self.lengths = np.fromfile(path, np.uint32, most, offset=at).tolist()
        self.text = np.memmap(path, np.uint8, "r", at + 4 * most) if n else np.zeros(0, np.uint8)

    @staticmethod
    def write(path: str, entries: Iterable[tuple[str, str, str]]) -> None:
        best: dict[tuple[str, str], bool] = {}
        for host, prefix, verdict in entries:
            best[host, prefix] = best.get((host, prefix), False) or verdict == "block"
        items = [(host + "\0" + prefix, len(host), block) for (host, prefix), block in best.items()]
        keys = digests(x[0] for x in items)
        order = np.argsort(keys, kind="stable")
        texts = [items[k][0].encode("utf-8", "surrogatepass") for k in order]
        lengths = np.array(sorted({len(prefix) for _, prefix in best}), np.uint32)
        with open(path, "wb") as f:
            f.write(np.array([len(items), len(lengths)], np.uint64).tobytes() + keys[order].tobytes())
            f.write(np.cumsum([0, *map(len, texts)]).astype(np.uint64).tobytes())
            f.write(np.array([items[k][1] for k in order], np.uint32).tobytes() + np.array([items[k][2] for k in order], np.uint8).tobytes())
            f.write(lengths.tobytes() + b"".join(texts))

    def find(self, strings: list[str]) -> np.ndarray:
        """The place of each string in the array, or -1."""
        wanted = digests(strings)
        low = np.searchsorted(self.keys, wanted, "left")
        high = np.searchsorted(self.keys, wanted, "right")
        found = np.full(len(strings), -1, np.int64)
        for i in np.flatnonzero(high > low):
            raw = strings[i].encode("utf-8", "surrogatepass")
            for k in range(low[i], high[i]):  # all that share the digest
                if self.text[int(self.ends[k]) : int(self.ends[k + 1])].tobytes() == raw:
                    found[i] = k
                    break
        return found

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
        """For each URL the entry that fits best, as host + path, and its verdict."""
        owners, strings = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            for s in candidates(host, path, self.lengths):
                owners.append(i)
                strings.append(s)
        best: dict[int, tuple[int, int, int]] = {}
        places = self.find(strings)
        for at in np.flatnonzero(places >= 0):
            k = int(places[at])
            rank = len(strings[at]), int(self.host_chars[k]), k
            best[owners[at]] = max(best.get(owners[at], rank), rank)
        text = lambda k: self.text[int(self.ends[k]) : int(self.ends[k + 1])].tobytes().decode("utf-8", "surrogatepass").replace("\0", "", 1)
        rule = [text(best[i][2]) if i in best else None for i in range(len(hosts))]
        return rule, [("block" if self.blocks[best[i][2]] else "allow") if i in best else None for i in range(len(hosts))]


def candidates(host: str, path: str, lengths: list[int]) -> Iterator[str]:
    """Every host suffix at a label's start with every path prefix of the given lengths."""
    if host:
        labels = host.split(".")
        for k in range(len(labels)):
            suffix = ".".join(labels[k:])
            for n in lengths:
                if n <= len(path):
                    yield suffix + "\0" + path[:n]


@lru_cache(maxsize=16)
def _opened(path: str) -> DigestArray:
    return DigestArray(path)


def _shipped(docs: DataFrame, entries: Iterable[tuple[str, str, str]]) -> str:
    """Writes the array beside the driver and has Spark bring it to every machine; the name to ask SparkFiles for."""
    name = f"digests-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(), name)
    DigestArray.write(path, entries)
    docs.sparkSession.sparkContext.addFile(path)
    return name


def match(urls: DataFrame, entries: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """urls (key, host_, path_) with rule and verdict of the best fitting entry (host, path, verdict), or nulls."""
    n = entries.limit(most + 1).count()
    if n > most:
        return _match_by_join(urls, entries)
    name = _shipped(urls, [tuple(r) for r in entries.select("host", "path", "verdict").toLocalIterator()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = _opened(SparkFiles.get(name))
        for batch in batches:
            made = array.judge(batch.column("host_").to_pylist(), batch.column("path_").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.string()) for x in made)], [*batch.schema.names, "rule_", "verdict_"])

    return urls.mapInArrow(run, T.StructType([*urls.schema.fields, T.StructField("rule_", T.StringType()), T.StructField("verdict_", T.StringType())]))


def _match_by_join(urls: DataFrame, entries: DataFrame) -> DataFrame:
    """The same for a list of any size: candidates meet entries in a shuffled join on the digest and the strings."""
    numbered = materialise(urls.withColumn("nth_", F.monotonically_increasing_id()))  # written, so that both uses have the same numbers
    lengths = [r[0] for r in entries.select(F.length("path")).distinct().collect()]  # as many as there are path lengths
    labels = F.split("host_", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.filter(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.when(n <= F.length("path_"), F.substring("path_", F.lit(1), n))), lambda p: p.isNotNull())
    wanted = (
        numbered.filter("host_ != ''").select("nth_", F.explode(suffixes).alias("host"), "path_").select("nth_", "host", F.explode(prefixes).alias("path"))
        .withColumn("key", F.xxhash64("host", "path"))
    )
    stored = entries.groupBy("host", "path").agg(F.max("verdict").alias("verdict_")).withColumn("key", F.xxhash64("host", "path"))
    rank = F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), F.concat("host", "path").alias("rule"), F.col("verdict_").alias("verdict"))
    best = wanted.join(stored, ["key", "host", "path"]).groupBy("nth_").agg(F.max(rank).alias("best"))
    return numbered.join(best, "nth_", "left").select(*(F.col(f"`{c}`") for c in urls.columns), F.col("best.rule").alias("rule_"), F.col("best.verdict").alias("verdict_"))


def judge(pages: DataFrame, rules: DataFrame, blocked: DataFrame, id_col: str = "page_id", url_col: str = "url", most: int = MOST_ENTRIES) -> DataFrame:
    """One row per page: id, host, path, rule, verdict: the rule's, else block if the list has the host, else allow."""
    host, path = host_and_path(F.coalesce(F.col(url_col), F.lit("")))
    urls = pages.select(F.col(id_col).alias("id_"), host.alias("host_"), path.alias("path_"))
    ruled = match(urls, rules, most).withColumnsRenamed({"rule_": "rule", "verdict_": "ruled"})
    return match(ruled.withColumn("whole_", F.col("path_")).withColumn("path_", F.lit("/")), blocked, most).select(
        F.col("id_").alias(id_col), F.col("host_").alias("host"), F.col("whole_").alias("path"), "rule", F.coalesce("ruled", "verdict_", F.lit("allow")).alias("verdict")
    )


def entries_of(pages: DataFrame, rows: list[tuple[str, str, str]]) -> DataFrame:
    return pages.sparkSession.createDataFrame(rows, "host string, path string, verdict string")
