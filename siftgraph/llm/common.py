"""Helpers that the corpus operators share: tables, shared storage and vectorised word hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows whose values a task holds as Python objects at once.
AT_ONCE = 1_000
#: Rows of two or three numbers up to which a side may be broadcast (some 32 MB); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000

_WRITTEN: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file lies; every machine has the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees; a local one only where the session names none and all runs in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage is cut and nothing is computed twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(_clean, spark)
    _WRITTEN.setdefault("paths", []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def _clean(spark: SparkSession) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _WRITTEN.pop("paths", []):
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone by then
        return


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, with a broadcast hint if it has been counted to be small. df should be materialised."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_made(df: DataFrame, column: str, schema: str, make: Callable[[], Callable[[list], Iterable[list]]], keep: bool = True) -> DataFrame:
    """df with further columns, made batch by batch from the values of one; all others pass through as they are, that one too unless keep is false.

    make() gives, once for each task, a function from a batch's values to the new columns' values.
    """
    own = [f for f in df.schema.fields if keep or f.name != column]
    added = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    kinds = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _ASKED.clear()
        f = make()
        if not _ASKED:
            _HELD.clear()
        for batch in (whole.slice(k, AT_ONCE) for whole in batches for k in range(0, max(1, whole.num_rows), AT_ONCE)):
            made = f(batch.column(column).to_pylist())
            kept = [batch.column(f.name) for f in own]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, k) for x, k in zip(made, kinds, strict=True))], [*(f.name for f in own), *added.names])

    return df.mapInArrow(run, T.StructType([*own, *added.fields]))


_HELD: dict[tuple, object] = {}
_ASKED: set[tuple] = set()


def held(key: tuple, make: Callable[[], object]) -> object:
    """What make() gives, kept for the worker process until another key is asked for, or a task of with_made asks for none: a worker that goes on to another operator doesn't keep the table of the last."""
    _ASKED.add(key)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def fresh(columns: list[str], name: str) -> str:
    """name, with as many underscores as it takes to be no column's."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Word hashing ---------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_DEPTH = 64
_TABLE = np.random.default_rng(20240501).integers(1, 2**64, size=(_DEPTH, 256), dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit words."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of UTF-8 data in order, and the byte each starts at. A-Z fold to a-z; words end at [\\x20\\x09-\\x0D].

    Tabulation hashing by position: a word's hash is the sum of one random number for each (position, byte), stepped every 64 bytes.
    """
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[raw]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    at = np.flatnonzero(inside)
    letters = _LOWER[raw[at]]
    firsts = np.searchsorted(at, starts)
    lengths = np.diff(np.append(firsts, len(at)))
    place = np.arange(len(at)) - np.repeat(firsts, lengths)
    if lengths.max() <= _DEPTH:
        terms = _TABLE[place, letters]
    else:
        terms = _TABLE[place % _DEPTH, letters] * (_STEP * (2 * (place // _DEPTH).astype(np.uint64) + np.uint64(1)))
        short = place < _DEPTH
        terms[short] = _TABLE[place[short], letters[short]]
    return mix(np.add.reduceat(terms, firsts) + lengths.astype(np.uint64)), starts


# Shingles -------------------------------------------------------------------------------------

#: Words of a shingle.
SHINGLE = 5


def shingles(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the text's runs of `words` words; a shorter text with words is one shingle of them all."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass"))[0]
    if not len(h):
        return h
    n = min(words, len(h))
    with np.errstate(over="ignore"):
        made = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            made = mix(made) + h[k : len(h) - n + 1 + k]
        return np.unique(mix(made))


# Connected components -------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b); root is the least node of its component. Large-star and small-star, until nothing changes."""
    from pyspark.sql import functions as F

    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    before, after = None, state(now)
    while before != after:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = materialise(both.join(least, "u").filter("v > u and m < v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct())
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").filter("a != m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select("m", "b")).distinct()
        now = materialise(small)
        before, after = after, state(now)
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", "a").distinct())
