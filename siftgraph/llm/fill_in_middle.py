"""Fill-in-the-middle transformation over an index of distinct texts.

Texts are cut into n tokens, a word with the white space before it or trailing white space, and each document's seed says after how many of them its prefix and
middle end. Where tokens end depends on the text alone, so identical texts share one entry of an index: texts are grouped by digest and, within a
digest, by their whole content. Documents, of which only ids and digests travel, join the entry whose content is theirs. A task meets an entry with all its
documents in a row: the ends of its tokens become an Elias-Fano list, some five bits for each token, once, and for each document the two ends that its seed
asks for are selected from the list and the text is cut there. Texts shuffle once, and copies within a task only as one.
A digest of more than SPLIT documents is dealt over parts, each with an entry of its own, so that no task gets a hot text's documents.

Defined results: null and empty texts have no tokens and stay plain; a null id has the seed of an empty number; repeated rows give equal rows; a text
of any length is cut whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgraph.llm.common import materialise, small_or_shuffled

#: Documents of one digest beyond which they are dealt over parts.
SPLIT = 4096

# The marks, and the shares of documents that are transformed and of those that put the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TRANSFORMED, SUFFIX_FIRST = 50, 80


def token_ends(text: str) -> np.ndarray:
    """Code points up to the end of each token of `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return np.zeros(0, np.int64)
    space = (points == 0x20) | (points >= 9) & (points <= 13)
    return np.append(np.flatnonzero(~space[:-1] & space[1:]) + 1, len(points))


_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1)


class EliasFano:
    """A rising list of numbers: their low bits side by side, and their high bits as gaps in unary.

    Stored as count, low bits a number, then both bit strings. select(k) finds the k-th number without decoding the list.
    """

    def __init__(self, data: bytes) -> None:
        self.n, self.low_bits = int.from_bytes(data[:8], "little"), data[8]
        size = (self.n * self.low_bits + 7) // 8
        self.low, self.high = np.frombuffer(data, np.uint8, size, 9), np.frombuffer(data, np.uint8, offset=9 + size)
        self.before = np.cumsum(_ONES[self.high])

    @staticmethod
    def pack(numbers: np.ndarray) -> bytes:
        n = len(numbers)
        low_bits = max(0, (int(numbers[-1]) // n).bit_length() - 1) if n else 0
        low = (numbers[:, None] >> np.arange(low_bits)[None, :]) & 1
        high = np.zeros((int(numbers[-1]) >> low_bits) + n if n else 0, np.uint8)
        high[(numbers >> low_bits) + np.arange(n)] = 1
        return n.to_bytes(8, "little") + bytes([low_bits]) + np.packbits(low.astype(np.uint8).ravel()).tobytes() + np.packbits(high).tobytes()

    def select(self, k: int) -> int:
        """The k-th number, from 0."""
        byte = int(np.searchsorted(self.before, k, "right"))
        rank = k - (int(self.before[byte - 1]) if byte else 0)
        place = 8 * byte + int(np.flatnonzero(np.unpackbits(self.high[byte : byte + 1]))[rank])
        first, last = k * self.low_bits, (k + 1) * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : (last + 7) // 8])[first % 8 : first % 8 + self.low_bits]
        return ((place - k) << self.low_bits) + int(bits @ (1 << np.arange(self.low_bits)))


def seeded(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def cut(text: str, ends: EliasFano, doc_id: int | None, seed: int) -> tuple[str, str, int | None, int | None]:
    """form, output, and the code points of prefix and middle."""
    h1, h2, h3, h4 = seeded(doc_id, seed)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= TRANSFORMED:
        return "plain", text, None, None
    first, second = sorted((h1 % (ends.n + 1), h2 % (ends.n + 1)))
    a, b = (ends.select(k - 1) if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", a, b - a
    return "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", a, b - a


def restored(output: str, form: str) -> str:
    """The text that an output was made from. No part holds a mark, and a mark can't begin within another."""
    if form == "plain":
        return output
    one, two = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    left, _, rest = output[len(one) :].partition(two)
    right, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (right, left) if form == "spm" else (left, right)
    return prefix + middle + suffix


def _transformed(seed: int, texts: bool):  # noqa: ANN202
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *(["output"] if texts else [])]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * (3 if texts else 2)]
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, text, content, ends = None, "", "", None
        for batch in batches:
            rows, entry = [], batch.column("text")
            for k, (doc_id, wanted) in enumerate(zip(batch.column("id").to_pylist(), batch.column("content").to_pylist(), strict=True)):
                if of is None or not entry[k].equals(of):  # an entry begins: its list is made once
                    of = entry[k]
                    text = of.as_py()
                    content, ends = sha(text), EliasFano(EliasFano.pack(token_ends(text)))
                if content != wanted:  # another text of the same digest
                    continue
                form, output, prefix, middle = cut(text, ends, doc_id, seed)
                digest = sha(output)
                row = (doc_id, ends.n, form, prefix, middle, digest, digest if form == "plain" else sha(restored(output, form)))
                rows.append((*row, output) if texts else row)
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    return run


def distinct_texts(keyed: DataFrame) -> DataFrame:
    """(digest, part, text): an entry for each distinct text of keyed (digest, part, text). Texts that only share a digest have entries of their own."""
    whole = keyed.groupBy("digest", "part").agg(F.collect_set("text").alias("texts"))  # one text, unless digests collide
    return whole.select("digest", "part", F.explode("texts").alias("text"))


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, digest: Callable[[Column], Column] = F.xxhash64, split: int = SPLIT, texts: bool = False
) -> DataFrame:
    """One row per document: id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256; texts adds output."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("digest", digest(F.col("text")).cast("long"))
    counted = named.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > split)
    hot = small_or_shuffled(materialise(counted.select("digest", F.ceil(F.col("n") / split).cast("int").alias("parts"))))
    of_hot = named.join(hot, "digest").groupBy("digest", "parts").agg(F.collect_set("text").alias("texts"))  # in part before any shuffle
    dealt = of_hot.select("digest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "texts").select("digest", "part", F.explode("texts").alias("text"))
    index = distinct_texts(named.join(hot, "digest", "left_anti").select("digest", F.lit(0).alias("part"), "text").union(dealt))
    place = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.coalesce("parts", F.lit(1))).cast("int")  # every part has every text of its digest, so any will do
    asked = named.join(hot, "digest", "left").select("id", "digest", place.alias("part"), F.sha2(F.col("text").cast("binary"), 256).alias("content"))
    # By what the index is dealt by already; contents are compared in the task, where an entry meets all its documents in a row.
    joined = index.join(asked.hint("merge"), ["digest", "part"]).select("id", "content", "text")
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * texts
    return joined.mapInArrow(_transformed(seed, texts), schema).withColumnRenamed("doc_id", id_col)
