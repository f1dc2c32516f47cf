"""BPE encoding with a priority queue of merge ranks over a doubly linked symbol list, and decoding.

A text is cut at special tokens, normalised (NFC, lower case) and split into words. A word always gives the
same ids, so its result is kept in a bounded table and only unseen words are merged: the queue holds rank and
place of adjacent pairs, and an entry whose pair has changed since is skipped; short words need no queue. Decoding joins the vocabulary's
strings.

Defined results: null and empty texts give no ids and an empty decoded text; repeated rows encode alike;
an empty table gives no rows; extra columns are ignored; ids pass through as they are, nulls too.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from functools import lru_cache
from itertools import pairwise

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgraph.llm.common import held, with_made

#: Words in a generation of what a Python worker keeps.
KEPT_WORDS = 200_000
#: Symbols up to which a word is merged without a queue.
SHORT = 40
#: Characters of the longest word whose result is kept.
LONGEST = 64

# White space as the tokenizer's word pattern counts it; of Latin-1, white space, letters and numbers.
_WHITE = r"\t-\r\x20\x85\xa0  -     　"
_WHITE_LATIN = r"\t-\r\x20\x85\xa0"
_LETTERS_LATIN = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBERS_LATIN = r"0-9\xb2\xb3\xb9\xbc-\xbe"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Encoder:
    """Words and ids of texts, from a tokenizer file of the word-end kind."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocabulary: dict[str, int] = model["vocab"]
        end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in vocabulary.items()} | {i: s for s, i in self.special.items()}
        alphabet = byte_alphabet()
        self.inner, self.last = [vocabulary[c] for c in alphabet], [vocabulary[c + end] for c in alphabet]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(vocabulary[left], vocabulary[right]): n for n, (left, right) in enumerate(pairs)}
        self.joined = [vocabulary[left + right] for left, right in pairs]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(pattern.replace(r"\s", _WHITE)).findall
        #: The same for texts within Latin-1, by the standard library's faster engine.
        self.find_latin = re.compile(pattern.replace(r"\s", _WHITE_LATIN).replace(r"\p{L}", _LETTERS_LATIN).replace(r"\p{N}", _NUMBERS_LATIN)).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.marks = tuple(self.special)

    def words(self, text: str | None) -> list[str]:
        """The normalised words in order; special tokens stand as they are."""
        if not text:
            return []
        if any(m in text for m in self.marks):
            return [w for piece in self.cut(text) for w in ([piece] if piece in self.special else self._words(piece))]
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.find(text)
            return self.find_latin(text)
        return self.find_latin(text.lower())

    def merge(self, word: str) -> list[int]:
        """Ids of one word. The least rank, then the leftmost, is merged first; the queue of a long word holds rank and place of mergeable neighbours in one number."""
        if word in self.special:
            return [self.special[word]]
        ids = self._symbols(word)
        return self._merge_short(ids) if len(ids) <= SHORT else self._merge_queued(ids)

    def _symbols(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        return ids

    def _merge_short(self, ids: list[int]) -> list[int]:
        """The same merges for few symbols, whose ranks are looked over each time: the queue's upkeep costs more than that."""
        rank_of, joined, none = self.ranks.get, self.joined, len(self.joined)
        ranks = [rank_of(pair, none) for pair in pairwise(ids)]
        while ranks and (rank := min(ranks)) < none:
            k = ranks.index(rank)
            ids[k] = new = joined[rank]
            del ids[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = rank_of((new, ids[k + 1]), none)
            if k:
                ranks[k - 1] = rank_of((ids[k - 1], new), none)
        return ids

    def _merge_queued(self, ids: list[int]) -> list[int]:
        n, rank_of = len(ids), self.ranks.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [rank * n + k for k in range(n - 1) if (rank := rank_of((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            rank, k = divmod(heapq.heappop(queue), n)
            j = after[k]
            if j < 0 or ids[k] < 0 or rank_of((ids[k], ids[j])) != rank:
                continue  # stale: one of the two has been merged since
            ids[k], ids[j] = self.joined[rank], -1
            after[k] = m = after[j]
            if m >= 0:
                before[m] = k
                if (new := rank_of((ids[k], ids[m]))) is not None:
                    heapq.heappush(queue, new * n + k)
            h = before[k]
            if h >= 0 and (new := rank_of((ids[h], ids[k]))) is not None:
                heapq.heappush(queue, new * n + h)
        return [i for i in ids if i >= 0]

    def encode(self, text: str | None) -> list[int]:
        return [i for word in self.words(text) for i in self.merge(word)]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids])


class Kept(dict):
    """Results by key, made on first use. Two generations of at most `most` entries: what is asked for again outlives a full table.

    Keys longer than LONGEST are made each time, so that texts without white space can't fill the table.
    """

    def __init__(self, make, most: int = KEPT_WORDS) -> None:  # noqa: ANN001
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str):  # noqa: ANN204
        if len(key) > LONGEST:
            return self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


def _kept(path: str) -> Kept:
    """One for each worker process and tokenizer file: word -> (ids as text, decoded text, count)."""
    encoder = encoder_of(path)

    def make(word: str) -> tuple[str, str, int]:
        ids = encoder.merge(word)
        return " ".join(map(str, ids)), encoder.decode(ids), len(ids)

    return held(("ids", path), lambda: Kept(make))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def packed_ids(path: str) -> Kept:
    """word -> its ids as little-endian unsigned 32-bit numbers."""
    encoder = encoder_of(path)
    return held(("packed ids", path), lambda: Kept(lambda word: _packed(encoder.merge(word))))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: id (of any type, as it is), n_tokens, ids_sha256, decoded_sha256; with_ids adds ids and decoded."""
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def make():  # noqa: ANN202
        get, words = _kept(path).__getitem__, encoder_of(path).words
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

        def of(texts: list) -> list[list]:
            out: list[list] = [[] for _ in range(5 if with_ids else 3)]
            for text in texts:
                parts = list(map(get, words(text)))
                ids, decoded = " ".join([p[0] for p in parts]), " ".join([p[1] for p in parts])
                row = (sum([p[2] for p in parts]), sha(ids), sha(decoded), *(([int(i) for i in ids.split()], decoded) if with_ids else ()))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return of

    return with_made(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", schema, make, keep=False).withColumnRenamed("id", id_col)
