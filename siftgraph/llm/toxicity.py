"""Toxicity by noisy-channel deobfuscation: words are restored first, then scored.

A word that holds leetspeak, inner separators or stretched letters, and a run of spaced single letters, is a
noisy reading of ordinary text. Each of its symbols opens a column of a character lattice (the letters it
may stand for, or nothing), with channel costs; Viterbi decoding under a character n-gram model picks the
restored text. Plain and restored words are then scored by features of the word: itself and its prefixes.
A feature's weight is its precision among labelled documents; a document's score is the noisy-or of its words.

The classifier and the character model are fitted on every labelled row that isn't held out; near copies share one vote
there. Every document is scored, over its whole text.

Defined results: null and empty texts get the score of a document without toxic words; repeated rows score
alike; a null id is never held out; without usable labels every score is 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgraph.llm.bpe import Kept
from siftgraph.llm.common import fresh, held, materialise, mix, small_or_shuffled, with_made, word_hashes

THRESHOLD = 0.3
#: Noisy pieces whose score a worker keeps, in each of two generations, and costs of characters.
KEPT_PIECES, KEPT_COSTS = 50_000, 200_000
#: The vote of a row in whole numbers, whose sums don't depend on their order; near copies share it.
VOTE = 1 << 20
#: Features that a task counts before it hands them on.
MOST_COUNTED = 300_000
#: Least precision of a feature that counts, and documents' worth of the prior on it, which is the share of toxic rows.
LEAST_PRECISION, PRIOR = 0.85, 1.5
#: Characters of the model's n-grams.
ORDER = 5
PREFIXES = range(4, 8)

# What a symbol may stand for in leetspeak, and separators inside a word.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = ".-_*~'`^/\\,:;=#%&·•"
ENDS = SEPARATORS + "\"()[]{}<>?«»“”"
#: Nats: a symbol for a letter, a separator dropped, a repeated letter folded, and a symbol dropped.
COST_LEET, COST_SEPARATOR, COST_FOLD, COST_DROP = 0.7, 0.3, 0.4, 8.0

_WORDS = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<!\S)(?:\S{1,2}\s{1,3}){2,}\S{1,2}(?!\S)")
_SYMBOLS = "0123456789@$!|+(€£¡"
_REPEATED = re.compile(r"(.)\1", re.S)
_STRETCHED, _PARTED = re.compile(r"([^\W\d_])\1\1"), re.compile(r"[^\W_][^\w\s]+[^\W_]")
_FIRM, _LETTER, _SYMBOL = re.compile(r"[^\W_]"), re.compile(r"[^\W\d_]"), re.compile("[" + re.escape(_SYMBOLS) + "]")


class CharacterModel:
    """A character model of order ORDER with interpolated backoff; \\x02 begins a word, \\x03 ends it."""

    def __init__(self, counts: dict[str, float]) -> None:
        self.counts = counts
        contexts: defaultdict[str, float] = defaultdict(float)
        for gram, n in counts.items():
            contexts[gram[:-1]] += n
        self.contexts, self.letters = contexts, 1 + sum(len(g) == 1 for g in counts)
        self.known: dict[str, float] = {}

    def cost(self, before: str, c: str) -> float:
        """-log p(c | the characters before)."""
        gram = before + c
        found = self.known.get(gram)
        if found is None:
            if len(self.known) > KEPT_COSTS:
                self.known.clear()
            p = 1 / self.letters
            for n in range(len(gram)):
                part = gram[len(gram) - 1 - n :]
                p = (self.counts.get(part, 0) + 3 * p) / (self.contexts.get(part[:-1], 0) + 3)
            found = self.known[gram] = -math.log(p)
        return found


def columns(word: str) -> list[list[tuple[str, float]]]:
    """The lattice: for each run of equal symbols the texts that it may stand for, with their costs."""
    out = []
    for m in re.finditer(r"(.)\1*", word, re.S):
        c, n = m[1], len(m[0])
        if c.isspace():
            out.append([("", 0.1 if n == 1 else 0.5), (" ", 4.0)])
        elif c.isalpha():
            options = [(c, COST_FOLD if n > 1 else 0.0)]
            if n > 1:
                options.append((c + c, 0.0 if n == 2 else COST_FOLD))
            out.append(options)
        elif c in LEET:
            options = [(x, COST_LEET) for x in LEET[c]]
            if n > 1:
                options += [(x + x, COST_LEET) for x in LEET[c]]
            out.append([*options, ("", COST_DROP)])
        else:
            out.append([("", COST_SEPARATOR if c in SEPARATORS else COST_DROP), (" ", 4.0)])
    return out


def decode(word: str, model: CharacterModel) -> str:
    """The likeliest text behind word: Viterbi over the lattice; a state is the last ORDER - 1 characters. Linear in the word: texts are chains of (what is before, letters)."""
    beam: dict[str, tuple[float, tuple]] = {"\2": (0.0, ())}
    for options in columns(word):
        new: dict[str, tuple[float, tuple]] = {}
        for state, (cost, before) in beam.items():
            for letters, extra in options:
                total, last = cost + extra, state
                if letters == " ":
                    if last == "\2":
                        continue
                    total += model.cost(last, "\3")
                    last = "\2"
                else:
                    for c in letters:
                        total += model.cost(last, c)
                        last = (last + c)[1 - ORDER :]
                if last not in new or total < new[last][0]:
                    new[last] = total, (before, letters) if letters else before
        beam = new or beam
    _, chain = min(((cost + model.cost(state, "\3") * (state != "\2"), state, chain) for state, (cost, chain) in beam.items()), default=(0.0, "", ()))[::2]
    text = []
    while chain:
        chain, letters = chain
        text.append(letters)
    return "".join(reversed(text))


def noisy(form: str) -> bool:
    """Whether a piece may be a noisy reading: a stretched letter, a symbol for a letter inside it or before or after letters, or a separator between letters."""
    if _STRETCHED.search(form) or "_" in form or _PARTED.search(form):
        return True
    firm = [m.start() for m in (_FIRM.search(form), _FIRM.search(form[::-1])) if m]  # from both ends, the first letter or digit
    if not firm:
        return False
    inside = form[firm[0] + 1 : len(form) - firm[1] - 1]
    return bool(_SYMBOL.search(inside)) or form[0] in _SYMBOLS and bool(_LETTER.search(form)) or form[-1] in "0123456789@$!|" and bool(_LETTER.search(form.rstrip("0123456789@$!|")[-1:]))


def forms(piece: str) -> set[str]:
    """What of a piece in lower case is to be restored: nothing unless it is noisy; pieces of any length."""
    if (piece.isalpha() or piece.isdigit()) and not _STRETCHED.search(piece):
        return set()
    core = piece.strip(ENDS)
    return {form for form in {core, core.rstrip("!$@+|(")} if form and not (form.isalpha() and not _STRETCHED.search(form)) and noisy(form)}


def restored(piece: str, model: CharacterModel) -> list[str]:
    """The words of a piece in lower case that are only seen once it is restored."""
    known, found = set(_WORDS.findall(piece)), []
    for form in sorted(forms(piece)):
        new = [w for w in decode(form, model).split() if w not in known]
        known.update(new)
        found += new
    return found


def features(word: str) -> Iterable[str]:
    if len(word) > 2:
        yield word + "$"
        for n in PREFIXES:
            if n <= len(word):
                yield word[:n]


class Scorer:
    def __init__(self, weights: dict[str, float], grams: dict[str, float], none: float) -> None:
        self.none = none
        self.heads = {f[:4].rstrip("$") for f in weights}  # a word has a feature only if it begins like one
        self.model = CharacterModel(grams) if grams else None
        self.told = Kept(lambda w: min([weights.get(f, 0.0) for f in features(w)], default=0.0), KEPT_PIECES)
        self.kept = Kept(lambda piece: self.words(restored(piece, self.model)), KEPT_PIECES)
        self.runs = Kept(self.run, KEPT_PIECES)

    def words(self, words: Iterable[str]) -> float:
        """log of the chance that none of the words makes the text toxic."""
        told, heads = self.told, self.heads
        return sum([told[w] for w in words if w[:4] in heads])

    def run(self, run: str) -> float:
        """The same for a run of spaced letters in lower case. One of single letters is read as a cut of them all, which has no feature if nothing in them begins like one."""
        letters = "".join(run.split())
        if letters.isalpha() and not _REPEATED.search(letters) and not any(letters[i : i + n] in self.heads for i in range(len(letters) - 2) for n in (3, 4)):
            return 0.0
        return self.words(decode(run, self.model).split())

    def score(self, text: str | None) -> float:
        total = self.none
        if text:
            low = text.lower()
            total += self.words(_WORDS.findall(low))
            if self.model is not None:
                kept, stretched = self.kept, _STRETCHED.search if _STRETCHED.search(low) else None
                total += sum([kept[p] for p in low.split() if not p.isalpha() and not p.strip(ENDS).isalpha() or stretched and stretched(p)])
                total += sum([self.runs[r] for r in map(str.lower, _SPACED.findall(text))])
        return 1 - math.exp(total)


def remainder(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, y, vote) of every labelled row to learn from; rows of a class whose smallest hash of five words is the same share one vote."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").filter(remainder(F.col("id")) != 2).groupBy("id").agg(F.max("y").alias("y"))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(remainder(F.col("id")) != 2).join(small_or_shuffled(materialise(usable)), "id").select("text", "y")

    def signature(text: str | None) -> int:
        h = word_hashes((text or "").encode("utf-8", "surrogatepass"))[0]
        if not len(h):
            return 0
        n = min(5, len(h))
        with np.errstate(over="ignore"):
            made = sum(h[k : len(h) - n + 1 + k] * np.uint64(3 + 2 * k) for k in range(n))
            return int(mix(made).min().view(np.int64))

    rows = materialise(with_made(own, "text", "sig long", lambda: lambda texts: [[signature(t) for t in texts]]))
    alike = materialise(rows.groupBy("sig", "y").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    vote = F.greatest(F.lit(1), F.round(F.lit(VOTE) / F.coalesce("n", F.lit(1)))).cast("long")
    return rows.join(small_or_shuffled(alike), ["sig", "y"], "left").select("text", "y", vote.alias("vote"))


def _counts(rows: DataFrame) -> DataFrame:
    """(feature, n0, n1): votes of each class with the feature. The empty feature is every row's; short words, which are none, stand after \\x00."""
    kinds = pa.string(), pa.int64(), pa.int64()

    def table(n: dict[tuple[int, int], Counter[str]]) -> Iterator[pa.RecordBatch]:
        for (y, vote), seen in n.items():
            votes, none = np.fromiter(seen.values(), np.int64, len(seen)) * vote, np.zeros(len(seen), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), kinds[0]), *(pa.array(votes if k == y else none, kinds[1]) for k in (0, 1))], ["feature", "n0", "n1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: defaultdict[tuple[int, int], Counter[str]] = defaultdict(Counter)
        known: dict[str, tuple[str, ...]] = {}
        held_ = 0
        for batch in batches:
            for text, y, vote in zip(batch["text"], batch["y"].to_pylist(), batch["vote"].to_pylist(), strict=True):
                own = {""}
                for w in set(_WORDS.findall((text.as_py() or "").lower())):
                    found = known.get(w)
                    if found is None:
                        found = known[w] = tuple(features(w)) or ("\0" + w,)
                    own.update(found)
                seen = n[y, vote]
                held_ -= len(seen)
                seen.update(own)
                held_ += len(seen)
                if held_ > MOST_COUNTED:
                    yield from table(n)
                    n.clear()
                    known.clear()
                    held_ = 0
        yield from table(n)

    return rows.mapInArrow(run, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _grams_of(words: list[str], votes: np.ndarray) -> dict[str, int]:
    """Votes of the character model's n-grams in words. A gram's number is made from that of the gram without its last character, so that alphabets of any size are told apart."""
    text = "".join(["\2" + w + "\3" for w in words])
    lengths = np.array([len(w) + 2 for w in words])
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    place, vote = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths), np.repeat(votes, lengths)
    alphabet, letter = np.unique(code, return_inverse=True)
    found: dict[str, int] = {}
    before, at = np.zeros(len(code), np.int64), np.arange(len(code))  # the number of the gram that ends before each place
    for size in range(1, ORDER + 1):
        at = at[place[at] >= size - 1]
        _, first, number = np.unique(before[at - 1] * len(alphabet) + letter[at] if size > 1 else letter[at], return_index=True, return_inverse=True)
        ends = place[at[first]] > 0  # the mark alone is no gram
        total = np.zeros(len(first), np.int64)
        np.add.at(total, number, vote[at])
        found.update((text[e - size + 1 : e + 1], n) for e, n in zip(at[first][ends].tolist(), total[ends].tolist(), strict=True))
        before = np.zeros(len(code), np.int64)
        before[at] = number
    return found


def _grams(counts: DataFrame) -> DataFrame:
    """(gram, n): votes of the n-grams of all words in counts; a word has as many as there are rows that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _grams_of(batch["word"].to_pylist(), batch["n"].to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["gram", "n"])

    short = F.col("feature").startswith("\0")
    words = counts.filter(short | F.col("feature").endswith("$")).select(F.when(short, F.expr("substring(feature, 2)")).otherwise(F.expr("left(feature, length(feature) - 1)")).alias("word"), (F.col("n0") + F.col("n1")).alias("n"))
    return words.mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[dict[str, float], dict[str, float], float]:
    """(log(1 - precision) by feature, votes by character n-gram, log(1 - the score of a text without features))."""
    counts = materialise(_counts(_labelled(docs, labels, id_col, text_col, label_col)))
    whole = counts.filter("feature = ''").first()
    if not whole or not whole["n0"] or not whole["n1"]:
        return {}, {}, 0.0
    n0, n1 = whole["n0"] / VOTE, whole["n1"] / VOTE
    share = n1 / (n0 + n1)
    used = counts.filter("feature != '' and feature not like '\0%'").select("feature", (F.col("n0") / VOTE).alias("n0"), (F.col("n1") / VOTE).alias("n1")).withColumn("n", F.col("n0") + F.col("n1"))
    tested = used.filter("n >= 3").count()
    part = lambda k, q: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / F.col("n") / q)).otherwise(0.0)
    precision = (F.col("n1") + PRIOR * share) / (F.col("n") + PRIOR)
    chosen = used.filter((part("n1", share) + part("n0", 1 - share) > math.log(max(tested, 2)) + 2) & (precision >= LEAST_PRECISION)).select("feature", precision.alias("p")).collect()
    weights = {r["feature"]: math.log1p(-min(r["p"], 0.9999)) for r in chosen}
    grams = {r["gram"]: r["n"] / VOTE for r in _grams(counts).filter(F.col("n") > VOTE).collect()}  # as many as the languages of the labelled rows have
    return weights, grams, math.log1p(-0.25 * share)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    scored = with_scores(docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_")), "text_", "score_", fit(docs, labels, id_col, text_col, label_col))
    return scored.select(F.col("id_").alias(id_col), (remainder(F.col("id_")) == 2).alias("held_out"), F.col("score_").alias("score"), F.when(F.col("score_") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns."""
    name = fresh(docs.columns, "score_")
    return with_scores(docs, text_col, name, fit(docs, labels, id_col, text_col, label_col)).filter(F.col(name) < threshold).select(*(F.col(f"`{c}`") for c in docs.columns))


def with_scores(rows: DataFrame, text_col: str, score_col: str, fitted: tuple[dict[str, float], dict[str, float], float]) -> DataFrame:
    """rows with a column of scores by a fitted model."""
    model = rows.sparkSession.sparkContext.broadcast(fitted)  # the words that tell, and the n-grams of the languages
    name = uuid.uuid4().hex

    def make():  # noqa: ANN202
        scorer = held(("scorer", name), lambda: Scorer(*model.value))
        return lambda texts: [[scorer.score(t) for t in texts]]

    return with_made(rows, text_col, f"`{score_col}` double", make)
