import collections
import itertools
import math
import random
import zlib

import pyarrow as pa
from pyspark.sql import types as T

from siftgraph.llm import common
from siftgraph.llm import toxicity as t

SF = "/root/testdata/sf0.1"


def test_viterbi_against_all_paths():
    model = t.CharacterModel({g: n for w in ("\2idiot\3", "\2the\3") for k in (1, 2, 3) for g, n in [(w[i : i + k], 5) for i in range(1, len(w) - k + 1)]})
    for word in ("1d10t", "i-d", "tthe", "t h e"):
        costs = {}
        for path in itertools.product(*t.columns(word)):
            text, last, cost, fine = "", "\2", sum(c for _, c in path), True
            for letters, _ in path:
                if letters == " ":
                    fine &= last != "\2"
                    cost, last = cost + model.cost(last, "\3"), "\2"
                else:
                    for c in letters:
                        cost, last = cost + model.cost(last, c), (last + c)[1 - t.ORDER :]
                text += letters
            if fine:
                costs[text] = min(costs.get(text, math.inf), cost + model.cost(last, "\3") * (last != "\2"))
        assert math.isclose(costs[t.decode(word, model)], min(costs.values()))


def test_held_out_and_obfuscated(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in t.score(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for k, r in rows.items())
    held = [(x["toxic"], rows[x["doc_id"]]["predicted"]) for x in labels.collect() if rows[x["doc_id"]]["held_out"]]
    assert sum(y == p == 1 for y, p in held) >= 0.75 * sum(y for y, _ in held)
    assert sum((y, p) == (0, 1) for y, p in held) <= 0.03 * len(held)
    scorer = t.Scorer(*t.fit(docs, labels))
    noisy = ["an 1d10t here", "i d i o t", "idiiiiot", "i.d.i.o.t", "p@thet1c", "w o r t h l e s s", "m-o-r-o-n", "the m0r0n!", "STUUUPID", "w0rth1ess", "d!sgust!ng", "***idiot***", "$tup1d"]
    assert all(scorer.score(x) >= 0.3 for x in noisy)
    clean = [None, "", " ", "The quick br0wn 2nd a 1st 3.14 foo_bar http://a.b/c", "a b c d", "!!! $$$", "1 2 3 4 5"]
    assert all(scorer.score(x) < 0.3 for x in clean)


def test_odd_rows(spark, documents):
    labels = spark.createDataFrame([(1, 0), (4, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    rows = t.score(documents, labels).collect()
    assert len(rows) == documents.count() and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in t.score(documents, none).collect()} == {0.0}
    assert t.score(spark.createDataFrame([], "doc_id long, text string"), labels).count() == 0


def plain_fit(rows):
    """The fit by dictionaries, of rows (text, y) that are no near copies; all are sampled, so that each stands for itself."""
    n, seen = [0, 0], [collections.Counter(), collections.Counter()]
    for text, y in rows:
        n[y] += 1
        seen[y].update({f for w in t._WORDS.findall(text.lower()) for f in t.features(w)})
    share, often = n[1] / sum(n), [f for f in seen[0] | seen[1] if seen[0][f] + seen[1][f] >= 3]
    weights = {}
    for f in often:
        c0, c1 = seen[0][f], seen[1][f]
        gain = sum(c * math.log(c / (c0 + c1) / q) for c, q in ((c1, share), (c0, 1 - share)) if c)
        p = (c1 + t.PRIOR * share) / (c1 + c0 + t.PRIOR)
        if gain > math.log(max(len(often), 2)) + 2 and p >= t.LEAST_PRECISION:
            weights[f] = math.log1p(-min(p, 0.9999))
    return weights, math.log1p(-0.25 * share)


def test_fit_and_score_against_plain_dictionaries(spark):
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("lor", "mip", "tas", "ven") for b in ("do", "ri", "ka") for c in ("mer", "lin", "sto")]
    rows = []
    for k in range(400):
        text = " ".join(rng.choices(words, k=12)) + (" badword nasty" if k % 4 == 0 else " fine")
        rows.append((k, text, int(k % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    learn = [(text, y) for k, text, y in rows if zlib.crc32(str(k).encode()) % 4 != 2]
    weights, none = plain_fit(learn)
    got, grams, base = t.fit(docs, labels)
    assert got.keys() == weights.keys() and "badword$" in got and math.isclose(base, none)
    assert all(math.isclose(got[f], w) for f, w in weights.items())
    model = t.CharacterModel(grams)
    for r in t.score(docs, labels).collect():
        text = rows[r["doc_id"]][1]
        total = none + sum(min((weights.get(f, 0.0) for f in t.features(w)), default=0.0) for w in text.split())
        assert math.isclose(r["score"], 1 - math.exp(total), abs_tol=1e-12)
    assert t.decode("b4dw0rd", model) == "badword"
    scorer = t.Scorer(got, grams, base)
    dotted = ".".join(["lordomer", "miprilin", "b4dw0rd", "taskasto"] * 8)  # far more than 64 characters without white space
    assert scorer.score(dotted) > 0.3 and scorer.score("b" + "a" * 5000 + "dword") > 0.3
    assert scorer.score(" ".join("lordomer" * 40) + " " + " ".join("badword") + " " + " ".join("miprilin" * 40)) > 0.3


def test_pieces_of_a_megabyte():
    model = t.CharacterModel({"a": 3, "b": 2, "ab": 2})
    scorer = t.Scorer({"idiot$": -2.0}, {"a": 3, "b": 2, "ab": 2}, -0.01)
    for text in ("x" * 1_000_000, "1" * 1_000_000, "-" * 1_000_000, "a " * 300_000, "ab" * 500_000, "é" * 100_000 + "!"):
        assert 0 <= scorer.score(text) < 0.3
    assert len(t.decode("a-b1" * 50_000, model)) >= 100_000


def test_clashing_columns(spark, documents):
    labels = spark.createDataFrame([(1, 0), (4, 1)], "doc_id long, toxic int")
    docs = documents.selectExpr("*", "1 as score_", "2 as id_", "3 as text_", "4 as y")
    kept = t.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert t.score(docs, labels).columns == ["doc_id", "held_out", "score", "predicted"]


def test_every_labelled_row_counts(spark):
    """More rows of a class than any sample of old took, and copies, which share one vote."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghilmnoprstu", k=7)) for _ in range(600)]
    rows = [(k, " ".join(rng.choices(words, k=8)) + (" badword" if k % 30 == 0 else " rude" if k % 11 == 0 else " fine"), int(k % 30 == 0)) for k in range(9_000)]
    learn = [(text, y) for k, text, y in rows if zlib.crc32(str(k).encode()) % 4 != 2]
    assert sum(y == 0 for _, y in learn) > 6_000
    copied = rows + [(k, rows[1][1], 0) for k in range(9_000, 9_100)]
    assert zlib.crc32(b"1") % 4 != 2
    weights, none = plain_fit(learn)
    got, grams, base = t.fit(spark.createDataFrame([r[:2] for r in copied], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in copied], "doc_id long, toxic int"))
    assert "badword$" in got and got.keys() == weights.keys() and math.isclose(base, none, rel_tol=1e-6)
    assert all(math.isclose(got[f], w, rel_tol=1e-5) for f, w in weights.items())
    often = collections.Counter("\2" + w + "\3" for text, _ in learn for w in set(text.split()))
    assert all(math.isclose(grams[g], sum(n * w.count(g) for w, n in often.items()), rel_tol=1e-5) for g in ("fine\3", "\2rude", "o", "bad"))


def test_grams_in_any_alphabet():
    words = ["the", "a", "日本", "ééé", "𝔘𝔫", "thethe"]
    expected = collections.Counter()
    for w, n in zip(words, range(1, 7), strict=True):
        s = "\2" + w + "\3"
        expected.update({g: n * k for g, k in collections.Counter(s[i : i + m] for m in range(1, t.ORDER + 1) for i in range(len(s) - m + 1)).items() if g != "\2"})
    assert {g: n for g, n in t._grams_of(words, t.np.arange(1, 7)).items()} == expected


def test_tables_of_other_operators_are_let_go():
    """A task that asks for no kept table frees the one of the operator before, and values become Python objects some rows at a time."""
    kept = common.held(("test", "table"), lambda: [1])
    assert common.held(("test", "table"), list) is kept
    sizes = []

    class Rows:
        schema = T.StructType([T.StructField("x", T.LongType())])

        def mapInArrow(self, run, schema):  # noqa: N802
            batch = pa.RecordBatch.from_arrays([pa.array(range(2_500), pa.int64())], ["x"])
            return pa.Table.from_batches(run(iter([batch])))["y"].to_pylist()

    made = common.with_made(Rows(), "x", "y long", lambda: lambda values: sizes.append(len(values)) or [values])
    assert made == list(range(2_500)) and max(sizes) <= common.AT_ONCE
    assert not common._HELD
