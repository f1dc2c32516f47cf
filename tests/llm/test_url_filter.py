import os
import random

import numpy as np

from siftgraph.llm import url_filter as u

URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1?x#y", "https://example.org/en/12", "https://example.org/en/2", "x://notexample.org/es/", "x://org", "x://org/",
    "http://www.spam-farm.example.net/de/1", "http://www.spam-farm.example.com/fr/1", "http://spam-farm.example.com?/", "ftp://a.com/de/", "a://b://c.com/fr/", "http://ÄÖ.com/fr/é", "http://x.com:80/fr/", "http://a..com/fr/#/de/", "a\n://org/\nx",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p)
    best = max((r for r in u.RULES if fits(*r[:2])), key=lambda r: len(r[0] + r[1]), default=None)
    listed = any(host == h or host.endswith("." + h) for h, _, _ in u.BLOCKED)
    return host, path, best and best[0] + best[1], best[2] if best else "block" if listed else "allow"


def test_against_brute_force(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", "1 as host", "2 as rule", "3 as id_")
    rules, blocked = u.entries_of(pages, u.RULES), u.entries_of(pages, u.BLOCKED)
    for most in (100, 0):  # by the mapped array, and by the join
        got = {r["page_id"]: tuple(r)[1:] for r in u.judge(pages, rules, blocked, most=most).collect()}
        assert got == {k: brute(x) for k, x in enumerate(URLS)}


def test_ids_pass_unchanged_and_repeated_rows_are_kept(spark):
    ids = [None, None, 2**53 + 1, 2**60 + 3, 2**60 + 3, 7]
    pages = spark.createDataFrame([(k, "http://a.com/de/x", 1, "x") for k in ids], "page_id long, url string, verdict int, host_ string").coalesce(1)
    rules, blocked = u.entries_of(pages, u.RULES), u.entries_of(pages, u.BLOCKED)
    for most in (100, 0):
        got = [(r["page_id"], r["rule"]) for r in u.judge(pages, rules, blocked, most=most).collect()]
        assert sorted(got, key=str) == sorted(((k, "com/de/") for k in ids), key=str)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert u.judge(pages, u.entries_of(pages, []), u.entries_of(pages, [])).count() == 0


def test_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(u, "digests", lambda strings: np.array([len(s) % 2 for s in strings], np.uint64))
    path = os.path.join(tmp_path, "a.bin")
    names = ["".join(random.Random(k).choices("abc", k=5)) for k in range(60)]
    u.DigestArray.write(path, [(n, "/", "block") for n in names[:30]])
    rule, _ = u.DigestArray(path).judge(names, ["/x"] * 60)
    assert [r is not None for r in rule] == [n in names[:30] for n in names]
