import html
import re

import pytest

from siftgraph.llm import html_extract as h

TEXT = ["The first paragraph tells of &amp; about things at length, as articles do.", "Another one follows it, with <b>bold</b>&nbsp;words and a <a href='#'>link</a> inside.", "And a third ends the story of the day with more words."]
PLAIN = ["The first paragraph tells of & about things at length, as articles do.", "Another one follows it, with bold words and a link inside.", "And a third ends the story of the day with more words."]


def page(body, head="<title>Title</title><style>p{}</style><script>var t='</p><p>no</p>';</script>"):
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'>{head}</head><body>{body}</body></html>"


def one(body):
    return h.extract(page(body), None)


NAV = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
PARAGRAPHS = "".join(f"<p>{x}</p>\n" for x in TEXT)
ALL = " ".join(PLAIN)


@pytest.mark.parametrize("body", [
    f"{NAV}<article>{PARAGRAPHS}</article><footer>&copy; all</footer>",
    f"<header>Site <form><input><button>Go</button></form></header><main><div class='cookie-notice'>We use cookies</div>{PARAGRAPHS}<div class='ads'>Buy</div></main>",
    f"<div id='menu'><a href='x'>One</a> <a href='y'>Two</a></div><div class='post-content'>{PARAGRAPHS}</div><div class='sidebar'>Latest posts and other long words about the site that nobody reads</div>",
    f"<div><ul><li><a href='a'>a</a><li><a href='b'>b</a></ul></div><div><div>{PARAGRAPHS}</div></div><div><p>short foot</p></div>",
    f"<article>{PARAGRAPHS}<section class='comments'><article class='comment'><p>I disagree with all of this, at length.</p></article></section></article>",
    f"<article><!-- <p>hidden</p> -->{PARAGRAPHS}<div style='display: none'>secret</div><aside>See also</aside><div class='share-buttons'>Share</div></article>",
    f"<article>{PARAGRAPHS.replace('</p>', '')}",
    f"<div class='layout with-sidebar'><article>{PARAGRAPHS}</article><div class='sidebar'><p>Other things of the site</p></div></div>",
    f"<article>{PARAGRAPHS}<section><h3>3 Comments</h3><ul><li>First of all, I think so</li><li>And I do not</li></ul></section></article><section><h2>Related articles</h2><p>One</p></section>",
    f"<div role='navigation'><p>Go on here or there and see what is there</p></div><main><h6 class='banner'>Breaking</h6>{PARAGRAPHS}<ul class='pagination'><li>1</li></ul></main><div role='contentinfo'>x</div>",
    f"<article>{PARAGRAPHS}<noscript>Enable it</noscript><textarea>type</textarea></article><div id='comments'><p>First!</p></div><foot",
])
def test_templates(body):
    assert one(body) == ALL


def test_references_white_space_and_breaks():
    assert one("<article><p>a&lt;b &#x41;&#66; &am &amp x</p><h2> c\n\n d </h2>e<br>f<span>g</span>h</article>") == "a<b AB &am & x c d efgh".replace("ef", "e f")
    assert h.extract(None, None) == h.extract("", None) == h.extract("<nav>x</nav>", None) == ""


def known_of(pages):
    known = None
    for p in pages:
        known = h.add(known, h.wrapper(p))
    return known


def test_wrapper_has_groups_options_and_slots():
    pages = [page(f"{NAV}<article><h1>T{k}</h1>{'<h2>q</h2><p>r</p>' * k}</article>{'<div class=promo>now</div>' * (k % 2)}") for k in (2, 3, 4)]
    known = known_of(pages)
    assert h.expression(known) == '<page><head></head> <nav><ul>(<li>#</li>)+</ul></nav> <article><h1>#</h1> (<h2>#</h2> <p>#</p>)+</article> (<div.promo>"now"</div>)?</page>'
    assert known[0].n == 3 and h.unpack(h.pack(known))[0].n == 3


def test_expression():
    a, b = (h.wrapper(x) for x in ("<ul><li>a<li>b</ul><p>x</p>", "<ul><li>c</ul><p>x</p><hr><i>y</i>"))
    assert h.expression(h.add(a, b)) == '<page><ul>(<li>#</li>)+</ul> <p>"x"</p> ("y")?</page>'


@pytest.mark.parametrize("bodies,want", [
    (["<h2>a</h2><p>b</p>", "<h2>a</h2><p>b</p><h2>c</h2><p>d</p>"], "(<h2>#</h2> <p>#</p>)+"),  # a group meets one turn of it
    (["<h2>a</h2><p>b</p><h2>c</h2><p>d</p>", "<h2>a</h2><p>b</p>"], "(<h2>#</h2> <p>#</p>)+"),
    (["<h2>a</h2><p>b</p><p>c</p><h2>d</h2><p>e</p><p>f</p><p>g</p>"], "(<h2>#</h2> (<p>#</p>)+)+"),
    (["<p>a</p><table><tr><td>1</td></tr></table><pre>c</pre>", "<p>b</p><pre>c</pre>"], '<p>#</p> (<table><tr><td>"1"</td></tr></table>)? <pre>"c"</pre>'),
    (["<div><ul><li>a</ul></div><pre>x</pre>", "<div><p>a</p></div><pre>x</pre>"], '(<div><ul><li>"a"</li></ul></div>)? (<div><p>"a"</p></div>)? <pre>"x"</pre>'),  # same tag, nothing alike in it
    (["<p>a</p>" + "".join(f"<x{k}>t</x{k}>" for k in "abc"), "<p>a</p>"], '<p>"a"</p> (<xa>"t"</xa>)? (<xb>"t"</xb>)? (<xc>"t"</xc>)?'),
])
def test_mismatches_become_groups_options_and_slots(bodies, want):
    assert h.expression(known_of(bodies)) == f"<page>{want}</page>"


def test_merging_does_not_depend_on_how_pages_are_dealt():
    pages = [page(f"{NAV}<div class=x><p>t{k}</p></div>{'<div class=y>z</div>' * (k % 2)}<footer>f</footer>") for k in range(6)]
    read = lambda x: h.unpack(h.pack(x))
    assert h.pack(h.add(read(known_of(pages[:3])), read(known_of(pages[3:])))) == h.pack(known_of(pages))


def test_text_that_never_differs_is_the_templates():
    pages = [page(f"<article><p>Story number {k} with words of its own.</p><div>Read it all on our site today.</div></article>") for k in range(4)]
    assert h.extract(pages[2], h.label(known_of(pages))) == "Story number 2 with words of its own."


FILL = "words of the site that say the same on every page, and more of them than any article here has. " * 6


def test_only_the_wrapper_tells_regions_with_meaningless_names():
    """Every page has the same long text, a menu and a box, in blocks whose names say nothing; what differs is the article."""
    story = lambda k: f"<p>Tale {k} of the day, told once, {'and on ' * k}to its end.</p><p>It closes in the year {1900 + k}.</p>"
    body = lambda k: f"<div class=zq><div class=kx>Home</div><div class=kx>News {{}}</div></div><div class=vv><p>{FILL}</p><p>{FILL}</p></div><div class=wd>{story(k)}<div class=ok>{FILL}</div></div><div class=pf><p>{FILL}</p></div>"
    pages = [page(body(k)) for k in range(8)]
    want = [f"Tale {k} of the day, told once, {'and on ' * k}to its end. It closes in the year {1900 + k}." for k in range(8)]
    known = h.label(known_of(pages))
    assert [h.extract(p, known) for p in pages] == want
    assert all(h.extract(p, None) != w for p, w in zip(pages, want, strict=True))
    odd = page(body(9).replace("<div class=ok>", "<pre>def f(): pass</pre><div class=ok>"))  # a block that the wrapper doesn't know
    assert h.extract(odd, known).endswith("It closes in the year 1909. def f(): pass")


@pytest.mark.parametrize("part,text", [
    ("<section><h2>Discussion</h2><p>We talk about what {k} means.</p></section>", "Discussion We talk about what {k} means."),
    ("<div class='legal'><p>The court said {k} in its ruling.</p></div>", "The court said {k} in its ruling."),
    ("<div class='widget-story'><p>Of the widget {k} there is more.</p></div>", "Of the widget {k} there is more."),
    ("<div class='ad-free-story'><p>No {k} here.</p></div>", "No {k} here."),
    ("<ul><li><a href='x'>Source {k}</a></li><li><a href='y'>Another source of {k}</a></li></ul>", "Source {k} Another source of {k}"),
    ("<div class='post-comments'><p>I say {k} to that.</p></div>", ""),
    ("<div class='comment-list'><div class='comment'>I say {k}</div><div class='comment'>No</div></div>", ""),
    ("<h2>About us</h2><div>All of it is by us.</div>", ""),
    ("<div class='legal'>All rights are reserved by the site.</div>", ""),
    ("<div class='cookieNotice'>We use {k} cookies</div>", ""),
    ("<div class='related'><a href='x'>Read {k}</a></div>", ""),
])
def test_names_break_ties_only(part, text):
    pages = [page(f"<article><h1>Title {k}</h1><p>First of {k}, said at some length.</p>{part.replace('{k}', str(k))}<p>Last of {k}, and so on.</p></article>") for k in range(5)]
    known = h.label(known_of(pages))
    for k in range(5):
        assert h.extract(pages[k], known) == " ".join(f"Title {k} First of {k}, said at some length. {text.replace('{k}', str(k))} Last of {k}, and so on.".split())


def test_copies_of_one_page_are_no_template():
    pages = [page(f"<nav>Menu</nav><article><p>{ALL}</p></article>")] * 3 + [page(f"<nav>Menu</nav><article><p>Other {k} text</p></article>") for k in range(4)]
    known = h.label(known_of(pages))
    assert h.extract(pages[0], known) == ALL and h.extract(pages[3], known) == "Other 0 text"
    same = h.label(known_of(pages[:3]))
    assert h.extract(pages[0], same) == ALL


def test_deep_and_long_pages():
    n = 100_000
    assert h.extract("<div>" * n + f"<p>{ALL}</p>" + "</div>" * n, None) == ALL
    deep = h.label(known_of(["<div>" * n + f"<p>Text {k}</p>" for k in range(3)]))
    assert h.extract("<div>" * n + "<p>Text 7</p>", deep) == "Text 7"
    assert h.extract("<article>" + "".join(f"<p>a{k}</p>" for k in range(n)), None) == " ".join(f"a{k}" for k in range(n))
    assert h.extract("<article>" + "".join(f"<p>a<ul><li>{k}</ul></p>" for k in range(n // 10)), None) == " ".join(f"a {k}" for k in range(n // 10))
    assert h.extract("<a '" * 20_000 + "<p>x</p>", None) in ("", "x") and h.extract("<p>" + "x" * 1_000_000, None) == "x" * 1_000_000


def test_wrappers_stay_bounded_and_lose_no_text():
    import random

    rng, tags = random.Random(3), ["h2", "p", "pre", "table", "ul", "dl", "blockquote", "div class=a", "div class=b"]
    pages = [page("<article>" + "".join(f"<{t}>w0.{rng.randrange(10**9)}</{t.split()[0]}>" for t in rng.choices(tags, k=30)) + "</article>") for _ in range(60)]
    known = h.label(known_of(pages))
    assert len(known) < h.MOST_TOKENS and [h.extract(p, known) for p in pages] == [truth_of_words(p) for p in pages]


def truth_of_words(source):
    return " ".join(re.findall(r"w0\.\d+", source))


def truth(source):
    inner = re.search(r"<article>(.*?)(</article>|$)", source, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<(p|/p|h1|/h1|br)>", " ", inner))).split())


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: (r["url"], truth(r["html"]), len(truth(r["html"]))) for r in pages.collect()}
    assert {r["page_id"]: tuple(r)[1:] for r in h.main_texts(pages).collect()} == want
    assert {r["page_id"]: tuple(r)[1:] for r in h.main_texts(pages, most=0).collect()} == want


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (2, "http://a.b/", "", "y"), (2, "http://a.b/", "", "y"), (None, "no scheme", page(f"<article>{PARAGRAPHS * 500}</article>"), None), (3, "http://a.b/", "\x00<p>1 < 2", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").selectExpr("*", "1 as text", "2 as wrapper")
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in h.main_texts(pages).collect()}
    assert got[1, None] == got[2, "http://a.b/"] == ("", 0) and got[None, "no scheme"][0] == " ".join([ALL] * 500) and got[3, "http://a.b/"][0] == "\x00 1 < 2".replace("\x00 ", "\x00 ")
    assert h.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# Blocks whose names are near, and blocks of one name of which one is the template's.

REAL = ["<p class='para'>" + " ".join(f"w{n}x{k}" for k in range(30)) + "</p>" for n in range(40)]


def texts_of(pages):
    """Texts by the wrapper that all pages make."""
    known = None
    for p in pages:
        known = h.add(known, h.wrapper(p))
    known = h.unpack(h.pack(h.label(known)))
    return [h.extract(p, known) for p in pages]


@pytest.mark.parametrize("n", [1, 10])
@pytest.mark.parametrize("advert_at", [0, 1, 2])
def test_adverts_named_like_their_neighbours(n, advert_at):
    blocks = [["<div class='para ad'>Buy now</div>", f"<div class='para'>Real text one {k}</div>", f"<div class='para'>Real text two {k}</div>"] for k in range(n)]
    for b in blocks:
        b.insert(advert_at, b.pop(0))
    pages = [f"<article><h1>T{k}</h1>{''.join(b)}</article>" for k, b in enumerate(blocks)]
    want = [f"T{k} Real text one {k} Real text two {k}" for k in range(n)]
    assert [one(p) for p in pages] == want and texts_of(pages) == want


@pytest.mark.parametrize("around", ["<article>{}</article>", "<div class='content'>{}</div>", "<body><div>{}</div></body>"])
def test_a_template_paragraph_among_paragraphs_of_its_name(around):
    rate = "<p class='para'>Rate us with five stars if you liked this page and come again</p>"
    pages = [around.format(REAL[k] + (rate if k % 2 else "") + "".join(REAL[10 + 3 * k : 10 + 3 * k + k % 3 + 1]) + ("" if k % 2 else rate)) for k in range(10)]
    want = [" ".join(x.split(">", 1)[1][:-4] for x in [REAL[k], *REAL[10 + 3 * k : 10 + 3 * k + k % 3 + 1]]) for k in range(10)]
    assert texts_of(pages) == want


def test_copies_on_a_host_keep_their_text():
    shared = "".join(REAL[:8])
    pages = [f"<article>{shared}{REAL[10 + k]}</article>" for k in range(6)]
    assert texts_of(pages) == [" ".join(x.split(">", 1)[1][:-4] for x in [*REAL[:8], REAL[10 + k]]) for k in range(6)]


def test_article_parts_that_look_like_others():
    links = "<ul>" + "".join(f"<li><a href='{k}'>Reference number {k} in full</a></li>" for k in range(5)) + "</ul>"
    said = " ".join(f"Reference number {k} in full" for k in range(5))
    assert one(f"<div class='content'>{PARAGRAPHS}{links}</div>") == f"{ALL} {said}"
    court = "<section><h2>Comments</h2><p>The court found that the first claim was well made.</p></section>"
    assert one(f"<article>{PARAGRAPHS}{court}</article>") == f"{ALL} Comments The court found that the first claim was well made."
    assert one(f"<article>{PARAGRAPHS}<ul class='menu-list'><li>Soup of the day</li><li>Fish with rice</li></ul></article>") == f"{ALL} Soup of the day Fish with rice"
    assert one(f"<article>{PARAGRAPHS}<ul class='menu-list'><li><a href='a'>Home</a></li><li><a href='b'>News</a></li></ul></article>") == ALL


def test_counts_of_texts_are_bounded_and_keep_the_frequent():
    counts = {}
    for k in range(5000):
        counts = h._counted(counts, {k: 1, -1: 1, -2 - k % 3: 1})
    assert len(counts) <= h.MOST_TEXTS and counts[-1] > 4900 and all(counts[-2 - j] > 1500 for j in range(3))
