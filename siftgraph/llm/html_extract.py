"""Main text of web pages by wrapper inference with union-free regular expressions.

A page is a stream of tokens: block tags and the texts between them. The stream folds in place while it is read: like neighbours and tandem
repeats become repeated groups. Streams of one host are then aligned, token by token: equal tags go on, texts that differ become slots,
and a mismatch of tags skips to the nearest place where both streams agree again, which makes what was skipped optional. The result is the
host's wrapper, a union-free regular expression; a wrapper is itself such a stream, so wrappers merge by the same alignment, each task folds
its own pages, and only wrappers travel: partial wrappers of a host meet in groups of bounded size, twice.

The wrapper is labelled once for the host. A slot is the template's if at least nine of ten pages have the same texts in it, else content. A slot that
stands for several blocks of a page counts in how many pages each text occurs, so that a template's text among an article's is told from it.
Blocks of a page fold only if their names are equal; blocks of two pages also align if their names are near and say the same.
The main region is the article or main element if the markup has one that holds content, else the block with most varying text outside links.
In it, everything is main text but regions whose elements say otherwise (nav, aside, form and the like), regions that never differ while the
rest does, and, as markup gives no other sign between two regions that both vary, those that class, id, role or heading call comments,
adverts, menus, sidebars, notices and the like. A page is aligned with its host's wrapper, and its texts take the labels of the slots that they meet; a
block that meets nothing takes the label of the block around it.

Nothing recurs: nesting of any depth is read by loops. A wrapper of more than MOST_TOKENS tokens forgets its rarest optional blocks
(pages that have them label them by the block around); no page's text is cut by that.

Defined results: null and empty html give an empty text; cut or unclosed markup ends where the page ends; pages without a host share one wrapper; a page that
its host's labels leave without any text is labelled by itself; repeated rows give the same text; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgraph.llm.common import materialise, with_made

#: Wrappers up to which they are sent to every machine, if their bytes allow it too; beyond it pages meet theirs in a shuffled join, a host dealt over SALTS.
MOST_WRAPPERS, SALTS = 5_000, 16
#: Hosts whose wrappers a task holds before it sends them on, and ways that a host's partial wrappers are first dealt.
HELD_HOSTS, WAYS = 2_000, 64
#: Tokens of a wrapper beyond which its rarest optional blocks are forgotten, and blocks that a mismatch looks ahead.
MOST_TOKENS, LOOK = 20_000, 128
#: Longest tandem repeat that becomes a group.
PERIOD = 6
#: Pages, and share of the host's pages, that a template's text needs; share of the region's text that must vary for it to count.
LEAST_PAGES, LEAST_SHARE, LEAST_VARYING = 3, 0.25, 0.34
#: Texts of a slot that are counted; beyond, the rarest go by the Misra-Gries rule. Bytes of wrappers up to which they are sent.
MOST_TEXTS, MOST_BYTES = 256, 64 << 20

# Kinds of elements, and words in class, id or role that tell what a region is.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
RAW = set("script style noscript template iframe noframes textarea title svg xmp object math canvas audio video select".split())
CLOSED_BY = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
SEMANTIC = set("article main nav footer aside header form".split())
DROPPED_TAGS = set("head nav footer aside form button dialog menu fieldset".split()) | RAW
LEAF_TAGS = set("p li h1 h2 h3 h4 h5 h6 td th tr dt dd blockquote pre #".split())
#: Names of regions that are never an article's, whatever they hold.
STRONG = set(
    "nav navbar navigation menubar breadcrumb breadcrumbs sidebar complementary footer masthead topbar contentinfo banner cookie cookies consent gdpr notice notices"
    " ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored comment comments commentlist disqus share sharing social newsletter subscribe subscription pagination pager".split()
)
#: Names of regions of links that other things have too; within the main region they decide only where most of the text is links.
LINKS = {"menu"}
#: Names of regions that may be an article's: they decide only outside the main region, or where the region's text never differs or is links.
WEAK = set("aside header alert alertdialog warning disclaimer promo promotion reply replies respond responses discussion related recommended signup login search popup modal overlay toolbar widget widgets copyright legal skip".split())
#: Parts of names that say only where or how.
FILLER = set("box block area section sections wrap wrapper container list item items bar inner outer top bottom left right buttons button links slot panel row col column unit region holder group content".split())
MAIN_WORDS = set("article content main post entry story body text maincontent articlebody postbody".split())
#: Headings of regions that aren't the article's; of those that name comments only where the region holds more than paragraphs.
AWAY_COMMENTS = re.compile(r"(\d+\s+)?(reader |user |leave a |post a |add a )?(comments?|repl(y|ies))( \(?\d+\)?)?:?", re.I)
PLAIN = set("p blockquote h1 h2 h3 h4 h5 h6 pre".split())
AWAY = re.compile(r"related( articles| posts| stories)|share( this)?|advertisements?|sponsored|newsletter|subscribe.{0,30}|most (read|popular)|menu|navigation", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|$)|<(?=/?[A-Za-z])[^>]*(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_NUMBERS = re.compile(r"(?<=[-_])\d+|\d{3,}")
_UNCLOSED = {tag: re.compile(f"</{tag}\\b[^>]*(?:>|$)", re.I) for tag in RAW}


class Token:
    """The start of a block ("<"), a text or slot ("#"), the start of a group ("(") or the end of either (">").

    value holds a slot's texts in most pages (a digest where it has several in a page) and votes how far these lead; at holds, in a page, where its texts are.
    seen counts the pages that hold each text of a slot, turns all texts of it, and known holds those that are the template's, once it is labelled.
    """

    __slots__ = ("kind", "sym", "tag", "hint", "shape", "repeated", "optional", "n", "chars", "links", "value", "votes", "label", "at", "seen", "turns", "known")

    def __init__(self, kind: str, sym: str = "", hint: str = "", shape: frozenset = frozenset(), n: int = 1, chars: int = 0, links: int = 0, value: str = "", votes: int = 1) -> None:
        self.kind, self.sym, self.hint, self.shape = kind, sym, hint, shape
        self.tag = "(" if kind == "(" else sym.split(".", 1)[0]
        self.repeated = self.optional = False
        self.n, self.chars, self.links, self.value, self.votes = n, chars, links, value, votes
        self.label, self.at = "", []
        self.seen: dict[int, int] = {}
        self.turns = 0
        self.known: frozenset[int] = frozenset()

    def pack(self) -> list:
        return [self.kind, self.sym, self.hint, sorted(self.shape), int(self.repeated), int(self.optional), self.n, self.chars, self.links, self.value, self.votes, self.label, [*self.seen], [*self.seen.values()], self.turns, [*self.known]]

    @staticmethod
    def unpack(x: list) -> Token:
        if x[0] == ">":
            return END
        t = Token(x[0], x[1], x[2], frozenset(x[3]), *x[6:11])
        t.repeated, t.optional, t.label = bool(x[4]), bool(x[5]), x[11]
        t.seen, t.turns, t.known = dict(zip(x[12], x[13], strict=True)), x[14], frozenset(x[15])
        return t


END = Token(">")


def pack(tokens: list[Token]) -> str:
    return json.dumps([t.pack() if t.kind != ">" else [">"] for t in tokens], ensure_ascii=False)


def unpack(packed: str) -> list[Token]:
    return [Token.unpack(x) for x in json.loads(packed)]


def ends(tokens: list[Token]) -> list[int]:
    """For each token the last token of what it starts."""
    out, open_ = list(range(len(tokens))), []
    for k, t in enumerate(tokens):
        if t.kind in "<(":
            open_.append(k)
        elif t.kind == ">":
            out[open_.pop()] = k
    return out


# Pages as token streams -----------------------------------------------------------------------


@lru_cache(maxsize=20_000)
def described(tag: str, attributes: str) -> tuple[str, str]:
    """A block's symbol (its tag, with class and id but for numbers) and what its names say: strong, weak, main, hidden or nothing."""
    if tag in ("html", "body") or not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return tag, ""
    names, heads, main = [], set(), False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")  # noqa: PLW2901
        if key in ("class", "id", "role"):
            if key == "class" or not re.search(r"\d", value):
                names += _NUMBERS.sub("", value).lower().split()
            for name in value.split():
                parts = [p.lower() for p in _PARTS.findall(name)]
                main |= bool(MAIN_WORDS & {*parts, name.lower()})
                while len(parts) > 1 and parts[-1] in FILLER:
                    parts.pop()
                heads.update(parts[-1:], (name.lower(),))  # the noun that the other parts describe
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return f"{tag}.hidden", "hidden"
    hint = "strong" if heads & STRONG else "links" if heads & LINKS else "weak" if heads & WEAK else "main" if main else ""
    if tag in SEMANTIC:  # what it is counts, whatever names it has
        return f"{tag}.{hint}" if hint in ("strong", "links") else tag, hint
    return ".".join([tag, *sorted(set(names))]), hint


def events(source: str | None) -> Iterator[tuple]:
    """("<", symbol, hint), ("#", text, characters in links) and (">",): balanced; texts of inline elements belong to the block around them."""
    if not source:
        return
    stack: list[str] = []
    open_: Counter[str] = Counter()
    texts: list[str] = []
    links = anchors = at = 0
    end = len(source)

    def text() -> tuple | None:
        nonlocal links
        joined = "".join(texts)
        if "&" in joined:
            joined = entities.unescape(joined)
        joined = " ".join(joined.split())
        found = ("#", joined, min(links, len(joined))) if joined else None
        texts.clear()
        links = 0
        return found

    def closing(k: int) -> Iterator[tuple]:
        while len(stack) > k:
            open_[stack.pop()] -= 1
            yield (">",)

    while at < end:
        m = _TOKEN.search(source, at)
        if m is None or m.start() > at:
            piece = source[at : m.start() if m else end]
            texts.append(piece)
            links += len(piece) * anchors
            if m is None:
                break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag, closes = tag.lower(), bool(m[1])
        if tag == "a":
            anchors = 0 if closes else 1
        if tag in INLINE or tag in ("img", "wbr"):
            continue
        if tag == "br":
            texts.append(" ")
            continue
        if texts and (found := text()):
            yield found
        anchors = 0
        if closes:
            if open_[tag]:
                yield from closing(next(k for k in range(len(stack) - 1, -1, -1) if stack[k] == tag))
            continue
        if tag in VOID or m[3].endswith("/") and tag in RAW:
            continue
        if tag in RAW:
            close = _UNCLOSED[tag].search(source, at)
            at = close.end() if close else end
            continue
        if tag in ("html", "body") and not stack:
            continue
        if stack and stack[-1] in ("p", *HEADINGS) and tag not in ("html", "body"):
            yield from closing(len(stack) - 1)
        same = {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}
        if tag in CLOSED_BY and any(open_[x] for x in same):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] in CLOSED_BY[tag]:
                    break
                if stack[k] in same:
                    yield from closing(k)
                    break
        if stack and stack[-1] == "head" and tag not in DROPPED_TAGS:
            yield from closing(len(stack) - 1)
        sym, hint = described(tag, m[3])
        stack.append(tag)
        open_[tag] += 1
        yield "<", sym, hint
    if texts and (found := text()):
        yield found
    yield from closing(0)


def stream(source: str | None) -> tuple[list[Token], list[str]]:
    """The page's folded token stream, which is its own wrapper, and its texts in order."""
    out: list[Token] = []
    texts: list[str] = []
    levels: list[list[int]] = [[]]  # where the blocks of each open level start
    starts: list[int] = []
    for e in events(source):
        if e[0] == "<":
            starts.append(len(out))
            levels.append([])
            out.append(Token("<", e[1], e[2]))
            continue
        if e[0] == "#":
            t = Token("#", "#", "", chars=len(e[1]), links=e[2], value=e[1] if len(e[1]) <= 80 else "\2" + _digest(e[1]))
            t.at.append(len(texts))
            texts.append(e[1])
            if len(starts) > 1 and out[starts[-1]].tag in HEADINGS and len(e[1]) < 60 and starts[-1] == starts[-2] + 1 and out[starts[-2]].tag in ("section", "div") and out[starts[-2]].hint != "strong":
                out[starts[-2]].hint = "away" if AWAY.fullmatch(e[1]) else "comments" if AWAY_COMMENTS.fullmatch(e[1]) else out[starts[-2]].hint
            levels[-1].append(len(out))
            out.append(t)
        else:
            start = starts.pop()
            out[start].shape = frozenset(out[k].sym for k in levels.pop() if out[k].kind == "<")
            if out[start].hint == "comments":
                out[start].hint = "" if all(x.split(".", 1)[0] in PLAIN for x in out[start].shape) else "away"
            out.append(END)
            levels[-1].append(start)
        _fold(out, levels[-1])
    return out, texts


def _digest(text: str) -> str:
    return "\0" + xxhash.xxh3_64_hexdigest(text.encode("utf-8", "surrogatepass"))


def _number(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


# Alignment ------------------------------------------------------------------------------------


@lru_cache(maxsize=20_000)
def _near_names(a: str, b: str) -> bool:
    x, y = set(a.split(".")), set(b.split("."))
    shared = len((x & y) - {a.split(".", 1)[0]})
    return shared > 0 and 2 * shared >= len(x | y) - 1


def alike(a: Token, b: Token) -> bool:
    """Whether what the tokens start may be the same part of a template."""
    if a.kind != b.kind or a.tag != b.tag or a.hint != b.hint or a.sym != b.sym and (a.kind == "(" or not _near_names(a.sym, b.sym)):
        return False
    return a.kind != "<" or a.tag in LEAF_TAGS or not a.shape or not b.shape or 2 * len(a.shape & b.shape) >= min(len(a.shape), len(b.shape))


def _same(a: Token, b: Token) -> bool:
    """Whether two blocks of a page are turns of one: unlike names never are, however near."""
    return a.sym == b.sym and alike(a, b)


def _counted(a: dict[int, int], b: dict[int, int]) -> dict[int, int]:
    """The counts of both; of more than MOST_TEXTS texts the most frequent stay, less what the next one has."""
    out = dict(a)
    for text, n in b.items():
        out[text] = out.get(text, 0) + n
    if len(out) > MOST_TEXTS:
        less = sorted(out.values(), reverse=True)[MOST_TEXTS]
        out = {text: n - less for text, n in out.items() if n > less}
    return out


def _again(a: Token, b: Token) -> None:
    """Slot a also stands for b, which comes after it in the same page."""
    a.value, a.votes, a.chars, a.links = _digest(a.value + "\1" + b.value), 1, a.chars + b.chars, a.links + b.links
    a.at.extend(b.at)


def _blend(a: Token, b: Token, same_page: bool) -> Token:
    """One token for two of as many pages, or for two occurrences in one page."""
    out = Token(a.kind, a.sym, a.hint if a.hint == b.hint else "strong" if "strong" in (a.hint, b.hint) and a.sym == b.sym else "", a.shape | b.shape, max(a.n, b.n) if same_page else a.n + b.n, a.chars + b.chars, a.links + b.links)
    out.repeated, out.optional, out.label = a.repeated or b.repeated, a.optional or b.optional, a.label
    out.at = a.at or b.at
    if a.at and b.at:
        a.at.extend(b.at)
    if a.kind == "#":
        if same_page:
            out.value, out.votes = _digest(a.value + "\1" + b.value), 1
        elif a.value == b.value:
            out.value, out.votes = a.value, a.votes + b.votes
        else:  # the leading value, by as much as it leads
            lead = max(a, b, key=lambda t: (t.votes, t.value))
            out.value, out.votes = lead.value, abs(a.votes - b.votes)
        out.seen, out.turns = _counted(a.seen, b.seen), a.turns + b.turns
    return out


def aligned(a: list[Token], b: list[Token], same_page: bool = False, met: Callable[[Token | None, Token, Token | None], None] | None = None) -> list[Token]:
    """One stream for two. With met(of a or None, of b, the block of a around it) none is made, but told what each block of b meets; one that meets nothing is told whole."""
    out: list[Token] = []
    to_a, to_b = ends(a), ends(b)
    around: list[Token | None] = []
    lone: list[str] = []  # which side of each open group has no group of its own
    i = j = 0
    while i < len(a) or j < len(b):
        x, y = a[i] if i < len(a) else END, b[j] if j < len(b) else END
        if x is END and lone and lone[-1] == "b" or y is END and lone and lone[-1] == "a":
            out.append(END)
            i, j = i + (lone[-1] == "b"), j + (lone[-1] == "a")
            around.pop()
            lone.pop()
        elif x is END and y is END:
            out.append(END)
            i, j = i + 1, j + 1
            around.pop()
            lone.pop()
        elif x is not END and y is not END and alike(x, y):
            if met:
                met(x, y, around[-1] if around else None)
            else:
                out.append(_blend(x, y, same_page))
            if x.kind != "#":
                around.append(x)
                lone.append("")
            i, j = i + 1, j + 1
        elif x.kind == "(" != y.kind and y is not END and _holds(a, i, to_a, b, j, to_b):  # a group on one side meets one turn of it
            out.append(x)
            around.append(x)
            lone.append("b")
            i += 1
        elif y.kind == "(" != x.kind and x is not END and _holds(b, j, to_b, a, i, to_a):
            out.append(y)
            around.append(around[-1] if around else None)
            lone.append("a")
            j += 1
        else:
            skip_a, skip_b = _agree(a, i, to_a, b, j, to_b)
            for tokens, first, last in ((a, i, skip_a), (b, j, skip_b)):
                k, to = first, to_a if tokens is a else to_b
                while k < last:
                    if not met:
                        tokens[k].optional = True
                        out += tokens[k : to[k] + 1]
                    elif tokens is b:
                        met(None, b[k], around[-1] if around else None)
                    k = to[k] + 1
            i, j = skip_a, skip_b
    return out


def _holds(a: list[Token], i: int, to_a: list[int], b: list[Token], j: int, to_b: list[int]) -> bool:
    """Whether the parts of the group at a[i] are alike, one by one, to the blocks from b[j] on."""
    k, end = i + 1, to_a[i]
    while k < end:
        if j >= len(b) or not alike(a[k], b[j]):
            return False
        k, j = to_a[k] + 1, to_b[j] + 1
    return True


def _agree(a: list[Token], i: int, to_a: list[int], b: list[Token], j: int, to_b: list[int]) -> tuple[int, int]:
    """The nearest later places on this level where the streams agree, or the level's ends."""

    def blocks(tokens: list[Token], k: int, to: list[int]) -> list[int]:
        found = []
        while k < len(tokens) and tokens[k] is not END and len(found) < LOOK:
            found.append(k)
            k = to[k] + 1
        return [*found, k]

    left, right = blocks(a, i, to_a), blocks(b, j, to_b)
    places: dict[tuple[str, str], list[int]] = {}
    for m, k in enumerate(right[:-1]):
        places.setdefault((b[k].kind, b[k].tag), []).append(m)
    best = len(left) + len(right)
    found = left[-1], right[-1]
    for n, k in enumerate(left[:-1]):
        if n >= best:
            break
        for m in places.get((a[k].kind, a[k].tag), ()):
            if n + m >= best:
                break
            if alike(a[k], b[right[m]]):
                best, found = n + m, (k, right[m])
                break
    return found


def _fold(out: list[Token], blocks: list[int]) -> None:
    """The last block of a level joins what it repeats: its neighbour, the end of a group, a turn of a group, or a new group."""
    if len(blocks) < 2:
        return
    last, new = blocks[-2:]
    if _same(out[last], out[new]):
        if new - last == 3 == len(out) - new and out[last + 1].kind == out[new + 1].kind == "#" or out[new].kind == "#":  # as most are: one text each
            _again(*(out[last], out[new]) if out[new].kind == "#" else (out[last + 1], out[new + 1]))
            out[last].repeated = True
            del out[new:]
            blocks.pop()
            return
        made = aligned(out[last:new], out[new:], True)
        made[0].repeated = True
        out[last:] = made
        blocks.pop()
        return
    if out[last].kind == "(":
        part = last + 1
        to = ends(out[last:new])
        while last + to[part - last] + 2 < new:
            part = last + to[part - last] + 1
        if _same(out[part], out[new]):
            made = aligned(out[part : new - 1], out[new:], True)
            made[0].repeated = True
            out[part:] = [*made, END]
            blocks.pop()
            return
    syms = [out[k].sym for k in blocks[-PERIOD - 1 :]]
    for p in range(2, min(PERIOD, len(blocks) - 1) + 1):
        group = blocks[-p - 1]
        if out[group].kind == "(" and out[group].sym == " ".join(syms[-p:]):
            turn = blocks[-p]
            head = out[group]
            made = aligned(out[group + 1 : turn - 1], out[turn:], True)
            out[group:] = [head, *made, END]
            del blocks[-p:]
            return
    for p in range(2, min(PERIOD, len(blocks) // 2) + 1):
        one, two = blocks[-2 * p], blocks[-p]
        if all(out[x].kind != "(" and _same(out[x], out[y]) for x, y in zip(blocks[-2 * p : -p], blocks[-p:], strict=True)):
            head = Token("(", " ".join(out[k].sym for k in blocks[-2 * p : -p]))
            head.repeated = True
            out[one:] = [head, *aligned(out[one:two], out[two:], True), END]
            del blocks[-2 * p + 1 :]
            return


def add(known: list[Token] | None, new: list[Token]) -> list[Token]:
    """The wrapper of all pages of both; its first token counts them."""
    if known is None:
        return new
    made = aligned(known, new)
    if len(made) > MOST_TOKENS:
        to, rare = ends(made), sorted(t.n for t in made if t.optional)
        least, kept, k = rare[len(rare) // 2] if rare else 0, [], 0
        while k < len(made):
            if made[k].optional and made[k].n <= least:
                k = to[k] + 1
                continue
            kept.append(made[k])
            k += 1
        made = kept
    return made


def wrapper(source: str | None) -> list[Token]:
    """A page's own wrapper, under one block that counts pages."""
    own, texts = stream(source)
    for t in own:
        if t.at:
            t.seen, t.turns = dict.fromkeys((_number(texts[k]) for k in t.at), 1), len(t.at)
            t.at = []
    return [Token("<", "page"), *own, END]


def expression(tokens: list[Token]) -> str:
    """The wrapper as a union-free regular expression: (...)+ repeats, (...)? is optional, # is a text slot, quoted texts never differ (long ones as "...")."""
    out, open_, space = [], [], ""
    for t in tokens:
        if t.kind == ">":
            out.append(open_.pop())
            space = " "
            continue
        marks = "+" * t.repeated + "?" * t.optional
        before, after = (space + "(", f"){marks}") if marks else (space, "")
        if t.kind == "#":
            body = "#" if t.votes < t.n or t.value[:1] == "\0" else '"..."' if t.value[:1] == "\2" else json.dumps(t.value, ensure_ascii=False)
            out.append(before + body + after)
            space = " "
        else:
            out.append(before + (f"<{t.sym}>" if t.kind == "<" else ""))
            open_.append((f"</{t.tag}>" if t.kind == "<" else "") + after)
            space = ""
    return "".join(out)


# Labels ---------------------------------------------------------------------------------------


def by_element(t: Token, in_main: bool) -> bool:
    """Whether the element itself says that it is no part of an article."""
    return t.tag in DROPPED_TAGS or t.hint == "hidden" or t.tag == "header" and not in_main


def by_name(t: Token, in_main: bool) -> bool:
    """Whether its names say so; they break the tie between regions that vary alike."""
    return t.tag not in ("main", "page") and (t.hint in ("strong", "away") or t.hint in ("weak", "links") and not in_main and t.tag != "article")


def of_links(tokens: list[Token], first: int, last: int) -> bool:
    """Whether a block is named as a menu and most of its text is links."""
    return tokens[first].hint == "links" and 2 * sum(t.links for t in tokens[first : last + 1]) > sum(t.chars for t in tokens[first : last + 1])


def label(tokens: list[Token]) -> list[Token]:
    """Sets label on every token: m where the main text is, else empty."""
    to, n = ends(tokens), len(tokens)
    least = max(LEAST_PAGES, LEAST_SHARE * tokens[0].n) if tokens else 0
    same = [t.kind == "#" and t.n >= least and t.votes >= 0.8 * t.n for t in tokens]

    def over(value: Callable[[int, Token], int]) -> Callable[[int], int]:
        """The sum of a value over the texts of what a token starts."""
        sums = [0] * (n + 1)
        for k, t in enumerate(tokens):
            sums[k + 1] = sums[k] + (value(k, t) if t.kind == "#" else 0)
        return lambda k: sums[to[k] + 1] - sums[k]

    chars, links, varying = over(lambda k, t: t.chars), over(lambda k, t: t.links), over(lambda k, t: 0 if same[k] else t.chars)
    content = over(lambda k, t: 0 if same[k] else t.chars - t.links)
    holds = [0] * (n + 1)  # articles and main regions before a token
    for k, t in enumerate(tokens):
        holds[k + 1] = holds[k] + (t.kind == "<" and t.tag in ("article", "main") and t.hint != "strong")

    articles, mains, named = [], [], set()
    own: dict[int, int] = {}  # content of a block's own leaves, less that of links
    path, in_article, k = [], 0, 0
    while k < n:
        t = tokens[k]
        if t.kind == ">":
            in_article -= tokens[path.pop()].tag == "article"
            k += 1
            continue
        if t.kind == "<" and (by_element(t, in_article > 0) or by_name(t, in_article > 0) and holds[to[k]] == holds[k + 1]):
            k = to[k] + 1
            continue
        holder = next((p for p in reversed(path) if tokens[p].kind == "<"), 0)
        if t.kind == "<" and t.tag in LEAF_TAGS or t.kind == "#" and tokens[holder].tag not in LEAF_TAGS:
            own[holder] = own.get(holder, 0) + content(k) - links(k)
        if t.kind != "#":
            if t.tag == "article" and not in_article:
                articles.append(k)
            elif t.tag == "main" or "main" in t.sym.split(".")[1:]:
                mains.append(k)
            if t.hint == "main":
                named.add(k)
            path.append(k)
            in_article += t.tag == "article"
        k += 1
    total = sum(max(v, 0) for v in own.values())
    chosen = [k for k in articles if content(k) > 0.2 * total] or [k for k in mains if content(k) > 0.2 * total][:1]
    marked_up = bool(chosen)
    if not chosen and own and max(own.values()) > 0:
        best = max(own.values())
        close = [k for k, v in own.items() if v >= 0.8 * best]
        chosen = [next((k for k in close if k in named), next(k for k in close if own[k] == best))]
        chosen = [max((k for k in named if k < chosen[0] <= to[k]), default=chosen[0])]  # the innermost block around it whose name says content and the like
    titled = bool(chosen) and (chosen[0] in named or chosen[0] in mains)
    for first in chosen:
        varies = varying(first) >= LEAST_VARYING * max(1, chars(first))
        _know(tokens[first : to[first] + 1], least)
        k = first
        while k <= to[first]:
            t = tokens[k]
            if t.kind == ">":
                k += 1
                continue
            never = varies and chars(k) and not varying(k)  # the template's, but for a heading of what varies
            if never and t.tag in HEADINGS and to[k] + 1 < n and varying(to[k] + 1):
                for m in range(k, to[k]):
                    tokens[m].label = "m"
                k = to[k] + 1
                continue
            if k != first and t.kind == "<":
                linked = t.tag not in ("p", *HEADINGS) and links(k) > 0.6 * chars(k)
                if never or by_element(t, True) or by_name(t, True) or of_links(tokens, k, to[k]) or linked and (t.hint == "weak" or not marked_up and not titled):
                    k = to[k] + 1
                    continue
            t.label = "" if never else "m"
            k += 1
    return tokens


def _know(region: list[Token], least: float) -> None:
    """Sets known on the region's slots: texts that four of five pages have beside others, as an advert among paragraphs has. Not where most texts are such: then pages are copies."""
    found, path = [], []
    for t in region:
        if t.kind == ">":
            path.pop()
        elif t.kind != "#":
            path.append(t.tag)
        elif t.n >= least and not (path and path[-1] in (*HEADINGS, "th", "dt")):
            found.append((t, {text: n for text, n in t.seen.items() if n >= 0.8 * t.n}))
    if 2 * sum(sum(x.values()) for _, x in found) <= sum(t.turns for t in region if t.kind == "#"):
        for t, x in found:
            t.known = frozenset(x)


def main_text(page: list[Token], texts: list[str], known: list[Token]) -> str:
    """The page's texts that meet main slots of a labelled wrapper, in page order."""
    to, places = ends(page), {id(t): k for k, t in enumerate(page)}
    kept: list[int] = []

    def met(like: Token | None, own: Token, around: Token | None) -> None:
        if like is not None:
            if own.kind == "#" and like.label:
                kept.extend(k for k in own.at if _number(texts[k]) not in like.known) if like.known else kept.extend(own.at)
        elif around is not None and around.label:
            k = places[id(own)]
            end = to[k]
            while k <= end:
                t = page[k]
                if t.kind == "<" and (by_element(t, True) or by_name(t, True) or of_links(page, k, to[k])):
                    k = to[k] + 1
                    continue
                if t.kind == "#":
                    kept.extend(t.at)
                k += 1

    aligned(known, page, met=met)
    return " ".join(texts[k] for k in sorted(kept))


def extract(source: str | None, known: list[Token] | None) -> str:
    own, texts = stream(source)
    if not texts:
        return ""
    page = [Token("<", "page"), *own, END]
    text = main_text(page, texts, known) if known is not None else ""
    return text or _alone(page, texts)


def _alone(page: list[Token], texts: list[str]) -> str:
    return " ".join(texts[k] for k in sorted(k for t in label(page) if t.kind == "#" and t.label for k in t.at))


# Over tables ----------------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]+://([^/?#]*)", 1))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[Token]] = {}

    def out() -> pa.RecordBatch:
        rows = [(h, pack(w)) for h, w in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["host", "wrapper"])

    for batch in batches:
        for host, source in zip(batch["host"], batch["html"], strict=True):
            held[host.as_py()] = add(held.get(host.as_py()), wrapper(source.as_py()))
        if len(held) > HELD_HOSTS:
            yield out()
    yield out()


def _joined(last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known = None
        for x in sorted(pdf["wrapper"]):  # in an order of its own, so that a second run gives the same wrapper
            known = add(known, unpack(x))
        if last:
            for t in label(known):  # pages need no counts
                if t.kind == "#":
                    t.seen = {}
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [pack(known)]})

    return run


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from pages (host, html): one labelled wrapper for each host."""
    partial = pages.mapInArrow(_partial, "host string, wrapper string").withColumn("way", F.pmod(F.xxhash64("wrapper"), F.lit(WAYS)))
    some = partial.groupBy("host", "way").applyInPandas(_joined(False), "host string, wrapper string")
    return some.groupBy("host").applyInPandas(_joined(True), "host string, wrapper string")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most: int = MOST_WRAPPERS) -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    rows = pages.select(F.col(id_col).alias("id_"), F.col(url_col).alias("url_"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    known = materialise(wrappers(rows.select("host", "html")))
    size = known.limit(most + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("wrapper")), F.lit(0)).alias("bytes")).first()
    if size["n"] <= most and size["bytes"] <= MOST_BYTES:
        sent = {r["host"]: r["wrapper"] for r in known.toLocalIterator()}
        shared = pages.sparkSession.sparkContext.broadcast(sent)
        wrapper_of = lambda v: shared.value.get(v["host"])
        paired = rows.select("id_", "url_", F.struct("host", "html").alias("page"))
    else:
        wrapper_of = lambda v: v["wrapper"]
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = rows.withColumn("salt", F.pmod(F.xxhash64("id_", "url_"), F.lit(SALTS)).cast("int"))
        paired = dealt.join(salted, ["host", "salt"], "left").select("id_", "url_", F.struct("host", "html", "wrapper").alias("page"))

    def make() -> Callable:
        read = lru_cache(maxsize=256)(unpack)

        def of(values: list) -> list:
            return [[extract(v["html"], read(w) if (w := wrapper_of(v)) else None) for v in values]]

        return of

    made = with_made(paired, "page", "text string", make)
    return made.select(F.col("id_").alias(id_col), F.col("url_").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
