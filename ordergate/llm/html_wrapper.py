"""Main text of web pages with wrappers inferred per host.

A page is a stream of tags and texts. A host's wrapper is a union-free regular
expression over such streams: tags, text slots, optional groups and repeated
groups. It is inferred by alignment, page after page: adjacent equal
structures fold into repeated groups; where page and wrapper differ, texts become
slots, a single structure against a repeated group joins the group, and anything else
becomes optional. Every page of a host is aligned: each scan task folds its pages
into one wrapper per host, and partial wrappers are aligned with each other in rounds
of at most FAN, so no task holds a host's pages.

Every page is matched with its host's expression, which tells the texts that stand unchanged at
their place from those in slots. Extraction keeps the blocks of the page's articles that hold
a slot (all articles where none does), or, in pages without one, of the smallest container of
all text that the page does not share with its host, outside menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments. Within an article
nothing goes for being constant, and a section or anything with a heading or paragraph
does not go for its name alone: only if all its text is constant at its place, or most of
it links. Without an article those texts are left out that the wrapper holds as constant
at their place (unless nothing else is there).

Pages are read in linear time, whatever they nest or leave open.

Defined results: null or empty html gives empty text; pages without a
recognisable host are wrapped together; a tag whose quotes never close ends at the next
``>``, one without any at the next ``<``, other markup that never ends at the end of
the page; self-closed elements hold nothing; repeated pages give the same text; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import functools
import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordergate.llm.common import store

FAN = 32             # partial wrappers that one task aligns
OPTIONS = 32         # adjacent optional groups from which on anything is allowed there
BROADCAST = 16 << 20  # bytes of wrappers up to which extraction broadcasts them
PAIRS = 1 << 20      # token pairs compared between two anchors; larger stretches count as different

#: A tag with closed quotes and no angle brackets in them; each try ends at the next bracket.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)[^<>\"']*+(?:(?:\"[^\"<>]*+\"|'[^'<>]*+')[^<>\"']*+)*+>")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)")
KIND = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
          "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
          "tt", "u", "var", "wbr"}
#: Tags that an opening tag of the same group ends.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}}
OUT = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "button", "select", "fieldset"}
OUT_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
             "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "masthead", "sidebar", "aside", "widget",
             "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter",
             "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "comment",
             "comments", "reply", "replies", "respond", "disqus", "pagination", "pager", "toolbar", "copyright",
             "complementary", "contentinfo", "search"}
#: Words and tags that mark boilerplate even where it is most of a page.
FIRM = {"comment", "comments", "reply", "replies", "respond", "disqus", "ad", "ads", "advert", "adverts", "advertisement", "advertising",
        "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "copyright"} | OUT - {"form", "fieldset"}
#: What an article holds for its readers' eyes only by its name; other names need more inside one.
ADVERTS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "cookie", "cookies", "consent", "gdpr",
           "newsletter", "subscribe", "popup", "modal", "overlay"}
TEXT_PARTS = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
COMMENTS = {"comment", "comments", "reply", "replies", "respond", "disqus"}
#: Last words that say how a thing is laid out; the word before them says what it is ("share-links", "sidebar-left").
LAYOUT = {"links", "link", "list", "lists", "item", "items", "box", "block", "bar", "container", "wrapper", "wrap", "area", "section",
          "button", "buttons", "icon", "icons", "form", "panel", "widget", "widgets", "slot", "unit", "row", "col", "column", "inner",
          "outer", "content", "left", "right", "top", "bottom", "primary", "secondary", "posts", "articles", "stories", "text", "title",
          "this", "group", "message", "body"}
#: Words that make a name speak of what else is there ("with-sidebar").
STATES = {"with", "without", "has", "no", "not", "is", "show", "hide", "before", "after", "above", "below"}
ARTICLE_PARTS = {"entry", "post", "article", "story", "content", "section", "title"}
PAGE_HEADS = {"header"}
MAIN = {"article", "main"}
HOLDERS = {"article", "main", "section", "div", "td", "body"}


def _role(name: str) -> str:
    """What a class, id or role says the element is: "ad" for top-ad and adBox, nothing for with-sidebar."""
    words = [w.lower() for w in WORD.findall(name)]
    while len(words) > 1 and words[-1] in LAYOUT:
        words.pop()
    if not words or STATES & set(words[:-1]) or words[-1] == "header" and ARTICLE_PARTS & set(words[:-1]):
        return ""
    return words[-1]


@functools.lru_cache(maxsize=4096)
def _key(name: str, tag: str) -> tuple[str, str, bool]:
    """(name with class, id and role; the tag or role word that marks something outside the main text, or nothing;
    whether it is the tag)."""
    kinds = [(k.lower(), a or b or c) for k, a, b, c in KIND.findall(tag)]
    out = name if name in OUT or name in PAGE_HEADS else ""
    by_tag = bool(out)
    if not out and name not in ("html", "body"):
        roles = {_role(v) for _, value in kinds for v in value.split()}
        # An article can be a reader's comment; nothing else takes a main element out.
        marks = roles & COMMENTS if name == "article" else set() if name in MAIN else roles & (OUT_WORDS | PAGE_HEADS)
        out = min(marks, key=lambda w: (w in PAGE_HEADS, w not in FIRM, w), default="")
    # Numbers in names differ from page to page.
    return name + "".join(f".{re.sub('[0-9]+', '0', v)}" for _, v in sorted(kinds)), out, by_tag


def scan(source: str):
    """The page's parts in order: (0, text), (1, tag, name) for a start tag, (2, tag, name) for an end tag."""
    at, quotes = 0, None
    while True:
        start = source.find("<", at)
        if start < 0:
            yield 0, source[at:], ""
            return
        if start > at:
            yield 0, source[at:start], ""
        m = TAG.match(source, start)
        if m:
            at, tag, name = m.end(), m[0], m[2].lower()
        elif source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            if end < 0:
                return
            at = end + 3
            continue
        elif source.startswith(("<!", "<?"), start):
            end = source.find(">", start)
            if end < 0:
                return
            at = end + 1
            continue
        else:
            m = NAME.match(source, start)
            if not m:
                at = start + (2 if source.startswith("</", start) else 1)
                yield 0, source[start:at], ""
                continue
            quotes = quotes or _Quotes(source)
            at, name = quotes.end(m.end()), m[2].lower()
            tag = source[start:at]
        if m[1]:
            yield 2, tag, name
            continue
        if name in RAW:
            if not tag.endswith("/>"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
            continue
        yield 1, tag, name


class _Quotes:
    """Ends of tags that hold angle brackets in quotes or do not end; linear over a page."""

    def __init__(self, source: str):
        self.at = {c: [m.start() for m in re.finditer(c, source)] for c in "<>\"'"}
        self.length = len(source)
        self.dead: set[int] = set()     # quotes from which no tag ends

    def _next(self, c: str, at: int) -> int:
        places = self.at[c]
        i = bisect_left(places, at)
        return places[i] if i < len(places) else self.length

    def end(self, at: int) -> int:
        opened, here = [], at
        while True:
            close = self._next(">", here)
            if close == self.length:
                break
            quote, mark = min((self._next(c, here), c) for c in "\"'")
            if close < quote:
                return close + 1
            if quote in self.dead:
                break
            opened.append(quote)
            here = self._next(mark, quote + 1) + 1
            if here > self.length:
                break
        self.dead.update(opened)
        close = self._next(">", at)
        return close + 1 if close < self.length else self._next("<", at)


class Block(NamedTuple):
    text: str
    node: int        # the container that holds it
    mark: int        # the nearest element that is marked as boilerplate, -1
    inside: int      # number of the article (or <main>) it stands in, from 1; 0 for none
    linked: int      # letters in links


class Page:
    """Tokens of a page and its text blocks.

    Containers form a tree of distinct paths, marked elements one of their own, so
    that nothing is copied for a block however deep it stands."""

    def __init__(self, source: str):
        self.tokens: list[tuple] = []   # ("t", key) and ("s", text)
        self.blocks: list[Block] = []
        self.parent, self.path = [-1], [0]                 # of each container: the one above, a hash of its path
        self.depth, self.body = [0], [True]
        self._nodes: dict[tuple[int, str], int] = {}
        self.word, self.above, self.soft, self.by_tag = [], [], [], []   # of each marked element
        self.structured, self.main, self.article = [], [], []            # whether it holds text parts, <main>, an <article>
        self._stack: list[tuple[str, int, int, int]] = []  # name, container, marked element, article
        self._open: Counter = Counter()
        self._articles = 0
        self._text: list[str] = []
        self._linked = 0
        for kind, raw, name in scan(source):
            if kind == 0:
                self._text.append(raw)
                if self._open["a"]:
                    self._linked += len(raw.strip())
            elif kind == 1:
                self._start(name, raw)
            else:
                self._end(name)
        self._flush()
        self._settle()

    def _here(self) -> tuple[int, int, int]:
        return self._stack[-1][1:] if self._stack else (0, -1, 0)

    def _flush(self) -> None:
        text = " ".join(entities.unescape("".join(self._text)).split())
        self._text = []
        if text:
            node, mark, inside = self._here()
            self.blocks.append(Block(text, node, mark, inside, self._linked))
            self.tokens.append(("s", text))
        self._linked = 0

    def _pop(self) -> str:
        name = self._stack.pop()[0]
        self._open[name] -= 1
        return name

    def _start(self, name: str, tag: str) -> None:
        if name not in INLINE:
            self._flush()
        if name in ENDS or name not in INLINE:
            ends = ENDS.get(name, {"p"} if name not in VOID else NOTHING)
            while self._stack and (self._stack[-1][0] in ends or self._stack[-1][0] in INLINE and any(self._open[e] for e in ends)):
                self._pop()
        key, word, by_tag = _key(name, tag)
        self.tokens.append(("t", key))
        node, mark, inside = self._here()
        if name in TEXT_PARTS and mark >= 0:
            self.structured[mark] = True
        if name in VOID or tag.endswith("/>"):
            return
        if name in HOLDERS:
            node = self._container(node, key)
        if word:
            soft = bool(inside) and not by_tag and word not in COMMENTS and word not in ADVERTS and word not in PAGE_HEADS
            for column, value in ((self.word, word), (self.above, mark), (self.soft, soft), (self.by_tag, by_tag),
                                  (self.structured, name == "section"), (self.main, False), (self.article, False)):
                column.append(value)
            mark = len(self.word) - 1
        elif name in MAIN:
            if mark >= 0:
                (self.main if name == "main" else self.article)[mark] = True
        if name in MAIN and not inside:
            self._articles += 1
            inside = self._articles
        self._stack.append((name, node, mark, inside))
        self._open[name] += 1

    def _container(self, above: int, key: str) -> int:
        if (above, key) not in self._nodes:
            self._nodes[above, key] = len(self.parent)
            self.parent.append(above)
            self.path.append(xxhash.xxh64_intdigest(key.encode(), self.path[above]) >> 1)
            self.depth.append(self.depth[above] + 1)
            self.body.append(above == 0 and key.partition(".")[0] == "body")
        return self._nodes[above, key]

    def _end(self, name: str) -> None:
        if name not in INLINE:
            self._flush()
        if self._open[name]:
            while self._pop() != name:
                pass
            self.tokens.append(("t", "/" + name))

    def has_article(self) -> bool:
        return any(b.inside and not out for b, out in zip(self.blocks, self.outside))

    def _up(self, of_blocks: list[int]) -> list[int]:
        """Sums over the blocks of each marked element (elements stand after those that hold them)."""
        total = [0] * len(self.word)
        for b, value in zip(self.blocks, of_blocks):
            if b.mark >= 0:
                total[b.mark] += value
        for n in range(len(total) - 1, -1, -1):
            if self.above[n] >= 0:
                total[self.above[n]] += total[n]
        return total

    def _held(self, free: list[bool]) -> list[bool]:
        """Whether a marked element that is not free holds each block; headings of articles are no page heads."""
        any_, inner = [], []
        for n, word in enumerate(self.word):
            up = self.above[n]
            any_.append(not free[n] or up >= 0 and any_[up])
            inner.append(not free[n] and word not in PAGE_HEADS or up >= 0 and inner[up])
        return [b.mark >= 0 and (inner if b.inside else any_)[b.mark] for b in self.blocks]

    def _settle(self) -> None:
        """Which blocks are outside. A marked element is not, whatever its name, if it holds
        <main>, the page's only articles or, its mark not being firm, most of the text."""
        n = len(self.word)
        for i in range(n - 1, -1, -1):
            if self.above[i] >= 0:
                self.main[self.above[i]] |= self.main[i]
                self.article[self.above[i]] |= self.article[i]
                self.structured[self.above[i]] |= self.structured[i]
        self.soft = [s and t for s, t in zip(self.soft, self.structured)]     # decided with the wrapper
        free = [m or s for m, s in zip(self.main, self.soft)]
        held = self._held(free)
        if not any(b.inside and not h for b, h in zip(self.blocks, held)):
            free = [f or a and w not in COMMENTS for f, a, w in zip(free, self.article, self.word)]
            held = self._held(free)
        plain = [plain_size(b) for b in self.blocks]
        size = self._up(plain)
        free = [f or w not in FIRM and w not in PAGE_HEADS and not a and 2 * k > sum(plain)
                for f, w, a, k in zip(free, self.word, self.article, size)]
        held = self._held(free)
        if held and all(held):  # nothing is left: then what only a name marks is the page's text
            held = self._held([f or w not in OUT for f, w in zip(free, self.word)])
        self.outside = held

    def boilerplate(self, constants: set[int]) -> list[bool]:
        """Whether each block is outside, or within a soft mark whose text is all constant or mostly links."""
        if not any(self.soft):
            return self.outside
        blocks = self._up([1] * len(self.blocks))
        fixed = self._up([n in constants for n in range(len(self.blocks))])
        letters, linked = self._up([len(b.text) for b in self.blocks]), self._up([b.linked for b in self.blocks])
        gone: list[bool] = []
        for n in range(len(self.word)):
            own = self.soft[n] and (fixed[n] == blocks[n] or 2 * linked[n] > letters[n])
            gone.append(own or self.above[n] >= 0 and gone[self.above[n]])
        return [out or b.mark >= 0 and gone[b.mark] for out, b in zip(self.outside, self.blocks)]

    def spans(self) -> tuple[list[int], list[int]]:
        """Of each container: its place in depth-first order, and the last place below it."""
        below: list[list[int]] = [[] for _ in self.parent]
        for node, up in enumerate(self.parent):
            if up >= 0:
                below[up].append(node)
        first, last, todo, place = [0] * len(self.parent), [0] * len(self.parent), [(0, False)], 0
        while todo:
            node, done = todo.pop()
            if done:
                last[node] = place - 1
                continue
            first[node] = place
            place += 1
            todo.append((node, True))
            todo += [(x, False) for x in reversed(below[node])]
        return first, last


NOTHING: frozenset = frozenset()


def plain_size(block: Block) -> int:
    """Letters outside links."""
    return max(0, len(block.text) - block.linked)


# ------------------------------------------------------------------ wrappers
# A wrapper is a list of items: ["t", key], ["s", text or None], ["?", items],
# ["+", items] and ["*"] (anything).

def shape(item) -> str:
    kind = item[0]
    return item[1] if kind == "t" else "#" if kind == "s" else "*" if kind == "*" else f"{kind}({shapes(item[1])})"


def shapes(items) -> str:
    return " ".join(map(shape, items))


def fold(items: list) -> list:
    """Adjacent structures of equal shape become one repeated group, shorter ones first."""
    while True:
        names = [shape(x) for x in items]
        period = _period(names)
        if not period:
            return items
        out, i = [], 0
        while i < len(items):
            times = 1
            unit = names[i:i + period]
            while len(unit) == period and names[i + times * period:i + (times + 1) * period] == unit:
                times += 1
            if times > 1 and not (period == 1 and items[i][0] != "+"):
                group = [_all_same(items[i + k:i + times * period:period]) for k in range(period)]
                out.append(group[0] if period == 1 else ["+", group])
                i += times * period
            else:
                out.append(items[i])
                i += 1
        items = out


def flat(items: list) -> list:
    """Tags and texts of the items in order, those of a group once."""
    return [y for x in items for y in (flat(x[1]) if x[0] in "?+" else [x])]


def _period(names: list[str]) -> int:
    """The shortest structure that comes twice in a row, beginning with a name it holds once; 0 if there is none.
    Single tags and texts are no structures."""
    after: dict[str, int] = {}
    least = 0
    for i in range(len(names) - 1, -1, -1):
        j = after.get(names[i], 0)
        after[names[i]] = i
        p = j - i
        if j and (not least or p < least) and (p > 1 or names[i].startswith("+")) and j + p <= len(names) \
                and names[j - 1] == names[j + p - 1] and names[i:j] == names[j:j + p]:
            least = p
    return least


def _all_same(items: list):
    """Items of equal shape as one; differing texts become a slot (numbers of blocks are gathered)."""
    one = items[0]
    if one[0] == "s":
        text = one[1] if all(x[1] == one[1] for x in items) else None
        return ["s", text, [n for x in items for n in x[2]]] if len(one) > 2 else ["s", text]
    if one[0] in "?+":
        return [one[0], [_all_same(list(parts)) for parts in zip(*(x[1] for x in items))]]
    return one


def _same(a, b):
    return _all_same([a, b])


def _resolve(left: list, right: list) -> list:
    """One expression for two differing stretches."""
    if not left and not right:
        return []
    for a, b in ((left, right), (right, left)):
        if len(a) == 1 and a[0][0] in "+?" and shapes(a[0][1]) == shapes(b):
            return [[a[0][0], [_same(x, y) for x, y in zip(a[0][1], b)]]]
        for i, x in enumerate(a):
            if x[0] == "?" and b and shapes(x[1]) == shapes(b):
                return _optional(a[:i]) + [["?", [_same(p, q) for p, q in zip(x[1], b)]]] + _optional(a[i + 1:])
    return _optional(left) + _optional(right)


def _optional(part: list) -> list:
    """A stretch that may be left out."""
    return [] if not part else part if all(x[0] in "?*" for x in part) else [["?", part]]


def matching(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of equal stretches, in order: what both begin and end with, names that
    occur once in each as anchors, and between anchors the longest common stretches."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        k = 0
        while i + k < m and j + k < n and a[i + k] == b[j + k]:
            k += 1
        if k:
            found.append((i, j, k))
        i, j, k = i + k, j + k, 0
        while m - k > i and n - k > j and a[m - k - 1] == b[n - k - 1]:
            k += 1
        if k:
            found.append((m - k, n - k, k))
        m, n = m - k, n - k
        if i == m or j == n:
            continue
        once = {x for x, c in Counter(a[i:m]).items() if c == 1} & {x for x, c in Counter(b[j:n]).items() if c == 1}
        anchors = _rising(a, b, (i, m, j, n), once)
        if anchors:
            for (x, y), (u, v) in zip([(i - 1, j - 1), *anchors], [*anchors, (m, n)]):
                todo.append((x + 1, u, y + 1, v))
            found += [(x, y, 1) for x, y in anchors]
        elif (m - i) * (n - j) <= PAIRS:
            found += [(i + x, j + y, k) for x, y, k in SequenceMatcher(None, a[i:m], b[j:n], autojunk=False).get_matching_blocks() if k]
    return sorted(found) + [(len(a), len(b), 0)]


def _rising(a: list[str], b: list[str], span: tuple, names: set[str]) -> list[tuple[int, int]]:
    """The longest run of common single names that follow each other in both stretches."""
    i, m, j, n = span
    place = {b[y]: y for y in range(j, n) if b[y] in names}
    ends: list[int] = []                     # least last place of runs of each length
    tails: list[int] = []
    pairs = [(x, place[a[x]]) for x in range(i, m) if a[x] in names]
    before = []
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(ends, y)
        before.append(tails[at - 1] if at else -1)
        ends[at:at + 1], tails[at:at + 1] = [y], [k]
    out, k = [], tails[-1] if tails else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(wrapper: list, other: list) -> list:
    """The wrapper that matches what either matches."""
    a, b = [shape(x) for x in wrapper], [shape(x) for x in other]
    out, i, j = [], 0, 0
    for x, y, n in matching(a, b):
        out += _resolve(wrapper[i:x], other[j:y])
        out += [_same(p, q) for p, q in zip(wrapper[x:x + n], other[y:y + n])]
        i, j = x + n, y + n
    run, done = [], []
    for item in [*out, None]:
        if item and item[0] in "?*":
            run.append(item)
            continue
        done += [["*"]] if len(run) > OPTIONS or ["*"] in run else run
        run = []
        if item:
            done.append(item)
    return done


class Wrapper:
    """A host's expression, its number of pages, and where their text lies."""

    def __init__(self, state: str | None = None):
        s = json.loads(state) if state else {"items": None, "pages": 0, "held": []}
        self.items, self.pages = s["items"], s["pages"]
        self.held: set[int] = set(s["held"])        # paths that hold text which is not mostly links
        self._seen: dict[str, list] = {}
        self._places: dict[str, list[tuple[int, str]]] = {}

    def add(self, page: Page) -> None:
        items = fold([list(t) for t in page.tokens])
        self.pages += 1
        seen = set()
        for block, outside in zip(page.blocks, page.outside):
            node = block.node
            while not outside and 2 * block.linked <= len(block.text) and node >= 0 and node not in seen:
                seen.add(node)
                self.held.add(page.path[node])
                node = page.parent[node]
        name = shapes(items)
        known = self._seen.get(name)
        merged = items if known is None else [_same(a, b) for a, b in zip(known, items)]
        if merged != known:
            # Pages of one shape meet first; only news are aligned with the wrapper.
            if len(self._seen) >= 256:
                self._seen.clear()
            self._seen[name] = merged
            self.items = merged if self.items is None else align(self.items, merged)

    def join(self, other: Wrapper) -> None:
        self.items = other.items if self.items is None else self.items if other.items is None else align(self.items, other.items)
        self.pages += other.pages
        self.held |= other.held

    def state(self) -> str:
        return json.dumps({"items": self.items, "pages": self.pages, "held": sorted(self.held)}, ensure_ascii=False)

    def constants(self, page: Page) -> set[int]:
        """Numbers of the page's blocks whose text the expression holds unchanged at their place.

        Page and expression are aligned with each group once; blocks without a place
        in the expression (beyond OPTIONS) are no constants."""
        number, items = 0, []
        for kind, value in page.tokens:
            items.append([kind, value, [number]] if kind == "s" else [kind, value])
            number += kind == "s"
        own = flat(fold(items))
        names = [shape(x) for x in own]
        key = " ".join(names)
        if key not in self._places:
            if len(self._places) >= 256:
                self._places.clear()
            whole = flat(self.items or [])
            self._places[key] = [(y + k, whole[x + k][1])
                                 for x, y, n in matching([shape(x) for x in whole], names)
                                 for k in range(n) if whole[x + k][0] == "s" and whole[x + k][1]]
        return {n for place, text in self._places[key] for n in own[place][2] if page.blocks[n].text == text}


def main_text(page: Page, constants: set[int], plain_paths: set[int] | None) -> str:
    """``constants``: blocks that the host's wrapper holds unchanged at their place; ``plain_paths``: paths below
    which some page of the host has text that is not mostly links (None: no wrapper)."""
    outside = page.boilerplate(constants)
    inside = [n for n, out in enumerate(outside) if not out]
    article = [n for n in inside if page.blocks[n].inside]
    if article:
        # Articles that are the same on all pages are none of this page's, if another holds a slot.
        slots = {page.blocks[n].inside for n in article if n not in constants}
        return " ".join(page.blocks[n].text for n in article if not slots or page.blocks[n].inside in slots)
    linked = {n for n in inside if 2 * page.blocks[n].linked > len(page.blocks[n].text)}
    own = [n for n in inside if n not in constants] or inside
    if not own:
        return ""
    first, last = page.spans()
    places = sorted((first[page.blocks[n].node], page.blocks[n].node) for n in [n for n in own if n not in linked] or own)
    region = places[0][1]
    while last[region] < places[-1][0]:
        region = page.parent[region]
    chosen = [n for n in own if first[region] <= first[page.blocks[n].node] <= last[region]]
    if page.depth[region] == 0 or page.body[region]:
        # The page has no container for its text: containers of links alone are menus.
        if plain_paths is None:
            plain = Wrapper()
            plain.add(page)
            plain_paths = plain.held
        chosen = [n for n in chosen if n not in linked or page.path[page.blocks[n].node] in plain_paths] or chosen
    return " ".join(page.blocks[n].text for n in chosen)


# ------------------------------------------------------------------ Spark

def host_of(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def partial_wrappers(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, part, state): one wrapper per host and scan task."""
    def run(batches):
        found: dict[str, Wrapper] = {}
        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(host, Wrapper()).add(Page(source or ""))
        yield pa.RecordBatch.from_pydict({"host": list(found), "state": [w.state() for w in found.values()]},
                                         pa.schema([("host", pa.string()), ("state", pa.string())]))
    return (pages.select(host_of(F.col(url_col)).alias("host"), html_col).mapInArrow(run, "host string, state string")
            .withColumn("part", F.spark_partition_id()))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, state): one wrapper per host."""
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        whole = Wrapper()
        for _, state in sorted(zip(group["part"].to_pylist(), group["state"].to_pylist())):
            whole.join(Wrapper(state))
        return pa.table({"host": [key[0].as_py()], "state": [whole.state()], "part": pa.array([key[1].as_py()], pa.int32())})
    parts = store(partial_wrappers(pages, url_col, html_col), "wrappers")
    while (most := parts.agg(F.max("part")).first()[0]) not in (None, 0):
        parts = store(parts.withColumn("up", F.floor(F.col("part") / FAN).cast("int")).groupBy("host", "up")
                      .applyInArrow(run, "host string, state string, part int"), "wrappers")
    return parts.select("host", "state")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            broadcast_bytes: int = BROADCAST) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    def run(batches):
        known: dict[str, Wrapper] = {}
        for batch in batches:
            ids, urls, sources, states = (batch.column(i) for i in range(4))
            texts = []
            for source, state in zip(sources.to_pylist(), states.to_pylist()):
                page = Page(source or "")
                if state not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[state] = Wrapper(state)
                texts.append(main_text(page, known[state].constants(page), known[state].held))
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string())], ["page_id", "url", "text"])
    found = wrappers(pages, url_col, html_col).withColumnRenamed("host", "_host")
    size = found.agg(F.sum(F.octet_length("state") + F.octet_length("_host"))).first()[0] or 0
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("_html"),
                        host_of(F.col(url_col)).alias("_host"))
    # Measured; beyond the bound a join by host, whose large hosts can be split.
    side = F.broadcast(found) if size <= broadcast_bytes else found
    kind = pages.schema[id_col].dataType.simpleString()
    return (rows.join(side, "_host", "left").select("page_id", "url", "_html", "state")
            .mapInArrow(run, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long")))
