"""Operator 6: the main text of web pages by wrappers that are inferred for each host.

A page is read into blocks of text and a tree of the elements that hold them; a tree's node lists its children as a union-free regular
expression: elements, text slots (#), optional parts and repeated groups. A page first folds itself: neighbours of one label
(tag and class names) align into one repeated child, and stretches of children that follow each other in the same order into a repeated group.
So pages of one template have few distinct shapes however many paragraphs they hold. A host's distinct shapes are aligned
in groups of GROUP, and then what came of these, until one wrapper is left: children meet by a longest common subsequence of
their labels, what one side lacks becomes optional, and what gets adjacent folds again.

Each shape's slots are then found in its host's wrapper, and what all pages of the host hold in a slot decides over it: whether its
text is the same on nearly all pages, how many of its words are links, how many it has. decide() drops, of the wrapper:
  - parts that a class or id names (whole names: `sidebar`, `comment-list`; `has-sidebar` and `nav-closed` say something else), unless
    they hold an article, or all of the host's text that varies (more than half of it, for names of menus, headers and the like); comments
    only stay where there is nothing else;
  - slots outside of the article whose text stays the same on SHARE of the host's pages (FEW at least);
  - parts outside of the article, but paragraphs and headings, most of whose words are links, over FEW pages or more;
  - repeated records behind the article's text that begin with a few words (a name, a date, in a part of its own tag or name) and go on with
    more: reader comments, however named;
  - everything outside of the article (or else the main part) on pages that have one; articles of less than half the longest one's words are teasers.
Tags that say so themselves go as they are read: nav, header (but an article's own), footer, aside, forms (but one around the page), scripts, styles.

Pages are parsed once; their blocks are a written table, and the rest is counted and joined natively. Nothing of a page's text is cut. Null and
empty html give an empty text. A host with one page has a wrapper of that page. Pages without url share a host of "". Character references are
decoded; white space inside a block becomes one space; blocks are joined by one line feed. Repeated rows each get their text. Elements
more than DEPTH deep count as their ancestor's in the wrapper; their text isn't lost.
"""

from __future__ import annotations

import functools
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, small_batches, table
from .url_filters import host_of

FEW = 5
SHARE = 0.9
#: Shapes that are aligned into one in a task.
GROUP = 64
#: Tasks that share the pages of a hot shape.
SALTS = 32
DEPTH = 60
#: Share of words in links from which a part is a list of links, and words of a record's beginning at most.
LINKED, BRIEF = 0.6, 4

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<svg\b[^>]*/>|<(script|style|noscript|template|textarea|iframe|svg|select)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|</?([A-Za-z][A-Za-z0-9-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: A tag that the end of the page cuts off.
_CUT_OFF = re.compile(r"<[A-Za-z/!?][^<>]*\Z")
_SPACE = re.compile(r"\s+")

# Fixed values of HTML: void elements, blocks, and parts that aren't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
NOT_MAIN = frozenset("nav header footer aside form head button dialog menu".split())
#: Starts that close an open p, the elements through which they don't see it, and formatting that goes on behind it.
CLOSES_P = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
P_SCOPE = frozenset("applet button caption html marquee object table td template th".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words of names. Comments; what isn't an article's own within it either; what is only outside; boxes around a named thing; what makes a name say something else.
COMMENTS = frozenset("comment comments commentary response responses reply replies discussion discussions disqus feedback guestbook notes remarks reviews talkback thread threads".split())
NEVER = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies modal newsletter pager pagination popup promo promos promotion related share sharing sidebar social sponsor sponsored subscribe".split())
OUTSIDE = frozenset("aside complementary contentinfo footer form header masthead menu nav navbar navigation notice notices search toc widget widgets".split())
BOXES = frozenset("area bar block box buttons container inner item items left links list panel right section slot top wrap wrapper".split())
_DENIED, _STATES = frozenset("has hide hidden is no not show with without".split()), frozenset("active closed collapsed disabled enabled expanded fixed layout off on open page sticky theme visible".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 dt th summary figcaption caption".split())
REPEATED, OPTIONAL = 1, 2


@functools.lru_cache(100_000)
def named(name: str) -> str:
    """What a class, an id or a role calls a part: comments, never (not even within an article), outside, or nothing."""
    parts = [x.lower() for x in re.findall(r"[A-Z]?[a-z0-9]+|[A-Z]+", name)]
    if len(parts) > 1 and parts[:2] == ["side", "bar"]:
        parts[:2] = ["sidebar"]
    if not parts or parts[0] in _DENIED or len(parts) > 1 and parts[-1] in _STATES:
        return ""
    first = parts[0]
    while len(parts) > 1 and parts[-1] in BOXES:
        parts.pop()
    if parts[-1] in COMMENTS and first not in ("field", "key", "release"):
        return "comments"
    if parts[-1] in NEVER or first in NEVER:
        return "never"
    if first in COMMENTS:
        return "comments"
    return "outside" if parts[-1] in OUTSIDE else ""


def tokens(page: str | None) -> Iterator[tuple[str, str, str]]:
    """(kind, name, attributes or text): kinds open, close, text."""
    page, at = page or "", 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        if m[2]:
            name = m[2].lower()
            if page[m.start() + 1] == "/":
                yield "close", name, ""
            else:
                yield "open", name, m[3] if "=" in m[3] else ""
    rest = _CUT_OFF.sub("", page[at:])
    if rest:
        yield "text", "", rest


class Node:
    """label: the tag, ! for an article or ~ for a main part, and class names without digits; # for a text slot."""

    __slots__ = ("label", "mark", "kids", "ids")

    def __init__(self, label: str, mark: int = 0, kids: list[Node] | None = None, ids: list[int] | None = None):
        self.label, self.mark, self.kids, self.ids = label, mark, kids or [], ids or []


class Block:
    """A block of text: its words, how many of them are links, the form it stands in (or -1)."""

    __slots__ = ("text", "links", "form")

    def __init__(self, text: str, links: int, form: int):
        self.text, self.links, self.form = text, links, form


def read(page: str | None) -> tuple[Node, list[Block]]:
    """The tree of a page's elements with its blocks, without what tags alone put aside."""
    root = Node("")
    none = ("", False, False, root, -1, -1, 0)
    stack: list[tuple[str, bool, bool, Node, int, int, int]] = []  # name, in the article, dropped, node, place of the p that a block start closes, form outside of an article, depth of the node
    attributes: list[str] = []
    opened: Counter[str] = Counter()  # so that a close tag without its element costs no walk
    whole: set[int] = set()  # forms around an article or a page's heading: the page is wrapped in them
    blocks: list[Block] = []
    tops: list[Node] = []
    parts: list[str] = []
    links, place, forms = 0, none, 0

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                place[3].kids.append(Node("#", ids=[len(blocks)]))
                blocks.append(Block(text, links, place[5]))
            parts, links = [], 0

    def push(name: str, more: str) -> None:
        nonlocal forms
        top = stack[-1] if stack else none
        found = [(k.lower(), a or b or c) for k, a, b, c in _NAMES.findall(more)] if more else []
        main = name == "main" or ("role", "main") in found
        article = name == "article" or any(k == "itemprop" and "articlebody" in v.lower() for k, v in found)
        form = top[5]
        if name == "form" and not top[1] and form < 0:
            form, forms = forms, forms + 1
        elif form >= 0 and (main or article or name == "h1"):
            whole.add(form)
        heading = name == "header" and top[1]  # of the article itself
        drop = top[2] or (name in NOT_MAIN and not heading and not (name == "form" and form >= 0))
        node, depth = top[3], top[6]
        names = [x for k, v in found if k in ("class", "id", "role") for x in v.split()]
        if not drop and name in BLOCK and depth < DEPTH:
            shown = "".join(f".{x}" for x in sorted({re.sub(r"[^A-Za-z_-]", "", x) for x in names if not re.search(r"\d", x)} - {""})) if name not in ("html", "body") else ""
            node = Node(name + ("!" if article else "~" if main else "") + shown)
            top[3].kids.append(node)
            depth += 1
            if article and not top[1]:
                tops.append(node)
        elif not drop and name not in BLOCK and any(named(x) in ("never", "comments") for x in names):
            drop = True  # within a line
        p_at = len(stack) if name == "p" else -1 if name in P_SCOPE else top[4]
        stack.append((name, top[1] or article or main, drop, node, p_at, form, depth))
        attributes.append(more)
        opened[name] += 1

    def cut(n: int) -> None:
        for x in stack[n:]:
            opened[x[0]] -= 1
        del stack[n:], attributes[n:]

    for kind, name, more in tokens(page):
        top = stack[-1] if stack else none
        if kind == "text":
            if not top[2]:
                if not parts:
                    place = top
                parts.append(more)
                if opened["a"]:
                    links += len(more.split())
        elif kind == "open":
            if name in BLOCK:
                flush()
            if name in CLOSES_P and top[4] >= 0:
                again = [(x[0], m) for x, m in zip(stack[top[4] :], attributes[top[4] :], strict=True) if x[0] in FORMATTING]
                cut(top[4])
                seen: Counter[tuple[str, str]] = Counter(again)
                for x in again:  # formatting goes on behind the p, as in HTML at most three times alike
                    if seen[x] <= 3:
                        push(*x)
                    seen[x] -= 1
            if name in VOID:
                continue
            while stack and stack[-1][0] in _CLOSES.get(name, ()):
                cut(len(stack) - 1)
            push(name, more)
        else:
            if name in BLOCK:
                flush()
            if opened[name]:
                n = len(stack) - 1
                while stack[n][0] != name:
                    n -= 1
                if any(x[3] is not (stack[n - 1][3] if n else root) for x in stack[n:]):
                    flush()
                cut(n)
    flush()
    dropped = {i for i, b in enumerate(blocks) if b.form >= 0 and b.form not in whole}
    _prune(root, dropped)
    words = {id(x): sum(len(blocks[i].text.split()) for i in _ids(x)) for x in tops} if len(tops) > 1 else {}
    for x in tops:
        if words and 2 * words[id(x)] < max(words.values()):
            x.label += ".teaser"
    return root, blocks


def _ids(node: Node) -> list[int]:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        out += x.ids
        todo += x.kids
    return out


def _prune(node: Node, dropped: set[int]) -> bool:
    """Leaves out slots of dropped blocks and elements without text. Whether anything is left."""
    if node.label == "#":
        return node.ids[0] not in dropped
    node.kids = [x for x in node.kids if _prune(x, dropped)]
    return bool(node.kids)


def fold(node: Node) -> Node:
    return Node(node.label, node.mark, folded([fold(x) for x in node.kids]), node.ids) if node.kids else node


def folded(kids: list[Node]) -> list[Node]:
    """Neighbours of one label become one repeated child, then stretches that follow each other with the same labels a repeated group."""
    out: list[Node] = []
    for x in kids:
        if out and out[-1].label == x.label:
            out[-1] = merged(out[-1], x)
            out[-1].mark |= REPEATED
        else:
            out.append(x)
    i = 0
    while i < len(out):
        labels, tried = [x.label for x in out[i:]], 0
        for width in (w for w in range(2, len(labels) // 2 + 1) if labels[w] == labels[0]):
            tried += 1
            if labels[:width] == labels[width : 2 * width]:
                n = 2
                while labels[n * width : (n + 1) * width] == labels[:width]:
                    n += 1
                parts = [Node("(" + " ".join(labels[:width]) + ")", REPEATED, out[i + k * width : i + (k + 1) * width]) for k in range(n)]
                out[i : i + n * width] = [functools.reduce(merged, parts)]
                break
            if tried == 8:
                break
        i += 1
    return out


def merged(a: Node, b: Node) -> Node:
    """The wrapper of two nodes of one label."""
    return Node(a.label, a.mark | b.mark, _aligned(a.kids, b.kids) if a.kids or b.kids else [], a.ids + b.ids)


def _aligned(a: list[Node], b: list[Node]) -> list[Node]:
    """Children that are common to both in their order, merged; the others optional."""
    la, lb = [x.label for x in a], [x.label for x in b]
    if la == lb:
        return [merged(x, y) for x, y in zip(a, b, strict=True)]
    n, m = len(la), len(lb)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, label = best[i], best[i + 1], la[i]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if label == lb[j] else below[j] if below[j] >= row[j + 1] else row[j + 1]
    out: list[Node] = []
    i = j = 0
    while i < n and j < m:
        if la[i] == lb[j]:
            out.append(merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    return folded(out + [_optional(x) for x in (*a[i:], *b[j:])])


def _optional(x: Node) -> Node:
    return Node(x.label, x.mark | OPTIONAL, x.kids, x.ids)


def written_out(node: Node) -> list:
    return [node.label, node.mark, [written_out(x) for x in node.kids]]


def read_back(x: list) -> Node:
    return Node(x[0], x[1], [read_back(k) for k in x[2]])


def text_slots(node: Node) -> list[Node]:
    """Its text slots in order: a slot's number is its place here."""
    if node.label == "#":
        return [node]
    return [s for k in node.kids for s in text_slots(k)]


def _shown(node: Node) -> list[str]:
    inner = ["#"] if node.label == "#" else [x for k in node.kids for x in _shown(k)]
    if node.label != "#" and not node.label.startswith("("):
        inner = [f"<{node.label}>", *inner, f"</{node.label}>"]
    return [f"({' '.join(inner)})" + ("*" if node.mark == REPEATED | OPTIONAL else "+" if node.mark & REPEATED else "?")] if node.mark else inner


def shape(page: str | None) -> list[str]:
    """A page's own wrapper as one may read it: tags, text slots and groups, (...)+ repeated and (...)? optional ones."""
    return [x for k in fold(read(page)[0]).kids for x in _shown(k)]


def aligned(a: list[str], b: list[str]) -> list[str]:
    """The wrapper of two lists of parts, as shape gives them."""
    plain = lambda t: re.sub(r"^\((.*)\)[+?]$", r"\1", t)
    node = lambda t: Node(plain(t), (REPEATED if t.endswith(")+") else OPTIONAL if t.endswith(")?") else 0))
    out = _aligned([node(t) for t in a], [node(t) for t in b])
    return [t for x in out for t in ([f"({x.label})" + ("?" if x.mark & OPTIONAL else "+")] if x.mark else [x.label])]


def _spread(kids: list[Node]) -> list[Node]:
    """Children with groups replaced by what they repeat."""
    return [y for x in kids for y in (_spread(x.kids) if x.label.startswith("(") else [x])]


def _pairs(a: list[Node], b: list[Node]) -> list[int]:
    """For each of a the place of its partner in b, or -1: in order, of one label, as alike below as can be; without one in order, the most alike."""
    la, lb = [x.label for x in a], [x.label for x in b]
    below = lambda x: {k.label for k in _spread(x.kids)}
    ka, kb = list(map(below, a)), list(map(below, b))
    worth = [[1 + len(ka[i] & kb[j]) - len(ka[i] - kb[j]) / (1 + len(ka[i])) if x == y else 0 for j, y in enumerate(lb)] for i, x in enumerate(la)]
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], worth[i][j] and best[i + 1][j + 1] + worth[i][j])
    out = [max((j for j in range(len(b)) if worth[i][j]), key=lambda j: worth[i][j], default=-1) for i in range(len(a))]
    i = j = 0
    while i < len(a) and j < len(b):
        if worth[i][j] and best[i][j] == best[i + 1][j + 1] + worth[i][j]:
            if ka[i] <= kb[j] or out[i] < 0 or not ka[i] <= kb[out[i]]:
                out[i] = j
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def places(own: Node, wrapper: Node) -> list[int]:
    """For each text slot of a shape the number of the wrapper's slot in which it stands (-1 if the wrapper doesn't know its like)."""
    number = {id(s): i for i, s in enumerate(text_slots(wrapper))}
    out = {id(s): -1 for s in text_slots(own)}
    todo = [(own, wrapper)]
    while todo:
        x, w = todo.pop()
        if x.label == "#":
            out[id(x)] = number[id(w)]
            continue
        mine, theirs = _spread(x.kids), _spread(w.kids)
        for k, at in zip(mine, _pairs(mine, theirs), strict=True):
            if at >= 0:
                todo.append((k, theirs[at]))
    return list(out.values())


def decide(wrapper: Node, pages: int, held: dict[int, tuple[int, bool, int, int, int]]) -> tuple[list[int], list[int]]:
    """The wrapper's slots that stay on pages that have an article (or a main part), and those that stay on pages without.

    held: of each slot its pages, whether its text is always the same, its texts, their words, and the words in links."""
    slots = text_slots(wrapper)
    number = {id(s): i for i, s in enumerate(slots)}
    of = lambda i: held.get(i, (0, False, 0, 0, 0))
    template = lambda i: of(i)[1] and of(i)[0] >= max(FEW, SHARE * pages)
    inside_of = {id(n): [number[id(s)] for s in text_slots(n)] for n in _elements(wrapper)}
    words = lambda n: sum(of(i)[3] for i in inside_of[id(n)])
    varying = lambda ids: sum(of(i)[3] for i in ids if not template(i))
    everything = varying(range(len(slots)))
    gone: set[int] = set()

    def walk(n: Node, in_article: bool) -> None:
        ids = inside_of[id(n)]
        kinds = {named(x) for x in re.split(r"[.!~]+", n.label)[1:] if x != "teaser"}
        holds = any(re.search("[!~]", x.label) for x in _elements(n))
        much = varying(ids)
        layout = bool(kinds) and kinds <= {"outside", ""}
        if much < everything and (("comments" in kinds) or (not holds and ("never" in kinds or layout and "outside" in kinds and not in_article and 2 * much <= everything))):
            gone.update(ids)
            return
        linked = sum(of(i)[4] for i in ids)
        if not in_article and not holds and pages >= FEW and n.label and not n.label.startswith(("p", "h", "(", "#")) and words(n) and linked >= LINKED * words(n):
            gone.update(ids)
            return
        for k in n.kids:
            if k.label != "#":
                walk(k, in_article or bool(re.search("[!~]", k.label)))
            elif not in_article and pages >= FEW and not n.label.startswith(("p", "h", "(")) and of(number[id(k)])[4] >= LINKED * max(1, of(number[id(k)])[3]):
                gone.add(number[id(k)])

    walk(wrapper, False)
    tops = [n for n in _elements(wrapper) if "!" in n.label]
    tops = [n for n in tops if not any(n is not o and id(n) in {id(x) for x in _elements(o)} for o in tops)] if len(tops) > 1 else tops
    live = lambda n: sum(of(i)[3] for i in inside_of[id(n)] if i not in gone)
    longest = max(map(live, tops), default=0)
    article = [i for n in tops if ".teaser" not in n.label and 2 * live(n) >= longest for i in inside_of[id(n)]]
    mains = [i for n in _elements(wrapper) if "~" in n.label for i in inside_of[id(n)]]
    region = set(article or mains)
    if pages >= FEW:
        gone |= _records(wrapper, inside_of, of, region, gone)
    inside = [i for i in sorted(region) if i not in gone]
    outside = [i for i in range(len(slots)) if i not in gone and (i in region or not template(i))]
    return inside, outside


def _elements(node: Node) -> list[Node]:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if x.label != "#":
            out.append(x)
            todo += reversed(x.kids)
    return out


def _records(wrapper: Node, inside_of: dict[int, list[int]], of, region: set[int], gone: set[int]) -> set[int]:
    """Slots of repeated records behind the longest text: each begins with a few words outside of a heading, and goes on with more."""
    rest = [i for i in region or range(len(text_slots(wrapper))) if i not in gone]
    longest = max(rest, key=lambda i: (of(i)[3], -i), default=-1)
    average = lambda i: of(i)[3] / max(1, of(i)[2])
    found: set[int] = set()
    for n in _elements(wrapper):
        ids = inside_of[id(n)]
        if n.mark & REPEATED and re.match(r"(div|li|section|article|blockquote|dl)\b", n.label) and len(ids) > 1 and min(ids) > longest:
            first = _lead(n)
            if first not in _HEADINGS and 0 < average(ids[0]) <= BRIEF and sum(average(i) for i in ids[1:]) > 2 * BRIEF:
                found.update(ids)
    return found


def _lead(node: Node) -> str:
    """The tag that holds a node's first text."""
    while node.kids and node.kids[0].label != "#":
        node = node.kids[0]
    return re.split(r"[.!~]", node.label)[0]


def page_text(page: str | None) -> str:
    """The main text of a page by itself: what a host of this page alone would get."""
    root, blocks = read(page)
    own = fold(root)
    slots = text_slots(own)
    held = {i: (1, True, len(s.ids), sum(len(blocks[b].text.split()) for b in s.ids), sum(blocks[b].links for b in s.ids)) for i, s in enumerate(slots)}
    inside, outside = decide(own, 1, held)
    keep = {b for i in inside or outside for b in slots[i].ids}
    return "\n".join(b.text for i, b in enumerate(blocks) if i in keep)


_BLOCKS = "array<struct<slot:int,text:string,links:int>>"


def parsed(df: DataFrame, html: str, url: str) -> DataFrame:
    """df without its html, with __host, __key and __shape (of the page's own wrapper) and __blocks (slot, text, words in links)."""
    base = df.withColumn("__host", host_of(F.col(url)))
    others = [c for c in base.columns if c != html]
    kind = T.StructType([*[base.schema[c] for c in others], *T._parse_datatype_string(f"__key string, __shape string, __blocks {_BLOCKS}").fields])
    own = to_arrow_schema(T.StructType(kind.fields[-3:]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, shapes, texts = [], [], []
            for page in batch.column(len(others)):
                root, blocks = read(page.as_py())
                tree = fold(root)
                slot = {b: i for i, s in enumerate(text_slots(tree)) for b in s.ids}
                shapes.append(json.dumps(written_out(tree), separators=(",", ":")))
                keys.append(xxhash.xxh3_128_hexdigest(shapes[-1].encode()))
                texts.append([{"slot": slot[i], "text": b.text, "links": b.links} for i, b in enumerate(blocks) if i in slot])
            found = [pa.array(x, f.type) for x, f in zip((keys, shapes, texts), own, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *found], [*others, *own.names])

    return small_batches(base).select(*others, html).mapInArrow(rows, kind)


def _merge(rows: pa.Table) -> pa.Table:
    order = sorted(zip(rows.column("n").to_pylist(), rows.column("shape").to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    whole = functools.reduce(merged, (read_back(json.loads(s)) for _, s in order))
    return pa.table({"host": [rows.column("host")[0].as_py()], "shape": [json.dumps(written_out(whole), separators=(",", ":"))], "n": pa.array([sum(n for n, _ in order)], pa.int64())})


def wrappers(shapes: DataFrame, scratch: Scratch, group: int = GROUP) -> DataFrame:
    """host, shape (its wrapper), n (pages) of distinct shapes (host, shape, n). Rounds of groups of `group` shapes or so; their number grows with the logarithm of a host's shapes."""
    now, old = shapes.select("host", "shape", "n"), None
    while True:
        counts = now.groupBy("host").agg(F.count("*").alias("k"))
        if (counts.agg(F.max("k")).first()[0] or 0) <= 1:
            return now
        parts = F.ceil(F.col("k") / group)
        dealt = now.join(counts, "host").withColumn("part", F.pmod(F.xxhash64("shape"), parts))
        # a round of one part each ends it; more parts of a host meet in the next
        new = scratch.written(dealt.groupBy("host", "part").applyInArrow(_merge, "host string, shape string, n long"))
        if old is not None:
            scratch.drop(old)
        now = old = new


@functools.lru_cache(256)
def _tree(shape_: str) -> Node:
    return read_back(json.loads(shape_))


def extract_main_text(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """df without its html, with text and n_chars (code points); such columns of df are replaced."""
    scratch = Scratch(df.sparkSession)
    pages = scratch.written(parsed(df, html, url))
    shapes = scratch.written(pages.groupBy(F.col("__host").alias("host"), F.col("__key").alias("key"), F.col("__shape").alias("shape")).agg(F.count("*").alias("n")))
    of_hosts = wrappers(shapes, scratch).select("host", F.col("shape").alias("wrapper"), F.col("n").alias("pages"))

    @F.arrow_udf("array<int>")
    def found(own: pa.Array, whole: pa.Array) -> pa.Array:
        return pa.array([places(_tree(a.as_py()), _tree(b.as_py())) for a, b in zip(own, whole, strict=True)], pa.list_(pa.int32()))

    @F.arrow_udf("inside array<int>, outside array<int>")
    def decided(whole: pa.Array, n: pa.Array, held: pa.Array) -> pa.Array:
        out = [decide(_tree(w.as_py()), k.as_py(), {x["place"]: (x["pages"], x["same"], x["texts"], x["words"], x["links"]) for x in h.as_py() or ()}) for w, k, h in zip(whole, n, held, strict=True)]
        ints = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array([x[0] for x in out], ints), pa.array([x[1] for x in out], ints)], ["inside", "outside"])

    mapped = scratch.written(shapes.join(of_hosts, "host").select("host", "key", "n", found("shape", "wrapper").alias("places")))
    texts = pages.select(F.col("__host").alias("host"), F.col("__key").alias("key"), F.explode("__blocks").alias("b"))
    hashed, counted = F.xxhash64("b.text"), F.size(F.split("b.text", " "))
    held = texts.groupBy("host", "key", "b.slot").agg(F.min(hashed).alias("lo"), F.max(hashed).alias("hi"), F.count("*").alias("texts"), F.sum(counted).alias("words"), F.sum("b.links").alias("links"))
    met = mapped.select("host", "key", "n", F.posexplode("places").alias("slot", "place")).join(held, ["host", "key", "slot"])
    of_places = met.groupBy("host", "place").agg(F.sum("n").alias("pages"), (F.min("lo") == F.max("hi")).alias("same"), *[F.sum(c).alias(c) for c in ("texts", "words", "links")])
    # a row for each slot of the host's wrapper
    gathered = of_places.groupBy("host").agg(F.collect_list(F.struct("place", "pages", "same", "texts", "words", "links")).alias("held"))
    decisions = of_hosts.join(gathered, "host", "left").select("host", decided("wrapper", "pages", "held").alias("d"))
    slots_in = lambda c: F.filter(F.transform("places", lambda p, i: F.when((p < 0) | F.array_contains(c, p), i)), lambda i: i.isNotNull())
    in_article = F.exists("places", lambda p: F.array_contains("d.inside", p))
    kept = scratch.written(mapped.join(decisions, "host").select(F.col("host").alias("__h"), F.col("key").alias("__k"), F.when(in_article, slots_in(F.col("d.inside"))).otherwise(slots_in(F.col("d.outside"))).alias("__kept")))
    # the pages of a hot shape go to SALTS tasks; its one row is copied to each
    kept = kept.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = pages.withColumn("__salt", F.pmod(F.xxhash64("__blocks"), F.lit(SALTS)).cast("int"))
    out = dealt.join(kept, (F.col("__host") == F.col("__h")) & (F.col("__key") == F.col("__k")) & (F.col("__salt") == F.col("__s")))
    text = F.array_join(F.transform(F.filter("__blocks", lambda b: F.array_contains("__kept", b["slot"])), lambda b: b["text"]), "\n")
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).drop("__host", "__key", "__shape", "__blocks", "__h", "__k", "__s", "__salt", "__kept")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")
