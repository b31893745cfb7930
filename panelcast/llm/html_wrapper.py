"""Main text of web pages by wrapper induction: DOM trees of same-host pages are aligned by simple tree matching."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import materialized, send_code, small, strings

#: Elements that begin a block, and so are nodes of the tree; all others are inline.
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split())
#: Elements whose inside is no text of the page.
RAW = frozenset("script style noscript template textarea iframe svg math object title canvas video audio".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and words in class, id or role that are never part of an article.
OUTSIDE = frozenset("nav header footer aside form button select head menu dialog option".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices pagination "
    "popup promo promoted related respond search share sharing sidebar signup social sponsor sponsored subscribe "
    "toolbar topbar widget".split())
#: Words that may stand beside one of those in a name. With any other word, as in has-sidebar, a name says nothing.
PLACE_WORDS = frozenset(
    "area bar block bottom box cell col container content global group inner item left link links list main middle outer page panel "
    "primary right secondary section site slot sub top unit wrap wrapper zone".split())
#: Elements that hold the article or are it, whatever they are called.
HOLDERS = frozenset("html body main article".split())
#: Which open elements a start tag closes, up to which.
CLOSES = {"li": ("li", ("ul", "ol", "menu", "dir")), "dd": ("dd dt", ("dl",)), "dt": ("dd dt", ("dl",)),
          "tr": ("tr td th", ("table",)), "td": ("td th", ("tr",)), "th": ("td th", ("tr",)),
          "option": ("option", ("select",))}
DEEPEST = 120
#: Neighbours of one shape that keep slots of their own.
TWINS = 2
#: A constant node is template if so many pages of the host have it.
MIN_PAGES = 8
SHAPES_PER_GROUP = 400

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)>"""
    r"""|</?[a-zA-Z][^>]*(?:>|\Z)""", re.S)
#: An attribute as a whole, its name and its value; names that say where an element belongs.
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
TELLING = frozenset("class id role style hidden aria-hidden".split())


class Node:
    """A block element or, labelled #text or #link, a run of text in one."""

    __slots__ = ("label", "children", "text", "outside", "slot")

    def __init__(self, label: str, outside: bool = False, text: str | None = None):
        self.label, self.children, self.text, self.outside, self.slot = label, [], text, outside, -1


def _names_outside(name: str) -> bool:
    """Whether a class, id or role names something outside of articles: all its words do, but for those of place."""
    parts = {w for w in re.split(r"[^a-z]+", name) if w}
    return not OUTSIDE_WORDS.isdisjoint(parts) and parts <= OUTSIDE_WORDS | PLACE_WORDS


def _label(tag: str, attributes: str) -> tuple[str, bool]:
    """The label of an element, tag and class with digits as 0, and whether it is outside of any article."""
    outside, name, holder = tag in OUTSIDE, "", tag in HOLDERS
    if attributes.strip():
        for key, value in _ATTR.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key not in TELLING:
                continue
            if key == "hidden" or key == "aria-hidden" and value == "true":
                outside = True
            elif key == "style":
                outside |= bool(re.search(r"display\s*:\s*none", value))
            else:
                outside |= not holder and any(map(_names_outside, value.split()))
                if key == "class" and value:
                    name = "." + re.sub(r"[^a-z0-9_-]", "", re.sub(r"\d+", "0", value.split()[0]))
    return tag + ("!" if outside else "") + name, outside


def parse(source: str | None) -> Node:
    """The tree of block elements of a page; never fails. Inline elements are transparent, but the text of hidden
    ones and of those named as outside of articles falls away, as do comments and raw elements. Unclosed elements end
    with their parent; what is nested too deep hangs on the last level, and its end tags close nothing else."""
    root = Node("#root")
    stack, tags, pieces, opened = [root], ["#root"], [], Counter()
    linked = [0, 0, False]  # signs of the run inside links, all signs, inside a link now
    muted = ["", 0, 0]  # an inline element whose text falls away, how often it is open, the level it began on

    def flush():
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                stack[-1].children.append(Node("#link" if 2 * linked[0] > linked[1] else "#text", False, text))
            pieces.clear()
        linked[0] = linked[1] = 0

    def close(count: int):
        flush()
        linked[2] = False
        opened.subtract(tags[count:])
        del stack[count:], tags[count:]
        if count < muted[2]:
            muted[:] = "", 0, 0

    def last(tag: str) -> int:
        """Where the innermost open element of this tag is; there is one. What is passed over is closed with it."""
        at = len(tags) - 1
        while tags[at] != tag:
            at -= 1
        return at

    def say(text: str):
        if muted[1]:
            return
        text = entities.unescape(text)
        pieces.append(text)
        size = len(text.strip())
        linked[1] += size
        linked[0] += size * linked[2]

    source, at = source or "", 0
    while True:
        m = _TAG.search(source, at)
        if m is None:
            break
        if m.start() > at:
            say(source[at:m.start()])
        at = m.end()
        if not m.group(2):
            continue
        tag, end = m.group(2).lower(), bool(m.group(1))
        if tag in RAW:
            if not end and not m.group(3).endswith("/"):
                stop = re.compile("</" + tag + r"[\s/>]", re.I).search(source, at)
                at = len(source) if stop is None else stop.start()
            continue
        if tag == "br":
            pieces.append(" ")
        elif tag == "a":
            linked[2] = not end
        if tag not in BLOCKS:
            if tag == muted[0]:
                muted[1] += -1 if end else 1
                if not muted[1]:
                    muted[:] = "", 0, 0
            elif not (end or muted[1] or tag in VOID or m.group(3).endswith("/")) and _label(tag, m.group(3))[1]:
                muted[:] = tag, 1, len(stack)
        elif tag == "hr":
            flush()
        elif end:
            if opened[tag] > 0:
                close(last(tag))
        else:
            flush()
            if opened["p"] > 0:
                close(last("p"))
            if tag in CLOSES and any(opened[x] > 0 for x in CLOSES[tag][0].split()):
                open_ones, limit = CLOSES[tag]
                for i in range(len(tags) - 1, 0, -1):
                    if tags[i] in limit:
                        break
                    if tags[i] in open_ones.split():
                        close(i)
                        break
            label, outside = _label(tag, m.group(3))
            node = stack[-1]
            # Beyond the last level only what begins to be outside still is a node of its own.
            if len(stack) < DEEPEST or outside and not node.outside:
                node = Node(label, outside)
                stack[-1].children.append(node)
            stack.append(node)
            tags.append(tag)
            opened[tag] += 1
    say(source[at:])
    flush()
    return root


def shape_of(root: Node) -> tuple[str, int]:
    """The shape of a tree and its number of text slots; sets the slot of every text node.

    A shape writes labels with their children's shapes in brackets. More than TWINS neighbours of the same shape
    are written once, with a plus, and share their slots."""
    shapes: dict[int, str] = {}

    def runs(node: Node) -> list[list[Node]]:
        """The children, those that share slots together."""
        out: list[list[Node]] = []
        for child in node.children:
            if out and shape(out[-1][0]) == shape(child):
                out[-1].append(child)
            else:
                out.append([child])
        return [part for run in out for part in ([run] if len(run) > TWINS else [[x] for x in run])]

    def shape(node: Node) -> str:
        if id(node) not in shapes:
            inner = [shape(run[0]) + "+" * (len(run) > 1) for run in runs(node)]
            shapes[id(node)] = node.label + ("(" + ",".join(inner) + ")" if inner else "")
        return shapes[id(node)]

    def number(nodes: list[Node], first: int) -> int:
        """Number all ``nodes``, of one shape, alike; returns the next free slot."""
        if nodes[0].text is not None:
            for node in nodes:
                node.slot = first
            return first + 1
        for column in zip(*map(runs, nodes), strict=True):
            first = number([node for run in column for node in run], first)
        return first

    return shape(root), number([root], 0)


class Wrapper:
    """A node of an aligned tree: label, children, and what its text slot held: pages, least and largest hash."""

    __slots__ = ("label", "children", "pages", "low", "high", "slot")

    def __init__(self, label: str):
        self.label, self.children, self.pages, self.low, self.high, self.slot = label, [], 0, None, None, -1


def read_shape(shape: str, stats: list[tuple[int, int, int]]) -> Wrapper:
    """The tree of a shape, its text slots filled with (pages, least hash, largest hash) in order."""
    root, stack, slot = None, [], 0
    for m in re.finditer(r"([^(),+]+)(\()?|\)", shape):
        if m.group(1):
            node = Wrapper(m.group(1))
            if node.label in ("#text", "#link"):
                node.slot = slot
                node.pages, node.low, node.high = stats[slot]
                slot += 1
            if stack:
                stack[-1].children.append(node)
            else:
                root = node
            if m.group(2):
                stack.append(node)
        elif m.group(0) == ")":
            stack.pop()
    return root


def match(one: Wrapper, other: Wrapper, known: dict) -> int:
    """Simple tree matching: the most pairs of nodes of equal label that keep order and parents."""
    if one.label != other.label:
        return 0
    key = id(one), id(other)
    if key not in known:
        best = _table(one, other, known)
        known[key] = 1 + best[len(one.children)][len(other.children)]
    return known[key]


def _table(one: Wrapper, other: Wrapper, known: dict) -> list[list[int]]:
    best = [[0] * (len(other.children) + 1) for _ in range(len(one.children) + 1)]
    for i, a in enumerate(one.children, 1):
        for j, b in enumerate(other.children, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + match(a, b, known))
    return best


def pairs(one: Wrapper, other: Wrapper, known: dict):
    """The pairs of children of a best matching, (a or None, b or None) in order."""
    best, out = _table(one, other, known), []
    i, j = len(one.children), len(other.children)
    while i or j:
        a, b = one.children[i - 1] if i else None, other.children[j - 1] if j else None
        gain = match(a, b, known) if a and b else 0
        if gain and best[i][j] == best[i - 1][j - 1] + gain:
            out.append((a, b))
            i, j = i - 1, j - 1
        elif i and best[i][j] == best[i - 1][j]:
            out.append((a, None))
            i -= 1
        else:
            out.append((None, b))
            j -= 1
    return out[::-1]


def merge(wrapper: Wrapper, tree: Wrapper, known: dict | None = None) -> None:
    """Align ``tree`` with ``wrapper`` and add it: what matches shares a node, the rest becomes optional nodes."""
    known = {} if known is None else known
    if tree.low is not None:
        wrapper.pages += tree.pages
        wrapper.low = tree.low if wrapper.low is None else min(wrapper.low, tree.low)
        wrapper.high = tree.high if wrapper.high is None else max(wrapper.high, tree.high)
    children = []
    for a, b in pairs(wrapper, tree, known):
        if a is not None and b is not None:
            merge(a, b, known)
        children.append(a if a is not None else b)
    wrapper.children = children


def write_wrapper(wrapper: Wrapper) -> tuple[str, list[tuple[int, int, int]]]:
    """The shape of a wrapper and the statistics of its slots, as ``read_shape`` takes them."""
    stats = []

    def write(node: Wrapper) -> str:
        if node.low is not None:
            stats.append((node.pages, node.low, node.high))
        return node.label + ("(" + ",".join(map(write, node.children)) + ")" if node.children else "")

    return write(wrapper), stats


def kept_slots(wrapper: Wrapper, tree: Wrapper, slots: int) -> list[bool]:
    """Which text slots of a shape are content: inside the article (or main) if there is one, not in an element
    outside of articles, not a constant of the host's pages; without an article, runs of links go too.

    Where all that varies would go as outside, and it is more than what stays, elements that hold most of it, such
    as a form around the page, count as inside; marked elements in them stay outside."""
    known = {}

    def walk(a: Wrapper | None, b: Wrapper, outside: bool, inside: bool) -> int:
        tag, marked, varying = re.split(r"[.!]", b.label)[0], "!" in b.label, 0
        outside |= marked and id(b) not in opened
        inside |= tag in ("article", "main")
        if b.slot >= 0:
            constant = a is not None and a.low == a.high and a.pages >= MIN_PAGES
            rows.append((b.slot, outside, inside, constant, b.label == "#link"))
            varying += not constant
        matched = pairs(a, b, known) if a is not None else [(None, c) for c in b.children]
        varying += sum(walk(x, y, outside, inside) for x, y in matched if y is not None)
        if marked:
            marks[id(b)] = varying
        return varying

    opened, kept = set(), []
    while True:
        rows, marks = [], {}
        total = walk(wrapper, tree, False, False)
        article = any(r[2] and not r[1] for r in rows)
        varies = any(not r[1] and not r[3] for r in rows)
        kept = [slot for slot, outside, inside, constant, link in rows
                if not outside and not (constant and varies) and (inside if article else not link)]
        most = {k for k, n in marks.items() if 2 * n > total and n > len(kept)}
        if opened or varies or not most:
            break
        opened = most
    keep = [False] * slots
    for slot in kept:
        keep[slot] = True
    return keep


PARSED = "page_id long, url string, host string, shape string, hashes array<bigint>, blocks array<struct<slot:int,text:string>>"


def _host(url: str | None) -> str:
    head, found, rest = (url or "").partition("://")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower() if found else ""


def _parsed(frames):
    for frame in frames:
        rows = []
        for page, url, source in zip(frame["page_id"], strings(frame["url"]), strings(frame["html"]), strict=True):
            root = parse(source)
            shape, slots = shape_of(root)
            blocks, todo = [], [root]
            while todo:
                node = todo.pop()
                if node.text is not None:
                    blocks.append((node.slot, node.text))
                todo += node.children[::-1]
            hashes = [0] * slots
            for slot, text in blocks:
                hashes[slot] = crc32(text.encode("utf-8", "replace"), hashes[slot])
            page = None if pd.isna(page) else int(page)
            rows.append((page, url, _host(url), shape, hashes, [{"slot": s, "text": t} for s, t in blocks]))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")], dtype=object)


def _join(rows: list[tuple[str, list]]) -> Wrapper | None:
    whole = None
    for shape, stats in rows:
        tree = read_shape(shape, stats)
        if whole is None:
            whole = tree
        else:
            merge(whole, tree)
    return whole


def wrappers(parsed: DataFrame) -> DataFrame:
    """(host, shape, keep): for each shape of each host, which of its text slots are content.

    Pages are first collapsed to (host, shape, slot) with the least and largest text hash, in the map tasks, so
    that a host with any share of the pages is a few rows. The shapes of a host are dealt into groups of bounded
    size; each group is aligned to a wrapper, the groups' wrappers are aligned to the host's, and each shape
    is aligned with that."""
    slots = parsed.select("host", "shape", F.posexplode("hashes").alias("slot", "hash")).groupBy(
        "host", "shape", "slot").agg(F.count("*").alias("pages"), F.min("hash").alias("low"), F.max("hash").alias("high"))
    shapes = slots.groupBy("host", "shape").agg(F.array_sort(F.collect_list(F.struct("slot", "pages", "low", "high"))).alias("s"))
    shapes = materialized(shapes.select(
        "host", "shape", F.col("s.pages").alias("pages"), F.col("s.low").alias("low"), F.col("s.high").alias("high")),
        "page-shapes")
    groups = shapes.groupBy("host").agg(F.ceil(F.count("*") / SHAPES_PER_GROUP).alias("groups"))
    shapes = shapes.join(groups, "host").withColumn("part", F.pmod(F.xxhash64("shape"), "groups"))

    def aligned(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(n=rows["pages"].map(max)).sort_values(["n", "shape"], ascending=[False, True])
        whole = _join([(r.shape, list(zip(r.pages, r.low, r.high, strict=True))) for r in rows.itertuples()])
        shape, stats = write_wrapper(whole)
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "shape": [shape], "pages": [[s[0] for s in stats]],
                             "low": [[s[1] for s in stats]], "high": [[s[2] for s in stats]]}, dtype=object)

    kind = "host string, shape string, pages array<bigint>, low array<bigint>, high array<bigint>"
    parts = shapes.groupBy("host", "part").applyInPandas(aligned, kind)
    whole = parts.groupBy("host").applyInPandas(aligned, kind)

    def kept(rows: pd.DataFrame, wrapper: pd.DataFrame) -> pd.DataFrame:
        w = wrapper.iloc[0]
        tree = read_shape(w["shape"], list(zip(w["pages"], w["low"], w["high"], strict=True)))
        out = [kept_slots(tree, read_shape(r.shape, list(zip(r.pages, r.low, r.high, strict=True))), len(r.pages))
               for r in rows.itertuples()]
        return pd.DataFrame({"host": rows["host"], "shape": rows["shape"], "keep": pd.Series(out, dtype=object, index=rows.index)})

    whole = whole.join(groups, "host").selectExpr("*", "explode(sequence(0L, groups - 1)) as part")
    return shapes.groupBy("host", "part").cogroup(whole.groupBy("host", "part")).applyInPandas(
        kept, "host string, shape string, keep array<boolean>")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html; other columns are left out).

    The text is that of the article: blocks in page order, white space inside one as one space, joined by two
    line ends. Null, empty and textless pages give the empty text; so does a page all of whose text is template.
    Pages without a url, and ones whose url has no host, share one wrapper. Repeated rows give equal rows. A
    host with fewer than MIN_PAGES pages has no constants, so there the elements alone decide; so too where
    nothing varies between the pages of a host, as with copies of one page.

    Pages are parsed once and written; the shapes' slots are joined back, by broadcast while their counted rows
    are few, else by a shuffle, whose hot keys Spark splits.
    """
    send_code(__name__)
    parsed = materialized(pages.select(F.col("page_id").cast("long"), "url", "html").mapInPandas(_parsed, PARSED), "parsed")
    keep = materialized(wrappers(parsed.select("host", "shape", "hashes")), "wrappers")
    rows = parsed.select("page_id", "url", "host", "shape", "blocks").join(small(keep), ["host", "shape"], "left")
    kept = F.expr("filter(blocks, b -> coalesce(keep[b.slot], false))")
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    return rows.select("page_id", "url", F.coalesce(text, F.lit("")).alias("text")).withColumn(
        "n_chars", F.length("text").cast("long"))

