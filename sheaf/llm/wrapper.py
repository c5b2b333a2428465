"""Main text of web pages by wrapper induction over the pages of a host.

A page becomes a tree of block elements; inline elements only pass their text on. For each host up
to ``SAMPLE`` pages are drawn by hash, and their trees are folded into one template by simple tree
matching: two nodes match if their labels do (tag, and names in class and id), and the children of
matched nodes are aligned in order so that most nodes match. Equal neighbours count as one repeated
node. The sample gives the template's shape alone. What is constant in it is counted over all pages:
every page is aligned with its host's template, and a text is constant in a node if it stands there
in at least half of the different main texts that have the node, and in ``LEAST_TEXTS`` of them; all
other texts vary and are slots. Regions that hold menus, headers, footers, sidebars, notices,
adverts, forms or reader comments are known by tag, role or name and by being mostly links; inside of
an article element only by a name that is no more than such a word. The root of the content is the
article element, else the main element, else the lowest node that holds most of what varies.

Extraction aligns a page's whole tree with its host's template in the same way. Nodes that match a
dropped region go; what lies below the root stays, as blocks in page order, less the texts that are
constant there. An article keeps its constants, and so does a page of which they are more than half,
as with near copies. A page whose tree has no match for any root is read by the rules alone.

A host's template is small; pages meet it by a join on the host, by broadcast while there are few
templates, and no task holds a host. Counts are combined before they are shuffled and spread by main
text. Defined results: a null or empty page has an empty text; a null url is a host of its own;
repeated rows give equal results and count once; an unfinished tag at the end is dropped; blocks
below ``DEPTH`` others keep their text and order, but no node of their own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import query, slices, small_side, table, written

SAMPLE = 8
#: Up to so many drawn pages and templates (some kilobytes each) are broadcast.
BROADCAST_DRAWN, BROADCAST_WRAPPERS = 500_000, 10_000
#: A constant stands in so many different main texts at least.
LEAST_TEXTS = 3
#: Up to so many nodes of templates (three numbers each) are broadcast.
BROADCAST_SLOTS = 1_000_000
DEPTH = 100
#: A descent to a child keeps at least this share of the varying text.
MOST = 0.7
#: A node with at least this share of text in links, and this many links, is a menu.
LINK_SHARE, LINKS = 0.7, 4

_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol option p pre search section select summary "
    "table tbody td tfoot th thead tr ul button".split()
)
_CLOSES = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody"),
    "body": ("head",),
}
_ENDS_P = _BLOCKS - {"option", "legend", "caption", "button"}
_DROP_TAGS = set("head nav footer aside form select option button dialog menu search fieldset legend".split())
_DROP_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_DROP_NAMES = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer header masthead topbar cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus replies "
    "reply respond related recommended recommendations share sharing social widget widgets pagination pager toolbar skip "
    "copyright legal paywall".split()
)
#: Words that say nothing beside such a name.
_NEUTRAL = set("area bar block body box buttons container content inner items left links list right section slot unit wrap wrapper".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_NAME = re.compile(r"[a-zA-Z]+")


def _named_region(values: list[str]) -> bool:
    """Whether a class or id is nothing but the name of a region, as ``ad-box`` is and
    ``legal-analysis`` is not."""
    for token in " ".join(values).split():
        parts = set(_NAME.findall(token))
        if parts & _DROP_NAMES and parts <= _DROP_NAMES | _NEUTRAL:
            return True
    return False


class Node:
    __slots__ = ("label", "tag", "drop", "depth", "article", "children", "text", "links", "linked")

    def __init__(self, tag: str, values: list[str] = (), role: str = "", parent: Node | None = None):
        names = [n for v in values for n in _NAME.findall(v)]
        self.tag = tag
        self.label = ".".join([tag, *names])
        self.depth = parent.depth + 1 if parent else 0
        inside = parent is not None and parent.article
        self.article = inside or tag == "article"
        by_name = _named_region(values) if inside else any(n in _DROP_NAMES for n in names)
        self.drop = tag in _DROP_TAGS or role in _DROP_ROLES or by_name
        self.children: list[Node | str] = []
        self.text = self.links = self.linked = 0


def parse(page: str) -> Node:
    """The tree of block elements. Text between blocks is a child string with references decoded
    and white space made single. Below ``DEPTH`` a block that is no dropped region shares the node of
    the block around it."""
    root = Node("#")
    stack = [("#", root)]
    held: list[str] = []
    in_link = 0

    def flush() -> None:
        if held:
            if text := " ".join(html.unescape("".join(held)).split()):
                stack[-1][1].children.append(text)
                stack[-1][1].text += len(text)
            held.clear()

    def close(n: int) -> None:
        flush()
        del stack[n:]

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at:m.start()])
            if in_link:
                stack[-1][1].linked += m.start() - at
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            if tag == "a":
                in_link = 0
            if tag in _BLOCKS or any(x == tag for x, _ in stack[1:]):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
                else:
                    flush()
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else end
            if tag not in ("title", "textarea"):
                held.append(" ")
            continue
        if tag == "a":
            in_link = 1
            stack[-1][1].links += 1
        if tag in ("br", "hr", "img"):
            held.append(" ")
        values, role = [], ""
        if m[3]:
            for kind, *forms in _ATTRIBUTE.findall(m[3]):
                value = next((v for v in forms if v), "").lower()
                if kind.lower() == "role":
                    role = value.strip()
                else:
                    values.append(value)
        if tag in _VOID:
            continue
        around = stack[-1][1]
        node = Node(tag, values, role, around)
        if tag in _BLOCKS or node.drop:
            if tag in _ENDS_P or tag in _CLOSES:
                closed = _CLOSES.get(tag, ("p",)) + (("p",) if tag in _ENDS_P and tag != "p" else ())
                i = len(stack) - 1
                while i > 0 and stack[i][0] in closed:
                    i -= 1
                if i < len(stack) - 1:
                    close(i + 1)
                    around = stack[-1][1]
                    node = Node(tag, values, role, around)
            flush()
            if around.depth >= DEPTH and (around.drop or not node.drop):
                node = around
            else:
                around.children.append(node)
            stack.append((tag, node))
    flush()
    _measure(root)
    return root


def _measure(node: Node) -> bool:
    """Text, links and linked text of whole subtrees; whether an article or headline is inside,
    which a region named like a sidebar does not drop."""
    main = node.tag in ("article", "main", "h1")
    for child in node.children:
        if isinstance(child, Node):
            main |= _measure(child)
            node.text += child.text
            node.links += child.links
            node.linked += child.linked
    if node.drop and main and node.tag not in ("nav", "footer", "aside", "form", "head"):
        node.drop = False
    if not main and not node.article and node.links >= LINKS and node.linked >= LINK_SHARE * max(1, node.text):
        node.drop = True
    if node.tag == "header" and not main:
        node.drop = True
    return main


class Slot:
    """A node of the template's shape."""

    __slots__ = ("label", "drop", "children")

    def __init__(self, node: Node):
        self.label, self.drop, self.children = node.label, node.drop, []

    def dump(self):
        return [self.label, self.drop, 0, [], [c.dump() for c in self.children]]


def _groups(node: Node) -> list[list[Node]]:
    """The child elements with equal neighbours as one repeated node."""
    out: list[list[Node]] = []
    for c in node.children:
        if isinstance(c, Node):
            if out and out[-1][0].label == c.label:
                out[-1].append(c)
            else:
                out.append([c])
    return out


def _weight(slot, node: Node, label, children) -> int:
    """Nodes that match in the best alignment of a template node and a page node."""
    if label(slot) != node.label:
        return 0
    kids = children(slot)
    return 1 + (_table(kids, _groups(node), label, children)[-1][-1] if kids and node.children else 0)


def _table(slots, groups, label, children) -> list[list[int]]:
    best = [[0] * (len(groups) + 1) for _ in range(len(slots) + 1)]
    for i, s in enumerate(slots):
        for j, g in enumerate(groups):
            w = _weight(s, g[0], label, children)
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w if w else 0)
    return best


def align(slots, groups, label, children) -> list[tuple[int | None, int | None]]:
    """Simple tree matching of two lists of children: pairs of indices, None where one has no
    partner, in an order that keeps both."""
    if [label(s) for s in slots] == [g[0].label for g in groups]:
        return [(i, i) for i in range(len(slots))]
    same = 0
    while same < min(len(slots), len(groups)) and label(slots[same]) == groups[same][0].label:
        same += 1
    ahead = [(i, i) for i in range(same)]
    slots, groups = slots[same:], groups[same:]
    best = _table(slots, groups, label, children)
    i, j, out = len(slots), len(groups), []
    while i or j:
        if i and j and label(slots[i - 1]) == groups[j - 1][0].label and best[i][j] > max(best[i - 1][j], best[i][j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif j and (not i or best[i][j] == best[i][j - 1]):
            j -= 1
            out.append((None, j))
        else:
            i -= 1
            out.append((i, None))
    shifted = [(None if i is None else i + same, None if j is None else j + same) for i, j in out[::-1]]
    return ahead + shifted


_slot_label, _slot_children = (lambda s: s.label), (lambda s: s.children)
_wrap_label, _wrap_children = (lambda w: w[0]), (lambda w: w[4])


def _fold(slot: Slot, nodes: list[Node]) -> None:
    """Take the nodes of one page that match a slot into the template."""
    for node in nodes:
        groups, merged = _groups(node), []
        for i, j in align(slot.children, groups, _slot_label, _slot_children):
            if i is None:
                merged.append(Slot(groups[j][0]))
            else:
                merged.append(slot.children[i])
            if j is not None:
                _fold(merged[-1], groups[j])
        slot.children = merged


def _roots(node, tag, drop, children, mass) -> list:
    """Article elements, else main elements, else the lowest node that holds most of the text."""
    for wanted in ("article", "main"):
        found = [x for x in _tagged(node, wanted, tag, drop, children) if mass(x)]
        if found:
            return found
    return [_lowest(node, tag, drop, children, mass)]


def _tagged(x, wanted, tag, drop, children) -> list:
    if drop(x):
        return []
    return [x] if tag(x) == wanted else [y for c in children(x) for y in _tagged(c, wanted, tag, drop, children)]


def _lowest(node, tag, drop, children, mass):
    while True:
        inside = [c for c in children(node) if not drop(c)]
        top = max(inside, key=mass, default=None)
        if top is None or tag(top) in ("p", "li", "pre", "h1", "td") or mass(top) < MOST * mass(node) or not children(top):
            return node
        node = top


def induce_shape(pages: list[str]) -> str:
    """The template of a host without its constants, as JSON, from the distinct pages of its sample."""
    template = Slot(Node("#"))
    for page in sorted(set(pages)):
        _fold(template, [parse(page)])
    return json.dumps(template.dump())


def _numbered(slot, out: list | None = None) -> list:
    """The nodes of a loaded template, by number."""
    out = [] if out is None else out
    out.append(slot)
    for child in slot[4]:
        _numbered(child, out)
    return out


def text_mark(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _partners(node: Node, slot) -> dict[int, list | None]:
    """The template node of each child element, by the child's identity."""
    groups, out = _groups(node), {}
    for i, j in align(slot[4], groups, _wrap_label, _wrap_children):
        if j is not None:
            for x in groups[j]:
                out[id(x)] = None if i is None else slot[4][i]
    return out


def slot_texts(tree: Node, shape) -> set[tuple[int, int, int]]:
    """(number of the template node, mark, length) of the texts of a page that stand in nodes of the
    template, outside of dropped regions and of articles, whose texts all stay."""
    numbers = {id(x): i for i, x in enumerate(_numbered(shape))}
    out = set()

    def walk(node: Node, slot) -> None:
        own = _partners(node, slot)
        for c in node.children:
            if isinstance(c, str):
                out.add((numbers[id(slot)], text_mark(c), len(c)))
            elif not c.drop and not c.article and own[id(c)] is not None and not own[id(c)][1]:
                walk(c, own[id(c)])

    walk(tree, shape)
    return out


#: Marks of the roots of a wrapper: articles or main elements, and the lowest node of most of what varies.
TAGGED, INDUCED = 1, 2


def finish(shape: str, counted: list[tuple[int, int, list[int]]]) -> str:
    """The wrapper of a shape: ``counted`` has the number of a node, its varying text and the marks
    of its constants."""
    template = json.loads(shape)
    nodes = _numbered(template)
    own = {}
    for number, varying, constants in counted:
        own[id(nodes[number])] = varying
        nodes[number][3] = sorted(constants)

    def tag(x) -> str:
        return x[0].split(".", 1)[0]

    def mass(x) -> int:
        return 0 if x[1] else own.get(id(x), 0) + sum(mass(c) for c in x[4])

    _lowest(template, tag, lambda x: x[1], lambda x: x[4], mass)[2] = INDUCED
    for wanted in ("article", "main"):
        found = _tagged(template, wanted, tag, lambda x: x[1], lambda x: x[4])
        for root in found:
            root[2] = TAGGED
        if found:
            break
    return json.dumps(template)


def _node_mass(node: Node) -> int:
    if node.drop:
        return 0
    return sum(len(c) if isinstance(c, str) else _node_mass(c) for c in node.children)


def by_rules(tree: Node) -> str:
    """The main text by tags, roles, names and links alone."""
    out: list[str] = []
    for root in _roots(tree, lambda n: n.tag, lambda n: n.drop,
                       lambda n: [c for c in n.children if isinstance(c, Node)], _node_mass):
        _kept(root, out)
    return "\n".join(out)


def _kept(node: Node, out: list[str]) -> None:
    for c in node.children:
        if isinstance(c, str):
            out.append(c)
        elif not c.drop:
            _kept(c, out)


def extract(page: str, wrapper) -> str:
    """The main text of a page; ``wrapper`` is a loaded template or None."""
    tree = parse(page)
    for kind in (TAGGED, INDUCED) if wrapper is not None else ():
        texts: list[tuple[str, bool]] = []

        def walk(node: Node, slot, inside: bool) -> None:
            inside = inside or slot[2] == kind
            constant = set(slot[3]) if inside and kind == INDUCED else ()
            own = _partners(node, slot)
            for c in node.children:
                if isinstance(c, str):
                    if inside:
                        texts.append((c, bool(constant) and text_mark(c) in constant))
                elif c.drop or own[id(c)] is not None and own[id(c)][1]:
                    continue
                elif own[id(c)] is not None:
                    walk(c, own[id(c)], inside)
                elif inside:
                    rest: list[str] = []
                    _kept(c, rest)
                    texts.extend((t, False) for t in rest)

        walk(tree, wrapper, False)
        if texts:
            gone = sum(len(t) for t, constant in texts if constant)
            near_copy = 2 * gone > sum(len(t) for t, _ in texts)
            return "\n".join(t for t, constant in texts if near_copy or not constant)
    return by_rules(tree)


def _host(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), F.lit(""))


def induce_shapes(pages: DataFrame) -> DataFrame:
    """(host, wrapper): the shape of a template for each host, from at most ``SAMPLE`` of its pages."""
    known = pages.where("length(html) > 0").select(_host().alias("host"), F.xxhash64("url", "page_id").alias("mark"), "html")
    place = F.pmod("mark", F.lit(SAMPLE)).alias("place")
    drawn = known.select("host", "mark", place).groupBy("host", "place").agg(F.min("mark").alias("mark"))
    drawn = small_side(written(drawn, "drawn"), BROADCAST_DRAWN)
    # One row for each place: repeated rows share a mark.
    sample = known.join(drawn, ["host", "mark"]).groupBy("host", "place").agg(F.max("html").alias("html"))
    return sample.groupBy("host").applyInPandas(
        lambda own: pd.DataFrame({"host": [own["host"].iloc[0]], "wrapper": [induce_shape(own["html"].tolist())]}),
        "host string, wrapper string")


def count_texts(pages: DataFrame, shapes: DataFrame) -> DataFrame:
    """(host, slot, mark, chars, n): how many different main texts of a host have a text in a node of
    its template, over all pages; with a null mark, how many have the node with any text."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded = _Loaded()
        for frame in slices(frames, "html"):
            rows = []
            for host, page, shape in zip(frame["host"], frame["html"], frame["wrapper"]):
                tree = parse(page)
                texts = slot_texts(tree, loaded[shape])
                main = text_mark(by_rules(tree)) if texts else 0
                rows += [(host, slot, mark, chars, main) for slot, mark, chars in texts]
                rows += [(host, slot, None, 0, main) for slot in {t[0] for t in texts}]
            out = pd.DataFrame(rows, columns=["host", "slot", "mark", "chars", "main"], dtype=object)
            # By way of a float, marks with nulls among them would lose digits.
            yield out.assign(mark=pd.array([r[2] for r in rows], dtype="Int64")).astype({"slot": "int32", "chars": "int64", "main": "int64"})

    known = pages.where("length(html) > 0").select(_host().alias("host"), "html")
    seen = known.join(small_side(shapes, BROADCAST_WRAPPERS), "host").select("host", "html", "wrapper").mapInPandas(
        read, "host string, slot int, mark long, chars long, main long")
    return seen.groupBy("host", "slot", "mark").agg(F.max("chars").alias("chars"), F.count_distinct("main").alias("n"))


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): shapes with the constants and roots that all pages of a host give."""
    shapes = written(induce_shapes(pages), "shapes")
    texts = written(count_texts(pages, shapes), "slot-texts")
    slots = texts.where("mark IS NULL").select("host", "slot", F.col("n").alias("of"))
    slots = small_side(slots, BROADCAST_SLOTS)
    constant = (F.col("n") >= LEAST_TEXTS) & (2 * F.col("n") >= F.col("of"))
    # A node has at most as many constants as two pages have texts there.
    counted = texts.where("mark IS NOT NULL").join(slots, ["host", "slot"]).groupBy("host", "slot").agg(
        F.sum(F.when(constant, F.lit(0)).otherwise(F.col("n") * F.col("chars"))).alias("varying"),
        F.collect_list(F.when(constant, F.col("mark"))).alias("constants"))
    by_host = counted.groupBy("host").agg(F.collect_list(F.struct("slot", "varying", "constants")).alias("counted"))

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [finish(shape, [] if found is None else [(x["slot"], x["varying"], [int(c) for c in x["constants"]]) for x in found])
                    for shape, found in zip(frame["wrapper"], frame["counted"])]
            yield pd.DataFrame({"host": frame["host"], "wrapper": made})

    return shapes.join(by_host, "host", "left").select("host", "wrapper", "counted").mapInPandas(
        build, "host string, wrapper string")


class _Loaded(dict):
    """Templates by their JSON, the last thousand at most."""

    def __missing__(self, wrapper: str):
        if len(self) > 1000:
            self.clear()
        self[wrapper] = json.loads(wrapper)
        return self[wrapper]


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    loaded = _Loaded()
    for frame in slices(frames, "html"):
        texts = [extract(page, loaded[wrapper] if wrapper else None) if page else ""
                 for page, wrapper in zip(frame["html"], frame["wrapper"])]
        yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "host": frame["host"], "text": texts,
                            "n_chars": [len(t) for t in texts]})


def extract_pages(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, text, n_chars) for every page."""
    wrappers = written(induce_wrappers(pages), "wrappers") if wrappers is None else wrappers
    wrappers = small_side(wrappers, BROADCAST_WRAPPERS)
    named = pages.select(F.col("page_id").cast("string"), "url", _host().alias("host"), "html")
    return named.join(wrappers, "host", "left").select("page_id", "url", "host", "html", "wrapper").mapInPandas(
        _extract, "page_id string, url string, host string, text string, n_chars long",
    ).withColumn("page_id", F.col("page_id").cast("long"))


@query("op1_wrapper_induction")
def op1(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))
