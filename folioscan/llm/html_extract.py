"""Main text of pages by wrapper induction over the block trees of each host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .common import empty_if_null

#: A slot's text is the host's template if so great a part of the pages with the slot have it, and so many different pages.
CONSTANT_SHARE, CONSTANT_PAGES = 0.8, 5
#: A slot is a menu if so great a part of its characters on the host's pages, so many at least, stand in links.
LINK_SHARE, LINK_PAGES = 0.7, 5
#: Hosts' slots and texts are broadcast up to this number; beyond it they are joined by a shuffle.
BROADCAST_SLOTS = 500_000
#: Tasks that a host's pages are dealt to where templates are not broadcast.
SALTS = 64
#: Texts that a slot's summary holds, and page hashes that each of them holds.
SUMMARY, WITNESSES = 4, CONSTANT_PAGES

# Elements by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template iframe svg math canvas object textarea select title".split()
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul hr".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS_P_OPEN = {"hr"}
SCOPES = set("article aside body div dialog footer form header html main nav ol section table ul".split())
PART = {"article", "main"}
DROPPED = set("aside button dialog footer form head label menu nav".split())
DROPPED_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
DROPPED_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar sidenav footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription share sharing social related recommended comment comments commentlist reply replies disqus discussion respond widget toolbar "
    "pagination pager skip login signup search".split()
)
#: Names and elements that count only outside an article.
OUTSIDE_NAMES, OUTSIDE = {"header", "head", "topbar"}, {"header"}
#: Inside an article a whole name must be one of these or begin so; other dropped names count there only with the host's template.
INSIDE = re.compile(
    r"(?:ad|ads|advert\w*|adsense|adsbygoogle|adbox|adslot|sponsor|sponsored|comments?|cookies?|disqus|newsletter)(?:[-_].*)?"
    r"|banner|sidebar|navbar|breadcrumbs?|consent|gdpr|notices?|popup|modal|overlay|subscribe|subscription|sharing|social|commentlist|reply|replies|respond|pagination|pager|toolbar"
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/a-zA-Z][^>]*+>",
    re.S | re.I,
)
_ATTR = re.compile(r"([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[^a-z0-9]+")


class Node:
    """A block element: label, whether it is left out or may be, child nodes and its own text segments in page order."""

    __slots__ = ("tag", "label", "out", "weak", "parts", "linked")

    def __init__(self, tag: str, label: str = "", out: bool = False, weak: bool = False):
        self.tag, self.label, self.out, self.weak = tag, label or tag, out, weak
        self.parts: list[Node | str] = []
        self.linked = 0  # characters of its own text that stand in links

    @property
    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]

    def text(self) -> str:
        return "\n".join(p for p in self.parts if isinstance(p, str))


def _facts(tag: str, attrs: str, in_part: bool) -> tuple[str, bool, bool]:
    """Label of an element, whether its kind or names say that it is not main text, and whether its names only hint at it."""
    out = tag in DROPPED or (tag in OUTSIDE and not in_part)
    if not attrs.strip():
        return tag, out, False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    named = f"{found.get('class', '')} {found.get('id', '')}".lower()
    label = f"{tag}.{' '.join(sorted(named.split()))}" if named.strip() else tag
    if tag in PART or tag in ("html", "body"):
        return label, out, False
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    out = out or hidden or found.get("role", "").lower() in DROPPED_ROLES
    hint = not DROPPED_NAMES.isdisjoint(_NAME.split(named))
    if in_part:
        return label, out or any(INSIDE.fullmatch(n) for n in named.split()), hint
    return label, out or hint or not OUTSIDE_NAMES.isdisjoint(_NAME.split(named)), False


def parse(source: str) -> Node:
    """The block tree of a page. Inline elements melt into the text around them, unless their names mark them as
    left out; open elements end as browsers end them, at the next block that can't stand inside."""
    root = Node("#page")
    open_nodes, skipped = [root], None  # skipped: an inline element that is left out, with its depth
    buffer: list[str] = []
    links = linked = part_depth = 0  # open links, characters in them since the last flush, open articles and mains

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                open_nodes[-1].parts.append(text)
                open_nodes[-1].linked += min(linked, len(text))
        linked = 0

    def close_to(at: int) -> None:
        nonlocal part_depth
        flush()
        part_depth -= sum(n.tag in PART for n in open_nodes[at:])
        del open_nodes[at:]

    at = 0
    for m in _TOKEN.finditer(source):
        if m.start() > at and not skipped:
            buffer.append(source[at : m.start()])
            if links:
                linked += len(" ".join(buffer[-1].split()))
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag, end = tag.lower(), bool(m["end"])
        if skipped:
            if tag == skipped[0]:
                skipped = (tag, skipped[1] + (-1 if end else 1))
                if not skipped[1]:
                    skipped = None
                continue
            if tag not in BLOCK:
                continue
            skipped = None
        if tag not in BLOCK:
            if tag == "a":
                links = max(0, links - 1) if end else 1
            if tag == "br":
                buffer.append(" ")
            elif not end and tag not in VOID and m["attrs"]:
                if _facts(tag, m["attrs"], part_depth > 0)[1]:
                    skipped = (tag, 1)
            elif not end and tag in DROPPED:
                skipped = (tag, 1)
            continue
        if end:
            for k in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[k].tag == tag:
                    close_to(k)
                    break
                if open_nodes[k].tag in PART and tag not in PART and tag not in ("body", "html"):
                    break
            flush()
            continue
        flush()
        closes = CLOSED_BY.get(tag, set()) | {"p"}
        for k in range(len(open_nodes) - 1, 0, -1):
            own = open_nodes[k].tag
            if own in closes:
                close_to(k)
                if own != "p":
                    break
            elif own in SCOPES:
                break
        if tag in VOID:
            continue
        node = Node(tag, *_facts(tag, m["attrs"] or "", part_depth > 0))
        part_depth += tag in PART
        open_nodes[-1].parts.append(node)
        open_nodes.append(node)
    if at < len(source) and not skipped:
        buffer.append(source[at:])
    close_to(1)
    return root


def _below(root: Node) -> list[Node]:
    """All nodes, each before its children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed(node.children)
    return out


class Shape:
    """A tree for matching: labels, children and texts, each node before its children; runs of siblings alike are one node."""

    __slots__ = ("keys", "sizes", "labels", "children", "paths", "texts", "nodes")

    def __init__(self, root: Node):
        # A node's key stands for its label and those of its children, runs counted once.
        runs: dict[int, list[list[Node]]] = {}
        key: dict[int, int] = {}
        for node in reversed(_below(root)):
            own: list[list[Node]] = []
            for child in node.children:
                if own and key[id(own[-1][0])] == key[id(child)]:
                    own[-1].append(child)
                else:
                    own.append([child])
            runs[id(node)] = own
            key[id(node)] = xxhash.xxh64_intdigest(f"{node.label} {' '.join(str(key[id(r[0])]) for r in own)}")
        self.keys, self.labels, self.children, self.paths, self.texts, self.nodes = [], [], [], [], [], []
        todo: list[tuple[list[Node], int, int]] = [([root], 0, -1)]
        while todo:
            held, path, parent = todo.pop()
            me = len(self.labels)
            if parent >= 0:
                self.children[parent].append(me)
            path = xxhash.xxh64_intdigest(f"{path} {held[0].label}")
            self.keys.append(key[id(held[0])])
            self.labels.append(held[0].label)
            self.children.append([])
            self.paths.append(path)
            self.texts.append("\n".join(t for n in held if (t := n.text())))
            self.nodes.append(held)
            todo += [([n for h in held for n in runs[id(h)][j]], path, me) for j in reversed(range(len(runs[id(held[0])])))]
        self.sizes = [1] * len(self.labels)
        for i in reversed(range(len(self.labels))):
            self.sizes[i] += sum(self.sizes[c] for c in self.children[i])

    def slots(self) -> list[tuple[int, int, int, int, int]]:
        """(node, slot, text hash, characters, characters in links) of the nodes with text."""
        return [(i, p, xxhash.xxh64_intdigest(t), len(t), sum(n.linked for n in h)) for i, (p, t, h) in enumerate(zip(self.paths, self.texts, self.nodes)) if t]


def _ends(a: Shape, b: Shape, i: int, j: int) -> tuple[list[int], list[int], int, int]:
    """Children of i and j, and how many at their starts and at their ends are alike: those match each other."""
    left, right = a.children[i], b.children[j]
    most, head, tail = min(len(left), len(right)), 0, 0
    while head < most and a.keys[left[head]] == b.keys[right[head]]:
        head += 1
    while tail < most - head and a.keys[left[-1 - tail]] == b.keys[right[-1 - tail]]:
        tail += 1
    return left, right, head, tail


def _table(a: Shape, b: Shape, left: list[int], right: list[int], known: dict[tuple[int, int], int]) -> list[list[int]]:
    best = [[0] * (len(right) + 1)]
    for x in left:
        row, above = [0], best[-1]
        for y, node in enumerate(right):
            row.append(max(row[-1], above[y + 1], above[y] + known.get((x, node), 0)))
        best.append(row)
    return best


def simple_tree_matching(a: Shape, b: Shape) -> tuple[int, list[tuple[int, int]]]:
    """Largest order-preserving matching of two trees whose roots match, and its node pairs; without recursion.

    Subtrees alike match whole, and so do children alike at both ends of their parents' lists; between those, the classic
    table over both lists.
    """
    if a.labels[0] != b.labels[0]:
        return 0, []
    known: dict[tuple[int, int], int] = {}
    todo = [(0, 0)]
    while todo:
        i, j = todo[-1]
        if (i, j) in known:
            todo.pop()
        elif a.keys[i] == b.keys[j]:
            known[todo.pop()] = a.sizes[i]
        else:
            left, right, head, tail = _ends(a, b, i, j)
            inner, other = left[head : len(left) - tail], right[head : len(right) - tail]
            missing = [(x, y) for x in inner for y in other if a.labels[x] == b.labels[y] and (x, y) not in known]
            if missing:
                todo += missing
                continue
            ends = sum(a.sizes[x] for x in left[:head] + left[len(left) - tail :])
            known[todo.pop()] = 1 + ends + _table(a, b, inner, other, known)[-1][-1]
    pairs, todo = [], [(0, 0)]
    while todo:
        i, j = todo.pop()
        if a.keys[i] == b.keys[j]:
            pairs += [(i + n, j + n) for n in range(a.sizes[i])]
            continue
        pairs.append((i, j))
        left, right, head, tail = _ends(a, b, i, j)
        todo += zip(left[:head], right[:head])
        todo += zip(left[len(left) - tail :], right[len(right) - tail :])
        inner, other = left[head : len(left) - tail], right[head : len(right) - tail]
        best, x, y = _table(a, b, inner, other, known), len(inner), len(other)
        while x and y:
            if best[x][y] == best[x - 1][y]:
                x -= 1
            elif best[x][y] == best[x][y - 1]:
                y -= 1
            else:
                x, y = x - 1, y - 1
                todo.append((inner[x], other[y]))
    return known[0, 0], pairs


class Wrapper:
    """A tree as plain lists, so that it can travel: labels, and for each node how many nodes its subtree has."""

    def __init__(self, labels: list[str], sizes: list[int]):
        self.labels, self.sizes, self.children, self.keys, self.paths = labels, sizes, [[] for _ in labels], [0] * len(labels), [0] * len(labels)
        for i in range(len(labels)):
            if not i:
                self.paths[0] = xxhash.xxh64_intdigest(f"0 {labels[0]}")
            at = i + 1
            while at < i + sizes[i]:
                self.children[i].append(at)
                self.paths[at] = xxhash.xxh64_intdigest(f"{self.paths[i]} {labels[at]}")
                at += sizes[at]
        for i in reversed(range(len(labels))):
            self.keys[i] = xxhash.xxh64_intdigest(f"{labels[i]} {' '.join(str(self.keys[c]) for c in self.children[i])}")


class HostTemplate:
    """What one host's aligned pages have in each slot: the most common texts (a frequent-items summary), pages that have them, and links."""

    def __init__(self, shape: Shape):
        self.shape, self.pages, self.seen = shape, 0, [0] * len(shape.labels)
        self.texts: list[dict[int, list]] = [{} for _ in shape.labels]
        self.chars, self.linked = [0] * len(shape.labels), [0] * len(shape.labels)
        self.paths, self.places = [*shape.paths], {}  # nodes without a mate have a place for each path, after the shape's

    def add(self, slots: list[tuple[int, int, int, int, int]], mate: dict[int, int], page: int) -> None:
        self.pages += 1
        for i, path, text, chars, linked in slots:
            at = mate.get(i)
            if at is None:
                if path not in self.places:
                    self.places[path] = len(self.paths)
                    self.paths.append(path)
                    self.seen.append(0)
                    self.texts.append({})
                    self.chars.append(0)
                    self.linked.append(0)
                at = self.places[path]
            self.chars[at] += chars
            self.linked[at] += linked
            self._count(at, text, page)

    def _count(self, at: int, text: int, page: int) -> None:
        self.seen[at] += 1
        held = self.texts[at]
        if text in held:
            held[text][0] += 1
            if len(held[text][1]) < WITNESSES:
                held[text][1].add(page)
        elif len(held) < SUMMARY:
            held[text] = [1, {page}]
        else:
            for t in list(held):
                held[t][0] -= 1
                if not held[t][0]:
                    del held[t]

    def rows(self) -> Iterator[tuple]:
        """(slot, pages, text, count, chars, linked, witnesses, labels, sizes): a row without text has the pages and characters, one without slot the tree."""
        for i, n in enumerate(self.seen):
            if n:
                yield self.paths[i], n, None, 0, self.chars[i], self.linked[i], [], None, None
                for text, (count, pages) in self.texts[i].items():
                    yield self.paths[i], 0, text, count, 0, 0, sorted(pages), None, None
        yield None, self.pages, self.shape.keys[0], 0, 0, 0, [], self.shape.labels, self.shape.sizes


VOTES = "host string, slot long, pages long, text long, n long, chars long, linked long, witnesses array<long>, labels array<string>, sizes array<int>"


def _signed(x: int | None) -> int | None:
    return None if x is None else x - (1 << 64) if x >> 63 else x


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Align the pages of each task by host and give the tasks' votes; templates leave when there are many."""
    templates: dict[str, list[HostTemplate]] = {}
    pairs: dict[tuple[int, int], tuple[int, dict[int, int]]] = {}

    def drain() -> Iterator[pa.RecordBatch]:
        rows = [(host, _signed(slot), n, _signed(text), count, chars, linked, [_signed(w) for w in seen], labels, sizes) for host, held in templates.items() for t in held for slot, n, text, count, chars, linked, seen, labels, sizes in t.rows()]
        templates.clear()
        types = [pa.string(), *[pa.int64()] * 6, pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32())]
        for at in range(0, len(rows), 20_000):
            columns = list(zip(*rows[at : at + 20_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in VOTES.split(", ")])

    count = 0
    for batch in batches:
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html")):
            root = parse(source.as_py())
            shape = Shape(root)
            # Pages are different if their main texts are: copies of one article that differ around it are one page.
            slots, page = shape.slots(), xxhash.xxh64_intdigest(_left(root).encode("utf-8", "replace"))
            held, best = templates.setdefault(host, []), None
            for t in held:
                key = (t.shape.keys[0], shape.keys[0])
                if key not in pairs:
                    if len(pairs) > 5_000:
                        pairs.clear()
                    score, found = simple_tree_matching(t.shape, shape)
                    pairs[key] = (score, {j: i for i, j in found})
                if best is None or pairs[key][0] > best[1][0]:
                    best = (t, pairs[key])
            if best is None or 2 * best[1][0] < len(shape.labels):
                held.append(HostTemplate(shape))
                count += 1
                best = (held[-1], (0, {i: i for i in range(len(shape.labels))}))
            best[0].add(slots, best[1][1], page)
            if count >= 2_000:
                count = 0
                yield from drain()
    yield from drain()


def _host(url_col: str) -> Column:
    return F.lower(F.regexp_extract(empty_if_null(url_col), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))


def host_templates(pages: DataFrame, scratch: Scratch, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, constant, menus, labels, sizes): hashed (slot, text) pairs that are constant over the pages of a host, slots that are menus there,
    and the tree that most of its pages were aligned with."""
    rows = pages.select(_host(url_col).alias("host"), empty_if_null(html_col).alias("html"))
    # One row for each task, host, slot and frequent text: sums by host never meet whole pages.
    votes = scratch.write(rows.mapInArrow(_vote, VOTES), "votes")
    texts = votes.where("slot IS NOT NULL").groupBy("host", "slot", "text").agg(
        F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.collect_set(F.slice("witnesses", 1, WITNESSES)).alias("w")
    )
    texts = scratch.write(texts.select("host", "slot", "text", "pages", "n", "chars", "linked", F.size(F.array_distinct(F.flatten("w"))).alias("different")), "texts")
    slots = texts.where("text IS NULL").select("host", "slot", F.col("pages").alias("of"), "chars", "linked")
    menu = (F.col("of") >= LINK_PAGES) & (F.col("linked") >= LINK_SHARE * F.col("chars"))
    fixed = texts.where(F.col("text").isNotNull() & (F.col("different") >= CONSTANT_PAGES)).select("host", "slot", "text", "n")
    fixed = fixed.join(slots.select("host", "slot", "of").hint("merge"), ["host", "slot"]).where(F.col("n") >= CONSTANT_SHARE * F.col("of"))
    found = fixed.select("host", F.struct("slot", "text").alias("pair"), F.lit(None).cast("long").alias("menu")).union(slots.where(menu).select("host", F.lit(None), "slot"))
    found = found.groupBy("host").agg(F.collect_set("pair").alias("constant"), F.collect_set("menu").alias("menus"))
    trees = votes.where("slot IS NULL").groupBy("host", F.col("text").alias("key")).agg(F.sum("pages").alias("pages"), F.any_value(F.struct("labels", "sizes")).alias("tree"))
    trees = trees.groupBy("host").agg(F.max_by("tree", F.struct("pages", "key")).alias("tree"))
    out = scratch.write(trees.join(found.hint("merge"), "host", "left").select("host", "constant", "menus", "tree.labels", "tree.sizes"), "templates")
    scratch.drop(votes, texts)
    return out


def _left(root: Node, fixed: set[int] = frozenset(), menus: set[int] = frozenset()) -> str:
    """Blocks of the articles (else of main, else of the body) without the own texts of the nodes in fixed (by id()), and outside
    article and main of those in menus; nodes whose names only hint at other text leave with all below if the template has all of their texts in either."""
    order = _below(root)
    has_part, ours = {}, {}
    for node in reversed(order):
        has_part[id(node)] = node.tag in PART or any(has_part[id(c)] for c in node.children)
        own = id(node) in fixed or id(node) in menus or not node.text()
        ours[id(node)] = own and all(ours[id(c)] for c in node.children)
    parts: dict[str, list[str]] = {"article": [], "main": [], "": []}
    whole: dict[str, list[str]] = {"article": [], "main": [], "": []}
    todo: list[tuple[Node | str, str, bool, bool]] = [(root, "", False, False)]
    while todo:
        node, kind, drop, shown = todo.pop()
        if isinstance(node, str):
            if shown:
                whole[kind].append(node)
                if not drop:
                    parts[kind].append(node)
            continue
        if node.out and not (kind == "" and has_part[id(node)]):
            continue
        if node.weak and ours[id(node)]:
            continue
        kind = "article" if node.tag == "article" or kind == "article" else "main" if node.tag == "main" else kind
        drop = id(node) in fixed or (kind == "" and id(node) in menus)
        todo += [(p, kind, drop, not node.out) for p in reversed(node.parts)]
    for kind in ("article", "main"):
        if parts[kind] or whole[kind]:
            return "\n\n".join(parts[kind] or whole[kind])
    return "\n\n".join(parts[""])


class HostRules:
    """A host's template, ready for its pages."""

    def __init__(self, constant=(), menus=(), labels=(), sizes=()):
        self.constant, self.menus = {(x["slot"], x["text"]) for x in constant or ()}, set(menus or ())
        self.tree = Wrapper(list(labels), list(sizes)) if labels and (self.constant or self.menus) else None
        self.mates: dict[int, dict[int, int]] = {}

    def decide(self, shape: Shape) -> tuple[set[int], set[int]]:
        """The nodes (by id()) of an aligned page whose text is the template's, and those that are menus.

        A node with a mate in the host's tree follows its mate's slot; one without a mate is content, unless its own
        (slot, text) is constant all the same.
        """
        if not self.tree:
            return set(), set()
        key = shape.keys[0]
        if key not in self.mates:
            if len(self.mates) >= 1_000:
                self.mates.clear()
            self.mates[key] = {j: i for i, j in simple_tree_matching(self.tree, shape)[1]}
        mate, fixed, menus = self.mates[key], set(), set()
        for i, path, text, _, _ in shape.slots():
            slot = _signed(self.tree.paths[mate[i]] if i in mate else path)
            if (slot, _signed(text)) in self.constant:
                fixed.update(map(id, shape.nodes[i]))
            elif i in mate and slot in self.menus:
                menus.update(map(id, shape.nodes[i]))
        return fixed, menus


def main_text(source: str, rules: HostRules | None = None) -> str:
    """Blocks of the articles (else of main, else of the body) joined by blank lines, without what elements, names
    or the host's template mark as not being main text. An article or main that the template would empty stays whole."""
    root = parse(source)
    return _left(root, *rules.decide(Shape(root))) if rules and rules.tree else _left(root)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Two passes over the pages: the first aligns the block trees of same-host pages and finds which slots hold the
    same text on most pages or mostly links; the second aligns every page, whole, with its host's tree, leaves out the text of those
    slots and all parts whose elements or names mark them, and keeps the varying slots. A host's
    pages are never gathered. Null html is empty and gives an empty text; pages without a host are one host; repeated
    rows each give a row; an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "wrapper")
    templates = host_templates(pages, scratch, url_col, html_col)
    held = F.size(F.coalesce("constant", F.array())) + F.size(F.coalesce("menus", F.array())) + F.size("labels")
    few = templates.agg(F.coalesce(F.sum(held), F.lit(0))).first()[0] <= BROADCAST_SLOTS
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), empty_if_null(html_col).alias("html"), _host(url_col).alias("host"))
    if few:
        rows = rows.join(F.broadcast(templates), "host", "left")
    else:
        # A host with a large part of all pages goes to many tasks: its template is sent to each.
        salts = F.lit(SALTS)
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("html"), salts))
        rows = rows.join(templates.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).hint("merge"), ["host", "_salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules: dict[str, HostRules] = {}
        for batch in batches:
            texts = []
            for host, source, *template in zip(batch.column("host").to_pylist(), batch.column("html"), *[batch.column(c) for c in ("constant", "menus", "labels", "sizes")]):
                if host not in rules:
                    if len(rules) >= 200:
                        rules.clear()
                    rules[host] = HostRules(*[x.as_py() for x in template])
                texts.append(main_text(source.as_py(), rules[host]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "host", "constant", "menus", "labels", "sizes").mapInArrow(run, "page_id long, url string, text string, n_chars long")
