"""Main text of web pages by a tree-structured graphical model over the DOM.

Each element that makes a block, and each block of text, is a node that is content or not.
A node has a potential from its tag, its class, id and role names and its share of link text; each
edge has one for the labels of parent and child.  On a tree, one sum-product pass upward and one downward
give every node's exact marginal; text blocks with a marginal of at least one half are the
main text.  The weights maximise the conditional likelihood of labelled pages
(``labelled_pages``): the gradient is observed less expected counts from the same marginals.

Pages are independent, so nothing is shuffled.  A page's whole html is read.

Text: character references are decoded, white space inside a block becomes one space, blocks
are joined in page order by one line feed.  Scripts, styles, head, and what a browser does not show are never text.

Edge cases: null or empty html gives an empty text; unclosed and stray tags are repaired as far as
blocks need it (a head ends at what can't stand in it, other unseen elements at their parent's end or the next block); rows that repeat are each returned; an empty table gives an empty result; other columns
stay as they are.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .common import text_of

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(\bhidden\b)")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# How HTML elements are shown and nested.
INLINE = set("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small
span strike strong sub sup time tt u var wbr""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noembed noframes xmp".split())
UNSEEN = RAW | set("noscript template svg math canvas audio video object select datalist button option map".split())
# elements that end an open drawing or formula
BREAKOUT = set("""address article aside blockquote body center dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr
li main menu nav ol p pre section table tbody td tfoot th thead tr ul""".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
             "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
          "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}


@dataclass
class Node:
    tag: str
    parent: int
    above: str = ""  # the parent's tag
    names: tuple[str, ...] = ()
    label: int | None = None
    text: list[str] = field(default_factory=list)
    chars: int = 0
    link_chars: int = 0


class Page:
    """The block elements and text blocks of a page, parents first."""

    def __init__(self, source: str, labelled: bool = True):
        self.labelled = labelled  # whether attributes y are labels
        self.ends: dict[str, dict[int, int]] = {}  # per tag of unseen elements: place of a start tag -> place after its end tag
        self.endless: set[tuple] = set()  # elements around an unclosed one of which none ends later
        self.nodes = [Node("#root", -1, label=1)]
        self.stack: list[tuple[str, int]] = [("#root", 0)]  # open elements, inline ones too, and their node
        self.block: Node | None = None
        self.links = 0
        self.read(source)

    def read(self, source: str) -> None:
        at, n, unseen = 0, len(source), 0
        while at < n:
            found = TOKEN.search(source, at)
            end = found.start() if found else n
            if end > at:
                self.add_text(source[at:end])
            if not found:
                break
            at = found.end()
            closing, tag, attributes = found.groups()
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "head":  # what may stand in a head is unseen by itself; anything else ends the head
                continue
            if closing:
                self.close(tag)
            elif tag in UNSEEN and not attributes.endswith("/"):
                at = self.skip(source, found.start(), at, tag)
            else:
                self.open(tag, attributes)

    def skip(self, source: str, start: int, at: int, tag: str) -> int:
        """The place after the end tag of an element that isn't shown."""
        if tag == "option":
            found = re.compile(r"</?option\b[^>]*>", re.I).search(source, at)
            return found.end() if found else at
        if (end := self.end_of(source, start, at, tag)) is not None:
            return end
        return at if tag in ("select", "button", "map", "object", "video", "audio") else self.unclosed(source, at, tag)

    def end_of(self, source: str, start: int, at: int, tag: str) -> int | None:
        """The place after the end tag of an unseen element, None if it has none.  Each tag is looked up in one pass."""
        if tag in RAW and tag != "noframes":
            if self.ends.get(tag) == {}:  # none from an earlier place on
                return None
            found = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            if not found:
                self.ends[tag] = {}
            return found.end() if found else None
        if tag not in self.ends:
            opened: list[int] = []
            self.ends[tag] = {}
            for found in re.finditer(rf"<(/?){tag}\b[^>]*>", source, re.I):
                if found[1] and opened:
                    self.ends[tag][opened.pop()] = found.end()
                elif not found[1] and not found[0].endswith("/>"):
                    opened.append(found.start())
        return self.ends[tag].get(start)

    def unclosed(self, source: str, at: int, tag: str) -> int:
        """Where an unseen element without an end tag ends: at the end of an element around it or at the
        first element that makes a block.  With neither, only a script or the like takes the rest."""
        around = {name for name, _ in self.stack} | {"head", "body", "html"}
        inside: dict[str, int] = {}
        begin, kind = at, (tag in ("svg", "math"), frozenset(around))
        if kind in self.endless:
            return len(source) if tag in RAW else begin
        while found := TOKEN.search(source, at):
            at = found.end()
            closing, name, attributes = found.groups()
            if name is None:
                continue
            name = name.lower()
            if closing:
                if inside.get(name):
                    inside[name] -= 1
                elif name in around:
                    return found.start()
            elif name in UNSEEN:
                at = self.end_of(source, found.start(), at, name) or at
            elif name in INLINE:
                if name not in VOID and not attributes.endswith("/"):
                    inside[name] = inside.get(name, 0) + 1
            elif re.fullmatch("[a-z][a-z0-9]*", name) and not (tag in ("svg", "math") and name not in BREAKOUT):
                return found.start()
        self.endless.add(kind)
        return len(source) if tag in RAW else begin

    def open(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self.block = None
            if tag not in ("html", "body"):
                self.close_implied(tag)
        if tag == "br":
            self.add_text(" ")
        if tag in VOID:
            return
        node = self.stack[-1][1]
        if tag not in INLINE:
            names, label = [], None
            for key, *values, hidden in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), "".join(values)
                if key in ("class", "id", "role"):
                    names += [x.lower().rstrip("s") or x for x in NAME.findall(value)]
                elif key == "y" and self.labelled:
                    label = {"0": 0, "1": 1}.get(value)
                elif hidden or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                    names.append("#hidden")
            parent = node
            self.nodes.append(Node(tag, parent, self.nodes[parent].tag, tuple(dict.fromkeys(names)),
                                   self.nodes[parent].label if label is None else label))
            node = len(self.nodes) - 1
        elif tag == "a":
            self.links += 1
        self.stack.append((tag, node))

    def close_implied(self, tag: str) -> None:
        ends, scope = CLOSED_BY.get(tag), SCOPES.get(tag, set())
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.stack[k][0]
            if name == "p" or ends and name in ends:
                self.pop(k)
            elif name in scope or name not in INLINE and not (ends and name not in ("div", "section", "article")):
                return

    def close(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag not in INLINE:
            self.block = None
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.stack[k][0]
            if name == tag:
                self.pop(k)
                return
            if tag in INLINE and name not in INLINE:  # an inline end tag doesn't leave its block
                return

    def pop(self, k: int) -> None:
        self.links -= sum(name == "a" for name, _ in self.stack[k:])
        self.block = None if any(name not in INLINE for name, _ in self.stack[k:]) else self.block
        del self.stack[k:]

    def add_text(self, text: str) -> None:
        if self.block is None:
            if not text.strip():
                return
            parent = self.stack[-1][1]
            self.block = Node("#text", parent, label=self.nodes[parent].label)
            self.nodes.append(self.block)
        self.block.text.append(text)
        size = len(text)
        self.block.chars += size
        if self.links:
            self.block.link_chars += size

    def blocks(self) -> list[tuple[int, str]]:
        out = []
        for i, node in enumerate(self.nodes):
            if node.text and (text := " ".join(html_lib.unescape("".join(node.text)).split())):
                out.append((i, text))
        return out


def features(node: Node) -> tuple[str, ...]:
    if node.tag == "#text":
        share = node.link_chars / max(1, node.chars)
        return ("text", "links>.8" if share > 0.8 else "links>.4" if share > 0.4 else "links<.4",
                *(["copyright"] if re.match(r"\s*(?:&copy;|©)", "".join(node.text[:1])) else []))
    return ("element", "tag=" + node.tag, f"tag={node.tag}<{node.above}", *("name=" + x for x in node.names))


@dataclass
class Model:
    unary: dict[str, float]  # log odds of content
    edge: dict[tuple[str, int, int], float]  # (kind of child, parent's label, child's label)

    def marginals(self, nodes: list[Node]) -> tuple[list[float], list[dict]]:
        """P(content) per node, and per node the joint of its parent's and its own label."""
        n = len(nodes)
        psi = {k: [[math.exp(self.edge.get((k, p, c), 0.0)) for c in (0, 1)] for p in (0, 1)] for k in ("text", "element")}
        cache: dict[tuple, float] = {}
        own, up, kinds = [], [None] * n, []
        for node in nodes:
            f = features(node)
            if f not in cache:
                cache[f] = math.exp(max(-30.0, min(30.0, sum(self.unary.get(x, 0.0) for x in f))))
            own.append([1.0, cache[f]])
            kinds.append(psi[f[0]])
        belief = [list(x) for x in own]
        for i in range(n - 1, 0, -1):  # upward: children come after their parents
            b, w = belief[i], kinds[i]
            m0, m1 = w[0][0] * b[0] + w[0][1] * b[1], w[1][0] * b[0] + w[1][1] * b[1]
            s = m0 + m1
            up[i] = (m0 / s, m1 / s)
            parent = belief[nodes[i].parent]
            parent[0] *= up[i][0]
            parent[1] *= up[i][1]
            s = parent[0] + parent[1]
            parent[0] /= s
            parent[1] /= s
        joint: list = [None] * n
        full = [None] * n
        full[0] = belief[0]
        for i in range(1, n):  # downward
            p, b, w = full[nodes[i].parent], belief[i], kinds[i]
            c0, c1 = p[0] / max(up[i][0], 1e-300), p[1] / max(up[i][1], 1e-300)
            j = [[c0 * w[0][0] * b[0], c0 * w[0][1] * b[1]], [c1 * w[1][0] * b[0], c1 * w[1][1] * b[1]]]
            s = j[0][0] + j[0][1] + j[1][0] + j[1][1]
            joint[i] = [[x / s for x in row] for row in j]
            full[i] = [joint[i][0][0] + joint[i][1][0], joint[i][0][1] + joint[i][1][1]]
        return [f[1] / (f[0] + f[1]) for f in full], joint

    def text(self, source: str | None) -> str:
        if not source:
            return ""
        page = Page(source, labelled=False)
        content, _ = self.marginals(page.nodes)
        return "\n".join(t for i, t in page.blocks() if content[i] >= 0.5)


def train(pages: list[str], rounds: int = 100, rate: float = 0.3, l2: float = 0.01) -> Model:
    """Conditional likelihood by gradient ascent (a few pages of some fifty nodes; see the operator
    for where it runs)."""
    trees = [Page(p).nodes for p in pages]
    model = Model({}, {})
    for _ in range(rounds):
        unary: dict = {k: -l2 * v for k, v in model.unary.items()}
        edge: dict = {k: -l2 * v for k, v in model.edge.items()}
        for nodes in trees:
            content, joint = model.marginals(nodes)
            for i, node in enumerate(nodes):
                f = features(node)
                gap = node.label - content[i]
                for x in f:
                    unary[x] = unary.get(x, 0.0) + gap
                if i:
                    seen = (nodes[node.parent].label, node.label)
                    for p in (0, 1):
                        for c in (0, 1):
                            key = (f[0], p, c)
                            edge[key] = edge.get(key, 0.0) + ((p, c) == seen) - joint[i][p][c]
        for total, weights in ((unary, model.unary), (edge, model.edge)):
            for k, g in total.items():
                weights[k] = weights.get(k, 0.0) + rate * max(-1.0, min(1.0, g))
    return model


def main_text(pages: DataFrame, labelled: list[str] | None = None, html_col: str = "html") -> Column:
    """A column for ``pages``: the main text.  The model is trained once, on the driver, from the given
    labelled pages (by default the few of ``labelled_pages``), and broadcast: some hundred weights."""
    from .labelled_pages import PAGES

    sent = pages.sparkSession.sparkContext.broadcast(train(labelled or PAGES))

    @F.arrow_udf("string")
    def extract(source):
        import pyarrow as pa
        model = sent.value
        return pa.array([model.text(s) for s in source.to_pylist()], pa.string())

    return extract(text_of(html_col))
