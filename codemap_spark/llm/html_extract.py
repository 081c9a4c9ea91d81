"""HTML extraction by tree scoring.

A tokenizer builds the element tree with implied end tags. Each text block
passes points for its length and commas to its parent, and each element half of
its points to its own; an element's score is discounted by its link density and
moved by its tag and names. The best container and those of its siblings that
score well are kept, without menus, headers, footers, sidebars, notices,
adverts, forms and comments inside.

Navigation, footers and the like, by tag or role, never count. A name such as
``sidebar`` or ``comments`` takes an element out, and so do forms and names such
as ``widget`` or ``login``, but these last are spared where they wrap half of
the page's text or an article. Where that leaves nothing, names are ignored.

Every step is linear in the page: tags without end, attributes without closing
quotes and elements that are never closed cost no more than others. Nulls,
empty pages and pages without text give ''; of equal scores the earlier element
wins. Whole pages are read; null ids and repeated rows are each extracted, an
empty table has no rows, and extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codemap_spark.llm.scratch import trimmed

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)>""")
HINTS = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
STRONG = set("nav footer aside button select option menu dialog input textarea head".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "alertdialog"}


def _words(names: str) -> re.Pattern:
    return re.compile(rf"(?i)(?:^|[\s_-])(?:{names})(?:$|[\s_-])")


OUT = _words("ads?|adverts?|advertisement|advertising|sponsor(?:ed|s)?|cookies?|consent|gdpr|notices?|newsletter|subscribe|subscription|sidebar|side-bar|menu|navbar|nav|navigation|breadcrumbs?|pagination|pager|footer|comments?|comment-list|disqus|replies|respond|skip-link|toc|site-header|page-header|related|recommend(?:ed|ations)?|share|sharing")
WRAP = _words("promo(?:tion)?s?|banner|alert|popup|modal|overlay|signup|login|social|widget|masthead|topbar|toolbar")
GOOD = _words("article|articlebody|body|content|entry|main|page|post|story|text|hentry")
HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
#: An open element that ends when one of these starts.
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
SCOPE = {"table", "article", "section", "div", "main", "ul", "ol", "dl", "aside", "nav", "footer", "header", "body", "html", "blockquote", "form"}
BONUS = {"article": 25.0, "main": 15.0, "section": 3.0, "div": 3.0, "blockquote": 2.0, "td": 2.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "table": 0.0, "body": -10.0, "html": -20.0}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that hand all their points to their parent.
PARAGRAPHS = HEADINGS | {"p", "pre", "td", "li", "blockquote"}
#: How far back an end tag looks that was left out; tags without an end after which quotes no longer count.
BACK, FAILS = 64, 50
#: What an element is: part of the page, a wrapper that may be spared, taken out by its name, or by what it is.
FINE, WRAPPER, NAMED, NEVER = range(4)


class Node:
    __slots__ = ("tag", "up", "kind", "inner", "bonus", "score", "chars", "links", "main", "kids", "dead")

    def __init__(self, tag: str, up: "Node | None", kind: int, bonus: float):
        self.tag, self.up, self.kind, self.bonus = tag, up, kind, bonus
        self.inner = tag in ("article", "main") or up is not None and up.inner
        self.score, self.chars, self.links, self.main, self.kids, self.dead = 0.0, 0, 0, 0, [], False


def _node(tag: str, attrs: str, up: Node) -> Node:
    kind, bonus = NEVER if tag in STRONG or up.kind == NEVER or tag == "header" and not up.inner else WRAPPER if tag in ("form", "fieldset") else FINE, BONUS.get(tag, 0.0)
    if attrs and kind < NEVER:
        for name, value in HINTS.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            low = value.lower()
            if name in ("class", "id"):
                if tag not in ("body", "html", "article", "main"):
                    kind = max(kind, NAMED if OUT.search(value) else WRAPPER if WRAP.search(value) else FINE)
                if GOOD.search(value):
                    bonus += 20
            elif name == "hidden" or name == "aria-hidden" and low == "true" or name == "role" and low in ROLES or name == "style" and HIDDEN.search(value):
                kind = NEVER
            elif name == "role" and low in ("main", "article") or name == "itemprop" and low == "articlebody":
                bonus += 25
    return Node(tag, up, kind, bonus)


class _Tree:
    """The element tree of a page: nodes in the order of their start tags, and blocks (node, text) in page order."""

    def __init__(self, page: str):
        self.root = Node("", None, FINE, -30.0)
        self.nodes, self.blocks = [self.root], []
        self.stack, self.open = [self.root], Counter()
        self.parts: list[str] = []
        self.linked, self.in_link = 0, False
        self.read(page)

    def flush(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                node = self.stack[-1]
                while node.tag in INLINE:
                    node = node.up
                node.links += self.linked
                self.blocks.append((node, text))
            self.parts, self.linked = [], 0

    def put(self, raw: str) -> None:
        if raw:
            text = unescape(raw) if "&" in raw else raw
            if self.stack[-1].kind == NEVER and not text.isspace():
                return
            if self.stack[-1].tag in INLINE and self.stack[-1].kind > FINE and not text.isspace():
                return  # an inline advert or notice
            self.parts.append(text)
            self.linked += len(text) if self.in_link else 0

    def pop(self, k: int) -> None:
        for n in self.stack[k:]:
            self.open[n.tag] -= 1
        del self.stack[k:]

    def start(self, tag: str, attrs: str) -> None:
        if tag == "a":
            self.in_link = True
        node = _node(tag, attrs, self.stack[-1])
        if tag in INLINE and node.kind == FINE:
            return
        if ends := CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set()):
            least = max(0, len(self.stack) - 1 - BACK)
            k = len(self.stack) - 1
            while k > least and self.stack[k].tag not in ends and self.stack[k].tag not in SCOPE:
                k -= 1
            if k > 0 and self.stack[k].tag in ends:
                self.pop(k)
                node = _node(tag, attrs, self.stack[-1])
        self.nodes.append(node)
        self.stack[-1].kids.append(node)
        self.stack.append(node)
        self.open[tag] += 1

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        if not self.open[tag]:
            return
        k = len(self.stack) - 1
        if tag in INLINE:  # formatting does not end blocks
            least = max(0, k - BACK)
            while k > least and self.stack[k].tag in INLINE and self.stack[k].tag != tag:
                k -= 1
            if self.stack[k].tag == tag:
                self.pop(k)
        else:
            while self.stack[k].tag != tag:
                k -= 1
            self.pop(k)

    def read(self, page: str) -> None:
        at, fails, low = 0, 0, None
        while (lt := page.find("<", at)) >= 0:
            after = page[lt + 1 : lt + 2]
            if after in "!?" and after:
                self.put(page[at:lt])
                comment = page.startswith("<!--", lt)
                end = page.find("-->" if comment else ">", lt + (4 if comment else 1))
                at = len(page) if end < 0 else end + (3 if comment else 1)
                continue
            m = TAG.match(page, lt) if fails < FAILS else None
            if m is None and (after.isalpha() or after == "/"):
                fails += 1
                if (gt := page.find(">", lt)) < 0:
                    break
                m = TAG.match(page[lt : gt + 1].replace('"', " ").replace("'", " "))
                end = gt + 1
            else:
                end = m.end() if m else 0
            if m is None:
                self.put(page[at : lt + 1])
                at = lt + 1
                continue
            self.put(page[at:lt])
            at, tag = end, m[2].lower()
            if tag == "br":
                self.parts.append(" ")
                continue
            if tag not in INLINE and (tag not in VOID or tag == "hr"):
                self.flush()
            if m[1]:
                self.end(tag)
            elif tag in RAW:
                if low is None:
                    low = page.lower()
                    low = low if len(low) == len(page) else page
                end = low.find(f"</{tag}", at)
                at = len(page) if end < 0 else end
            elif tag not in VOID:
                self.start(tag, m[3])
        self.put(page[at:])
        self.flush()


def _kept(tree: _Tree, names: bool) -> list[str]:
    """The blocks to keep; without names, those of classes and ids take nothing out."""
    for n in tree.nodes:
        n.score, n.chars, n.main = 0.0, 0, 0
    points: dict[int, float] = {}
    for node, text in tree.blocks:
        if node.kind < NEVER:
            node.chars += len(text)
            points[id(node)] = points.get(id(node), 0.0) + 1.0 + text.count(",") + min(len(text) / 100, 3)
    links = {id(n): n.links for n in tree.nodes}
    for n in reversed(tree.nodes[1:]):  # children come after their parents
        if n.tag in ("article", "main"):
            n.main = n.chars
        n.up.main += n.main
        if n.kind < NAMED or not names:
            n.up.chars += n.chars
            links[id(n.up)] += links[id(n)]
    total = tree.root.chars
    for n in tree.nodes:
        spared = 2 * n.chars >= total or n.main and 2 * n.main >= n.chars
        n.dead = n.up is not None and n.up.dead or n.kind == NEVER or names and (n.kind == NAMED or n.kind == WRAPPER and not spared)
    for n in reversed(tree.nodes):
        own = points.get(id(n), 0.0)
        if n.tag in PARAGRAPHS and n.up is not None:
            n.up.score += own + n.score / 2  # a paragraph passes its points to what is around it
        else:
            n.score += own
            if n.up is not None and not n.dead:
                n.up.score += n.score / 2

    def worth(n: Node) -> float:
        s = n.score + n.bonus
        return s * (1 - min(1.0, links[id(n)] / max(1, n.chars))) if s > 0 else s

    alive = [n for n in tree.nodes if not n.dead and n.chars]
    if not alive:
        return []
    best = max(alive, key=lambda n: (worth(n), n.chars))
    around = best
    while around is not None and around.tag not in ("article", "main"):
        around = around.up
    if around is not None and around.tag == "article":
        best = around
    kept = {id(best)}
    if best.up is not None:
        least, seen = max(10.0, 0.2 * worth(best)), False
        for n in best.up.kids:
            seen = seen or n is best
            if not n.dead and n.chars and (worth(n) >= least or n.tag == "p" and n.chars > 80 and links[id(n)] < 0.25 * n.chars or n.tag in HEADINGS and not seen):
                kept.add(id(n))
    inside: dict[int, bool] = {}
    for n in tree.nodes:  # parents first
        inside[id(n)] = not n.dead and (id(n) in kept or n.up is not None and inside[id(n.up)])
    return [t for n, t in tree.blocks if inside[id(n)]]


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    tree = _Tree(page)
    return "\n\n".join(_kept(tree, True) or _kept(tree, False))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    schema = T.StructType([pages.schema[id_col], pages.schema[url_col], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return pages.select(id_col, url_col, html_col).mapInArrow(trimmed(run), schema)
