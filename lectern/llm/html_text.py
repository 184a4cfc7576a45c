"""HTML extraction by consensus host paths.

Pass 1 scores the containers of every page and emits the best ones' generalised tag-class paths; Spark sums the votes
of a host (partially aggregated, so a hot host is a few rows a task) and keeps its winning path. Pass 2 extracts the
text of the containers on the host's winning path; a page that has none on it falls back to its own best container.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable
from .workers import tidy

NAME_END = re.compile(r"[^\s/>]+")
TAG_STOP = re.compile("[>\"']")
ATTR = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINER = frozenset("article body div main section td center".split())
DROP_TAGS = frozenset("nav footer aside form script style noscript iframe button select option textarea input label template svg math canvas object embed applet audio video dialog menu head title".split())
# Names of parts that are not the article, as a whole word of a class or an id; or, joined by - or _, with each other and
# with words that say nothing. ``share-price`` or ``legal-note`` are not such names, whatever they hold.
DROP_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar topbar masthead footer colophon sidebar aside rail "
    "notice notices cookie cookies consent gdpr banner popup modal newsletter subscribe "
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promoted promotion outbrain taboola "
    "comment comments disqus respond replies".split()
)
NEUTRAL = frozenset("area bar block bottom box container form inner left list outer reader right section site slot thread top unit user widget wrap wrapper".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CLOSES = {  # an opening tag ends these open ones, up to the given fence
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
DIGITS, JOINT = re.compile(r"\d+"), re.compile(r"[-_\d]+")


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    def names(self) -> dict[str, str]:
        if "=" not in self.attrs:
            return {}
        return {k.lower(): unescape(a or b or c) for k, a, b, c in ATTR.findall(self.attrs)}

    def step(self) -> str:
        """Tag and classes, digits generalised: ``div.post.post-#``."""
        words = sorted({DIGITS.sub("#", w.lower()) for w in self.names().get("class", "").split()})
        return ".".join([self.tag, *words])

    def path(self) -> str:
        out, node = [], self
        while node.parent is not None:
            out.append(node.step())
            node = node.parent
        return ">".join(reversed(out))

    def dropped(self) -> bool:
        if self.tag in DROP_TAGS:
            return True
        if not self.attrs:
            return False
        names = self.names()
        if names.get("role", "").lower() in DROP_ROLES or "hidden" in names or names.get("aria-hidden", "").lower() == "true":
            return True
        if self.tag in ("body", "html", "article", "main"):
            return False
        return any(_boilerplate(w) for w in f"{names.get('class', '')} {names.get('id', '')}".lower().split())


def _boilerplate(name: str) -> bool:
    words = [w for w in JOINT.split(name) if w]
    return any(w in DROP_NAMES for w in words) and all(w in DROP_NAMES or w in NEUTRAL for w in words)


def tokens(html: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, name, attributes, end) of a page in one pass: text, open and close tags. The caller may send the place from
    which to go on (behind a script). Comments and declarations give nothing; a tag that the page's end cuts short goes with all
    behind it, as in browsers. A value whose quote is never closed ends with its tag, at the next ``>``."""
    at, n, closed = 0, len(html), {'"': True, "'": True}  # closed: may there be such a quote further on?
    while at < n:
        here = html.find("<", at)
        while here >= 0 and not (html[here + 1 : here + 2].isascii() and html[here + 1 : here + 2].isalpha() or html[here + 1 : here + 2] in ("/", "!", "?") and here + 2 < n):
            here = html.find("<", here + 1)
        if here < 0:
            yield "text", html[at:], "", n
            return
        if here > at:
            yield "text", html[at:here], "", here
        sign = html[here + 1]
        if sign in "!?":
            if html.startswith("<!--", here):
                end, after = html.find("-->", here + 2), 3
            elif html.startswith("<![CDATA[", here):
                end, after = html.find("]]>", here + 9), 3
                yield "text", html[here + 9 : end if end >= 0 else n].replace("&", "&amp;"), "", here
            else:
                end, after = html.find(">", here), 1
            at = end + after if end >= 0 else n
            continue
        close = sign == "/"
        name = NAME_END.match(html, here + 1 + close)
        if close and (name is None or not name[0][0].isalpha()):  # </ without a name is a comment
            end = html.find(">", here)
            at = end + 1 if end >= 0 else n
            continue
        stop = name.end()
        while (m := TAG_STOP.search(html, stop)) is not None and m[0] != ">":
            quote, stop = m[0], m.end()
            if html[: m.start()].endswith("=") if m.start() < 64 else html[m.start() - 64 : m.start()].rstrip().endswith("="):
                end = html.find(quote, stop) if closed[quote] else -1
                if end < 0:
                    closed[quote] = False
                else:
                    stop = end + 1
        if m is None:
            return
        at = m.end()
        back = yield "close" if close else "open", name[0].lower(), html[name.end() : m.start()], at
        if back is not None:
            at = back
            yield "", "", "", at


def parse(html: str) -> Node:
    """A tree of nodes and strings. Ends that are missing are put where the rules of the language have them."""
    root = node = Node("#root")
    open_ = Counter()  # tags on the way from the root to here
    some = tokens(html)

    def leave(last: Node) -> Node:
        """The parent of ``last``, after all that is open down from it is closed."""
        nonlocal node
        while node is not last:
            open_[node.tag] -= 1
            node = node.parent
        open_[last.tag] -= 1
        return last.parent

    for kind, tag, attrs, at in some:
        if kind == "text":
            node.kids.append(tag)
            continue
        if kind == "close":
            up = node if open_[tag] > 0 else root
            while up is not root and up.tag != tag:
                if up.tag in ("td", "th", "table", "body") and tag not in ("tr", "table", "tbody", "thead", "tfoot", "body", "html", "article", "main"):
                    up = root
                    break
                up = up.parent
            if up is not root:
                node = leave(up)
            elif tag == "br":
                node.kids.append(Node("br", "", node))
            continue
        if tag in BLOCK and open_["p"] > 0:
            # an open paragraph ends at any block, and what is open in it
            up = node
            while up is not root and up.tag not in CONTAINER and up.tag not in ("p", "li", "td", "th", "button", "table"):
                up = up.parent
            if up.tag == "p":
                node = leave(up)
        if tag in CLOSES and any(open_[t] > 0 for t in CLOSES[tag][0]):
            ends, fence = CLOSES[tag]
            up, cut = node, None
            while up is not root and up.tag not in fence:
                if up.tag in ends:
                    cut = up
                up = up.parent
            if cut is not None:
                node = leave(cut)
        new = Node(tag, attrs, node)
        node.kids.append(new)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = RAW[tag].search(html, at)
            if tag in ("textarea", "title"):
                new.kids.append(html[at : end.start() if end else len(html)])
            some.send(end.end() if end else len(html))
        else:
            node = new
            open_[tag] += 1
    return root


def blocks(node: Node) -> list[str]:
    """The texts of a node's blocks in page order, without parts that are not the article; of a header only its headings."""
    out: list[str] = []
    run: list[str] = []

    def flush():
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text:
                out.append(text)
            run.clear()

    # children still to come, whether their parent is a block, is or is in a heading, is in a header: pages may be nested deeply
    stack = [(iter(node.kids), True, False, False)]
    while stack:
        kids, block, heading, header = stack[-1]
        k = next(kids, None)
        if k is None:
            stack.pop()
            if block:
                flush()
        elif isinstance(k, str):
            if heading or not header:
                run.append(k)
        elif k.tag == "br":
            run.append(" ")
        elif k.dropped():
            if k.tag in BLOCK:
                flush()
        elif k.tag in BLOCK:
            flush()
            stack.append((iter(k.kids), True, (heading and k.tag != "header") or k.tag in HEADINGS, header or k.tag == "header"))
        else:
            stack.append((iter(k.kids), False, heading, header))
    return out


def scores(root: Node) -> list[tuple[Node, float]]:
    """Containers that aren't dropped and their score: the text of their own and their paragraph-like children's blocks,
    links counting against it; a container that only wraps a better one gets less."""
    found: list[tuple[Node, float]] = []
    stack: list[list] = [[root, iter(root.kids), False, 0.0]]  # node, children still to come, in a link, own text
    while stack:
        top = stack[-1]
        k = next(top[1], None)
        if k is None:
            x, _, _, own = stack.pop()
            if x.tag in CONTAINER and own > 0:
                found.append((x, own * (1.5 if x.tag in ("article", "main") else 1.0)))
            if stack:
                stack[-1][3] += own if x.tag not in CONTAINER else 0.25 * own
        elif isinstance(k, str):
            top[3] += len(k.strip()) * (-1.0 if top[2] else 1.0)
        elif not k.dropped() and k.tag != "header":
            stack.append([k, iter(k.kids), top[2] or k.tag == "a", 0.0])
    return found


def best(root: Node) -> tuple[Node, float] | None:
    """The container with the highest score; of equal ones the first in page order closes first, so the inner one."""
    some = scores(root)
    return max(some, key=lambda s: s[1]) if some else None


def on_path(root: Node, path: str) -> list[Node]:
    """Outermost nodes with this path, in page order."""
    steps, level = path.split(">"), [root]
    for step in steps:
        tag = step.split(".")[0]
        level = [k for x in level for k in x.kids if not isinstance(k, str) and k.tag == tag and k.step() == step]
    return [x for x in level if not x.dropped()]


def extract(html: str, path: str | None) -> str:
    """Main text of a page, by the host's path where the page has it, or else by the page's best container or its root."""
    root = parse(html)
    nodes = on_path(root, path) if path else []
    text = "\n".join(b for x in nodes for b in blocks(x))
    if text:
        return text
    own = best(root)
    return "\n".join(blocks(own[0] if own else root))


HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def _vote(html: str) -> list[tuple[str, float]]:
    """Paths of the best container and of those close to it; a page's votes sum to 1, so long pages count like others."""
    some = scores(parse(html))
    if not some:
        return []
    top = max(s for _, s in some)
    near: dict[str, float] = {}
    for node, s in some:
        if s >= 0.7 * top:
            near[p] = near.get(p := node.path(), 0.0) + s
    total = sum(near.values())
    return [(p, s / total) for p, s in near.items()]


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", out: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the html) of ``pages`` and ``out``, the main text ('' if there is none).

    Null html is empty; a null url or one without a host is the host ''. A host's winning path has the most votes, of
    equal ones the smallest path. Blocks (paragraphs, headings, items, cells) are joined by one newline, white space in
    a block is one blank. Repeated rows stay; an empty table stays empty; ``keep`` may have any names. Very
    long and deeply nested pages are read whole, in time that grows with their length."""
    host = F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), HOST, 1))
    keep = [c for c in (pages.columns if keep is None else keep) if c not in (html_col, out)]

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, paths, votes = [], [], []
            for h, html in zip(b.column(0).to_pylist(), pc.fill_null(b.column(1), "").to_pylist(), strict=True):
                for p, v in _vote(html):
                    hosts.append(h)
                    paths.append(p)
                    votes.append(round(v * 1_000_000))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes, pa.int64())], names=["__host", "path", "votes"])

    votes = pages.select(host.alias("__host"), html_col).mapInArrow(tidy(vote), "__host string, path string, votes long")
    totals = votes.groupBy("__host", "path").agg(F.sum("votes").alias("votes"))
    winners = durable(totals.groupBy("__host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "path")).alias("w")).select("__host", F.col("w.path").alias("__path")), "host-paths")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h, p) for h, p in zip(pc.fill_null(b.column("__html"), "").to_pylist(), b.column("__path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, out])

    # the planner broadcasts the winners where their written size is under its limit, or else joins by host and splits a hot one
    joined = pages.select(*keep, F.col(html_col).alias("__html"), host.alias("__host")).join(winners, "__host", "left").drop("__host")
    return joined.mapInArrow(tidy(cut), T.StructType([pages.schema[c] for c in keep] + [T.StructField(out, T.StringType())]))
