"""Main text of HTML pages by wrapper induction.

Each page's DOM tree is aligned with that of its host's exemplar by simple tree matching. Over all distinct pages of
the host (copies count once) it is counted how often a block is matched to each node of the exemplar, and how often both
hold the same text. Nodes that nearly always hold the same text are the template, the others are slots; blocks that fall
on the template are left out. A host's exemplar is the page with the smallest page_id that has text, of the layout (set
of sections with their first class) with the most distinct pages; each other layout with enough distinct pages has an
exemplar of its own, and its pages are aligned with both. Elements whose name, role or class says that they are menus, forms,
notices and the like are left out before. Where a page marks its articles, all of them are its main text, and only a
template node with much support is left out inside them, never all of their blocks.

Tree matching works on runs of siblings with the same label: two runs are matched member by member, in order, so a
list of a thousand paragraphs is one run. Scanning, parsing and matching need neither recursion nor backtracking, so
neither deep nesting nor unclosed quotes stop them; a tag that never ends takes the rest of its page with it.

Defined results: null html and pages without text give the empty text; null urls are a host of their own; repeated
rows get a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import html
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick

#: An exemplar's size limit for a broadcast, in bytes of all exemplars' skeletons; template rows (host hash, node).
BROADCAST_BYTES = 32 << 20
BROADCAST_ROWS = 500_000
#: Support and constancy from which a node is template: outside a marked article, and inside it.
OUTSIDE, INSIDE = (3, 0.8), (20, 0.95)

#: A start or end tag. Quotes count only after an equals sign; every repeat is possessive, so there is no going back.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?+)*+)>")
COMMENT_END = re.compile("--!?>")
ATTRIBUTE = re.compile(r"([^\s=>/\"'][^\s=>/]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
#: What the HTML standard says about elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr math semantics mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "optgroup": {"select"}, "tbody": {"table"}}
#: Elements, roles and words in classes and ids that stand for what isn't main text.
DROPPED = frozenset("nav footer aside form button select textarea input iframe svg annotation annotation-xml object embed canvas audio video dialog menu head title script style noscript template noembed noframes xmp datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_WORDS = (
    r"ads?|adverts?|advertis\w*|adsense|banner|cookies?|consent|gdpr|notices?|comments?|commentlist|disqus|respond|replies|sidebar|menu|navbar|navigation|nav|breadcrumbs?|footer|masthead|site-header|page-header|topbar|share|sharing|social|related|recommended"
    r"|promo|promoted|sponsor|sponsored|newsletter|subscribe|subscription|signup|popup|modal|overlay|widget|pagination|pager|toolbar|login|skip-link|copyright|disclaimer"
)
NAMES = re.compile(rf"(?:^|[\s_-])(?:{_WORDS})(?:$|[\s_-])", re.I)
#: Inside an article only a whole name counts: a paragraph about a share price is text.
WHOLE_NAMES = re.compile(rf"(?:^|\s)(?:{_WORDS})(?:$|\s)", re.I)


class Node:
    __slots__ = ("tag", "label", "attrs", "children", "index", "parent", "texts", "block", "last")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.label, self.children, self.texts, self.index = tag, [], [], -1
        #: The nearest element, itself or above, that isn't inline.
        self.block: Node = parent.block if parent is not None and tag in INLINE else self


def tokens(page: str):
    """(text, tag match or None) in order: a text, and the tag after it. Each character is looked at a bounded number of
    times: a tag that never ends takes the rest of the page with it, as in the HTML standard."""
    begin = at = 0
    while (at := page.find("<", at)) >= 0:
        after = page[at + 1 : at + 2]
        if after.isascii() and after.isalpha() or after == "/" and page[at + 2 : at + 3].isascii() and page[at + 2 : at + 3].isalpha():
            m = TAG.match(page, at)
            if m is None:
                break
            at = yield page[begin:at], m
        elif after in ("!", "?", "/") and after:
            if page.startswith("<!--", at):
                last = COMMENT_END.search(page, at + 2)
                end = last.end() if last else len(page)
            else:
                end = page.find(">", at) + 1 or len(page)
            yield page[begin:at], None
            at = end
        else:
            at += 1
            continue
        begin = at
    yield page[begin : at if at >= 0 else len(page)], None


def parse(page: str) -> Node:
    """A tree of elements; texts of an element are (position among the children, text)."""
    root = now = Node("#root", "", None)
    open_: dict[str, int] = {}
    lower = None

    def close(node: Node) -> Node:
        """Close an open element and all that is open inside it."""
        up = now
        while up is not node:
            open_[up.tag] -= 1
            up = up.parent
        open_[node.tag] -= 1
        return node.parent

    found = tokens(page)
    item = next(found, None)
    while item is not None:
        text, m = item
        if text:
            now.texts.append((len(now.children), text))
        if m is None:
            item = next(found, None)
            continue
        at, tag, attrs = m.end(), m[2].lower(), m[3]
        if m[1]:
            if open_.get(tag):
                up = now
                while up.tag != tag:
                    up = up.parent
                now = close(up)
        else:
            if tag in CLOSES_P or tag in ENDS:
                ends, stop = ENDS.get(tag, frozenset()), SCOPE.get(tag, ())
                up, last = now.block, None
                while up is not root and up.tag not in stop and (up.tag == "p" or up.tag in ends):
                    if up.tag in ends or tag in CLOSES_P:
                        last = up
                    up = up.parent.block
                if last is not None:
                    now = close(last)
            node = Node(tag, attrs, now)
            now.children.append(node)
            if tag in RAW:
                lower = page.lower() if lower is None else lower
                end = lower.find(f"</{tag}", at) if len(lower) == len(page) else _find_end(page, tag, at)
                stop_at = page.find(">", end) if end >= 0 else -1
                at = len(page) if stop_at < 0 else stop_at + 1
            elif tag not in VOID and not attrs.endswith("/"):
                now = node
                open_[tag] = open_.get(tag, 0) + 1
        try:
            item = found.send(at)
        except StopIteration:
            item = None
    return root


def _find_end(page: str, tag: str, at: int) -> int:
    """Where an end tag begins, in a page that lower-casing would make longer."""
    m = re.compile(f"</{re.escape(tag)}", re.I | re.A).search(page, at)
    return m.start() if m else -1


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(node.attrs)} if node.attrs.strip() else {}


def _isnt_main(child: Node, inside: bool) -> bool:
    """Whether an element by name, role or class isn't main text; sets its label from its first class."""
    a = attributes(child) if child.attrs else {}
    drop = child.tag in DROPPED or child.tag == "header" and not inside
    if drop or not a:
        return drop
    name = f"{a.get('class', '')} {a.get('id', '')}"
    marked = child.tag in ("article", "main", "body", "html")
    first = a.get("class", "").split()[:1]
    child.label = f"{child.tag}.{first[0]}" if first else child.tag
    if a.get("role", "").lower() == "main" or a.get("itemprop", "").lower() == "articlebody":
        child.label = "main"
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    return (not marked or child.tag == "article" and "comment" in name.lower()) and (WHOLE_NAMES if inside else NAMES).search(name) is not None


def prune(root: Node) -> None:
    """Drop what by name, role or class isn't main text; label the rest by element and first class."""
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        kept, at = [], [0]
        for child in node.children:
            if not _isnt_main(child, inside):
                kept.append(child)
                todo.append((child, inside or child.tag == "article"))
            at.append(len(kept))
        node.children = kept
        node.texts = [(at[k], t) for k, t in node.texts]


def numbered(root: Node) -> list[Node]:
    """All nodes in page order, with their index and that of the last node inside them."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.index = node.last = len(out)
        out.append(node)
        todo.extend(reversed(node.children))
    for node in reversed(out):
        if node.parent is not None:
            node.parent.last = max(node.parent.last, node.last)
    return out


def skeleton(nodes: list[Node], found: list[tuple[Node, str]]) -> list[tuple[int, str, int]]:
    """(parent's index, label, hash of the texts of its blocks) of each node."""
    texts: dict[int, int] = {}
    for n, text in found:
        texts[n.index] = zlib.crc32(text.encode("utf-8", "replace"), texts.get(n.index, 0))
    return [(n.parent.index if n.parent is not None else -1, n.label, texts.get(n.index, 0)) for n in nodes]


class Skeleton:
    def __init__(self, rows):
        self.labels, self.texts = [r[1] for r in rows], [r[2] for r in rows]
        self.children: list[list[int]] = [[] for _ in rows]
        for k, r in enumerate(rows):
            if r[0] >= 0:
                self.children[r[0]].append(k)
        self.runs = [_runs(c, self.labels) for c in self.children]


def _runs(children: list[int], labels: list[str]) -> list[list[int]]:
    out: list[list[int]] = []
    for c in children:
        if out and labels[out[-1][0]] == labels[c]:
            out[-1].append(c)
        else:
            out.append([c])
    return out


def match(a: Skeleton, b: Skeleton) -> list[int]:
    """Simple tree matching from the roots: for each node of a the node of b, or -1."""
    to = [-1] * len(a.labels)
    if a.labels and b.labels:
        _align(a, 0, b, 0, to)
    return to


def _weight(a: Skeleton, i: int, b: Skeleton, j: int, known: dict) -> int:
    """Size of the largest matching of two subtrees with the same label, from the leaves up without recursion."""
    todo = [(i, j)]
    while todo:
        p, q = todo[-1]
        if (p, q) in known:
            todo.pop()
        elif not a.children[p] or not b.children[q]:
            known[p, q] = 1
        elif missing := [c for c in _child_pairs(a, p, b, q) if c not in known]:
            todo += missing
        else:
            known[p, q] = 1 + _table(a, p, b, q, known)[-1][-1]
    return known[i, j]


def _child_pairs(a: Skeleton, i: int, b: Skeleton, j: int):
    """The pairs of children that may be matched: members in order of runs with the same label."""
    return [c for r in a.runs[i] for s in b.runs[j] if a.labels[r[0]] == b.labels[s[0]] for c in zip(r, s, strict=False)]


def _table(a: Skeleton, i: int, b: Skeleton, j: int, known: dict) -> list[list[int]]:
    """The alignment of two elements' runs; known holds the weights of the pairs of their children."""
    x, y = a.runs[i], b.runs[j]
    rows = [[0] * (len(y) + 1)]
    for r in x:
        last, row = rows[-1], [0]
        for k, s in enumerate(y):
            best = max(row[-1], last[k + 1])
            if a.labels[r[0]] == b.labels[s[0]]:
                best = max(best, last[k] + sum(known[c] for c in zip(r, s, strict=False)))
            row.append(best)
        rows.append(row)
    return rows


def _align(a: Skeleton, i: int, b: Skeleton, j: int, to: list[int]) -> None:
    known: dict = {}
    todo = [(i, j)]
    while todo:
        i, j = todo.pop()
        to[i] = j
        x, y = a.runs[i], b.runs[j]
        if not x or not y:
            continue
        if [a.labels[r[0]] for r in x] == [b.labels[s[0]] for s in y]:
            for r, s in zip(x, y, strict=True):
                todo.extend(zip(r, s, strict=False))
            continue
        for c in _child_pairs(a, i, b, j):
            _weight(a, c[0], b, c[1], known)
        rows = _table(a, i, b, j, known)
        p, q = len(x), len(y)
        while p and q:
            if rows[p][q] == rows[p - 1][q]:
                p -= 1
            elif rows[p][q] == rows[p][q - 1]:
                q -= 1
            else:
                p, q = p - 1, q - 1
                todo.extend(zip(x[p], y[q], strict=False))


def blocks(root: Node) -> list[tuple[Node, str]]:
    """(element, text) of each block with text, in page order; white space is one space."""
    out: list[tuple[Node, list[str]]] = []
    fresh, owner = True, root
    todo: list = [(root, 0, 0)]
    while todo:
        node, k, t = todo.pop()
        if k == 0 and t == 0 and node.tag not in INLINE and node.tag not in ("br", "img", "input"):
            fresh, owner = True, node
        elif node.tag in ("br", "img") and k == 0 and t == 0 and out and not fresh:
            out[-1][1].append(" ")
        while t < len(node.texts) and node.texts[t][0] <= k:
            text = node.texts[t][1]
            if not fresh or text.strip():
                if fresh:
                    out.append((owner, []))
                    fresh = False
                out[-1][1].append(text)
            t += 1
        if k < len(node.children):
            todo.append((node, k + 1, t))
            todo.append((node.children[k], 0, 0))
        elif node.tag not in INLINE and node.tag not in ("br", "img", "input"):
            fresh, owner = True, node.parent.block if node.parent is not None else node
    return [(n, text) for n, parts in out if (text := " ".join(html.unescape("".join(parts)).split()))]


def region(nodes: list[Node], found: list[tuple[Node, str]]) -> tuple[list[tuple[Node, str]], bool]:
    """The blocks of all articles that the page marks, else of its main elements, else all; and whether it marks any."""
    for name in ("article", "main"):
        spans: list[tuple[int, int]] = []
        for n in nodes:  # in page order, so an element inside the one before adds nothing
            if (n.tag == name or n.label == name) and (not spans or n.index > spans[-1][1]):
                spans.append((n.index, n.last))
        if spans:
            starts = [x for x, _ in spans]
            inside = lambda k: (at := bisect.bisect_right(starts, k) - 1) >= 0 and k <= spans[at][1]  # noqa: B023, E731
            return [x for x in found if inside(x[0].index)], True
    return found, False


def page_tree(page: str | None) -> list[Node]:
    root = parse(page or "")
    prune(root)
    return numbered(root)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


SKELETON = "array<struct<parent:int,label:string,text:long>>"


def layout_of(page):
    """Hash of the page's distinct (section element, first class)."""
    found = F.regexp_extract_all(F.lower(page), F.lit(r"<(?:body|div|section|main|article|table|header|center)\b[^<>]*+>"), 0)
    name = lambda x: F.concat_ws(".", F.regexp_extract(x, "^<([a-z]+)", 1), F.regexp_extract(x, r"""\sclass\s*=\s*["']?\s*([a-z_-]+)""", 1))
    return F.xxhash64(F.array_sort(F.array_distinct(F.transform(found, name))))


def exemplar_pages(p: DataFrame) -> DataFrame:
    """(host, layout, page_id, content, main) of the exemplars: main for the host's largest layout."""
    filled = p.where(F.trim(F.regexp_replace("html", r"<[^<>]*+>", "")) != "")
    once = filled.groupBy("host", "layout", "content").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "content"))
    layouts = once.groupBy("host", "layout").agg(F.count("*").alias("n_distinct"), F.sum("n").alias("n"), first.alias("first"))
    largest = layouts.groupBy("host").agg(F.max_by("layout", F.struct("n_distinct", "n", "layout")).alias("largest"), F.sum("n").alias("n_host"))
    df = layouts.join(largest, "host").withColumn("main", F.col("layout") == F.col("largest"))
    return df.where(F.when(F.col("main"), F.col("n_host") > 1).otherwise(F.col("n_distinct") > OUTSIDE[0])).select("host", "layout", "first.page_id", "first.content", "main")


def aligned_blocks(pages: DataFrame) -> DataFrame:
    """page_id, url, host (hash), layout (null where the page has no exemplar but its host's), marked, blocks:
    array<struct<text, node (of the host's exemplar, or -1), same, own (node of the layout's exemplar, or -1), own_same>>."""
    p = pick(pages, page_id="long", url="string", html="string").withColumn("host", F.xxhash64(host_of(F.col("url"))))
    p = p.withColumn("layout", layout_of(F.col("html"))).withColumn("content", F.xxhash64("html"))
    first = cut(exemplar_pages(p), "first")
    few = first.count() <= BROADCAST_ROWS
    chosen_by = first.select(F.col("host").alias("h"), F.col("layout").alias("l"), F.col("page_id").alias("i"), F.col("content").alias("c"), "main")
    same_page = (F.col("host") == F.col("h")) & (F.col("layout") == F.col("l")) & (F.col("content") == F.col("c")) & F.col("page_id").eqNullSafe(F.col("i"))
    chosen = p.join(F.broadcast(chosen_by) if few else chosen_by, same_page).select("host", "layout", "main", "html")

    def learn(batches):
        for b in batches:
            trees = [page_tree(h) for h in b.column(3).to_pylist()]
            out = [[{"parent": x, "label": y, "text": z} for x, y, z in skeleton(t, blocks(t[0]))] for t in trees]
            kind = pa.list_(pa.struct([("parent", pa.int32()), ("label", pa.string()), ("text", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, kind)], ["host", "layout", "main", "exemplar"])

    learnt = chosen.mapInArrow(learn, f"host long, layout long, main boolean, exemplar {SKELETON}")
    known = cut(learnt.groupBy("host", "layout", "main").agg(F.max("exemplar").alias("exemplar")), "exemplars")
    size = known.agg(F.sum(F.aggregate("exemplar", F.lit(8), lambda s, x: s + 24 + F.length(x["label"])))).first()[0] or 0
    once = F.broadcast if size <= BROADCAST_BYTES else lambda df: df
    joined = p.join(once(known.where("main").select("host", "exemplar")), "host", "left")
    joined = joined.join(once(known.where("NOT main").select("host", "layout", F.col("exemplar").alias("own"))), ["host", "layout"], "left")
    joined = joined.select("page_id", "url", "host", F.when(F.col("own").isNotNull(), F.col("layout")).alias("layout"), "html", "exemplar", "own")

    def run(batches):
        cache: dict = {}
        kind = pa.list_(pa.struct([("text", pa.string()), ("node", pa.int32()), ("same", pa.bool_()), ("own", pa.int32()), ("own_same", pa.bool_())]))

        def exemplar(key, rows):
            if key not in cache:
                if len(cache) >= 500:
                    cache.clear()
                rows = rows.as_py()
                cache[key] = Skeleton([(r["parent"], r["label"], r["text"]) for r in rows]) if rows else None
            return cache[key]

        for b in batches:
            for start in range(0, b.num_rows, 200):
                part = b.slice(start, 200)
                marked, out = [], []
                hosts, layouts = part.column(2).to_pylist(), part.column(3).to_pylist()
                for k, page in enumerate(part.column(4).to_pylist()):
                    nodes = page_tree(page)
                    every = blocks(nodes[0])
                    found, sure = region(nodes, every)
                    marked.append(sure)
                    others = [exemplar((hosts[k], None), part.column(5)[k]), exemplar((hosts[k], layouts[k]), part.column(6)[k]) if layouts[k] is not None else None]
                    mine = Skeleton(skeleton(nodes, every)) if any(others) else None
                    to = [match(mine, x) if x else None for x in others]
                    at = lambda n: [(-1, False) if t is None else (j := t[n.index], j >= 0 and mine.texts[n.index] == x.texts[j]) for t, x in zip(to, others, strict=True)]  # noqa: B023, E731
                    out.append([dict(zip(("text", "node", "same", "own", "own_same"), (t, *a, *c), strict=True)) for n, t in found for a, c in [at(n)]])
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(marked), pa.array(out, kind)], ["page_id", "url", "host", "layout", "marked", "blocks"])

    return joined.mapInArrow(run, "page_id long, url string, host long, layout long, marked boolean, blocks array<struct<text:string,node:int,same:boolean,own:int,own_same:boolean>>")


def template(found: DataFrame, node: str = "node", same: str = "same", by: tuple[str, ...] = ("host", "marked")) -> DataFrame:
    """(*by, node + "s"): the exemplar's nodes that are template there. Each distinct list of blocks has one vote a node."""
    cast = F.array_distinct(F.transform(F.filter("blocks", lambda b: b[node] >= 0), lambda b: F.struct(b[node].alias("node"), b[same].alias("same"))))
    pages = found.select(*by, F.xxhash64("blocks").alias("content"), cast.alias("votes")).where(F.size("votes") > 0)
    once = pages.groupBy(*by, "content").agg(F.first("votes").alias("votes"))
    votes = once.select(*by, F.inline("votes")).groupBy(*by, "node").agg(F.count("*").alias("n"), F.count_if("same").alias("same"))
    enough = lambda limits: (F.col("n") > limits[0]) & (F.col("same") >= limits[1] * F.col("n"))
    return votes.where(F.when(F.col("marked"), enough(INSIDE)).otherwise(enough(OUTSIDE))).groupBy(*by).agg(F.collect_set("node").alias(f"{node}s"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    found = cut(aligned_blocks(pages), "blocks")
    joined = found
    for node, same, by in (("node", "same", ("host", "marked")), ("own", "own_same", ("host", "layout", "marked"))):
        nodes = cut(template(found, node, same, by), "template")
        rows = nodes.agg(F.sum(F.size(f"{node}s") + 4)).first()[0] or 0
        joined = joined.join(F.broadcast(nodes) if rows <= BROADCAST_ROWS else nodes, list(by), "left")
    falls = lambda b, node, same: F.coalesce(F.array_contains(f"{node}s", b[node]), F.lit(False)) & b[same]
    kept = F.filter("blocks", lambda b: ~falls(b, "node", "same") & ~falls(b, "own", "own_same"))
    # a marked article all of whose blocks are constant is no template but one article told many times
    main = F.when(F.col("marked") & (F.size(kept) == 0), F.col("blocks")).otherwise(kept)
    text = F.array_join(F.transform(main, lambda b: b["text"]), "\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
