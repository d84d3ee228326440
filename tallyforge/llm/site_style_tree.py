"""HTML extraction by site style trees.

Pages of one host are merged into a tree of style nodes: a node is the path of structural elements, each
with its tag, class, id and role. Every node gathers, over all pages of the host, its pages, text, distinct
contents and the sets of child styles that pages show below it. Content importance of a node is 1 less the mean
entropy of its contents over the pages that have the node's parent (a text on every page has entropy near 1, a
text of one page 0; the fewer pages, the more of the contents must repeat, and inside articles still more);
presentation importance is the entropy of its child styles over the pages that have it (a node built alike on all
pages has 0). The node's importance weighs them 9 to 1, as the content below counts for more than one level of
styles. Branches of low importance are removed from each page, and what stays is written block by block in page
order. On pages with an article or main element, only what is inside one is content.

Some parts differ from page to page and still are no content. They are told by what the page says of them: tags and
roles of navigation, forms and the like, hidden elements, and class or id names all of whose words speak of such a
part ("cookie-notice", not "related-work"), unless the node so named holds most of the host's text. Words may be
plural or run together ("commentlist"). A form or fieldset that holds an article, or most of the page's or of the
host's text, is a wrapper and no form; what lies in its labels and controls is cut all the same. Reader comments are
kept only where a page has nothing else. An aside within an article is cut, but for pull quotes, which are told by
their names or by a blockquote. All these parts are nodes of the tree, but lend a body neither its identity nor its share
of distinct text.

Copies of one page count once: pages are bodies, known by the longest block of their article, or by all
blocks where there is no article. A node that is or holds an article, or holds most of the host's distinct
text, is never cut by content; and a page that has more than such parts is not cut empty. A host of one body has no
repeats: there only presentation counts.

Statistics are gathered by (host, path, content), never by host alone. Branches to remove are broadcast up to
CUT_BYTES; beyond, they are joined page by page. A null html gives an empty text; a null url is a host of its own, a
null page_id stays null. Repeated rows are equal pages and count once for the tree, and each gets its result; ties
do not arise. Whole pages are read, however long. Unclosed elements and references are read as browsers do; what is
no valid tag is text. Empty tables give an empty result; other columns, whatever their names, are not carried.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm._spark import small_batches, written

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?""")
_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img", "nobr"}
_ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
_SCOPE = {"ul", "ol", "dl", "table", "select", "menu"}
_NO_TAGS = {"nav", "footer", "aside", "button", "select", "option", "dialog", "menu", "head", "object", "svg", "canvas", "video", "audio", "datalist", "map"}
_NO_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
_FORMS, _IN_FORMS = {"form", "fieldset"}, {"label", "legend", "output"}
_NO_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup",
    "modal", "overlay", "sidebar", "sidenav", "widget", "widgets", "related", "recommended", "recommendations", "share", "sharing", "social", "breadcrumb", "breadcrumbs", "menu", "nav", "navbar", "navigation",
    "footer", "pagination", "pager", "comment", "comments", "disqus", "respond", "replies", "newsletter", "subscribe", "subscription", "signup", "login", "search", "copyright", "disclaimer", "skip",
}
_NO_NAMES_OUTSIDE = {"header", "masthead", "topbar", "toolbar", "site", "logo"}
#: Words that say nothing of their own in a name.
_PLAIN_NAMES = {
    "area", "article", "articles", "aside", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "card", "cell", "col", "column", "container", "content", "flex", "form", "global", "grid", "group", "head",
    "header", "heading", "icon", "inner", "item", "items", "left", "link", "links", "list", "main", "message", "mobile", "module", "outer", "page", "panel", "policy", "post", "posts", "primary", "right", "row", "secondary",
    "section", "site", "slot", "small", "text", "title", "top", "unit", "wrap", "wrapper", "user", "reader", "visitor", "guest", "customer", "member", "wp", "fb", "facebook", "thread", "feed", "stream", "count", "author", "meta",
    "avatar", "date", "all", "latest", "recent", "view", "load", "more", "holder", "zone", "region", "app", "root", "embed", "entry", "blog", "children", "tree", "loop",
}
_COMMENTS = {"comment", "comments", "disqus", "respond", "reply", "replies", "responses"}
_QUOTES = {"quote", "quotes", "pullquote", "blockquote", "pull"}
_MAIN = {"article", "main"}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ROLE, _NAMED, _IN_MAIN, _FORM, _COMMENT, _ASIDE = 1, 2, 4, 8, 16, 32
_PART = _ROLE | _NAMED | _FORM | _COMMENT | _ASIDE
_MAIN_PATH = r"^(.*?/(?:(?:article|main)(?=[./@]|$)|[^/]*@(?:article|main)(?=/|$)))"
SMOOTH, SMOOTH_IN_MAIN = 0.5, 8.0
PRESENTATION = 0.1
CUT_BYTES = 8 << 20
SALTS = 16
_HOST = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


class _Element:
    __slots__ = ("flags", "forms", "path", "tag")

    def __init__(self, tag: str, path: str, flags: int, forms: tuple[tuple[int, bool], ...]):
        self.tag, self.path, self.flags, self.forms = tag, path, flags, forms


@lru_cache(1 << 16)
def _parts(word: str) -> frozenset[str]:
    """The known words of which a word is made, all of it ("commentlist": comment, list); itself if there are none."""
    known = _NO_NAMES | _COMMENTS | _PLAIN_NAMES
    ways: list[frozenset[str] | None] = [frozenset()] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for at in range(max(0, end - 16), end):
            w = word[at:end]
            if ways[at] is not None and len(w) > (2 if at else 1) and (w in known or w[:-1] in known and w[-1] == "s"):
                ways[end] = ways[at] | {w if w in known else w[:-1]}
                break
    return ways[-1] or frozenset([word])


@lru_cache(1 << 16)
def _style(tag: str, attrs: str) -> tuple[str, str, bool, int, int, bool]:
    """Of an element: its step in a path (none for plain inline ones), role, whether it is hidden, and the flags its
    names give outside and inside of an article, and whether they speak of a quote."""
    names: set[str] = set()
    spoken: list[frozenset[str]] = []
    role, hidden = "", False
    for k, v in _ATTR.findall(attrs):
        k, v = k.lower(), v.strip("\"'")
        if k in ("class", "id"):
            for x in v.split():
                words = {w.lower() for w in _WORD.findall(x)}
                names |= words
                spoken.append(frozenset().union(*map(_parts, words)))
        elif k == "role":
            role = v.strip().lower()
        elif k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and re.search(r"(?:^|;)\s*display\s*:\s*none", v, re.I)):
            hidden = True
    told = [_NAMED if any(x & no and x <= no | _PLAIN_NAMES for x in spoken) else 0 for no in (_NO_NAMES | _NO_NAMES_OUTSIDE, _NO_NAMES)]
    if any(x & _COMMENTS and x <= _COMMENTS | _NO_NAMES | _PLAIN_NAMES for x in spoken):
        told = [x | _COMMENT for x in told]
    step = "" if tag in _INLINE and not names and not role else f"/{tag}" + "".join(f".{n}" for n in sorted(names)) + (f"@{role}" if role else "")
    return step, role, hidden, told[0], told[1], bool(names & _QUOTES)


def _open(tag: str, attrs: str, parent: _Element | None, number: int) -> _Element:
    path, flags, forms = (parent.path, parent.flags, parent.forms) if parent else ("", 0, ())
    if tag in _IN_FORMS and forms:
        flags |= _ROLE
    if tag in _INLINE and not attrs:
        return _Element(tag, path, flags, forms)
    step, role, hidden, outside, inside, quote = _style(tag, attrs)
    if hidden:
        flags |= _ROLE
    if tag in _MAIN or role in ("main", "article"):
        flags |= _IN_MAIN
    if tag not in ("html", "body"):
        if tag in _FORMS or role == "form":
            forms = (*forms, (number, bool(flags & _IN_MAIN)))
            flags |= _FORM
        elif tag == "aside" and flags & _IN_MAIN:
            flags |= 0 if quote else _ASIDE
        elif tag in _NO_TAGS or role in _NO_ROLES or (tag == "header" and not flags & _IN_MAIN):
            flags |= _ROLE
        if tag == "blockquote":
            flags &= ~_ASIDE
        if tag != "main":
            flags |= inside if flags & _IN_MAIN else outside
    return _Element(tag, path + step, flags, forms)


def _wrappers(found: list[tuple[str, int, tuple[tuple[int, bool], ...], str]]) -> set[int]:
    """The forms that hold an article or most of the page's text."""
    size: dict[int, int] = {}
    out: set[int] = set()
    total = 0
    for _, flags, forms, text in found:
        if flags & _PART & ~_FORM:
            continue
        total += len(text)
        for number, in_main in forms:
            size[number] = size.get(number, 0) + len(text)
            if flags & _IN_MAIN and not in_main:
                out.add(number)
    return out | {number for number, n in size.items() if 2 * n > total}


def blocks(page: str) -> list[tuple[str, int, str]]:
    """(path, flags, text) of each block with text, in page order; references decoded, white space one space."""
    stack: list[_Element] = []
    found: list[tuple[str, int, tuple[tuple[int, bool], ...], str]] = []
    runs: list[tuple[str, _Element]] = []
    root = _Element("", "", 0, ())

    def flush() -> None:
        keep: dict[tuple, tuple[str, list[str]]] = {}  # one block, also where a part of another kind stands inside
        for raw, e in runs:
            keep.setdefault((e.flags, e.forms), (e.path, []))[1].append(raw)
        runs.clear()
        for (flags, forms), (path, raw) in keep.items():
            text = " ".join(_html.unescape("".join(raw)).split())
            if text:
                found.append((path, flags, forms, text))

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            runs.append((page[at:], stack[-1] if stack else root))
            break
        if m.start() > at:
            runs.append((page[at : m.start()], stack[-1] if stack else root))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        attrs = (m[3] or m[6] or "").strip()
        if m[1] or m[4]:
            if tag not in _INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in _INLINE and stack[k].tag not in _INLINE:
                    break
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "br":
            runs.append((" ", stack[-1] if stack else root))
            continue
        if tag not in _INLINE:
            flush()
        shut = _SELF.get(tag, {"p"} if tag in _ENDS_P else set())
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in shut:
                del stack[k:]
                if tag not in ("tr", "tbody", "tfoot"):
                    break
            elif stack[k].tag in _SCOPE or (stack[k].tag not in _INLINE and "p" in shut):
                break
        if tag not in _VOID and not attrs.endswith("/"):
            stack.append(_open(tag, attrs, stack[-1] if stack else None, at))
    flush()
    wrappers = _wrappers(found)
    return [(path, flags & ~_FORM if forms and all(x in wrappers for x, _ in forms) else flags, text) for path, flags, forms, text in found]


def _id(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts)) - (1 << 63)


def host(url: Column) -> Column:
    """A number for the host in a url; null and what is no url are hosts of their own."""
    return F.xxhash64(F.lower(F.regexp_extract(url, _HOST, 1)), url.isNull())


_FACT = "host long, page long, body long, path string, named boolean, content long, chars long"


def body_of(found: list[tuple[str, int, str]]) -> int:
    """Names what a page tells: the longest block of its article, or all its blocks."""
    plain = [x for x in found if not x[1] & _PART] or found
    main = [t for _, flags, t in plain if flags & _IN_MAIN]
    return _id("main", max(main, key=lambda t: (len(t), t))) if main else _id("all", *(f"{p}\n{t}" for p, t in sorted({(p, t) for p, _, t in plain})))


def _nodes(path: Column, least: int) -> Column:
    """The style nodes of a path, from its first `least` steps (the host is step 1) on; "" has itself."""
    steps = F.split(path, "/")
    return F.transform(F.sequence(F.lit(least), F.greatest(F.size(steps), F.lit(least))), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))


def _parent(node: Column) -> Column:
    steps = F.split(node, "/")
    return F.when(F.size(steps) > 1, F.array_join(F.slice(steps, F.lit(1), F.size(steps) - 1), "/")).otherwise("")


def facts(pages: DataFrame) -> DataFrame:
    """A row for each page, path and distinct content: the pages' trees, cut into leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: set[tuple] = set()
            for page, own, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = blocks(text or "")
                body = body_of(found)
                rows.update((own, page, body, path, bool(flags & _PART), _id(t), len(t)) for path, flags, t in found)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["host", "page", "body", "path", "named", "content", "chars"])

    return pages.select("_page", "_host", "html").mapInArrow(run, _FACT)


def style_tree(leaves: DataFrame) -> DataFrame:
    """host, node, seen (bodies that have it), m (bodies that have its parent), share (of the host's text), once
    (share of its distinct text), importance (of content), named, holds (an article): one row a style node. Every
    leaf counts for all its ancestors."""
    each = leaves.groupBy("host", "path", "content").agg(F.countDistinct("body").alias("n"), F.max("named").alias("named"), F.sum("chars").alias("chars"), F.max("chars").alias("once"))
    each = written(each.withColumn("once", F.when(F.col("named"), 0).otherwise(F.col("once"))), "contents")
    total = each.groupBy("host").agg(F.sum("chars").alias("all_chars"), F.sum("once").alias("all_once"))
    per = each.groupBy("host", "path").agg(F.sum(F.log("n")).alias("h"), F.count("*").alias("k"), F.sum("chars").alias("chars"), F.sum("once").alias("once"), F.max("named").alias("named"))
    per = per.withColumn("main", F.size(F.split(F.regexp_extract("path", _MAIN_PATH, 1), "/")))
    tree = per.select("*", F.explode(_nodes(F.col("path"), 2)).alias("node")).groupBy("host", "node").agg(F.sum("h").alias("h"), F.sum("k").alias("k"), F.sum("chars").alias("chars"), F.sum("once").alias("once"), F.min("named").alias("named"), F.max("main").alias("main"))
    nodes = leaves.select("host", "body", "path").distinct().select("host", "body", F.explode(_nodes(F.col("path"), 1)).alias("node")).distinct()
    seen = written(nodes.groupBy("host", "node").agg(F.count("*").alias("seen")), "seen")
    below = nodes.where(F.col("node") != "").select("host", "body", _parent(F.col("node")).alias("node"), F.col("node").alias("child"))
    below = below.groupBy("host", "body", "node").agg(F.xxhash64(F.array_sort(F.collect_set("child"))).alias("styles"))
    below = below.groupBy("host", "node", "styles").agg(F.count("*").alias("n")).groupBy("host", "node").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    below = below.select("host", "node", F.when(F.col("all") > 1, 1 - F.col("nlogn") / F.col("all") / F.log("all")).otherwise(1.0).alias("styles"))
    depth = F.size(F.split("node", "/"))
    salted = total.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    tree = tree.join(seen, ["host", "node"]).join(below, ["host", "node"], "left").withColumn("parent", _parent(F.col("node"))).join(seen.select("host", F.col("node").alias("parent"), F.col("seen").alias("m")), ["host", "parent"])
    tree = tree.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"])
    smooth = F.when((F.col("main") > 1) & (F.col("main") < depth), SMOOTH_IN_MAIN).otherwise(SMOOTH)
    content = F.when(F.col("m") > 1, 1 - F.col("h") / F.col("k") / F.log(F.col("m") + smooth)).otherwise(1.0)
    importance = content + PRESENTATION * (F.coalesce("styles", F.lit(0.0)) - content) * F.when(F.col("styles").isNull(), 0.0).otherwise(1.0)
    once = F.when(F.col("all_once") > 0, F.col("once") / F.col("all_once")).otherwise(0.0)
    return tree.select("host", "node", "seen", "m", "named", (F.col("chars") / F.col("all_chars")).alias("share"), once.alias("once"), importance.alias("importance"), ((F.col("main") > 1) & (F.col("main") >= depth)).alias("holds"))


def removed(tree: DataFrame, least: float = 0.3, most_share: float = 0.6) -> DataFrame:
    """host, node, spared: branches of low importance (spared false), and branches that are marked as no content but
    hold most of the host's text (spared true)."""
    low = (F.col("importance") < least) & (F.col("seen") * 2 > F.col("m")) & ~F.col("holds") & (F.col("once") <= 0.5)
    spared = F.col("named") & (F.col("share") > most_share)
    return tree.where(low | spared).select("host", "node", (spared & ~low).alias("spared"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    spark = pages.sparkSession
    small_batches(spark, 500)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("_host"), F.xxhash64("url", "html").alias("_page"))
    leaves = written(facts(own), "leaves")
    cut = written(removed(style_tree(leaves)), "branches")
    size = cut.agg(F.sum(F.octet_length("node") + 32)).first()[0] or 0
    known: dict[int, tuple[set[str], set[str]]] | None = None
    if size <= CUT_BYTES:
        known = {}
        for r in cut.collect():
            known.setdefault(r["host"], (set(), set()))[r["spared"]].add(r["node"])
        rows = own.select("page_id", "url", "html", "_host")
    else:
        nodes = leaves.select("host", "page", "path").distinct().select("host", "page", F.explode(_nodes(F.col("path"), 2)).alias("node")).distinct()
        some = lambda when: F.collect_set(F.when(when, F.col("node")))
        mine = nodes.join(cut, ["host", "node"]).groupBy(F.col("page").alias("_page")).agg(some(~F.col("spared")).alias("low"), some(F.col("spared")).alias("spared"))
        rows = own.join(mine, "_page", "left").select("page_id", "url", "html", "low", "spared")

    def under(path: str, nodes: set[str]) -> bool:
        while path and path not in nodes:
            path = path.rpartition("/")[0]
        return path in nodes

    def main_text(page: str, low: set[str], spared: set[str]) -> str:
        found = blocks(page)
        for comments in (0, _COMMENT):  # comments only where there is nothing else
            got = [(p, f, t) for p, f, t in found if not f & (_ROLE | _ASIDE | _COMMENT & ~comments) and not (f & _PART & ~comments and not under(p, spared))]
            got = [x for x in got if x[1] & _IN_MAIN] or got
            if got:
                break
        return "\n".join(t for _, _, t in [x for x in got if not under(x[0], low)] or got)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if known is None:
                lists = [(set(low or []), set(spared or [])) for low, spared in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            else:
                lists = [known.get(x, (set(), set())) for x in b.column(3).to_pylist()]
            texts = [main_text(page or "", *sets) for page, sets in zip(b.column(2).to_pylist(), lists, strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
