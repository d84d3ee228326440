import html
import re

from helpers import rows
from tallyforge.llm import site_style_tree as s

PAGE = "page_id long, url string, html string"


def texts(spark, pages, url="http://a.example.com/x"):
    data = [(k, url if isinstance(p, str) or p is None else p[0], p if isinstance(p, str) or p is None else p[1]) for k, p in enumerate(pages)]
    got = {r["page_id"]: r for r in s.extract(spark.createDataFrame(data, PAGE)).collect()}
    assert len(got) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in got.values())
    return [got[k]["text"] for k in range(len(pages))]


def test_blocks():
    b = lambda x: [t for _, _, t in s.blocks(x)]
    assert b("<p>a <b>b<br><p>c&amp;d &lt;e</p>tail") == ["a b", "c&d <e", "tail"]
    assert b("<ul><li>x<li>y <i>z</i></ul><script>var t='<p>no</p>';</script>end") == ["x", "y z", "end"]
    assert b("a < b & c &copy; &#233; &nbsp; d") == ["a < b & c © é d"]
    assert b("<div class='q\">r</div>") == ["r"] and b("") == [] and b("<!-- open") == []
    assert b("<table><tr><td>1<td>2<tr><td>3</table>x") == ["1", "2", "3", "x"]


def test_documents_article(spark, sf):
    pages = rows(sf, "pages")
    got = {r["page_id"]: r["text"] for r in s.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    for p in pages:
        body = re.search(r"(?s)<article>(.*)</article>", p["html"])[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", body))
        assert got[p["page_id"]] == "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in parts) if x)


def test_style_tree_removes_repeated_branches(spark):
    pages = [f"<body><div class=top>Welcome to our shop</div><div class=box><p>Story {k} about {k * 7}</p><p>More of {k}</p></div><div class=end>All rights reserved</div></body>" for k in range(20)]
    assert texts(spark, pages) == [f"Story {k} about {k * 7}\nMore of {k}" for k in range(20)]


def test_roles_and_names(spark):
    page = """<header>Site</header><nav>Menu</nav><div class="cookie-notice">We use cookies</div><main><article><header><h1>Title</h1></header>
    <p>Text <a href=x>link</a> goes on</p><div class="ad">Buy</div><aside>Side</aside><form>Mail <input></form><section id="comments"><p>First!</p></section></article></main><footer>End</footer>"""
    assert texts(spark, [page, None, "", "plain", ("x", "<div class=menu>1</div>")]) == ["Title\nText link goes on", "", "", "plain", "1"]


def test_named_wrapper_is_spared_and_empty_table(spark):
    pages = [f"<div class='with-sidebar'><p>{'word ' * 30}{k}</p></div><div class='menu'>go</div>" for k in range(10)]
    assert texts(spark, pages) == [" ".join(["word"] * 30) + f" {k}" for k in range(10)]
    df = spark.createDataFrame([], PAGE)
    assert s.extract(df).count() == 0


def test_copies_keep_their_article(spark):
    def page(k, a):
        body = "".join(f"<p>{a} tells {i} of {'long ' * 9}things</p>" for i in range(3))
        return (f"http://c.example.com/{k}", f"<html><body><div class=top>Our shop</div><article><h1>On {a}</h1>{body}</article></body></html>")

    want = lambda a: "\n".join([f"On {a}", *(f"{a} tells {i} of {'long ' * 9}things" for i in range(3))])
    assert texts(spark, [page(k, "one") for k in range(9)]) == [want("one")] * 9
    assert texts(spark, [page(k, "one" if k < 12 else "two") for k in range(20)]) == [want("one")] * 12 + [want("two")] * 8
    plain = [(f"http://d.example.com/{k}", f"<body><div class=top>Our shop</div><div class=box><p>{'same words ' * 9}</p></div><div class=count>{k} reads</div></body>") for k in range(12)]
    assert all(" ".join(["same words"] * 9) in t for t in texts(spark, plain))


def test_small_hosts_and_sections(spark):
    def page(k, section="box"):
        return f"<body><div class=top>Welcome to our shop</div><div class={section}><p>Story {k} about {k * 7}</p><p>More of {k}</p><div class=hint>Read it well</div></div><div class=end>All rights reserved</div></body>"

    want = lambda k: f"Story {k} about {k * 7}\nMore of {k}"
    for n in (2, 3, 7):
        assert texts(spark, [page(k) for k in range(n)]) == [want(k) for k in range(n)]
    assert texts(spark, [page(k, "box" if k < 25 else "east") for k in range(30)]) == [want(k) for k in range(30)]


def test_attributes_and_names_that_only_look_like_other_parts(spark):
    page = """<main><article><h1 title="the hidden valley">T</h1><p>see <a href="/hidden-gems">b</a> and <a data-x="style=display:none" href='/ad'>c</a></p>
    <p title="the hidden valley" data-role="navigation">valley</p><p class="ad-hoc">made for this</p><div class="search-theory"><p>on search</p></div>
    <section id="related-work"><p>Others did</p></section><p>Text <span class="share-button">Share</span> goes on</p><p alt=hidden>plain</p>
    <div hidden>no</div><div style="color:red; display: none">no</div><div class="relatedPosts">no</div><div class="comment-list">no</div></article></main>"""
    assert texts(spark, [page]) == ["T\nsee b and c\nvalley\nmade for this\non search\nOthers did\nText goes on\nplain"]


def test_both_ways_of_sending_branches_agree(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/pages.parquet").selectExpr("*", "1 as node", "2 as host", "3 as low", "4 as `a.b`")
    one = sorted((r["page_id"], r["text"]) for r in s.extract(df).collect())
    monkeypatch.setattr(s, "CUT_BYTES", -1)
    assert sorted((r["page_id"], r["text"]) for r in s.extract(df).collect()) == one


def test_null_and_repeated_ids_and_a_very_long_page(spark):
    long = "<article>" + "".join(f"<p>line {k} of it</p>" for k in range(20_000)) + "</article>"
    rows_ = [(None, None, "<p>a"), (1, "http://x/1", long), (1, "http://x/1", long), (1, None, None), (2, "no url", "<p>b</p>")]
    got = sorted((r["page_id"] or 0, r["n_chars"]) for r in s.extract(spark.createDataFrame(rows_, PAGE)).collect())
    n = len("\n".join(f"line {k} of it" for k in range(20_000)))
    assert got == [(0, 1), (1, 0), (1, n), (1, n), (2, 1)]


def brute_importance(pages):
    """Of each style node of one host: content and presentation importance, by hand."""
    import math
    from collections import Counter, defaultdict

    bodies = {}
    for page in pages:
        found = [x for x in s.blocks(page) if not x[1] & s._ROLE]
        bodies[s.body_of(found)] = {(p, t) for p, _, t in found}
    seen, contents, styles = defaultdict(set), defaultdict(Counter), defaultdict(dict)
    for b, found in bodies.items():
        for path, text in found:
            steps = path.split("/")
            for k in range(1, len(steps) + 1):
                node = "/".join(steps[:k])
                seen[node].add(b)
                contents[node][path, text] += 1
                if k < len(steps):
                    styles[node].setdefault(b, set()).add("/".join(steps[: k + 1]))
    out = {}
    for node, c in contents.items():
        if not node:
            continue
        m = len(seen[node.rpartition("/")[0]])
        content = 1 - sum(map(math.log, c.values())) / len(c) / math.log(m + s.SMOOTH) if m > 1 else 1.0
        kinds = Counter(frozenset(x) for x in styles[node].values())
        n = sum(kinds.values())
        look = None if not n else 1.0 if n == 1 else -sum(x / n * math.log(x / n) for x in kinds.values()) / math.log(n)
        out[node] = content if look is None else content + s.PRESENTATION * (look - content)
    return out


def test_importance_matches_brute_force(spark):
    pages = [f"<div class=top>Shop</div><div class=box><p>Story {k}</p>{'<ul><li>point</ul>' if k % 3 else ''}</div><div class=end><b>All</b><p>rights {k % 2}</p></div>" for k in range(9)]
    df = spark.createDataFrame([(k, "http://h/x", p) for k, p in enumerate(pages)], PAGE).selectExpr("*", "1L as _host", "xxhash64(url, html) as _page")
    got = {r["node"]: r["importance"] for r in s.style_tree(s.facts(df)).collect()}
    want = brute_importance(pages)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_forms_that_wrap_pages(spark):
    article = "<article><h1>T</h1><p>Text goes on and on</p></article>"
    page = f"<body><form id=aspnetForm><nav>Menu</nav>{article}<fieldset><legend>Mail</legend><label>Your mail</label>send it</fieldset><footer>End</footer></form></body>"
    plain = "<body><form><div class=menu>Menu</div><div><p>A long text of the page</p><p>and more of it</p></div><label>Name</label></form></body>"
    small = "<body><p>A long text of the page</p><form><p>Write us</p></form></body>"
    pages = [(f"http://{k}.example.com/x", p) for k, p in enumerate([page, plain, small, f"<fieldset><form>{article}</form></fieldset>", f"<form>Only {article}</form><form>Other form that says a lot more than the article does</form>"])]
    both = "T\nText goes on and on"
    assert texts(spark, pages) == [both, "A long text of the page\nand more of it", "A long text of the page", both, both]
    assert texts(spark, [page.replace("T<", f"T{k}<").replace("goes on", f"of {k} goes on") for k in range(12)]) == [f"T{k}\nText of {k} goes on and on" for k in range(12)]


def test_comments_by_any_spelling_and_pull_quotes(spark):
    for name in ("user-comments", "commentlist", "readerComments", "comment_section", "wp-comments-area", "CommentsWrapper", "disqus_thread", "fb-comments"):
        for page in (f"<article><p>Text</p><ol class='{name}'><li>First!</li></ol></article>", f"<div><p>Text</p></div><section id='{name}'><article>{'First! ' * 30}</article></section>"):
            assert texts(spark, [page]) == ["Text"]
    quotes = "<article><p>Text</p><aside class='pull-quote'>Said so</aside><aside><blockquote>And so</blockquote>By me</aside><div class='commentary'>On it</div></article>"
    assert texts(spark, [quotes, ("http://o/", "<article class=comment><p>Opinion</p></article>")]) == ["Text\nSaid so\nAnd so\nOn it", "Opinion"]
