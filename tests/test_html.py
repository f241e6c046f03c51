"""Tokeniser, selectors, content root, cleaning, links and Markdown goldens."""

from pyspark.sql import functions as F

from mdloom.functions.markdown import render_markdown
from mdloom.functions.tokenize import tokenize
from mdloom.operators import html as H


def _docs(spark, rows, selector="main", nav="nav"):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    p = H.parse_pages(df)
    cr = H.content_root(F.col("nodes"), selector)
    d = p.select("page_id", "url", "nodes", cr["root"].alias("root"), cr["source"].alias("source"))
    d = d.withColumn("kept", H.clean_nodes(F.col("nodes"), F.col("root")))
    return d.withColumn("md", render_markdown(F.col("kept"), F.col("nodes"))) \
        .withColumn("links", H.nav_links(F.col("nodes"), nav))


def md_of(spark, html, selector="main"):
    return _docs(spark, [(1, "http://h/a", html)], selector).first().md


def test_tokenizer_repairs_unclosed_b_and_p():
    nodes = tokenize("<body><p><b>x<br><p>y</p></body>")
    tags = {n[0]: n[5] for n in nodes}
    b = next(n for n in nodes if n[5] == "b")
    second_p = [n for n in nodes if n[5] == "p"][1]
    assert b[1] < second_p[0]          # bold ends before the next paragraph
    assert tags[second_p[2]] == "body"  # the new p is a sibling, not a child


def test_tokenizer_script_raw_text():
    nodes = tokenize('<html><head><script>var t="</p>";</script></head><body><p>a</p></body></html>')
    texts = [n[9] for n in nodes if n[4] == "text"]
    assert 'var t="</p>";' in texts and "a" in texts


def test_tokenizer_implicit_body():
    nodes = tokenize("<div>x</div>")
    assert [n[5] for n in nodes[:3]] == ["html", "body", "div"]


GOLDEN = [
    ("<main><h2>T</h2><p>Hello <b>bold</b> and <i>it</i>.</p></main>", "## T\n\nHello **bold** and *it*.\n"),
    ("<main><ul><li>a</li><li>b<ul><li>c</li></ul></li></ul></main>", "- a\n- b\n  - c\n"),
    ("<main><ol><li>x</li><li>y</li></ol></main>", "1. x\n2. y\n"),
    ('<main><p><a href="/x">go</a> <img src="i.png" alt="A"></p></main>', "[go](/x) ![A](i.png)\n"),
    ("<main><pre>a  b\nc</pre></main>", "```\na  b\nc\n```\n"),
    ("<main><table><tr><th>h1</th><th>h2</th></tr><tr><td>1</td><td>2</td></tr></table></main>",
     "| h1 | h2 |\n| --- | --- |\n| 1 | 2 |\n"),
    ("<main><p>line<br>next</p></main>", "line  \nnext\n"),
    ("<main><p>a &amp; b &lt;c&gt; x*y_z</p></main>", "a & b <c> x\\*y\\_z\n"),
    ("<main><p><b>bold<br><p>after</main>", "**bold**\n\nafter\n"),
    ('<main><script>var s="</p>";</script><p>kept</p><nav>menu</nav><footer>f</footer></main>', "kept\n"),
    ("<main><p># not a heading</p></main>", "\\# not a heading\n"),
    ("<body><nav><p>menu</p></nav></body>", ""),
    ("<main><p><b>Note: </b>text <i> x</i>,<b></b> y</p></main>", "**Note:** text *x*, y\n"),
    ("<main><p>a</p><blockquote><p>q1</p><p># q2<br>x</p><blockquote>deep</blockquote></blockquote><p>b</p></main>",
     "a\n\n> q1\n>\n> \\# q2  \n> x\n>\n> > deep\n\nb\n"),
]


def test_markdown_goldens(spark):
    rows = [(i, "http://h/a", h) for i, (h, _) in enumerate(GOLDEN)]
    got = {r.page_id: r.md for r in _docs(spark, rows).select("page_id", "md").collect()}
    for i, (h, want) in enumerate(GOLDEN):
        assert got[i] == want, (h, got[i])


def test_content_root_that_is_nav(spark):
    assert md_of(spark, "<body><nav><p>menu</p></nav></body>", selector="nav") == "menu\n"


def test_content_root_sources(spark):
    rows = [(1, "u", "<body><main><p>a</p></main><main>b</main></body>"), (2, "u", "<body><p>x</p></body>"),
            (3, "u", None)]
    got = {r.page_id: (r.source, r.md) for r in _docs(spark, rows).collect()}
    assert got[1] == ("selector", "a\n")       # first match in document order
    assert got[2] == ("body", "x\n")
    assert got[3] == ("no_html", None)


def test_nav_links_nested_and_order(spark):
    html = ('<body><nav class="a"><a href="/1">one</a><nav><a href=" /2 "> t<b>wo</b> </a></nav></nav>'
            '<div class="sidebar"><a href="/3">3</a><a>no href</a><a href="">empty</a></div></body>')
    d = _docs(spark, [(1, "http://h/x", html)], nav="nav, .sidebar").first()
    got = [(l.nav_id, l.href, l.link_text) for l in d.links]
    # outer nav lists both links, inner nav repeats /2; sidebar keeps empty href (skipped later)
    assert [g[1] for g in got] == ["/1", " /2 ", " /2 ", "/3", ""]
    assert got[1][2] == "two"


def test_selector_variants(spark):
    html = ('<body><div role="main" id="m" class="x y"><section><p class="t">1</p></section></div>'
            '<div class="wy-nav-content-wrap"><main>2</main></div></body>')
    df = H.parse_pages(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))
    n = F.col("nodes")
    r = df.select(*[F.size(H.matches(n, s)).alias(f"c{i}") for i, s in enumerate(
        ["div[role='main']", "#m", ".x.y", "div p.t", "div > p", "section > p", ".wy-nav-content-wrap main",
         "[role]", "div[role='main'], main"])]).first()
    assert list(r) == [1, 1, 1, 1, 0, 1, 1, 1, 2]


def test_images_in_content(spark):
    html = '<body><main><img src="/i/a b.png"><img alt="x"><img src=""></main></body>'
    df = H.parse_pages(spark.createDataFrame([(1, "http://h/p/q", html)], "page_id long, url string, html string"))
    imgs = df.select(H.images(F.col("nodes")).alias("i")).first().i
    assert [i.src for i in imgs] == ["/i/a b.png"]


def test_markdown_uses_image_rewrite(spark):
    from mdloom.functions import urls as U
    from mdloom.operators import images as IM
    from mdloom.plans import corpus as C
    html = '<body><main><p><img src="/i/a.png" alt="A"><img src="b.gif"></p></main></body>'
    pages = spark.createDataFrame([(1, "http://h/d/p", html)], "page_id long, url string, html string")
    parsed = H.parse_pages(pages).withColumn("url_key", U.normalize_url("url")).withColumn("host", F.lit("h"))
    imgs = parsed.select("page_id", "url", F.explode(H.images(F.col("nodes"))).alias("i")) \
        .select("page_id", F.col("i.src").alias("src"), U.resolve_url(F.col("url"), F.col("i.src")).alias("abs_url"))
    assets = spark.createDataFrame([("http://h/i/a.png", 200, "image/png", 10)],
                                   "url string, status int, content_type string, bytes long")
    m = IM.page_image_map(IM.image_rewrite(IM.image_manifest(imgs, assets)))
    docs = C.documents(parsed.join(m, "page_id", "left"), src_map="src_map")
    assert docs.first().markdown == "![A](./images/a.png)![](http://h/d/b.gif)\n"


def test_byte_chunks():
    assert list(H.byte_chunks([5, 5, 5], 10)) == [(0, 2), (2, 3)]
    assert list(H.byte_chunks([50, 1, 1], 10)) == [(0, 1), (1, 3)]
    assert list(H.byte_chunks([], 10)) == []


def test_parse_pages_chunked_output(spark, monkeypatch):
    rows = [(i, "u", f"<p>{'x' * (i % 7)}</p>") for i in range(40)] + [(99, "u", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(H, "ARROW_CHUNK_BYTES", 30)
    got = {r.page_id: r.n for r in H.parse_pages(df).select("page_id", F.size("nodes").alias("n")).collect()}
    assert len(got) == 41 and got[99] is None and all(v == 4 for k, v in got.items() if k != 99 and k % 7)


def test_selectors_as_data_equal_compiled_ones(spark):
    from mdloom.functions.selector_rows import MatchedNodes, matched_nodes, parsed_steps
    deep = "<div class='d'>" * 300 + "<p id='low'>x</p>" + "</div>" * 300
    pages = ['<body><nav>n</nav><main>m</main><div class="side">s</div></body>', None, "", "plain",
             '<body><div class="a b" data-k="v w"><p>1</p><ul><li><p>2</p></li></ul></div><p class="b">3</p><section><div><div><a href="/x-y">4</a></div></div></section></body>',
             f"<body>{deep}</body>"]
    selectors = ["nav", ".side", "article", "div p", "div > p", "ul > li p, .b", "*", "body > *", "div div > a[href^='/x']", "[data-k~='w']", "[data-k='v']", "a[href$='y']",
                 "a[href*='-'], #low", ".a.b", "div.d div.d > p#low", "section a, nav", "[href|='/x']", "p:hover", "", None, "div >", "[data-k]"]
    rows = [(i, "u", h, s) for i, (h, s) in enumerate((h, s) for h in pages for s in selectors)]
    df = H.parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string, sel string")).withColumn("steps", parsed_steps("sel"))
    df = df.withColumn("ids", matched_nodes(F.col("nodes"), F.col("steps"))).withColumn("first", matched_nodes(F.col("nodes"), F.col("steps"), only_first=True))
    df = df.select("*", F.transform(H.matches(F.col("nodes"), MatchedNodes(F.col("ids"))), lambda n: n["node_id"]).alias("back")).checkpoint()
    unread = {r.sel for r in df.where("steps is null").collect()}
    assert unread == {"p:hover", "", None, "div >"}
    for sel in set(selectors) - unread:
        want = F.coalesce(F.transform(H.matches(F.col("nodes"), sel), lambda n: n["node_id"]), F.array().cast("array<int>"))
        for r in df.where(F.col("sel") == sel).select("ids", "first", "back", want.alias("want")).collect():
            assert (r.ids, r.first, r.back) == (r.want, r.want[:1], r.want), sel
    assert all(r.ids == [] for r in df.where("steps is null").collect())


def test_parsing_holds_few_nodes_at_a_time(spark, monkeypatch):
    """A worker's memory is that of a small part of a batch, not of all its pages."""
    import tracemalloc

    import pyarrow as pa
    pages = spark.createDataFrame([(0, "<p>x")], "page_id long, html string")
    taken = []
    monkeypatch.setattr(type(pages), "mapInArrow", lambda self, run, schema: taken.append(run) or self)
    H.parse_pages(pages)
    n, paragraphs = 600, 250
    html = [f"<body id=b{i}>" + "".join(f"<p>{j} of {i}</p>" for j in range(paragraphs)) for i in range(n)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(n + 2)), "html": html})
    ids, sizes = [], []
    tracemalloc.start()
    try:
        for out in taken[0](iter([batch])):
            ids += out.column(0).to_pylist()
            sizes += pa.compute.list_value_length(out.column(1)).to_pylist()
            del out
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert ids == list(range(n + 2))
    assert sizes == [2 + 2 * paragraphs] * n + [None, 0]
    assert peak < 40e6, peak
