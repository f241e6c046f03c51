"""Property checks with generated inputs, one Spark job per property."""

from urllib.parse import urljoin

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mdloom.functions import urls as U
from mdloom.operators import attempts as OA

SEG = st.text(alphabet="abcXYZ019-._~é", min_size=0, max_size=5)
URL = st.builds(lambda sch, host, segs, q, slash: f"{sch}://{host}/" + "/".join(segs) + ("/" if slash else "")
                + (f"?{q}" if q else ""),
                st.sampled_from(["http", "https", "HTTP"]), st.sampled_from(["h.org", "Ex.COM", "a.b.c"]),
                st.lists(SEG, max_size=4), st.text(alphabet="a=&1", max_size=4), st.booleans())
HREF = st.one_of(st.lists(st.sampled_from(["a", "..", ".", "b.html", ""]), min_size=1, max_size=4).map("/".join),
                 st.sampled_from(["?x=1", "#f", "//o.org/p", "/abs", "mailto:a@b"]))

CFG = settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))


@CFG
@given(st.lists(URL, min_size=20, max_size=40))
def test_normalize_idempotent_and_path_md(spark, urls):
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    rows = df.select("url", U.normalize_url("url").alias("k"), U.md_path("url").alias("p")) \
        .select("url", "k", U.normalize_url("k").alias("k2"), "p").collect()
    for r in rows:
        assert r.k == r.k2, r.url
        assert r.p.endswith(".md") and not r.p.startswith("/")


@CFG
@given(st.lists(st.tuples(URL, HREF), min_size=20, max_size=40))
def test_resolve_equals_urljoin(spark, pairs):
    df = spark.createDataFrame(pairs, "base string, href string")
    for r in df.select("base", "href", U.resolve_url(F.col("base"), F.col("href")).alias("r")).collect():
        want = urljoin(r.base, r.href.strip()) if r.href.strip() else None
        assert r.r == want, (r.base, r.href)


@CFG
@given(st.floats(1.0, 10.0), st.floats(0.0, 30.0), st.floats(1.0, 300.0))
def test_backoff_non_decreasing(spark, factor, initial, cap):
    d = [r.d for r in spark.range(12).orderBy("id").select(
        OA.backoff_delay(F.col("id"), initial, factor, cap).alias("d")).collect()]
    assert all(a <= b + 1e-9 for a, b in zip(d, d[1:])) and max(d) <= cap + 1e-9


@CFG
@given(st.lists(st.booleans(), min_size=1, max_size=30))
def test_auto_skip_monotone(spark, fails):
    rows = [(i, "u", i, f) for i, f in enumerate(fails)]
    df = spark.createDataFrame(rows, "attempt_id long, url_id string, ts long, failed boolean")
    got = sorted(OA.auto_skip(df).collect(), key=lambda r: r.attempt_no)
    prior = [r.prior_failures for r in got]
    assert prior == [sum(fails[:i]) for i in range(len(fails))]
    skipped = [r.skipped for r in got]
    assert skipped == sorted(skipped)      # once skipped, always skipped


TAGS = ["div", "p", "b", "i", "ul", "li", "nav", "a", "span", "br", "img", "table", "tr", "td", "h1", "pre"]
FRAG = st.recursive(
    st.text(alphabet="ab <&;#", max_size=6),
    lambda inner: st.builds(lambda t, kids, close: f"<{t}>" + "".join(kids) + (f"</{t}>" if close else ""),
                            st.sampled_from(TAGS), st.lists(inner, max_size=3), st.booleans()),
    max_leaves=25)


@settings(max_examples=200, deadline=None)
@given(st.lists(FRAG, max_size=4))
def test_tokenizer_tree_invariants(frags):
    from mdloom.functions.tokenize import tokenize
    nodes = tokenize("<html><body>" + "".join(frags))
    assert [n[0] for n in nodes] == list(range(len(nodes)))          # dense preorder ids
    by_id = {n[0]: n for n in nodes}
    for nid, end, parent, depth, kind, tag, _id, _cls, _attrs, text in nodes:
        assert end >= nid and depth == (by_id[parent][3] + 1 if parent >= 0 else 0)
        assert (kind == "text") == (tag is None) and (kind != "text" or end == nid)
        if parent >= 0:
            p = by_id[parent]
            assert p[0] < nid <= end <= p[1]   # subtree nested in parent's
            assert p[5] not in ("br", "img")                          # void elements have no children


def test_deep_page_stays_small():
    from mdloom.functions.tokenize import nodes_arrow_array
    levels = 8000
    arr = nodes_arrow_array(["<div>" * levels + "x" + "</div>" * levels])
    nodes = arr[0]
    assert len(nodes) == levels + 3                     # html, body and the text
    assert nodes[-1]["depth"].as_py() == levels + 2 and nodes[-1]["parent_id"].as_py() == levels + 1
    assert arr.nbytes < 10 * 1024 * 1024


def test_deep_page_renders(spark):
    from mdloom.plans import corpus as C
    from mdloom.operators import html as H
    n = 300
    html = "<body><main class='m'>" + "<div>" * n + "<ul><li>a<ul><li><b>b</b></li></ul></li></ul><p>t</p>" + "</div>" * n + "</main></body>"
    pages = spark.createDataFrame([(1, "https://a.org/x", html)], "page_id long, url string, html string")
    row = C.documents(H.parse_pages(pages), "body .m").select("markdown", "source").collect()[0]
    assert row.source == "selector" and row.markdown == "- a\n  - **b**\n\nt\n"
