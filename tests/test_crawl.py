"""Closure, ranking and attempt roll-ups against brute-force Python."""

import random
from collections import deque

from pyspark.sql import functions as F

from mdloom.operators import attempts as OA
from mdloom.operators.order import ranked
from mdloom.plans import corpus as C
from mdloom.plans import crawl as CR

from conftest import SF_SMALL


def bfs(edges, start, scope=lambda d: True):
    depth = {start: 0}
    q = deque([start])
    while q:
        u = q.popleft()
        for s, d in edges:
            if s == u and scope(d) and d not in depth:
                depth[d] = depth[u] + 1
                q.append(d)
    return depth


def test_synthetic_closure_anchors(spark):
    # SURVEY §5 anchors at sf0.001: all edges 50 nodes, scoped 43 nodes
    edges = C.synthetic_edges(spark, SF_SMALL)
    seeds = spark.range(1).select(F.lit(0).cast("long").alias("node"))
    allr = CR.closure(edges, seeds).collect()
    scoped = CR.closure(edges.where("in_scope"), seeds).collect()
    assert len(allr) == 50 and len(scoped) == 43
    py = bfs([(r.src, r.dst) for r in edges.collect()], 0, lambda d: d % 7 != 0)
    assert {r.node: r.depth for r in scoped} == py


def test_site_fixture_closure(spark):
    # small site: cycle, self link, dead link, page without nav
    pages = [("http://s/", '<body><nav><a href="/a">a</a><a href="/b">b</a><a href="/">home</a></nav></body>'),
             ("http://s/a", '<body><nav><a href="b">b</a><a href="/a">self</a><a href="/dead">x</a></nav></body>'),
             ("http://s/b", '<body><nav><a href="/c#frag">c</a><a href="/c">c</a></nav></body>'),
             ("http://s/c", "<body><p>no nav</p></body>"),
             ("http://s/island", '<body><nav><a href="/">home</a></nav></body>')]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    from mdloom.functions import urls as U
    from mdloom.operators import html as H
    parsed = H.parse_pages(df).select("page_id", "url", U.normalize_url("url").alias("url_key"), "nodes")
    links = C.links(parsed)
    keys = parsed.select("page_id", "url_key")
    # edges between snapshot pages, exclude patterns applied to targets
    e = links.where(~F.col("dst_url").rlike(".*#.*")).join(
        keys.select(F.col("url_key").alias("dst_key"), F.col("page_id").alias("dst")), "dst_key") \
        .select(F.col("page_id").alias("src"), "dst")
    got = {r.node: r.depth for r in CR.closure(e, spark.range(1).select(F.lit(0).cast("long").alias("node"))).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 2}
    # dead link stays in the frontier, the island is never reached
    fr = {r.dst_key for r in CR.frontier_new(links, keys).collect()}
    assert fr == {"http://s/dead"}


def test_ranked_matches_python(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", "c"]), i, rnd.randint(0, 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, x int")
    got = {(r.g, r.o): (r.seq, r.run) for r in ranked(df, ["g"], ["o"], sum_cols={"run": "x"}, num_partitions=7).collect()}
    for g in {r[0] for r in rows}:
        acc = 0
        for k, (_, o, x) in enumerate(sorted([r for r in rows if r[0] == g], key=lambda r: r[1])):
            acc += x
            assert got[(g, o)] == (k + 1, acc)


def test_auto_skip_monotone_and_threshold(spark):
    rows = [(i, "u", i, f) for i, f in enumerate([1, 1, 0, 1, 1, 1, 0, 1])]
    df = spark.createDataFrame(rows, "attempt_id long, url_id string, ts long, failed_i int") \
        .withColumn("failed", F.col("failed_i") == 1)
    got = sorted(OA.auto_skip(df).collect(), key=lambda r: r.attempt_no)
    assert [r.prior_failures for r in got] == [0, 1, 2, 2, 3, 4, 5, 5]
    assert [r.skipped for r in got] == [False] * 6 + [True, True]   # a success does not reset (Q4)


def test_classify_and_backoff(spark):
    rows = [("ok", 200), ("timeout", None), ("connection", None), ("http", 404), ("http", 429),
            ("http", 503), ("request", None), ("unexpected", None)]
    df = spark.createDataFrame(rows, "outcome string, status int")
    got = [tuple(r.c) for r in df.select(OA.classify_fetch("outcome", "status").alias("c")).collect()]
    assert got == [(None, None, None), ("network_error", "MEDIUM", True), ("network_error", "MEDIUM", True),
                   ("network_error", "LOW", False), ("network_error", "MEDIUM", True),
                   ("network_error", "MEDIUM", True), ("network_error", "MEDIUM", True),
                   ("network_error", "HIGH", False)]
    d = spark.range(8).select(OA.backoff_delay(F.col("id")).alias("d")).collect()
    assert [r.d for r in d] == [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 60.0, 60.0]


def test_top_failures_ties_by_url(spark):
    df = spark.createDataFrame([(u, n) for u, n in [("b", 3), ("a", 3), ("c", 5), ("d", 0)]],
                               "url_id string, failures long")
    got = [r.url_id for r in OA.top_failures(df, k=2).collect()]
    assert got == ["c", "a"]


def test_resume_from_visited_reaches_same_set(spark):
    # Q8 intent: a resumed crawl continues from the links of the visited pages
    edges = C.synthetic_edges(spark, SF_SMALL).where("in_scope")
    seeds0 = spark.range(1).select(F.lit(0).cast("long").alias("node"))
    full = {r.node for r in CR.closure(edges, seeds0).collect()}
    visited = spark.createDataFrame([(0,), (1,), (2,)], "node long")
    resumed = {r.node for r in CR.closure(edges, visited).collect()}
    assert resumed == full


def test_fallback_name_stable(spark):
    from mdloom.functions import urls as U
    import hashlib
    url = "http://h/a"
    got = spark.createDataFrame([(url,)], "u string").select(U.fallback_name("u")).first()[0]
    want = f"page_{int(hashlib.md5(url.encode()).hexdigest()[:8], 16) % 100000:05d}.md"
    assert got == want


def test_site_crawl_composed(spark):
    from mdloom.functions import urls as U
    from mdloom.operators import html as H
    pages = [("http://s/", '<body><nav><a href="/a">a</a><a href="/b">b</a><a href="http://o/x">off-site</a></nav></body>'),
             ("http://s/a", '<body><nav><a href="b">b</a><a href="/a">self</a><a href="/dead">x</a></nav></body>'),
             ("http://s/b", '<body><nav><a href="/c#frag">c</a><a href="/c/">c</a></nav></body>'),
             ("http://s/c", "<body><p>no nav</p></body>"),
             ("http://s/island", '<body><nav><a href="/">home</a></nav></body>')]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    parsed = H.parse_pages(df).select("page_id", "url", U.normalize_url("url").alias("url_key"), "nodes")
    scope = F.concat(U.origin_of("url"), F.lit("/")).alias("scope_prefix")
    links = C.links(parsed).join(parsed.select("page_id", scope), "page_id")
    seeds = spark.range(1).select(F.lit(0).cast("long").alias("node"))
    reached, misses = CR.site_crawl(links, parsed.select("page_id", "url", "url_key"), seeds, U.DEFAULT_EXCLUDE_PATTERNS)
    assert {r.node: r.depth for r in reached.collect()} == {0: 0, 1: 1, 2: 1, 3: 2}
    assert [(r.dst_key, r.first_src) for r in misses.collect()] == [("http://s/dead", 1)]


def test_run_profile_end_to_end(spark):
    import pytest
    from mdloom.plans import run as RUN
    pages = [("http://s/", '<body><nav><a href="/a">a</a><a href="/b">b</a><a href="http://o/x">off</a></nav><p>home</p></body>'),
             ("http://s/a", '<body><nav><a href="b">b</a><a href="/dead">x</a></nav><main><h1>A</h1></main></body>'),
             ("http://s/b", '<body><nav><a href="/c#frag">c</a><a href="/c/">c</a></nav><main>B</main></body>'),
             ("http://s/c", "<body><main><p>C</p></main></body>"),
             ("http://s/island", '<body><main>I</main></body>')]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    prof = {"target_site": {"start_url": "http://s/", "allowed_domain": "http://s/"}}
    out = RUN.run_profile(spark, df, prof)
    assert {r.node for r in out["reached"].collect()} == {0, 1, 2, 3}
    md = {r.page_id: r.markdown for r in out["documents"].collect()}
    assert md[1] == "# A\n" and md[3] == "C\n" and md[0] == "home\n"      # page 0 falls back to body
    run = out["runs"].first()
    assert (run.total_crawled, run.total_failed, run.content_errors) == (4, 1, 1)
    # content 1/4 > 0.2 → R04 (HIGH); network 1/5 → R03; all errors 2/9 → R13
    assert [r.rule_id for r in out["advice"].orderBy("line_no").collect()] == ["R04", "R03", "R13"]
    with pytest.raises(RUN.ProfileError):
        RUN.run_profile(spark, df, {"target_site": {"start_url": "ftp://s/", "allowed_domain": "http://s/"}})


def test_run_profiles_two_sites(spark):
    import json
    from mdloom.plans import run as RUN
    pages = [(0, "https://a.org/docs/", '<body><nav><a href="/docs/x">x</a></nav><main>A0</main></body>'),
             (1, "https://a.org/docs/x", '<body><nav><a href="/blog/y">y</a></nav><main>A1</main></body>'),
             (2, "https://a.org/blog/y", '<body><main>out of scope</main></body>'),
             (3, "http://b.net/", '<body><div class="sidebar"><a href="/p#frag">p</a><a href="/q">q</a></div>'
                                  '<article>B0</article><main>not b content</main></body>'),
             (4, "http://b.net/q", '<body><article>B1</article></body>'),
             (5, "http://b.net/p", '<body><article>B2</article></body>')]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    profiles = [("a", {"target_site": {"start_url": "https://a.org/docs/", "allowed_domain": "https://a.org/docs/"}}),
                ("b", {"target_site": {"start_url": "http://b.net/", "allowed_domain": "http://b.net/"},
                       "crawler": {"navigation_selector": ".sidebar"}, "extractor": {"content_selector": "article"}}),
                ("bad", {"target_site": {"start_url": "x", "allowed_domain": "http://c/"}})]
    raw = spark.createDataFrame([(k, json.dumps(v)) for k, v in profiles], "profile_id string, profile_json string")
    out = RUN.run_profiles(spark, df, raw)
    assert {r.node: r.depth for r in out["reached"].collect()} == {0: 0, 1: 1, 3: 0, 4: 1}
    md = {r.page_id: r.markdown for r in out["documents"].collect()}
    assert md == {0: "A0\n", 1: "A1\n", 3: "B0\n", 4: "B1\n"}
    assert {r.profile_id for r in out["rejected"].collect()} == {"bad"}


def test_progress_counts_the_queue(spark):
    # page 0 queues b, c and x; page 1 (b) queues c again, not the visited a; page 2 (c) finds x
    pages = spark.createDataFrame([(0, "h", "https://h/a"), (1, "h", "https://h/b"), (2, "h", "https://h/c"), (5, "i", "https://i/")],
                                  "page_id long, host string, url_key string")
    links = spark.createDataFrame(
        [(0, "https://h/b"), (0, "https://h/c"), (0, "https://h/x"), (0, "https://h/search.html"), (0, "https://other/y"),
         (1, "https://h/c"), (1, "https://h/a"), (2, "https://h/x"), (9, "https://h/z")], "page_id long, dst_url string") \
        .select("page_id", "dst_url", F.col("dst_url").alias("dst_key"), F.lit("https://h/").alias("scope_prefix"))
    got = {r.page_id: (r.processed, r.queued, r.total) for r in CR.crawl_progress(links, pages, [r".*/search\.html"]).collect()}
    assert got == {0: (1, 0, 1), 1: (2, 2, 4), 2: (3, 2, 5), 5: (1, 0, 1)}


def test_inventory_and_snapshots(spark):
    pages = spark.range(7).select(F.col("id").alias("page_id"), F.lit("h").alias("host"), F.lit("u").alias("url"))
    got = [(r.n, r.snapshot, r.snapshot_no, r.redo) for r in CR.snapshot_points(pages, 3).orderBy("n").collect()]
    assert got == [(1, False, 0, 1), (2, False, 0, 2), (3, True, 1, 0), (4, False, 1, 1), (5, False, 1, 2), (6, True, 2, 0), (7, False, 2, 1)]


def test_nested_profiles_and_many_selectors(spark):
    """Nested scopes crawl on their own; thousands of distinct selectors run; one that cannot be read is an error row."""
    import json
    from mdloom.plans import run as RUN
    pages = [(0, "https://a.org/", '<body><nav><a href="/docs/">Reference</a><a href="/z">Index</a><a href="/y">y</a></nav><main>top</main></body>'),
             (1, "https://a.org/docs/", '<body><nav><a href="x">x</a><a href="/z">z</a></nav><div class="box c7"><p>D</p></div></body>'),
             (2, "https://a.org/docs/x", '<body><section id="s"><div class="box"><b title="t7">B</b></div></section><p>X</p></body>'),
             (3, "https://a.org/z", '<body><main>Z</main></body>'), (4, "https://a.org/y", '<body><nav><a href="/z?q">z</a></nav><main>Y</main></body>')]
    site = lambda start, scope, **k: json.dumps({"target_site": {"start_url": start, "allowed_domain": scope}, **k})
    profiles = [("all", site("https://a.org/", "https://a.org/")),
                ("docs", site("https://a.org/docs/", "https://a.org/docs/", extractor={"content_selector": "section > .box b[title^='t'], div.c7"})),
                ("odd", site("https://a.org/", "https://a.org/", extractor={"content_selector": "p:hover"}))]
    profiles += [(f"m{i}", site(f"https://m{i}.org/", f"https://m{i}.org/", crawler={"navigation_selector": f".nav{i}"}, extractor={"content_selector": f"#c{i} > p"})) for i in range(2500)]
    pages += [(100 + i, f"https://m{i}.org/", f'<body><div class="nav{i}"><a href="/n">n</a></div><main id="c{i}"><p>own {i}</p></main></body>') for i in range(0, 2500, 500)]
    pages += [(9000, "https://m500.org/n", "<body><p>next</p></body>")]
    out = RUN.run_profiles(spark, spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(profiles, "profile_id string, profile_json string"))
    reached = {(r.profile_id, r.node): (r.depth, r.seq) for r in out["reached"].collect()}
    # Index (5 less) before y before Reference (5 more): priorities 5, 10 and 16
    assert {k: v for k, v in reached.items() if k[0] in ("all", "docs")} == {
        ("all", 0): (0, 1), ("all", 3): (1, 2), ("all", 4): (1, 3), ("all", 1): (1, 4), ("all", 2): (2, 5), ("docs", 1): (0, 1), ("docs", 2): (1, 2)}
    assert reached["m500", 9000] == (1, 2) and len(reached) == 7 + 6
    docs = {(r.profile_id, r.page_id): (r.markdown.strip(), r.source) for r in out["documents"].collect()}
    assert docs["docs", 1] == ("D", "selector") and docs["docs", 2][1] == "selector" and docs["all", 3] == ("Z", "selector")
    assert docs["m500", 600] == ("own 500", "selector") and docs["m2000", 2100] == ("own 2000", "selector")
    assert [(r.profile_id, r.rule_id) for r in out["rejected"].collect()] == [("odd", "H2C")]


def test_levels_shuffle_only_what_they_find(spark):
    from mdloom.plans.closure import _Bucketed
    table, seen = _Bucketed(spark, "edges", ["node"], 8), _Bucketed(spark, "visited", ["node"], 8)
    table.add(spark.range(1000).select(F.col("id").alias("node"), (F.col("id") + 1).alias("dst")))
    seen.add(spark.range(10).select(F.col("id").alias("node"), F.lit(0).alias("depth")))
    seen.add(spark.range(10, 20).select(F.col("id").alias("node"), F.lit(1).alias("depth")))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        now = seen.read()
        found = now.where("depth = 1").join(table.read(), "node").select(F.col("dst").alias("node")).distinct().join(now.select("node"), "node", "left_anti")
        assert {r.node for r in found.collect()} == {20}
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1, final


def test_closure_edges_keep_their_partitioning(spark):
    edges = CR._by_source(spark.range(100).select(F.col("id").alias("_src"), (F.col("id") + 1).alias("node")))
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark.range(5).select(F.col("id").alias("_src")).join(edges, "_src")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("Exchange hashpartitioning") == 1, plan
