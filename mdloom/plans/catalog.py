"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over the
given tables (or tables Spark derives from them). Names follow SURVEY §2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.functions import patterns as P
from mdloom.functions import urls as U
from mdloom.operators import html as H
from mdloom.operators import urls as OU
from mdloom.plans import corpus as C
from mdloom.operators import advisor as AD
from mdloom.operators import attempts as OA
from mdloom.operators import errors as OE
from mdloom.operators.order import ranked
from mdloom.plans import crawl as CR
from mdloom.plans import increments as IN
from mdloom.plans import log_files as LF
from mdloom.plans import page_images as PI
from mdloom.plans import recovery as RC
from mdloom.plans.closure import reach
from mdloom.plans import runs as R
from mdloom.session import scratch_path
from mdloom.sources.pages import attempts_from_events, page_scan, read_table
from mdloom.streaming import pages_stream as ST
from mdloom.streaming import resumable as RS

# --- fixed parameters of the registered queries ------------------------------
# scope prefix used by the scope-filter queries (rejects plain-http pages)
SCOPE_PREFIX = "https://"
# state snapshot cadence (pages) of the default profile
SNAPSHOT_EVERY = 10
# kinds and HTTP states that failed attempts are given in turn
FAILURE_KINDS = ["timeout", "connection", "request", "http", "unexpected"]
FAILURE_STATUS = [404, 429, 403, 500, 502, 503, 504]
# ----------------------------------------------------------------------------


# ---------------------------------------------------------------- scans / URLs
def q_page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", U.url_host("url").alias("host"),
                        F.length("html").alias("n_chars"))


def q_url_normalize(spark, sf_dir):
    return page_scan(spark, sf_dir).select("page_id", "url", "url_key")


def q_md_path(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", "url", U.md_path("url").alias("md_path"))


def q_md_path_fallback(spark, sf_dir):
    """Two of three pages get a host with an unpaired bracket, by their id."""
    url = (F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "://", "://["))
           .when(F.col("page_id") % 3 == 1, F.regexp_replace("url", "(://[^/?#]*)", "$1]")).otherwise(F.col("url")))
    return read_table(spark, sf_dir, "pages").select("page_id", url.alias("url")).withColumn("md_path", U.md_path_or_fallback("url"))


def q_url_dedup(spark, sf_dir):
    return OU.dedup_first(page_scan(spark, sf_dir).select("url_key", "page_id", "url"))


def q_markdown_manifest(spark, sf_dir):
    first = OU.dedup_first(page_scan(spark, sf_dir))
    return first.select("page_id", "url", "url_key", "host", U.md_path("url").alias("md_path"))


def q_path_collisions(spark, sf_dir):
    first = OU.dedup_first(page_scan(spark, sf_dir))
    return OU.path_collisions(first.select("page_id", U.md_path("url").alias("md_path")))


def q_url_allowed(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select(
        "page_id", "url", U.allowed_prefix("url", SCOPE_PREFIX).alias("allowed"))


def q_url_exclude(spark, sf_dir):
    pats = P.compiled(U.DEFAULT_EXCLUDE_PATTERNS)
    return read_table(spark, sf_dir, "pages").select(
        "page_id", "url", P.first_match(F.col("url"), pats).alias("matched_pattern"))


#: Valid Python patterns whose syntax or meaning Java does not share, as profiles may hold them.
DIALECT_PATTERNS = [r"/{version}/", r"e{,1}x/[[]", r"(?P<mark>#)top\Z", r"(?P<mark>[?])page=(?P<n>\d{,3})&(?P=mark)?", r"(/)?(?(1)\w+|x)[.]html$",
                    r"(?a)\bref=\w+", r"/[]x[]", r"(?i)UTM_(?:SOURCE|medium)=(?P<s>f)e{2}d", r"[^\D_]+/$"]


def q_url_exclude_dialect(spark, sf_dir):
    """the first pattern of each page's own list that matches, lists standing in the rows of a table (per-row form),
    and whether any of all patterns does (one joined Java pattern)."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    # list i holds the patterns from the i-th on; page_id % 9 picks a page's list
    lists = spark.range(len(DIALECT_PATTERNS)).select(
        F.col("id").alias("list"), F.slice(F.array(*[F.lit(p) for p in DIALECT_PATTERNS]), F.col("id").cast("int") + 1, F.lit(len(DIALECT_PATTERNS))).alias("patterns"))
    lists = lists.select("list", P.compiled_array("patterns").alias("compiled"))
    return (pages.withColumn("list", F.col("page_id") % len(DIALECT_PATTERNS)).join(F.broadcast(lists), "list")  # nine rows
            .select("page_id", "url", "list", P.first_match(F.col("url"), F.col("compiled")).alias("matched_pattern"),
                    P.any_match(F.col("url"), P.compiled(DIALECT_PATTERNS)).alias("any_match")))


def q_url_validate(spark, sf_dir):
    pages = OU.mark_duplicates(page_scan(spark, sf_dir).select("page_id", "url", "url_key"))
    v = OU.url_verdict(F.col("url"), F.col("is_duplicate"), SCOPE_PREFIX, U.DEFAULT_EXCLUDE_PATTERNS)
    return pages.select("page_id", "url", v["verdict"].alias("verdict"), v["reason"].alias("reason"))


def q_url_verdict_counts(spark, sf_dir):
    return q_url_validate(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- HTML / links
def q_page_nodes(spark, sf_dir):
    return C.page_nodes(C.parsed_pages(spark, sf_dir)).select(
        "page_id", "node_id", "end_id", "parent_id", "depth", "kind", "tag", "elem_id", "text")


def q_selector_match(spark, sf_dir):
    p = C.parsed_pages(spark, sf_dir)
    nodes = F.col("nodes")
    return p.select(
        "page_id",
        F.size(H.matches(nodes, "nav")).alias("n_nav"),
        F.size(H.matches(nodes, "article")).alias("n_article"),
        F.size(H.matches(nodes, "div.ad")).alias("n_ad"),
        F.size(H.matches(nodes, "nav a")).alias("n_nav_a"),
        F.size(H.matches(nodes, "ul > li")).alias("n_ul_li"))


def q_link_extract(spark, sf_dir):
    return C.links(C.parsed_pages(spark, sf_dir))


def q_link_resolve(spark, sf_dir):
    return C.links(C.parsed_pages(spark, sf_dir)).select("page_id", "pos", "href", "dst_url")


def q_link_text(spark, sf_dir):
    return C.links(C.parsed_pages(spark, sf_dir)).select("page_id", "pos", "link_text")


def q_link_priority(spark, sf_dir):
    return C.links(C.parsed_pages(spark, sf_dir)).select(
        "page_id", "pos", "dst_url", "link_text", U.keyword_class("link_text").alias("keyword"),
        "priority")


def q_content_extract(spark, sf_dir):
    p = C.parsed_pages(spark, sf_dir)
    main = H.content_root(F.col("nodes"), "main")
    art = H.content_root(F.col("nodes"), "article")
    return p.select(
        "page_id", main["source"].alias("source"), main["root"]["tag"].alias("root_tag"),
        art["source"].alias("article_source"),
        H.node_text(F.col("nodes"), art["root"]).alias("article_text"))


def q_content_clean(spark, sf_dir):
    d = C.documents(C.parsed_pages(spark, sf_dir))
    texts = F.transform(F.filter("kept", lambda n: n["kind"] == "text"), lambda n: n["text"])
    return d.select("page_id", F.array_join(texts, "").alias("clean_text"))


def q_markdown_docs(spark, sf_dir):
    d = C.documents(C.parsed_pages(spark, sf_dir))
    return d.select("page_id", "md_path", "markdown")


def q_image_extract(spark, sf_dir):
    """H6 + P3: images with a non-empty src in the cleaned content, resolved
    against the page URL (the input of the image manifest, S8)."""
    d = C.documents(C.parsed_pages(spark, sf_dir))
    imgs = d.select("page_id", "url", F.explode(H.images(F.col("kept"))).alias("i"))
    return imgs.select("page_id", F.col("i.src").alias("src"),
                       U.resolve_url(F.col("url"), F.col("i.src")).alias("abs_url"))


def q_convert_status(spark, sf_dir):
    d = C.documents(C.parsed_pages(spark, sf_dir))
    return d.select("page_id", "source", "status", "error_severity")


def q_convert_gaps(spark, sf_dir):
    """H8, H3: status of pages of which some have no html or an empty one; even ones ask for article, odd ones for a selector that nothing has."""
    from mdloom.functions.selector_rows import MatchedNodes, matched_nodes, parsed_steps
    asks = spark.createDataFrame([(0, "article"), (1, "main > .absent, #none")], "odd int, sel string").select("odd", parsed_steps("sel").alias("steps"))
    pid = F.col("page_id")
    html = F.when(pid % 7 == 0, F.lit(None)).when(pid % 11 == 0, F.lit("")).otherwise(F.col("html")).alias("html")
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", html, (pid % 2).cast("int").alias("odd"))
    parsed = H.parse_pages(pages.join(F.broadcast(asks), "odd"))  # two rows
    hit = parsed.withColumn("hit", matched_nodes(F.col("nodes"), F.col("steps"), only_first=True))
    return C.documents(hit, MatchedNodes(F.col("hit"))).select("page_id", "source", "status", "error_severity")


def q_convert_stats(spark, sf_dir):
    """A2: per host processed / success / failed and success rate (%)."""
    d = C.documents(C.parsed_pages(spark, sf_dir))
    return d.groupBy("host").agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if(F.col("status") == "success").alias("total_success"),
        F.count_if(F.col("status") == "failed").alias("total_failed"),
    ).withColumn("success_rate", F.round(F.try_divide(100.0 * F.col("total_success"),
                                                      F.col("total_processed")), 1))


# ---------------------------------------------------------------- crawl
def _links_and_keys(spark, sf_dir):
    links = C.links(C.parsed_pages(spark, sf_dir))
    keys = page_scan(spark, sf_dir).select("url_key", "page_id", "host")
    return links, keys


def q_frontier_new(spark, sf_dir):
    links, keys = _links_and_keys(spark, sf_dir)
    return CR.frontier_new(links, keys)


def q_frontier_seen(spark, sf_dir):
    links, keys = _links_and_keys(spark, sf_dir)
    return CR.frontier_seen(links, keys).select("page_id", "pos", "dst_key")


def q_link_graph(spark, sf_dir):
    links, keys = _links_and_keys(spark, sf_dir)
    return CR.link_graph(links, keys)


def q_frontier_lookup(spark, sf_dir):
    """Resolve each frontier URL against the snapshot; a miss is a failed fetch."""
    from mdloom.sources.pages import snapshot_lookup
    links, keys = _links_and_keys(spark, sf_dir)
    fr = CR.frontier_new(links, keys).select(F.col("dst_key").alias("url_key"), "dst_url")
    # only whether there is html takes part, so the texts themselves are not shuffled
    has = F.when(F.col("html").isNotNull(), F.lit("")).alias("html")
    snap = OU.dedup_first(page_scan(spark, sf_dir, with_html=True).select("url_key", "page_id", has))
    return snapshot_lookup(fr, snap.drop("n_variants")).select("url_key", "dst_url", "page_id", "fetched")


def q_frontier_order(spark, sf_dir):
    links, keys = _links_and_keys(spark, sf_dir)
    fr = CR.frontier_new(links, keys).withColumn("host", U.url_host("dst_url"))
    return CR.frontier_order(fr).select("host", "pop_seq", "dst_key", "dst_url", "priority")


def q_url_inventory(spark, sf_dir):
    return CR.url_inventory(OU.dedup_first(page_scan(spark, sf_dir)))


def q_snapshot_points(spark, sf_dir):
    return CR.snapshot_points(OU.dedup_first(page_scan(spark, sf_dir)), SNAPSHOT_EVERY)


def _closure(spark, sf_dir, scoped: bool):
    edges = C.synthetic_edges(spark, sf_dir)
    if scoped:
        edges = edges.where("in_scope")
    seeds = spark.range(1).select(F.lit(0).cast("long").alias("node"))
    return CR.closure(edges, seeds)


def q_crawl_closure(spark, sf_dir):
    return _closure(spark, sf_dir, True)


def q_crawl_closure_all(spark, sf_dir):
    return _closure(spark, sf_dir, False)


def q_crawl_order(spark, sf_dir):
    """Level-synchronous crawl order (depth, then node) as a global sequence."""
    return ranked(_closure(spark, sf_dir, True), [], ["depth", "node"], seq_col="crawl_seq")


def _scoped_links(spark, sf_dir):
    """Nav links, each with its page's origin as the scope."""
    parsed = C.parsed_pages(spark, sf_dir).withColumn("scope_prefix", F.concat(U.origin_of("url"), F.lit("/")))
    return C.links(parsed, keep=["scope_prefix"])


def _site_crawl(spark, sf_dir):
    links = _scoped_links(spark, sf_dir)
    pages = page_scan(spark, sf_dir).select("page_id", "url", "url_key", "host")
    seeds = pages.groupBy("host").agg(F.min("page_id").alias("node")).select("node")
    return CR.site_crawl(links, pages, seeds, U.DEFAULT_EXCLUDE_PATTERNS), pages


def q_site_crawl(spark, sf_dir):
    """G4 on the snapshot: one crawl per site from its first page, through
    in-scope nav links to snapshot pages."""
    (reached, _misses), pages = _site_crawl(spark, sf_dir)
    return reached.join(pages.select(F.col("page_id").alias("node"), "url"), "node") \
        .select(F.col("node").alias("page_id"), "url", "depth")


def _derived_links(spark, sf_dir):
    """Nav links whose targets stand in the snapshot: the href and the page pick a page by a digest. Profile k crawls the links with k more
    in their digest, so that profiles reach pages in common by other ways."""
    n = read_table(spark, sf_dir, "pages").agg(F.count(F.lit(1))).scalar()
    links = C.links(C.parsed_pages(spark, sf_dir)).select("page_id", "pos", "href", "priority")
    links = links.withColumn("profile", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    digest = F.md5(F.concat_ws("|", "href", "page_id", "profile"))
    target = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n
    # the path's depth and keywords give few priorities: a digit of the digest adds more, ties stay
    return links.select("profile", F.col("page_id").alias("src"), target.alias("dst"), (F.col("priority") + F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") % 4).alias("priority"), "pos")


def _links_to_pages(spark, sf_dir):
    """The derived links of profile 0 with the key of the page that each leads to, and all keys."""
    keys = page_scan(spark, sf_dir).select("url_key", "page_id")
    links = _derived_links(spark, sf_dir).where("profile = 0")
    target = keys.select(F.col("page_id").alias("dst"), F.col("url_key").alias("dst_key"))
    return links.join(target, "dst").select(F.col("src").alias("page_id"), "pos", "dst_key"), keys


def q_derived_link_graph(spark, sf_dir):
    """J3 over links that hit the snapshot: every page of the target's key."""
    return CR.link_graph(*_links_to_pages(spark, sf_dir))


def q_derived_links_seen(spark, sf_dir):
    """Links whose target is among the visited keys, those of every third page."""
    links, keys = _links_to_pages(spark, sf_dir)
    return CR.frontier_seen(links, keys.where(F.col("page_id") % 3 == 0)).select("page_id", "pos", "dst_key")


def q_site_order(spark, sf_dir):
    """G4 and G5 over links derived from the pages: three profiles crawl the snapshot from page 0 on; depth and place of each page."""
    seeds = spark.range(3).select(F.col("id").cast("int").alias("profile"), F.lit(0).cast("long").alias("node"))
    return reach(_derived_links(spark, sf_dir), seeds, ["profile"], ordered=True).select("profile", "node", F.col("depth").cast("int").alias("depth"), "seq")


def q_site_crawl_misses(spark, sf_dir):
    """S2 inside a crawl: in-scope targets of crawled pages missing from the snapshot."""
    (_reached, misses), _pages = _site_crawl(spark, sf_dir)
    return misses


# ---------------------------------------------------------------- attempts
def q_auto_skip(spark, sf_dir):
    return OA.auto_skip(attempts_from_events(spark, sf_dir)).select(
        "attempt_id", "url_id", "failed", "attempt_no", "prior_failures", "skipped")


def q_failed_urls(spark, sf_dir):
    return OA.failed_urls(attempts_from_events(spark, sf_dir))


def q_top_failures(spark, sf_dir):
    return OA.top_failures(OA.failed_urls(attempts_from_events(spark, sf_dir)))


def q_crawl_stats(spark, sf_dir):
    return OA.crawl_stats(attempts_from_events(spark, sf_dir))


def q_backoff_schedule(spark, sf_dir):
    """Delay before the retry that follows each failed attempt (k = failures
    of the URL so far, 0-based). Successes don't count, so they go before the ranking."""
    a = OA.auto_skip(attempts_from_events(spark, sf_dir).where("failed"))
    return a.select("attempt_id", "url_id", "prior_failures",
                    OA.backoff_delay(F.col("prior_failures")).alias("retry_delay"))


def q_fetch_classify(spark, sf_dir):
    """Outcome class of every attempt. The log only tells failures from
    successes, so the kind of a failure and its HTTP status follow from its id."""
    a = attempts_from_events(spark, sf_dir)
    nth = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))
    outcome = F.when(~F.col("failed"), F.lit("ok")).otherwise(nth(FAILURE_KINDS, F.col("attempt_id")))
    a = a.select("attempt_id", outcome.alias("outcome"))
    status = (F.when(F.col("outcome") == "ok", F.lit(200))
              .when(F.col("outcome") == "http", nth(FAILURE_STATUS, F.floor(F.col("attempt_id") / len(FAILURE_KINDS)))))
    a = a.withColumn("status", status)
    return a.select("attempt_id", "outcome", "status", OA.classify_fetch("outcome", "status").alias("c")).select(
        "attempt_id", "outcome", "status", "c.*")


def q_throughput(spark, sf_dir):
    """T4 (batch form): successful fetches per minute."""
    a = attempts_from_events(spark, sf_dir).where(~F.col("failed"))
    minute = F.date_trunc("minute", "ts").cast("timestamp_ntz")
    return a.groupBy(minute.alias("minute")).agg(F.count(F.lit(1)).alias("pages"))


# ---------------------------------------------------------------- errors / runs / advisor
def q_error_union(spark, sf_dir):
    return R.site_errors(spark, sf_dir).select("source", "error_type", "severity", "url", "message")


def q_error_summary(spark, sf_dir):
    return OE.error_summary(spark, R.site_errors(spark, sf_dir))


def q_error_policy(spark, sf_dir):
    e = OE.error_policy(R.site_errors(spark, sf_dir))
    return e.groupBy("error_type", "severity", "log_level", "continue_run", "retry").agg(
        F.count(F.lit(1)).alias("n"))


def q_site_runs(spark, sf_dir):
    return R.site_runs(spark, sf_dir)


def q_run_rates(spark, sf_dir):
    return AD.run_rates(R.site_runs(spark, sf_dir))


def q_advisor(spark, sf_dir):
    return AD.advisor(R.site_runs(spark, sf_dir)).select("run_id", "rule_id", "priority", "category")


def q_advisor_counts(spark, sf_dir):
    return AD.advisor_counts(AD.advisor(R.site_runs(spark, sf_dir)))


def q_advisor_report(spark, sf_dir):
    return AD.advisor_report(R.site_runs(spark, sf_dir)).select("run_id", "line_no", "rule_id", "priority")


def q_advisor_varied(spark, sf_dir):
    """R1-R14, W8 over runs of which some meet every rule and some none."""
    return AD.advisor_report(R.varied_runs(spark, sf_dir)).select("run_id", "line_no", "rule_id", "priority", "category")


def q_crawl_progress(spark, sf_dir):
    """Per site, in crawl order, pages processed so far and the total shown
    with each (processed + queued at that moment)."""
    pages = OU.dedup_first(page_scan(spark, sf_dir))
    return CR.crawl_progress(_scoped_links(spark, sf_dir), pages, U.DEFAULT_EXCLUDE_PATTERNS)


def q_page_priority(spark, sf_dir):
    """P4/P5 on page URLs with the page title as link text."""
    p = C.parsed_pages(spark, sf_dir)
    title = F.try_element_at(H.matches(F.col("nodes"), "title"), F.lit(1))
    t = p.select("page_id", "url", H.node_text(F.col("nodes"), title, strip=True).alias("title"))
    return t.select("page_id", "url", "title", U.keyword_class("title").alias("keyword"),
                    U.link_priority("url", "title").alias("priority"))


# ---------------------------------------------------------------- profiles
def _origin_profiles(spark, sf_dir):
    """One profile per site origin seen in the snapshot (JSON rows, as a
    profile source would deliver them)."""
    from mdloom.operators import profiles as PR
    pages = read_table(spark, sf_dir, "pages")
    p = U.parse_url("url")
    origin = F.concat(p["scheme"], F.lit("://"), F.lower(p["netloc"]), F.lit("/"))
    raw = pages.select(origin.alias("profile_id")).distinct().select(
        "profile_id", F.to_json(F.struct(F.struct(F.col("profile_id").alias("start_url"),
                                                  F.col("profile_id").alias("allowed_domain")).alias("target_site")))
        .alias("profile_json"))
    return PR.merge_profiles(PR.parse_profiles(raw))


def q_page_profile(spark, sf_dir):
    """Each page's site profile by longest allowed-domain prefix."""
    from mdloom.operators import profiles as PR
    return PR.page_profile(read_table(spark, sf_dir, "pages"), _origin_profiles(spark, sf_dir))


def q_profile_checksum(spark, sf_dir):
    """Checksum of the content-defining sections of each derived profile."""
    from mdloom.operators import profiles as PR
    return PR.profile_checksum(_origin_profiles(spark, sf_dir))


def q_profile_violations(spark, sf_dir):
    """K/T/V rules over the derived site profiles (all violations, ranked)."""
    from mdloom.operators import profiles as PR
    return PR.profile_violations(_origin_profiles(spark, sf_dir))


#: Profiles with something of their own, as a profile source may deliver them: (section, key, JSON value); the pages' origins fill in the
#: site. A null key replaces the section, a null section the whole text.
PROFILE_CASES = [
    ("execution", "request_delay", "1.5"), ("target_site", "allowed_domain", '""'), ("target_site", "start_url", '"ftp://x/"'), ("execution", "request_delay", "-1"),
    ("execution", "request_delay", "60"), ("execution", "request_delay", "60.5"), ("crawler", "exclude_patterns", '["ok", "("]'),
    ("crawler", "exclude_patterns", '["/{version}/", "(a)?(?(1)b|c)"]'), ("logging", "console_level", '"TRACE"'), ("logging", "console_level", '"info"'),
    ("retry", "max_retries", '"three"'), ("retry", "max_retries", "true"), ("retry", "max_retries", "11"), ("crawler", "navigation_selector", "null"),
    ("recovery", "recovery_file", '" "'), ("target_site", "allowed_domain", '"example"'), (None, None, "{"), ("logging", "max_file_size_mb", "0"),
    ("crawler", None, "5"), ("retry", "retry_status_codes", '"429"'), ("output", "download_images", '"yes"'), ("logging", "file_level", '"LOUD"'),
    ("recovery", "save_interval", "0"), ("logging", "backup_count", "21"), ("retry", "skip_after_failures", "0"), ("retry", "backoff_factor", "0.5"),
    ("retry", "initial_delay", "31"), ("retry", "max_delay", "301"), ("output", "base_dir", '""'), ("extractor", "content_selector", '"  "'), ("target_site", None, "{}"),
]


def _case_json(section: str | None, key: str | None, value: str) -> str:
    """The profile text of a case, ``@`` standing for the origin."""
    if section is None:
        return value
    site = {"start_url": '"@"', "allowed_domain": '"@"'}
    sections = {"target_site": site, section: {**(site if section == "target_site" else {}), **({key: value} if key else {})}}
    inner = {s: "{" + ", ".join(f'"{k}": {v}' for k, v in d.items()) + "}" for s, d in sections.items()}
    if key is None:
        inner[section] = value
    return "{" + ", ".join(f'"{s}": {d}' for s, d in inner.items()) + "}"


def _page_profiles(spark, sf_dir):
    """One profile per page: its origin and the case that its id picks."""
    from mdloom.operators import profiles as PR
    p = U.parse_url("url")
    origin = F.concat(p["scheme"], F.lit("://"), F.lower(p["netloc"]), F.lit("/"))
    texts = F.array(*[F.lit(_case_json(*c)) for c in PROFILE_CASES])
    text = F.replace(F.get(texts, F.pmod("page_id", F.lit(len(PROFILE_CASES))).cast("int")), F.lit("@"), origin)
    raw = read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("profile_id"), text.alias("profile_json"))
    return PR.merge_profiles(PR.parse_profiles(raw))


def q_profile_faults(spark, sf_dir):
    """K/T/V: all violations of profiles of which most have a fault."""
    from mdloom.operators import profiles as PR
    return PR.profile_violations(_page_profiles(spark, sf_dir)).select(F.col("profile_id").alias("page_id"), "rule_id", "rule_rank", "path")


def q_profile_merge(spark, sf_dir):
    """Values after the merge with the defaults: absent keys take them, a null stays, a replaced section has none."""
    m = _page_profiles(spark, sf_dir)
    return m.select(F.col("profile_id").alias("page_id"), F.col("target_site__allowed_domain").alias("allowed_domain"),
                    F.col("crawler__navigation_selector").alias("navigation_selector"), F.size("crawler__exclude_patterns").alias("n_patterns"),
                    F.col("execution__request_delay").alias("request_delay"), F.col("logging__console_level").alias("console_level"),
                    F.col("retry__skip_after_failures").alias("skip_after_failures"), F.col("output__base_dir").alias("base_dir"))


# ---------------------------------------------------------------- logs
def _attempt_logs(spark, sf_dir):
    from mdloom.sources import logs as LG
    a = R.site_attempts(spark, sf_dir)
    lines = a.select(F.format_string("%s - web_crawler - %s - %s | url=%s | attempt=%d",
                                     F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
                                     F.when(F.col("failed"), F.lit("WARNING")).otherwise(F.lit("INFO")),
                                     F.when(F.col("failed"), F.lit("fetch failed - retry")).otherwise(F.lit("fetched")),
                                     F.col("url"), F.col("attempt_id")).alias("value"))
    return LG.parse_lines(lines)


def q_log_stats(spark, sf_dir):
    """Crawler log lines (rendered from the attempt log) parsed back and
    counted per logger and level."""
    from mdloom.sources import logs as LG
    return LG.log_stats(_attempt_logs(spark, sf_dir))


def q_log_context(spark, sf_dir):
    """Message and key=value context of each parsed line."""
    from mdloom.sources import logs as LG
    p = _attempt_logs(spark, sf_dir)
    return p.select(F.col("ctx")["attempt"].cast("long").alias("attempt_id"), "message",
                    F.col("ctx")["url"].alias("url"), LG.level_rank("level").alias("level_rank"))


def q_log_tail(spark, sf_dir):
    """The last 50 lines of the crawler log."""
    from mdloom.sources import logs as LG
    t = LG.log_tail(_attempt_logs(spark, sf_dir))
    return t.select(F.col("ctx")["attempt"].cast("long").alias("attempt_id"), "level", F.col("ctx")["url"].alias("url"))


# ---------------------------------------------------------------- streaming
def q_stream_pages(spark, sf_dir):
    """The first page of each new URL key, run incrementally (availableNow) into a
    table in the shared checkpoint folder."""
    base = scratch_path(spark, "stream-pages")
    RS.run_new_pages(ST.new_pages_source(spark, sf_dir), base)
    return ST.read_table(spark, f"{base}/out").select("url_key", "page_id")


def q_stream_failures(spark, sf_dir):
    """Cumulative failures per URL from a streaming aggregate (update mode)."""
    base = scratch_path(spark, "stream-failures")
    ST.run_to_table(ST.stream_failures(spark, sf_dir), f"{base}/out", f"{base}/ckpt", mode="update")
    return ST.read_table(spark, f"{base}/out", keys=["url_id"])


QUERIES = {
    "page_scan": q_page_scan,
    "url_normalize": q_url_normalize,
    "md_path": q_md_path,
    "md_path_fallback": q_md_path_fallback,
    "url_dedup": q_url_dedup,
    "markdown_manifest": q_markdown_manifest,
    "path_collisions": q_path_collisions,
    "url_allowed": q_url_allowed,
    "url_exclude": q_url_exclude,
    "url_exclude_dialect": q_url_exclude_dialect,
    "url_validate": q_url_validate,
    "url_verdict_counts": q_url_verdict_counts,
    "page_nodes": q_page_nodes,
    "selector_match": q_selector_match,
    "link_extract": q_link_extract,
    "link_resolve": q_link_resolve,
    "link_text": q_link_text,
    "link_priority": q_link_priority,
    "content_extract": q_content_extract,
    "content_clean": q_content_clean,
    "markdown_docs": q_markdown_docs,
    "image_extract": q_image_extract,
    "convert_status": q_convert_status,
    "convert_stats": q_convert_stats,
    "convert_gaps": q_convert_gaps,
    "frontier_new": q_frontier_new,
    "frontier_seen": q_frontier_seen,
    "link_graph": q_link_graph,
    "frontier_lookup": q_frontier_lookup,
    "frontier_order": q_frontier_order,
    "url_inventory": q_url_inventory,
    "snapshot_points": q_snapshot_points,
    "crawl_closure": q_crawl_closure,
    "crawl_closure_all": q_crawl_closure_all,
    "crawl_order": q_crawl_order,
    "site_crawl": q_site_crawl,
    "site_order": q_site_order,
    "derived_link_graph": q_derived_link_graph,
    "derived_links_seen": q_derived_links_seen,
    "site_crawl_misses": q_site_crawl_misses,
    "auto_skip": q_auto_skip,
    "failed_urls": q_failed_urls,
    "top_failures": q_top_failures,
    "crawl_stats": q_crawl_stats,
    "backoff_schedule": q_backoff_schedule,
    "fetch_classify": q_fetch_classify,
    "throughput": q_throughput,
    "error_union": q_error_union,
    "error_summary": q_error_summary,
    "error_policy": q_error_policy,
    "site_runs": q_site_runs,
    "run_rates": q_run_rates,
    "advisor": q_advisor,
    "advisor_counts": q_advisor_counts,
    "advisor_report": q_advisor_report,
    "advisor_varied": q_advisor_varied,
    "crawl_progress": q_crawl_progress,
    "page_priority": q_page_priority,
    "page_profile": q_page_profile,
    "profile_violations": q_profile_violations,
    "profile_faults": q_profile_faults,
    "profile_merge": q_profile_merge,
    "profile_checksum": q_profile_checksum,
    "log_stats": q_log_stats,
    "log_context": q_log_context,
    "log_tail": q_log_tail,
    "image_manifest": PI.q_image_manifest,
    "image_markdown": PI.q_image_markdown,
    "state_snapshot": RC.q_state_snapshot,
    "state_restore": RC.q_state_restore,
    "resume_gate": RC.q_resume_gate,
    "log_errors": LF.q_log_errors,
    "log_error_records": LF.q_log_error_records,
    "stream_pages": q_stream_pages,
    "stream_failures": q_stream_failures,
    "stream_restart": IN.q_stream_restart,
    "stream_auto_skip": IN.q_stream_auto_skip,
    "stream_throughput": IN.q_stream_throughput,
}
