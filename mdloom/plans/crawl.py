"""Crawl plans over link tables.

The reference pops URLs one at a time from a heap. Here a crawl is a
level-synchronous closure: each level joins the frontier to the edge table,
drops what was already visited (anti join) and de-duplicates; the reached set
equals the sequential crawl's (see SURVEY Q13). Each level is written to the cluster's
shared folder, so lineage stays short and a lost executor recomputes at most one level;
crawls of several sites, and ordered ones, stand in ``plans.closure``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdloom.operators.order import ranked
from mdloom.plans.closure import reach
from mdloom.session import ensure_checkpoint_dir


def closure(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst",
            max_levels: int | None = None) -> DataFrame:
    """Every node reachable from ``seeds`` (column ``node``) along ``edges``,
    with its BFS depth. Seeds themselves are never filtered (Q11); callers
    remove out-of-scope edges beforehand. Returns (node, depth)."""
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    e = _by_source(edges.select(F.col(src).alias("_src"), F.col(dst).alias("node")).where(F.col("node").isNotNull()).distinct())
    frontier = seeds.select("node").distinct().withColumn("depth", F.lit(0)).checkpoint()
    levels = [frontier]
    depth = 0
    while max_levels is None or depth < max_levels:
        depth += 1
        visited = reduce(DataFrame.unionByName, levels).select("node")
        nxt = (frontier.select(F.col("node").alias("_src")).join(e, "_src").select("node")
               .distinct()
               .join(visited, "node", "left_anti")
               .withColumn("depth", F.lit(depth))
               .checkpoint())
        if nxt.isEmpty():
            break
        levels.append(nxt)
        frontier = nxt
    return reduce(DataFrame.unionByName, levels)


def _by_source(edges: DataFrame) -> DataFrame:
    """The edges, written once and hash-partitioned by ``_src``: a level then shuffles
    only its frontier. An adaptive plan forgets the partitioning of what it
    checkpoints, so this one write is planned without it."""
    spark = edges.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return edges.repartition(n_parts, "_src").checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def frontier_new(links: DataFrame, visited_keys: DataFrame) -> DataFrame:
    """Link targets not yet visited, one row per target key; the first
    reference (page_id, pos) supplies the URL and the priority. Links are aggregated
    first, so a target that every page links to is one row in the join."""
    first = F.min_by(F.struct("dst_url", "priority", "page_id", "pos"), F.struct("page_id", "pos"))
    return (links.groupBy("dst_key").agg(first.alias("f"), F.count(F.lit(1)).alias("n_refs"))
            .join(visited_keys.select(F.col("url_key").alias("dst_key")), "dst_key", "left_anti")
            .select("dst_key", "f.dst_url", "f.priority", F.col("f.page_id").alias("first_page_id"),
                    F.col("f.pos").alias("first_pos"), "n_refs"))


def frontier_seen(links: DataFrame, visited_keys: DataFrame) -> DataFrame:
    """Links whose target was already visited."""
    return links.join(visited_keys.select(F.col("url_key").alias("dst_key")), "dst_key", "left_semi")


def link_graph(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Link → snapshot page (equi join on the normalised key)."""
    p = pages.select(F.col("url_key").alias("dst_key"), F.col("page_id").alias("dst_page_id"))
    return links.join(p, "dst_key").select(F.col("page_id").alias("src_page_id"), "pos", "dst_key",
                                           "dst_page_id")


def frontier_order(frontier: DataFrame, host_col: str = "host") -> DataFrame:
    """Pop order per site: priority ascending, discovery order on ties."""
    return ranked(frontier, [host_col], ["priority", "first_page_id", "first_pos", "dst_key"],
                  seq_col="pop_seq")


def url_inventory(pages: DataFrame) -> DataFrame:
    """Numbered list of collected URLs per site (crawl order = page_id). ``pages``
    has one row per URL key: a later spelling of a visited URL is skipped, not listed."""
    return ranked(pages.select("host", "page_id", "url"), ["host"], ["page_id"], seq_col="n")


def snapshot_points(pages: DataFrame, every: int) -> DataFrame:
    """State snapshots every ``every`` fetched pages per site (one row per URL
    key); ``redo`` counts the pages since the last snapshot, the work repeated if
    the run ends right after this page."""
    r = ranked(pages.select("host", "page_id"), ["host"], ["page_id"], seq_col="n")
    return (r.withColumn("snapshot", (F.col("n") % every) == 0)
            .withColumn("snapshot_no", (F.col("n") / every).cast("long"))
            .withColumn("redo", F.col("n") % every))


def crawl_progress(links: DataFrame, pages: DataFrame, patterns: list[str]) -> DataFrame:
    """Per site, in crawl order, the number of pages processed and the total
    shown with each: processed + URLs queued at that moment.

    ``pages`` has one row per URL key; ``links`` needs (page_id, dst_url, dst_key,
    scope_prefix). Queued are the links of earlier pages that pass the scope and
    the exclude patterns and were not visited when found, repeats counted, less
    one for each page so far that was taken from the queue."""
    from mdloom.functions import patterns as P
    from mdloom.functions import urls as U
    p = pages.select("page_id", "host", "url_key")
    found = links.where(U.allowed_prefix(F.col("dst_url"), F.col("scope_prefix"))
                        & ~F.coalesce(P.any_match(F.col("dst_url"), P.compiled(patterns)), F.lit(False)))
    target = p.select(F.col("url_key").alias("dst_key"), F.col("page_id").alias("dst"))
    queued = (found.select("page_id", "dst_key").join(p.select("page_id"), "page_id", "left_semi")
              .join(target, "dst_key", "left").where(F.col("dst").isNull() | (F.col("dst") > F.col("page_id"))))
    # links found by a page, and a mark on every page that an earlier one has queued: one aggregate
    marks = queued.select(F.explode(F.array(
        F.struct(F.col("page_id").alias("page_id"), F.lit(1).alias("n"), F.lit(0).alias("popped")),
        F.struct(F.col("dst").alias("page_id"), F.lit(0).alias("n"), F.lit(1).alias("popped")))).alias("m")).select("m.*")
    per_page = marks.where("page_id IS NOT NULL").groupBy("page_id").agg(
        F.sum("n").alias("n"), F.max("popped").alias("popped"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    rows = p.join(per_page, "page_id", "left").select("host", "page_id", z("n"), z("popped"))
    r = ranked(rows, ["host"], ["page_id"], seq_col="processed", sum_cols={"_found": "n", "_popped": "popped"},
               stage_input=True)
    return (r.withColumn("queued", F.col("_found") - F.col("n") - F.col("_popped"))
            .select("host", "page_id", "processed", "queued", (F.col("processed") + F.col("queued")).alias("total")))


def crawl_edges(links: DataFrame, pages: DataFrame, patterns, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Scope-checked link edges between snapshot pages.

    ``links`` needs (page_id, pos, dst_url, dst_key, scope_prefix); a link is in
    scope when its URL starts with ``scope_prefix`` (blank allows all, F2) and
    matches no exclude pattern (F3). Returns (edges(src, dst, priority, pos) between snapshot pages, misses(dst_key,
    src)), both with the columns ``by`` of links (the profile a link was found under) — a miss is an in-scope target the snapshot does not hold, i.e. a
    failed fetch."""
    from mdloom.functions import patterns as P
    from mdloom.functions import urls as U
    from mdloom.operators.urls import dedup_first
    if isinstance(patterns, str):      # per-row column as of patterns.compiled_array
        hit = P.first_match(F.col("dst_url"), F.col(patterns))
    else:
        hit = F.when(P.any_match(F.col("dst_url"), P.compiled(patterns)), F.lit("x"))
    ok = links.where(U.allowed_prefix(F.col("dst_url"), F.col("scope_prefix")) & hit.isNull())
    snap = dedup_first(pages.select("url_key", "page_id")).select(
        F.col("url_key").alias("dst_key"), F.col("page_id").alias("dst"))
    by = by or []
    j = ok.select(*by, F.col("page_id").alias("src"), "dst_key", "priority", "pos").join(snap, "dst_key", "left")
    edges = j.where(F.col("dst").isNotNull()).select(*by, "src", "dst", "priority", "pos")
    misses = j.where(F.col("dst").isNull()).select(*by, "dst_key", "src")
    return edges, misses


def site_crawl(links: DataFrame, pages: DataFrame, seeds: DataFrame, patterns, by: list[str] | None = None,
               ordered: bool = False) -> tuple[DataFrame, DataFrame]:
    """G4 on real pages: from the seed pages (columns ``by`` and ``node`` = page_id), every
    snapshot page reachable through in-scope nav links, with its depth (and with ``ordered`` its place
    ``seq`` in the crawl order, G5); plus the misses met from crawled pages (one row per target key, first source).
    Sites told apart by ``by`` crawl on their own and may share pages."""
    by = by or []
    edges, misses = crawl_edges(links, pages, patterns, by)
    reached = reach(edges, seeds, by, ordered)
    met = misses.join(reached.select(*by, F.col("node").alias("src")), [*by, "src"], "left_semi")
    return reached, met.groupBy(*by, "dst_key").agg(F.min("src").alias("first_src"), F.count(F.lit(1)).alias("n_refs"))
