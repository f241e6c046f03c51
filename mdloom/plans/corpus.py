"""Page → corpus plans: parsed pages, links, documents.

All per-page work is one narrow projection over the parsed page row, so these
plans have no shuffle; cross-page work (dedup, visited tests) lives in
``plans.crawl``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.functions import urls as U
from mdloom.functions.markdown import render_markdown
from mdloom.operators import html as H
from mdloom.sources.pages import read_table


def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: (page_id, url, url_key, host, nodes). Reads only the three page columns."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return H.parse_pages(pages).select(
        "page_id", "url", U.normalize_url("url").alias("url_key"), U.url_host("url").alias("host"),
        "nodes")


def page_nodes(parsed: DataFrame) -> DataFrame:
    """H1 as a flat table: one row per node."""
    return parsed.select("page_id", F.explode("nodes").alias("n")).select("page_id", "n.*")


def valid_nav_links(nodes, nav_selector: str = H.DEFAULT_NAV_SELECTOR):
    """Nav links whose href is not blank (the ones a crawler would resolve)."""
    return F.filter(H.nav_links(nodes, nav_selector),
                    lambda l: F.regexp_replace(l["href"], r"^\s+|\s+$", "") != "")


def links(parsed: DataFrame, nav_selector=H.DEFAULT_NAV_SELECTOR, keep: list[str] | None = None) -> DataFrame:
    """H5 + P2 + P1 + P4: nav links with position (empty hrefs skipped), absolute
    target, target key and priority."""
    raw = valid_nav_links(F.col("nodes"), nav_selector)
    keep = keep or []
    out = parsed.select("page_id", "url", *keep, U.origin_of("url").alias("_origin"),
                        F.posexplode(raw).alias("pos", "l"))
    dst = U.resolve_url(F.col("url"), F.col("l.href"), F.col("_origin"))
    return out.select(
        "page_id", *keep, F.col("pos").cast("int").alias("pos"), F.col("l.href").alias("href"),
        F.col("l.link_text").alias("link_text"), dst.alias("dst_url"),
    ).withColumn("dst_key", U.normalize_url("dst_url")) \
     .withColumn("priority", U.link_priority("dst_url", "link_text"))


def documents(parsed: DataFrame, content_selector=H.DEFAULT_CONTENT_SELECTOR,
              src_map: str | None = None) -> DataFrame:
    """H3/H4/H7/H8: content root, cleaned nodes, Markdown, status and path."""
    cr = H.content_root(F.col("nodes"), content_selector)
    df = parsed.select("*", cr["root"].alias("root"), cr["source"].alias("source"))
    df = df.withColumn("kept", H.clean_nodes(F.col("nodes"), F.col("root")))
    md = render_markdown(F.col("kept"), F.col("nodes"), F.col(src_map) if src_map else None)
    # the renderer returns a string whenever a content root exists, so status
    # needs no rendering (queries that only count statuses skip the Markdown)
    status = (F.when(F.col("nodes").isNull(), F.lit("failed"))
              .when(F.col("root").isNull(), F.lit("failed"))
              .otherwise(F.lit("success")))
    error = (F.when(F.col("nodes").isNull(), F.lit("MEDIUM"))
             .when(F.col("source") == "none", F.lit("MEDIUM"))
             .when(F.col("source") == "body", F.lit("LOW")))
    return (df.withColumn("markdown", md)
            .withColumn("status", status)
            .withColumn("error_severity", error)
            .withColumn("md_path", U.md_path_or_fallback("url")))


def synthetic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closure test graph over ``pages``: page p links to (2p+1) % n and (2p+2) % n;
    targets with id % 7 = 0 are out of scope. ``n`` is a scalar subquery (one
    aggregate, evaluated once, no driver round trip)."""
    pages = read_table(spark, sf_dir, "pages").select("page_id")
    n = pages.agg(F.count(F.lit(1))).scalar()
    e = pages.select(F.col("page_id").alias("src"), F.explode(F.array(
        F.pmod(2 * F.col("page_id") + 1, n), F.pmod(2 * F.col("page_id") + 2, n))).alias("dst"))
    return e.withColumn("in_scope", F.pmod(F.col("dst"), F.lit(7)) != 0)
