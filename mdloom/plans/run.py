"""One profile-driven run over a page snapshot.

validate profile → seed at ``start_url`` → crawl snapshot pages through nav
links in scope (``allowed_domain``, exclude patterns) → extract, clean and
convert with the profile's selectors → optional Markdown sink → run counters,
error roll-up and advice. The profile is one row; its values are read once on
the driver to build the plan (selectors compile to Column predicates).
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.functions import urls as U
from mdloom.functions.patterns import compiled_array
from mdloom.functions.selector_rows import MatchedNodes, matched_nodes, parsed_steps
from mdloom.operators import advisor as AD
from mdloom.operators import html as H
from mdloom.operators import profiles as PR
from mdloom.operators.scope import scopes
from mdloom.plans import corpus as C
from mdloom.plans import crawl as CR


class ProfileError(ValueError):
    pass


def load_profile(spark: SparkSession, profile: dict | str | None) -> dict:
    """Merge a profile with the defaults and validate it; the first violation
    (required → type → value) is raised, as a stop-at-first validator would."""
    text = profile if isinstance(profile, str) or profile is None else json.dumps(profile)
    raw = spark.createDataFrame([("run", text)], "profile_id string, profile_json string")
    merged = PR.merge_profiles(PR.parse_profiles(raw))
    bad = PR.profile_violations(merged).orderBy("rule_rank").limit(1).collect()
    if bad:
        b = bad[0]
        raise ProfileError(f"{b.rule_id} {b.path}: {b.message}")
    row = merged.drop("v").first().asDict()
    return {k.replace("__", "."): v for k, v in row.items() if k != "profile_id"}


def run_profile(spark: SparkSession, pages: DataFrame, profile: dict | str | None,
                out_dir: str | None = None) -> dict[str, DataFrame]:
    """Crawl and convert ``pages(page_id, url, html)`` under one profile."""
    cfg = load_profile(spark, profile)
    parsed = H.parse_pages(pages.select("page_id", "url", "html")).select(
        "page_id", "url", U.normalize_url("url").alias("url_key"), U.url_host("url").alias("host"), "nodes")
    keys = parsed.select("page_id", "url", "url_key")
    links = C.links(parsed, cfg["crawler.navigation_selector"]).withColumn(
        "scope_prefix", F.lit(cfg["target_site.allowed_domain"]))
    start_key = U.normalize_url(F.lit(cfg["target_site.start_url"]))
    seeds = keys.where(F.col("url_key") == start_key).groupBy().agg(F.min("page_id").alias("node")) \
        .where(F.col("node").isNotNull())
    reached, misses = CR.site_crawl(links, keys, seeds, cfg["crawler.exclude_patterns"] or [])
    crawled = parsed.join(reached.select(F.col("node").alias("page_id"), "depth"), "page_id")
    docs = C.documents(crawled, cfg["extractor.content_selector"])
    out = {"reached": reached, "misses": misses, "documents": docs}
    if out_dir:
        from mdloom.sources.sinks import write_markdown
        write_markdown(docs, os.path.join(out_dir, "markdown"))
    n = lambda df, cond=None: (df.where(cond) if cond is not None else df).agg(
        F.count(F.lit(1))).scalar()
    runs = spark.range(1).select(
        F.lit("run").alias("run_id"),
        n(reached).alias("total_crawled"), n(misses).alias("total_failed"),
        F.lit(0).cast("long").alias("total_skipped"), F.lit(0).cast("long").alias("auto_skipped"),
        n(docs).alias("total_processed"), n(docs, F.col("status") == "success").alias("total_success"),
        n(docs, F.col("status") == "failed").alias("convert_failed"),
        F.lit(0).cast("long").alias("images_downloaded"), F.lit(0).cast("long").alias("images_failed"),
        n(misses).alias("network_errors"), n(docs, F.col("error_severity").isNotNull()).alias("content_errors"),
        F.lit(0).cast("long").alias("fs_errors"), F.lit(0).cast("long").alias("config_errors"),
        F.lit(0.0).alias("seconds"), F.lit(float(cfg["execution.request_delay"] or 0.0)).alias("request_delay"),
        F.lit(cfg["logging.console_level"]).alias("console_level"))
    out["runs"] = runs
    out["advice"] = AD.advisor_report(runs)
    return out


def run_profiles(spark: SparkSession, pages: DataFrame, profiles_raw: DataFrame) -> dict[str, DataFrame]:
    """Many sites at once: ``profiles_raw(profile_id, profile_json)``. Each profile crawls the
    snapshot pages in its ``allowed_domain`` on its own, with its selectors, scope and patterns, so
    a page in the scope of nested profiles belongs to each that reaches it. ``reached`` has
    (profile_id, node, depth, seq); ``documents`` is per profile and page. Profiles with
    violations, or with a selector that cannot be read, are left out and returned in ``rejected``.

    Scopes are found by prefix before any page is parsed; what a profile needs travels with its pages,
    so no node array is shuffled."""
    merged = PR.merge_profiles(PR.parse_profiles(profiles_raw))
    violations = PR.profile_violations(merged)
    ok = merged.join(violations.select("profile_id").distinct(), "profile_id", "left_anti")
    fld = lambda p: F.col(PR._field(p))
    paths = {"nav_steps": "crawler.navigation_selector", "content_steps": "extractor.content_selector"}
    prof = ok.select("profile_id", fld("target_site.start_url").alias("start_url"),
                     fld("target_site.allowed_domain").alias("scope_prefix"),
                     *[parsed_steps(fld(path)).alias(name) for name, path in paths.items()],
                     compiled_array(fld("crawler.exclude_patterns")).alias("exclude_patterns"))
    prof = prof.checkpoint()  # a row per profile; its parses are used several times
    unread = [prof.where(F.col(name).isNull()).select("profile_id", F.lit(rule).alias("rule_id"), F.lit(300 + i).alias("rule_rank"), F.lit(path).alias("path"),
                                                      F.lit("selector cannot be read").alias("message"))
              for i, (rule, (name, path)) in enumerate(zip(("H2N", "H2C"), paths.items(), strict=True))]
    rejected = violations.unionByName(unread[0]).unionByName(unread[1])
    prof = prof.where(F.col("nav_steps").isNotNull() & F.col("content_steps").isNotNull())
    scoped = scopes(pages.select("page_id", "url"), prof, prefix="scope_prefix")
    parsed = H.parse_pages(pages.select("page_id", "html").join(scoped, "page_id")).select(
        "*", U.normalize_url("url").alias("url_key"), U.url_host("url").alias("host"))
    nav = parsed.withColumn("nav_nodes", matched_nodes(F.col("nodes"), F.col("nav_steps")))
    links = C.links(nav, MatchedNodes(F.col("nav_nodes")), keep=["profile_id", "scope_prefix", "exclude_patterns"])
    keys = pages.select("page_id", "url", U.normalize_url("url").alias("url_key"))
    starts = prof.select("profile_id", U.normalize_url("start_url").alias("url_key"))
    seeds = keys.join(starts, "url_key").groupBy("profile_id").agg(F.min("page_id").alias("node"))
    reached, misses = CR.site_crawl(links, keys, seeds, "exclude_patterns", ["profile_id"], ordered=True)
    crawled = parsed.join(reached.select("profile_id", F.col("node").alias("page_id"), "depth"), ["profile_id", "page_id"], "left_semi")
    crawled = crawled.withColumn("content_nodes", matched_nodes(F.col("nodes"), F.col("content_steps"), only_first=True))
    docs = C.documents(crawled, MatchedNodes(F.col("content_nodes"))).drop("nav_steps", "content_steps", "exclude_patterns", "content_nodes")
    return {"reached": reached, "misses": misses, "documents": docs, "rejected": rejected}
