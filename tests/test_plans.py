"""Plan-shape guards over every query of the core catalog (sf0.001): no cartesian or
nested-loop joins, no row-at-a-time Python UDFs, and `html` is read only by
queries that parse pages or measure them."""

import re

from mdloom.plans import catalog

from conftest import SF_SMALL

HTML_READERS = {"page_scan", "page_nodes", "selector_match", "link_extract", "link_resolve", "link_text",
                "link_priority", "content_extract", "content_clean", "markdown_docs", "convert_status",
                "convert_stats", "frontier_new", "frontier_seen", "link_graph", "frontier_lookup", "frontier_order",
                "error_union", "error_summary", "error_policy", "site_runs", "run_rates", "advisor",
                "advisor_counts", "advisor_report", "crawl_progress", "page_priority", "site_crawl",
                "site_crawl_misses", "image_extract", "site_order", "derived_link_graph", "derived_links_seen", "convert_gaps",
                "image_manifest", "image_markdown"}
SKIP = {"stream_pages", "stream_failures", "stream_restart", "stream_auto_skip", "stream_throughput", "site_order",
        "state_snapshot", "state_restore", "resume_gate"}   # executed eagerly into a table, read back as a scan


def test_registered_plans(spark):
    bad = []
    for name, q in catalog.QUERIES.items():
        if name in SKIP:
            continue
        plan = q(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        for op in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
            if op in plan:
                bad.append((name, op))
        reads_html = any("html" in m for m in re.findall(r"ReadSchema: struct<([^>]*)>", plan))
        if reads_html and name not in HTML_READERS:
            bad.append((name, "reads html"))
    assert bad == []
