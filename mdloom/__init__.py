"""mdloom: documentation-site snapshots to Markdown corpora, as Spark jobs.

Pages, links, fetch attempts, errors, site profiles and runs are DataFrames.
Scalar rules live in ``mdloom.functions`` (plain Column expressions usable from
the DataFrame API and, through ``expr_sql`` strings, from SQL); table-level
operators live in ``mdloom.operators``; multi-step plans (crawl closure, run
roll-ups) in ``mdloom.plans``; incremental forms in ``mdloom.streaming``.
"""

__all__ = ["session"]
