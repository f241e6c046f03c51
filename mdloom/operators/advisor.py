"""Rule-based run advice (A6, A7, R1-R14, W8) over a ``runs`` table.

``runs`` has one row per run (or per site): the counters of SURVEY §2.9. Every
rule is a boolean Column; the fired rules of a run are ``explode(filter(array
(struct...)))`` — no join, no UDF. All thresholds are strict as in the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# --- fixed values: rule catalogue (id, priority, category, issue, advice) ----
RULES = [
    ("R01", "HIGH", "RELIABILITY", "network errors above 30% with a short request delay",
     "raise request_delay to 2s or more and max_retries"),
    ("R02", "MEDIUM", "RELIABILITY", "network errors above 30% despite a long request delay",
     "check the site's availability and the network path"),
    ("R03", "MEDIUM", "RELIABILITY", "network errors between 10% and 30%",
     "raise max_retries or the retry back-off"),
    ("R04", "HIGH", "CONFIGURATION", "content extraction failed on more than 20% of pages",
     "review extractor.content_selector for this site"),
    ("R05", "MEDIUM", "CONFIGURATION", "content extraction failed on 5% to 20% of pages",
     "check the pages that fell back to <body>"),
    ("R06", "MEDIUM", "CONFIGURATION", "more than 30% of image downloads failed",
     "check image URLs or disable download_images"),
    ("R07", "LOW", "PERFORMANCE", "fewer than 5 pages per minute",
     "lower request_delay if the site allows it"),
    ("R08", "LOW", "PERFORMANCE", "more than 100 images downloaded",
     "consider disabling image download to save time"),
    ("R09", "MEDIUM", "CONFIGURATION", "more than half of the popped URLs were skipped",
     "narrow the navigation selector or exclude patterns"),
    ("R10", "LOW", "CONFIGURATION", "few skips on a large crawl",
     "add exclude patterns for pages you do not need"),
    ("R11", "LOW", "PERFORMANCE", "DEBUG console logging on a crawl of more than 20 pages",
     "set logging.console_level to INFO"),
    ("R12", "HIGH", "RELIABILITY", "overall error rate above 40%",
     "review the profile and the site before the next run"),
    ("R13", "MEDIUM", "RELIABILITY", "overall error rate between 20% and 40%",
     "look at the error summary by type"),
    ("R14", "HIGH", "RELIABILITY", "file system errors occurred",
     "check permissions and free space of output.base_dir"),
]
PRIORITY_RANK = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}
NO_ISSUE = ("R00", "NONE", "NONE", "no problems detected", "no changes needed")
# -----------------------------------------------------------------------------


def run_rates(runs: DataFrame) -> DataFrame:
    """The rates the rules test; NULL where the denominator is zero."""
    return runs.select("run_id", *_rates())


def _rates() -> list[Column]:
    """The rates, as columns of a run's own row."""
    c = F.col
    return [
        F.try_divide(c("network_errors"), c("total_crawled") + c("total_failed")).alias("network_rate"),
        F.try_divide(c("content_errors"), c("total_processed")).alias("content_rate"),
        F.try_divide(c("images_failed"), c("images_downloaded") + c("images_failed")).alias("image_fail_rate"),
        F.when((c("total_crawled") > 0) & (c("seconds") > 0),
               c("total_crawled") / c("seconds") * 60.0).alias("pages_per_minute"),
        F.when(c("total_crawled") > 0,
               F.try_divide(c("total_skipped"), c("total_crawled") + c("total_skipped"))).alias("skip_rate"),
        F.try_divide(c("network_errors") + c("content_errors") + c("fs_errors") + c("config_errors"),
                     c("total_crawled") + c("total_failed") + c("total_processed")).alias("error_rate"),
    ]


def _conditions(r: DataFrame) -> dict[str, Column]:
    c = F.col
    nr, cr, ir = c("network_rate"), c("content_rate"), c("image_fail_rate")
    ppm, sr, er = c("pages_per_minute"), c("skip_rate"), c("error_rate")
    perf_ok = ppm.isNotNull()
    return {
        "R01": (nr > 0.3) & (c("request_delay") < 2.0),
        "R02": (nr > 0.3) & (c("request_delay") >= 2.0),
        "R03": (nr > 0.1) & (nr <= 0.3),
        "R04": cr > 0.2,
        "R05": (cr > 0.05) & (cr <= 0.2),
        "R06": cr.isNotNull() & (c("images_failed") > 0) & (ir > 0.3),
        "R07": perf_ok & (ppm < 5),
        "R08": perf_ok & (c("images_downloaded") > 100),
        "R09": sr > 0.5,
        "R10": (sr < 0.1) & (c("total_crawled") > 50),
        "R11": (F.coalesce(c("console_level"), F.lit("INFO")) == "DEBUG") & (c("total_crawled") > 20),
        "R12": er > 0.4,
        "R13": (er > 0.2) & (er <= 0.4),
        "R14": er.isNotNull() & (c("fs_errors") > 0),
    }


def _fired(runs: DataFrame) -> DataFrame:
    """run_id and the array of the rules that fire for the run, in rule order."""
    r = runs.select("*", *_rates())
    conds = _conditions(r)
    items = F.array(*[F.struct(F.coalesce(conds[rid], F.lit(False)).alias("fired"), *_texts((rid, p, cat, iss, sug)))
                      for rid, p, cat, iss, sug in RULES])
    return r.select("run_id", F.filter(items, lambda s: s["fired"]).alias("s"))


def _texts(rule: tuple) -> list[Column]:
    names = ["rule_id", "priority", "category", "issue", "suggestion"]
    return [F.lit(v).alias(k) for k, v in zip(names, rule)]


def advisor(runs: DataFrame) -> DataFrame:
    """One row per fired rule: (run_id, rule_id, priority, category, issue, suggestion)."""
    fired = _fired(runs).select("run_id", F.explode("s").alias("s"))
    return fired.select("run_id", "s.rule_id", "s.priority", "s.category", "s.issue", "s.suggestion")


def advisor_counts(suggestions: DataFrame) -> DataFrame:
    """Suggestions per priority."""
    return suggestions.groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


def advisor_report(runs: DataFrame) -> DataFrame:
    """Per run (a row of ``runs``), suggestions ordered by priority (stable on rule
    order); a run without any gets one 'no problems' row. The few rules of a run are
    sorted in its own row, so the runs are read once and nothing is shuffled."""
    none = F.array(F.struct(F.lit(True).alias("fired"), *_texts(NO_ISSUE)))

    def line(s: Column) -> Column:
        rank = F.lit(len(PRIORITY_RANK))
        for p, k in PRIORITY_RANK.items():
            rank = F.when(s["priority"] == p, F.lit(k)).otherwise(rank)
        return F.struct(rank.alias("priority_rank"), *[s[k].alias(k) for k in ("rule_id", "priority", "category", "issue", "suggestion")])
    lines = F.array_sort(F.transform(F.when(F.size("s") == 0, none).otherwise(F.col("s")), line))
    out = _fired(runs).select("run_id", F.posexplode(lines).alias("at", "l"))
    return out.select("run_id", "l.rule_id", "l.priority", "l.category", "l.issue", "l.suggestion", "l.priority_rank",
                      (F.col("at") + 1).cast("long").alias("line_no"))
