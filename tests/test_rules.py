"""Profiles, advisor, errors, images, logs, state and streaming on fixtures."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from mdloom.operators import advisor as AD
from mdloom.operators import errors as OE
from mdloom.operators import images as IM
from mdloom.operators import profiles as PR
from mdloom.sources import logs as LG
from mdloom.sources import state as STT

# ---------------------------------------------------------------- profiles
SAMPLES = {
    "python_docs": {"target_site": {"start_url": "https://docs.python.org/3/library/index.html",
                                    "allowed_domain": "https://docs.python.org/3/library/"},
                    "crawler": {"navigation_selector": ".toctree-wrapper", "exclude_patterns": [r".*#.*"]},
                    "extractor": {"content_selector": "div[role='main']"},
                    "execution": {"request_delay": 1.5},
                    "retry": {"max_retries": 3, "skip_after_failures": 5}, "recovery": {"save_interval": 5}},
    "minimal": {"target_site": {"start_url": "https://example.com/docs/", "allowed_domain": "https://example.com/docs/"},
                "crawler": {"navigation_selector": "nav"}, "extractor": {"content_selector": "main"},
                "output": {"base_dir": "./output/minimal"}},
    "empty": {},
    "null_nav": {"target_site": {"start_url": "https://e.com/", "allowed_domain": "https://e.com/"},
                 "crawler": {"navigation_selector": None}},
    "bad": {"target_site": {"start_url": "ftp://x", "allowed_domain": " "},
            "crawler": {"exclude_patterns": ["("]}, "execution": {"request_delay": 60.5},
            "retry": {"max_retries": 11, "backoff_factor": 0.5},
            "logging": {"console_level": "TRACE", "file_level": "info", "backup_count": True}},
}


def _merged(spark):
    raw = spark.createDataFrame([(k, json.dumps(v)) for k, v in SAMPLES.items()] + [("nullfile", None)],
                                "profile_id string, profile_json string")
    return PR.merge_profiles(PR.parse_profiles(raw))


def test_profile_merge(spark):
    m = {r.profile_id: r for r in _merged(spark).collect()}
    # lists replace, scalars default when absent
    assert m["python_docs"]["crawler__exclude_patterns"] == [r".*#.*"]
    assert m["minimal"]["crawler__exclude_patterns"] == [r".*#.*", r".*/search\.html", r".*/genindex\.html"]
    assert m["minimal"]["execution__request_delay"] == 1.0
    assert m["python_docs"]["execution__request_delay"] == 1.5
    # explicit null replaces the default (Q23)
    assert m["null_nav"]["crawler__navigation_selector"] is None
    assert m["empty"]["crawler__navigation_selector"] == "nav"
    assert m["nullfile"]["output__base_dir"] == "./output"


def test_profile_violations(spark):
    v = PR.profile_violations(_merged(spark)).collect()
    by = {}
    for r in v:
        by.setdefault(r.profile_id, set()).add(r.rule_id)
    assert "python_docs" not in by and "minimal" not in by
    assert by["empty"] == {"K1", "K2"}
    assert by["null_nav"] == {"K3"}
    assert {"K2", "V01", "V03", "V04", "V05", "V11", "V12"} <= by["bad"]
    assert "V13" not in by["bad"]                       # 'info' is accepted
    assert any(r.rule_id.startswith("T") and r.path == "logging.backup_count" for r in v)   # bool is not int
    first = min((r for r in v if r.profile_id == "bad"), key=lambda r: r.rule_rank)
    assert first.rule_id == "K2"


def test_checksum_and_resume_gate(spark):
    m = _merged(spark)
    cs = {r.profile_id: r.config_checksum for r in PR.profile_checksum(m).collect()}
    assert cs["empty"] == cs["nullfile"]          # both merge to the defaults
    assert len({cs[k] for k in ("python_docs", "minimal", "empty", "null_nav", "bad")}) == 5
    state = spark.createDataFrame(
        [("python_docs", cs["python_docs"], 40, 1), ("minimal", "changed", 10, 1)],
        "profile_id string, config_checksum string, processed_count int, timestamp long")
    g = {r.profile_id: (r.has_snapshot, r.checksum_match, r.can_resume) for r in PR.resume_gate(m, state).collect()}
    assert g["python_docs"] == (True, True, True)
    assert g["minimal"] == (True, False, False)
    assert g["empty"] == (False, False, False)


def test_page_profile_longest_prefix(spark):
    m = _merged(spark)
    pages = spark.createDataFrame([(1, "https://docs.python.org/3/library/os.html"), (2, "https://example.com/docs/x"),
                                   (3, "https://other.org/")], "page_id long, url string")
    got = {r.page_id: r.profile_id for r in PR.page_profile(pages, m).collect()}
    assert got == {1: "python_docs", 2: "minimal", 3: "nullfile"}   # a blank domain takes what is left


def test_scopes_by_prefix_length(spark):
    from mdloom.operators.scope import longest_scope, scopes
    prefixes = [("a", "https://"), ("b", "https://h/docs/"), ("b2", "https://h/docs/"), ("c", "/local"), ("d", None), ("e", ""), ("f", "https://é/"), ("g", "http")]
    urls = ["https://h/docs/x", "https://h/", "/local/y", "ftp://z", "https://é/ü", "", "http://h/docs/x", None, "https://h/docs/"]
    u = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    p = spark.createDataFrame(prefixes, "profile_id string, prefix string")
    want = {(i, name) for i, url in enumerate(urls) for name, x in prefixes if x and url is not None and url.startswith(x)}
    assert {(r.page_id, r.profile_id) for r in scopes(u, p).collect()} == want
    best = {i: max(((len(x), n) for n, x in prefixes if x and (i, n) in want), default=(0, "e")) for i in range(len(urls))}
    got = {r.page_id: r.profile_id for r in longest_scope(u, p, "page_id", "profile_id").collect()}
    assert got == {i: n for i, (_, n) in best.items()}
    nobody = longest_scope(u, p.where("prefix like 'ftps%'"), "page_id", "profile_id").collect()
    assert len(nobody) == len(urls) and all(r.profile_id is None and r.prefix is None for r in nobody)


# ---------------------------------------------------------------- advisor / errors
RUN_COLS = ("run_id string, total_crawled long, total_failed long, total_skipped long, auto_skipped long, "
            "total_processed long, total_success long, convert_failed long, images_downloaded long, "
            "images_failed long, network_errors long, content_errors long, fs_errors long, config_errors long, "
            "seconds double, request_delay double, console_level string")


def _run(rid, **kw):
    base = dict(total_crawled=0, total_failed=0, total_skipped=0, auto_skipped=0, total_processed=0, total_success=0,
                convert_failed=0, images_downloaded=0, images_failed=0, network_errors=0, content_errors=0,
                fs_errors=0, config_errors=0, seconds=0.0, request_delay=1.0, console_level="INFO")
    base.update(kw)
    return (rid,) + tuple(base[k] for k in ["total_crawled", "total_failed", "total_skipped", "auto_skipped",
                                            "total_processed", "total_success", "convert_failed", "images_downloaded",
                                            "images_failed", "network_errors", "content_errors", "fs_errors",
                                            "config_errors", "seconds", "request_delay", "console_level"])


def test_advisor_thresholds(spark):
    runs = spark.createDataFrame([
        _run("net30", total_crawled=7, total_failed=3, network_errors=3),           # exactly 0.3 → R03, R13
        _run("net31", total_crawled=69, total_failed=31, network_errors=31),        # > 0.3, delay 1 → R01 (+R13)
        _run("net10", total_crawled=9, total_failed=1, network_errors=1),           # exactly 0.1 → nothing
        _run("zero"),                                                              # zero denominators
        _run("slow", total_crawled=51, seconds=1000.0),                            # 3 ppm → R07, skip 0 → R10
        _run("dbg", total_crawled=21, console_level="DEBUG", total_skipped=21),     # R11 + skip 0.5 (not > 0.5)
        _run("fs", total_crawled=1, fs_errors=1),                                  # R14 (+ error rate 0.5 → R12)
        _run("img", total_processed=10, images_downloaded=101, images_failed=50, total_crawled=10, seconds=60.0),
    ], RUN_COLS)
    got = {}
    for r in AD.advisor(runs).collect():
        got.setdefault(r.run_id, []).append(r.rule_id)
    assert got["net30"] == ["R03", "R13"]
    assert got["net31"] == ["R01", "R10", "R13"]   # 69 crawled, no skips → R10 too
    assert "net10" not in got and "zero" not in got
    assert got["slow"] == ["R07", "R10"]
    assert got["dbg"] == ["R11"]
    assert got["fs"] == ["R12", "R14"]
    assert got["img"] == ["R06", "R08"]
    rep = {(r.run_id, r.line_no): r.rule_id for r in AD.advisor_report(runs).collect()}
    assert rep[("fs", 1)] == "R12" and rep[("fs", 2)] == "R14" and rep[("zero", 1)] == "R00"


def test_error_summary_zero_filled(spark):
    e = spark.createDataFrame([("crawler", "network_error", "MEDIUM", "u", None, "m")] * 3,
                              "source string, error_type string, severity string, url string, file_path string, message string")
    got = {r.error_type: r.n for r in OE.error_summary(spark, e).collect()}
    assert got == {"network_error": 3, "content_extraction_error": 0, "file_system_error": 0, "config_error": 0}
    pol = OE.error_policy(e).first()
    assert (pol.log_level, pol.continue_run, pol.retry) == ("warning", True, True)


# ---------------------------------------------------------------- images
def test_image_manifest(spark):
    imgs = spark.createDataFrame([(1, "http://h/i/a b.png", "x"), (1, "data:image/png;base64,x", "d"),
                                  (2, "http://h/.hidden.png", "h"), (2, "http://h/big.png", "b"),
                                  (2, "http://h/huge.png", "g"), (3, "http://h/p.html", "p"),
                                  (3, "http://h/c.png", "c"), (3, "http://h/missing.png", "m")],
                                 "page_id long, abs_url string, src string")
    assets = spark.createDataFrame([("http://h/i/a b.png", 200, "image/png", 10), ("http://h/.hidden.png", 200, "image/png", 1),
                                    ("http://h/big.png", 200, "image/png", 10485760), ("http://h/huge.png", 200, "image/png", 10485761),
                                    ("http://h/p.html", 200, "text/html", 5), ("http://h/c.png", 200, "image/png; charset=x", 5)],
                                   "url string, status int, content_type string, bytes long")
    m = {r.src: (r.outcome, r.local_path) for r in IM.image_manifest(imgs, assets).collect()}
    assert m["x"] == ("downloaded", "./images/a_b.png")
    assert m["d"][0] == "invalid_url"
    assert m["h"][0] == "downloaded" and m["h"][1].startswith("./images/image_") and m["h"][1].endswith(".png")
    assert m["b"] == ("downloaded", "./images/big.png")
    assert m["g"][0] == "too_large" and m["p"][0] == "not_image"
    assert m["c"] == ("downloaded", "./images/c.jpg")       # exact content-type match (Q17)
    assert m["m"][0] == "not_fetched"
    rw = {r.src: r.new_src for r in IM.image_rewrite(IM.image_manifest(imgs, assets)).collect()}
    assert rw["g"] == "http://h/huge.png" and rw["x"] == "./images/a_b.png"


# ---------------------------------------------------------------- logs
def test_log_parsing(spark):
    lines = ["2024-01-01 10:00:00 - web_crawler - INFO - fetch - ok | url=http://h/a | attempt=2",
             "2024-01-01 10:00:01 - markdown_converter - ERROR - convert failed | url=http://h/b",
             "Traceback (most recent call last):",
             "2024-01-01 10:00:02 - web_crawler - CRITICAL - stop",
             "2024-01-01 10:00:03 - web_crawler - DEBUG - d"]
    p = LG.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    rows = p.collect()
    assert rows[0].message == "fetch - ok" and rows[0].ctx == {"url": "http://h/a", "attempt": "2"}
    assert rows[2].continuation and rows[2].level is None
    assert [r.value for r in LG.log_errors(p, "http://h/b").collect()] == [lines[1]]
    st = {(r.logger, r.level): r.n for r in LG.log_stats(p).collect()}
    assert st[("web_crawler", "INFO")] == 1 and len(st) == 4
    assert [r.level for r in LG.log_tail(p, 2).collect()] == ["DEBUG", "CRITICAL"]
    ranks = spark.createDataFrame([("warning",), ("nope",)], "l string").select(LG.level_rank("l")).collect()
    assert [r[0] for r in ranks] == [30, 20]


# ---------------------------------------------------------------- state
def test_state_roundtrip(spark):
    base = tempfile.mkdtemp(prefix="mdloom-state-", dir="/tmp")
    hdr = lambda n: spark.createDataFrame([("p", "http://s/", n, n, 0, "2024-01-01T00:00:00", "c")],
                                          "profile_id string, start_url string, processed_count int, success_count int, "
                                          "failed_count int, timestamp string, config_checksum string")
    urls = lambda xs: spark.createDataFrame([(x,) for x in xs], "url string")
    fails = spark.createDataFrame([("http://s/x", 2)], "url string, failures int")
    crawled = spark.createDataFrame([(1, "http://s/")], "seq int, url string")
    STT.write_snapshot(base, "r1", 1, hdr(10), urls(["a"]), fails, crawled)
    STT.write_snapshot(base, "r1", 2, hdr(20), urls(["a", "b"]), fails, crawled)
    out = STT.read_latest(spark, base)
    h = out["header"].collect()
    assert len(h) == 1 and h[0].processed_count == 20
    assert sorted(r.url for r in out["visited"].collect()) == ["a", "b"]
    assert os.path.isdir(os.path.join(base, "header"))


def test_read_logs_from_files(spark):
    d = tempfile.mkdtemp(prefix="mdloom-logs-", dir="/tmp")
    with open(os.path.join(d, "crawler.log"), "w") as f:
        f.write("2024-01-01 10:00:00 - web_crawler - ERROR - fetch failed | url=http://h/a\n"
                "Traceback (most recent call last):\n"
                "2024-01-01 10:00:05 - web_crawler - INFO - ok\n")
    with open(os.path.join(d, "converter.log"), "w") as f:
        f.write("2024-01-01 10:00:01 - markdown_converter - CRITICAL - stop | file=/x.md\n")
    p = LG.parse_lines(LG.read_logs(spark, d))
    errs = LG.log_errors(p).select("logger", "level", "ctx").collect()
    assert sorted((r.logger, r.level) for r in errs) == [("markdown_converter", "CRITICAL"), ("web_crawler", "ERROR")]
    assert p.where("continuation").count() == 1
    assert {r.file.rsplit("/", 1)[-1] for r in p.select("file").distinct().collect()} == {"crawler.log", "converter.log"}


def test_patterns_in_java_terms(spark):
    from mdloom.functions import patterns as P
    pats = P.compiled([r"(?i)/SEARCH", r"(?P<a_b>x)y(?P=a_b)", r"/v\d+\Z", "(", r"a\\Zb"])
    assert len(pats) == 4
    df = spark.createDataFrame([("/search?q",), ("xyx",), ("/v12",), ("/v12/",), (r"a\Zb",)], "u string")
    got = [r[0] for r in df.select(P.first_match(F.col("u"), pats)).collect()]
    assert [g is not None for g in got] == [True, True, True, False, True]


def test_repeated_log_key_and_bad_profile(spark):
    from mdloom.operators.profiles import parse_profiles
    from mdloom.sources.logs import context_map
    df = spark.createDataFrame([("m | url=a | n=1 | url=b=c",)], "t string")
    assert df.select(context_map("t")).first()[0] == {"url": "b=c", "n": "1"}
    bad = spark.createDataFrame([("p", "{bad")], "profile_id string, profile_json string")
    assert parse_profiles(bad).select(F.to_json("v")).first()[0] == "{}"


def test_stream_reads_a_table_folder(spark, tmp_path):
    from mdloom.streaming.pages_stream import _source
    spark.range(30).withColumnRenamed("id", "page_id").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    _source(spark, str(tmp_path), "pages").writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).count() == 30


def test_varied_runs_meet_every_rule(spark):
    from mdloom.operators import advisor as AD
    from mdloom.plans import runs as R
    runs = R.varied_runs(spark, "/root/testdata/sf0.01")
    report = AD.advisor_report(runs)
    per_rule = {r.rule_id: r["count"] for r in report.groupBy("rule_id").count().collect()}
    assert set(per_rule) == {"R00"} | {r[0] for r in AD.RULES} and max(per_rule.values()) < runs.count()
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan parquet") == 1
