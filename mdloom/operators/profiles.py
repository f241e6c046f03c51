"""Site profiles as a table.

A profile arrives as one JSON document per row. It is parsed to VARIANT, so an
explicit ``null`` (replaces the default) is told apart from an absent key
(keeps it, Q23). Lists and scalars replace, sections merge per leaf. Validation
returns *all* violations as rows with a rank; the lowest rank is the one a
stop-at-first validator reports.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdloom.operators.scope import longest_scope

# --- fixed values: defaults of a profile (path, Spark type, default) ---------
DEFAULTS = [
    ("target_site.start_url", "string", ""),
    ("target_site.allowed_domain", "string", ""),
    ("crawler.navigation_selector", "string", "nav"),
    ("crawler.exclude_patterns", "array<string>", [r".*#.*", r".*/search\.html", r".*/genindex\.html"]),
    ("extractor.content_selector", "string", "main"),
    ("output.base_dir", "string", "./output"),
    ("output.image_dir_name", "string", "images"),
    ("output.download_images", "boolean", True),
    ("execution.request_delay", "double", 1.0),
    ("retry.max_retries", "bigint", 3),
    ("retry.backoff_factor", "double", 2.0),
    ("retry.initial_delay", "double", 1.0),
    ("retry.max_delay", "double", 60.0),
    ("retry.retry_status_codes", "array<bigint>", [429, 500, 502, 503, 504]),
    ("retry.skip_after_failures", "bigint", 5),
    ("recovery.enable_recovery", "boolean", True),
    ("recovery.save_interval", "bigint", 10),
    ("recovery.recovery_file", "string", "./recovery_state.json"),
    ("recovery.auto_resume", "boolean", True),
    ("logging.console_level", "string", "INFO"),
    ("logging.file_level", "string", "DEBUG"),
    ("logging.log_dir", "string", "./logs"),
    ("logging.max_file_size_mb", "double", 5.0),
    ("logging.backup_count", "bigint", 5),
    ("logging.enable_file_logging", "boolean", True),
    ("logging.log_format", "string", "%(asctime)s - %(name)s - %(levelname)s - %(message)s"),
    ("logging.date_format", "string", "%Y-%m-%d %H:%M:%S"),
]
REQUIRED = ["target_site.start_url", "target_site.allowed_domain", "crawler.navigation_selector",
            "extractor.content_selector", "output.base_dir"]
LOG_LEVELS = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"]
# value ranges: path -> (low, high, low_inclusive, high_inclusive)
RANGES = [
    ("V03", "execution.request_delay", 0, 60, True, True),
    ("V04", "retry.max_retries", 0, 10, True, True),
    ("V05", "retry.backoff_factor", 1, 10, True, True),
    ("V06", "retry.initial_delay", 0, 30, True, True),
    ("V07", "retry.max_delay", 1, 300, True, True),
    ("V08", "retry.skip_after_failures", 1, 20, True, True),
    ("V09", "recovery.save_interval", 1, 100, True, True),
    ("V14", "logging.max_file_size_mb", 0, 100, False, True),
    ("V15", "logging.backup_count", 0, 20, True, True),
]
# JSON kinds accepted per declared type (bool is not an int here, Q19)
KINDS = {"string": ["STRING"], "boolean": ["BOOLEAN"],
         "bigint": ["BIGINT", "INT", "SMALLINT", "TINYINT"],
         "double": ["BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "DECIMAL"],
         "array<string>": ["ARRAY"], "array<bigint>": ["ARRAY"]}
# -----------------------------------------------------------------------------

CHECKSUM_SECTIONS = ["crawler", "extractor", "output", "target_site"]


def _field(path: str) -> str:
    return path.replace(".", "__")


def parse_profiles(raw: DataFrame, json_col: str = "profile_json") -> DataFrame:
    """S3: JSON text → VARIANT; NULL, blank and malformed documents are ``{}``, so one bad
    row fails on the required keys it lacks and not the whole table."""
    txt = F.when(F.coalesce(F.trim(F.col(json_col)), F.lit("")) == "", F.lit("{}")).otherwise(F.col(json_col))
    return raw.withColumn("v", F.coalesce(F.try_parse_json(txt), F.parse_json(F.lit("{}"))))


def _kind(v: Column, path: str) -> Column:
    """JSON kind at ``path``: NULL when absent, 'NULL' for JSON null."""
    x = F.variant_get(v, f"$.{path}", "variant")
    return F.when(x.isNull(), F.lit(None)).when(F.is_variant_null(x), F.lit("NULL")) \
        .otherwise(F.regexp_extract(F.schema_of_variant(x), r"^([A-Z]+)", 1))


def merge_profiles(parsed: DataFrame) -> DataFrame:
    """One typed column per leaf (``section__key``): the user's value when
    the key is present (even as null), NULL when its section was replaced by a
    non-object, else the default. Wrong JSON kinds read as NULL here and are
    reported by ``profile_violations``."""
    v = F.col("v")
    cols = []
    for path, typ, default in DEFAULTS:
        sec = path.split(".")[0]
        leaf_kind = _kind(v, path)
        sec_kind = _kind(v, sec)
        user = F.try_variant_get(v, f"$.{path}", typ)
        dflt = F.lit(default).cast(typ) if not isinstance(default, list) else F.array(*[F.lit(x) for x in default]).cast(typ)
        val = (F.when(leaf_kind.isNotNull(), user)
               .when(sec_kind.isNotNull() & (sec_kind != "OBJECT"), F.lit(None).cast(typ))
               .otherwise(dflt))
        cols.append(val.alias(_field(path)))
    return parsed.select("profile_id", "v", *cols)


def _valid_regex_udf():
    from pyspark.sql.functions import pandas_udf
    from mdloom.functions.patterns import compiled

    @pandas_udf("boolean")
    def all_compile(pats: pd.Series) -> pd.Series:
        def ok(lst):
            if lst is None:
                return True
            return all(p is not None for p in lst) and len(compiled(lst)) == len(lst)
        return pats.apply(ok)
    return all_compile


def profile_violations(merged: DataFrame) -> DataFrame:
    """K/T/V rules → (profile_id, rule_id, rule_rank, path, message), all violations."""
    c = lambda p: F.col(_field(p))
    v = F.col("v")
    checks = []
    for i, path in enumerate(REQUIRED):
        val = c(path)
        missing = val.isNull() | (F.trim(val) == "")
        checks.append((f"K{i + 1}", i + 1, path, missing, "required value missing or blank"))
    for i, (path, typ, _d) in enumerate(DEFAULTS):
        k = _kind(v, path)
        bad = k.isNotNull() & (k != "NULL") & ~k.isin(*KINDS[typ])
        checks.append((f"T{i + 1:02d}", 100 + i, path, bad, f"expected {typ}"))
    for j, path in enumerate(["target_site.start_url", "target_site.allowed_domain"]):
        val = c(path)
        bad = (F.coalesce(val, F.lit("")) != "") & ~(val.startswith("http://") | val.startswith("https://"))
        checks.append((f"V0{j + 1}", 200 + j, path, bad, "must start with http:// or https://"))
    for rid, path, lo, hi, lo_inc, hi_inc in RANGES:
        val = c(path)
        low_bad = (val < lo) if lo_inc else (val <= lo)
        high_bad = (val > hi) if hi_inc else (val >= hi)
        bad = val.isNotNull() & (low_bad | high_bad)
        checks.append((rid, 200 + int(rid[1:]), path, bad, f"out of range [{lo}, {hi}]"))
    rf = c("recovery.recovery_file")
    checks.append(("V10", 210, "recovery.recovery_file", rf.isNotNull() & (F.trim(rf) == ""), "blank"))
    pats = c("crawler.exclude_patterns")
    checks.append(("V11", 211, "crawler.exclude_patterns", ~_valid_regex_udf()(pats), "pattern does not compile"))
    for rid, rank, path in (("V12", 212, "logging.console_level"), ("V13", 213, "logging.file_level")):
        val = c(path)
        bad = (F.coalesce(val, F.lit("")) != "") & ~F.upper(val).isin(*LOG_LEVELS)
        checks.append((rid, rank, path, bad, "unknown log level"))
    items = F.array(*[F.struct(F.coalesce(b, F.lit(False)).alias("bad"), F.lit(r).alias("rule_id"),
                               F.lit(k).alias("rule_rank"), F.lit(p).alias("path"), F.lit(m).alias("message"))
                      for r, k, p, b, m in checks])
    return merged.select("profile_id", F.explode(F.filter(items, lambda s: s["bad"])).alias("s")) \
        .select("profile_id", "s.rule_id", "s.rule_rank", "s.path", "s.message")


def profile_checksum(merged: DataFrame) -> DataFrame:
    """md5 of the key-sorted JSON of the four content-defining sections."""
    c = lambda p: F.col(_field(p))
    doc = F.struct(
        F.struct(c("crawler.exclude_patterns").alias("exclude_patterns"),
                 c("crawler.navigation_selector").alias("navigation_selector")).alias("crawler"),
        F.struct(c("extractor.content_selector").alias("content_selector")).alias("extractor"),
        F.struct(c("output.base_dir").alias("base_dir"), c("output.download_images").alias("download_images"),
                 c("output.image_dir_name").alias("image_dir_name")).alias("output"),
        F.struct(c("target_site.allowed_domain").alias("allowed_domain"),
                 c("target_site.start_url").alias("start_url")).alias("target_site"))
    return merged.select("profile_id", F.md5(F.to_json(doc)).alias("config_checksum"))


def resume_gate(merged: DataFrame, state: DataFrame) -> DataFrame:
    """resume only when recovery is enabled, a snapshot exists and its
    checksum equals the profile's current checksum (latest snapshot per profile)."""
    latest = state.groupBy("profile_id").agg(
        F.max_by(F.struct("config_checksum", "processed_count", "timestamp"), "timestamp").alias("s"))
    cs = profile_checksum(merged).join(
        merged.select("profile_id", F.col(_field("recovery.enable_recovery")).alias("enabled")), "profile_id")
    j = cs.join(latest, "profile_id", "left")
    has = F.col("s").isNotNull()
    match = F.coalesce(F.col("s.config_checksum") == F.col("config_checksum"), F.lit(False))
    return j.select("profile_id", F.coalesce("enabled", F.lit(False)).alias("recovery_enabled"),
                    has.alias("has_snapshot"), match.alias("checksum_match"),
                    (F.coalesce("enabled", F.lit(False)) & has & match).alias("can_resume"),
                    F.col("s.processed_count").alias("resume_processed"))


def page_profile(pages: DataFrame, merged: DataFrame) -> DataFrame:
    """Each page's profile = the longest ``allowed_domain`` that prefixes its URL; a
    profile with a blank one takes the pages of no other."""
    prof = merged.select("profile_id", F.col(_field("target_site.allowed_domain")).alias("allowed_domain"))
    found = longest_scope(pages.select("page_id", "url"), prof, "page_id", "profile_id", prefix="allowed_domain")
    return pages.select("page_id", "url").join(found, "page_id").select("page_id", "url", "profile_id", "allowed_domain")
