"""DuckDB oracle SQL for the registered queries (same column names).

The oracles are written independently in plain SQL over the driver's parquet
views. HTML oracles use regular expressions that hold for the test page layout
(one nav/article/footer per page, see SURVEY §5); the general behaviour is
covered by tests against fixtures.
"""

from __future__ import annotations

from mdloom.plans import image_oracles, increment_oracles, log_oracles, recovery_oracles

URL_RX = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"


def _parts(u: str) -> str:
    return (f"lower(regexp_extract({u}, '{URL_RX}', 1)) AS scheme, "
            f"regexp_extract({u}, '{URL_RX}', 2) AS netloc, "
            f"regexp_replace(regexp_extract({u}, '{URL_RX}', 3), ';[^/]*$', '') AS path")


KEY = ("scheme || ':' || '//' || lower(netloc) || "
       "CASE WHEN path = '/' THEN '/' ELSE regexp_replace(path, '/+$', '') END")
HOST = r"lower(regexp_extract(netloc, '^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)', 1))"
MDPATH = r"""CASE WHEN p3 IN ('', '/') THEN 'index.md'
  ELSE regexp_replace(regexp_replace(p3, '^/+', ''), '[<>:"|?*]', '_', 'g') || '.md' END"""


def _mdpath_cte(src: str) -> str:
    return f"""
  mp1 AS (SELECT *, regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '/+$', '') AS p2 FROM {src}),
  mp2 AS (SELECT *, CASE WHEN regexp_matches(p2, '/index\\.html?$') THEN regexp_replace(p2, '/index\\.html?$', '')
                         WHEN regexp_matches(p2, '[^/.][^/]*\\.html?$') THEN regexp_replace(p2, '\\.html?$', '')
                         ELSE p2 END AS p3 FROM mp1)"""


PAGES_P = f"pp AS (SELECT page_id, url, html, {_parts('url')} FROM pages)"

EXCLUDE = [r".*#.*", r".*/search\.html", r".*/genindex\.html"]
EXCLUDE_CASE = ("CASE " + " ".join(f"WHEN regexp_matches(url, '{p}') THEN '{p}'" for p in EXCLUDE)
                + " END")

# legacy named references decode with or without the ';' (as HTML parsers do)
ENT = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, "
       "'&quot;?', '\"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), "
       "'&amp;?', '&', 'g')")


def _decode(x: str) -> str:
    return ENT.format(x=x)


def _strip_tags(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]*>', '', 'g')"


LINKS_CTE = f"""
  {PAGES_P},
  nav AS (SELECT page_id, url, scheme, netloc,
                 regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pp),
  raw AS (SELECT page_id, url, scheme, netloc,
                 regexp_extract_all(nav, '<a href="([^"]*)">', 1) AS hrefs,
                 regexp_extract_all(nav, '<a href="[^"]*">([^<]*)</a>', 1) AS texts FROM nav),
  lk AS (SELECT page_id, url, scheme, netloc, unnest(hrefs) AS href, unnest(texts) AS link_text,
                unnest(generate_series(0, len(hrefs) - 1)) AS pos FROM raw),
  lk2 AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, href, trim(link_text) AS link_text,
                 scheme || '://' || netloc || href AS dst_url FROM lk),
  lk3 AS (SELECT *, {_parts('dst_url')} FROM lk2),
  links AS (SELECT page_id, pos, href, link_text, dst_url, {KEY} AS dst_key,
                 CAST(greatest(0, 10 + (length(dst_url) - length(replace(dst_url, '/', ''))) - 3
                   + CASE WHEN lower(link_text) SIMILAR TO '.*(index|overview|introduction|getting-started).*' THEN -5
                          WHEN lower(link_text) SIMILAR TO '.*(appendix|reference|changelog|history).*' THEN 5
                          ELSE 0 END) AS INTEGER) AS priority,
                 CASE WHEN lower(link_text) SIMILAR TO '.*(index|overview|introduction|getting-started).*' THEN 'high'
                      WHEN lower(link_text) SIMILAR TO '.*(appendix|reference|changelog|history).*' THEN 'low'
                      ELSE 'none' END AS keyword
            FROM lk3)"""

BODY_CLEAN = ("regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body>(.*?)(?:</body>|$)', 1), "
              "'(?s)<!--.*?-->', '', 'g'), '(?s)<nav>.*?</nav>', '', 'g'), '(?s)<footer>.*?</footer>', '', 'g')")

MD_STEPS = r"""
  md0 AS (SELECT page_id, url, {body} AS b FROM pages),
  md1 AS (SELECT page_id, url, regexp_replace(regexp_replace(b, '\\', '\\\\', 'g'), '([*_`\[\]])', '\\\1', 'g') AS b FROM md0),
  md2 AS (SELECT page_id, url, regexp_replace(b, '\s+', ' ', 'g') AS b FROM md1),
  md3 AS (SELECT page_id, url, regexp_replace(regexp_replace(b, '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS b FROM md2),
  md4 AS (SELECT page_id, url, regexp_replace(b, '<b>([^<]*)<br>', '**\1**', 'g') AS b FROM md3),
  md5 AS (SELECT page_id, url, regexp_replace(b, '<h1>', chr(1) || chr(57344) || ' ', 'g') AS b FROM md4),
  md6 AS (SELECT page_id, url, regexp_replace(b, '</?(div|article|p|h1)( [^>]*)?>', chr(1), 'g') AS b FROM md5),
  md7 AS (SELECT page_id, url, regexp_replace(b, ' *(' || chr(1) || ') *', '\1', 'g') AS b FROM md6),
  md8 AS (SELECT page_id, url, regexp_replace(b, chr(1) || '+', chr(10) || chr(10), 'g') AS b FROM md7),
  md9 AS (SELECT page_id, url, regexp_replace(b, '^\s+|\s+$', '', 'g') AS b FROM md8),
  md10 AS (SELECT page_id, url, regexp_replace(b, '(^|\n)([#>])', '\1\\\2', 'g') AS b FROM md9),
  md11 AS (SELECT page_id, url, regexp_replace(b, '(^|\n)([-+]) ', '\1\\\2 ', 'g') AS b FROM md10),
  md12 AS (SELECT page_id, url, regexp_replace(b, '(^|\n)([0-9]+)\. ', '\1\2\\. ', 'g') AS b FROM md11),
  md AS (SELECT page_id, url, CASE WHEN b = '' THEN '' ELSE replace(b, chr(57344), '#') || chr(10) END AS markdown FROM md12)
""".replace("{body}", BODY_CLEAN)


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


#: One row per URL key: the page visited first.
_FIRSTS = f""",
  firsts AS (SELECT page_id, url, {HOST} AS host, scheme || '://' || netloc || '/' AS scope, {KEY} AS url_key FROM pp
             QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY page_id) = 1)"""

# what the patterns of url_exclude_dialect mean, said without their syntax
DIALECT_HITS = r"""[
  {'i': 0, 'p': '/{version}/', 'm': contains(url, '/{version}/')},
  {'i': 1, 'p': 'e{,1}x/[[]', 'm': contains(url, 'x/[')},
  {'i': 2, 'p': '(?P<mark>#)top\Z', 'm': ends_with(url, '#top')},
  {'i': 3, 'p': '(?P<mark>[?])page=(?P<n>\d{,3})&(?P=mark)?', 'm': regexp_matches(url, '[?]page=[0-9]{0,3}&')},
  {'i': 4, 'p': '(/)?(?(1)\w+|x)[.]html$', 'm': regexp_matches(url, '(/[A-Za-z0-9_]+|x)[.]html$')},
  {'i': 5, 'p': '(?a)\bref=\w+', 'm': regexp_matches(url, '[^A-Za-z0-9_]ref=[A-Za-z0-9_]')},
  {'i': 6, 'p': '/[]x[]', 'm': contains(url, '/]') OR contains(url, '/x') OR contains(url, '/[')},
  {'i': 7, 'p': '(?i)UTM_(?:SOURCE|medium)=(?P<s>f)e{2}d', 'm': contains(lower(url), 'utm_source=feed') OR contains(lower(url), 'utm_medium=feed')},
  {'i': 8, 'p': '[^\D_]+/$', 'm': regexp_matches(url, '[0-9]/$')}]"""


ORACLES: dict[str, str] = {
    "page_scan": _with(PAGES_P, f"SELECT page_id, url, {HOST} AS host, CAST(length(html) AS INTEGER) AS n_chars FROM pp"),
    "url_normalize": _with(PAGES_P, f"SELECT page_id, url, {KEY} AS url_key FROM pp"),
    "md_path": _with(PAGES_P + "," + _mdpath_cte("pp"), f"SELECT page_id, url, {MDPATH} AS md_path FROM mp2"),
    "md_path_fallback": _with(PAGES_P + "," + _mdpath_cte("pp"), f"""
SELECT page_id, u AS url, CASE WHEN u = url THEN {MDPATH}
  ELSE format('page_{{:05d}}.md', CAST('0x' || left(md5(u), 8) AS BIGINT) % 100000) END AS md_path
FROM (SELECT *, CASE page_id % 3 WHEN 0 THEN replace(url, '://', '://[')
  WHEN 1 THEN regexp_replace(url, '(://[^/?#]*)', '\\1]') ELSE url END AS u FROM mp2)"""),
    "url_dedup": _with(PAGES_P + f""",
  k AS (SELECT page_id, url, {KEY} AS url_key FROM pp),
  f AS (SELECT url_key, min(page_id) AS first_id, count(*) AS n_variants FROM k GROUP BY url_key)""",
        "SELECT k.url_key, k.page_id, k.url, f.n_variants FROM k JOIN f ON k.url_key = f.url_key AND k.page_id = f.first_id"),
    "markdown_manifest": _with(PAGES_P + f""",
  k AS (SELECT *, {KEY} AS url_key, {HOST} AS host FROM pp),
  f AS (SELECT url_key, min(page_id) AS first_id FROM k GROUP BY url_key),
  w AS (SELECT k.* FROM k JOIN f ON k.url_key = f.url_key AND k.page_id = f.first_id),""" + _mdpath_cte("w"),
        f"SELECT page_id, url, url_key, host, {MDPATH} AS md_path FROM mp2"),
    "path_collisions": _with(PAGES_P + f""",
  k AS (SELECT *, {KEY} AS url_key FROM pp),
  f AS (SELECT url_key, min(page_id) AS first_id FROM k GROUP BY url_key),
  w AS (SELECT k.* FROM k JOIN f ON k.url_key = f.url_key AND k.page_id = f.first_id),""" + _mdpath_cte("w") + f""",
  m AS (SELECT page_id, {MDPATH} AS md_path FROM mp2)""",
        "SELECT md_path, count(*) AS n_pages, max(page_id) AS winner_page_id, min(page_id) AS first_page_id "
        "FROM m GROUP BY md_path HAVING count(*) > 1"),
    "url_allowed": "SELECT page_id, url, starts_with(url, 'https://') AS allowed FROM pages",
    "url_exclude": f"SELECT page_id, url, {EXCLUDE_CASE} AS matched_pattern FROM pages",
    "url_exclude_dialect": f"""
SELECT page_id, url, page_id % 9 AS list, list_filter({DIALECT_HITS}, lambda x: x.m AND x.i >= page_id % 9)[1].p AS matched_pattern,
       len(list_filter({DIALECT_HITS}, lambda x: x.m)) > 0 AS any_match
FROM pages""",
    "url_validate": _with(PAGES_P + f""",
  k AS (SELECT page_id, url, {KEY} AS url_key FROM pp),
  d AS (SELECT *, page_id <> min(page_id) OVER (PARTITION BY url_key) AS dup FROM k),
  v AS (SELECT page_id, url, CASE WHEN coalesce(url, '') = '' THEN 'empty' WHEN dup THEN 'duplicate'
          WHEN NOT starts_with(url, 'https://') THEN 'domain'
          WHEN ({EXCLUDE_CASE}) IS NOT NULL THEN 'pattern' ELSE 'valid' END AS verdict FROM d)""",
        f"SELECT page_id, url, verdict, CASE WHEN verdict = 'domain' THEN 'https://' "
        f"WHEN verdict = 'pattern' THEN {EXCLUDE_CASE} END AS reason FROM v"),
    "url_verdict_counts": "",  # filled below from url_validate
    "selector_match": r"""SELECT page_id,
        CAST(len(regexp_extract_all(html, '<nav[\s>]')) AS INTEGER) AS n_nav,
        CAST(len(regexp_extract_all(html, '<article[\s>]')) AS INTEGER) AS n_article,
        CAST(len(regexp_extract_all(html, '<div class="ad">')) AS INTEGER) AS n_ad,
        CAST(len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a[\s>]')) AS INTEGER) AS n_nav_a,
        CAST(len(regexp_extract_all(html, '<li[\s>]')) AS INTEGER) AS n_ul_li
      FROM pages""",
    "link_extract": _with(LINKS_CTE, "SELECT page_id, pos, href, link_text, dst_url, dst_key, priority FROM links"),
    "link_resolve": _with(LINKS_CTE, "SELECT page_id, pos, href, dst_url FROM links"),
    "link_text": _with(LINKS_CTE, "SELECT page_id, pos, link_text FROM links"),
    "link_priority": _with(LINKS_CTE, "SELECT page_id, pos, dst_url, link_text, keyword, priority FROM links"),
    "content_extract": f"""SELECT page_id,
        CASE WHEN regexp_matches(html, '<main[\\s>]') THEN 'selector' WHEN regexp_matches(html, '<body[\\s>]') THEN 'body' ELSE 'none' END AS source,
        CASE WHEN regexp_matches(html, '<main[\\s>]') THEN 'main' ELSE 'body' END AS root_tag,
        CASE WHEN regexp_matches(html, '<article[\\s>]') THEN 'selector' ELSE 'body' END AS article_source,
        {_decode(_strip_tags("regexp_extract(html, '(?s)<article>(.*)</article>', 1)"))} AS article_text
      FROM pages""",
    "content_clean": f"SELECT page_id, {_decode(_strip_tags(BODY_CLEAN))} AS clean_text FROM pages",
    "markdown_docs": _with(PAGES_P + "," + MD_STEPS + ", mdp AS (SELECT md.page_id, md.markdown, pp.path FROM md JOIN pp USING (page_id)),"
                           + _mdpath_cte("mdp"), f"SELECT page_id, {MDPATH} AS md_path, markdown FROM mp2"),
    "convert_status": """SELECT page_id, CASE WHEN regexp_matches(html, '<main[\\s>]') THEN 'selector' ELSE 'body' END AS source,
        'success' AS status, CASE WHEN regexp_matches(html, '<main[\\s>]') THEN NULL ELSE 'LOW' END AS error_severity FROM pages""",
    "convert_stats": _with(PAGES_P, f"""SELECT {HOST} AS host, count(*) AS total_processed, count(*) AS total_success,
        CAST(0 AS BIGINT) AS total_failed, round(100.0 * count(*) / count(*), 1) AS success_rate FROM pp GROUP BY 1"""),
}
ORACLES["url_verdict_counts"] = ("SELECT verdict, count(*) AS n FROM (" + ORACLES["url_validate"] + ") GROUP BY verdict")


# ------------------------------------------------------------------ crawl
_KEYS = f"keys AS (SELECT page_id AS kp, {KEY} AS url_key FROM pp)"
_FRESH = f"""{LINKS_CTE}, {_KEYS},
  fresh AS (SELECT * FROM links l WHERE NOT EXISTS (SELECT 1 FROM keys k WHERE k.url_key = l.dst_key)),
  fr AS (SELECT *, row_number() OVER (PARTITION BY dst_key ORDER BY page_id, pos) AS rn,
                count(*) OVER (PARTITION BY dst_key) AS n_refs FROM fresh),
  first AS (SELECT dst_key, dst_url, priority, page_id AS first_page_id, pos AS first_pos, n_refs FROM fr WHERE rn = 1)"""

_EDGES = """e0 AS (SELECT page_id AS src, (SELECT count(*) FROM pages) AS n FROM pages),
  edges AS (SELECT src, (2 * src + 1) % n AS dst FROM e0 UNION ALL SELECT src, (2 * src + 2) % n AS dst FROM e0)"""


def _closure_sql(scoped: bool) -> str:
    cond = "AND e.dst % 7 <> 0" if scoped else ""
    return f"""WITH RECURSIVE {_EDGES},
  r(node, depth) AS (SELECT CAST(0 AS BIGINT), 0
                     UNION
                     SELECT e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.node
                     WHERE r.depth < (SELECT count(*) FROM pages) {cond})
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node"""


ORACLES.update({
    "frontier_new": _with(_FRESH, "SELECT * FROM first"),
    "frontier_seen": _with(LINKS_CTE + ", " + _KEYS,
                           "SELECT page_id, pos, dst_key FROM links l WHERE EXISTS (SELECT 1 FROM keys k WHERE k.url_key = l.dst_key)"),
    "link_graph": _with(LINKS_CTE + ", " + _KEYS,
                        "SELECT l.page_id AS src_page_id, l.pos, l.dst_key, k.kp AS dst_page_id FROM links l JOIN keys k ON k.url_key = l.dst_key"),
    "frontier_order": _with(_FRESH + f""",
  fh AS (SELECT *, {_parts('dst_url')} FROM first),
  fh2 AS (SELECT *, {HOST} AS host FROM fh)""",
        "SELECT host, row_number() OVER (PARTITION BY host ORDER BY priority, first_page_id, first_pos, dst_key) AS pop_seq, "
        "dst_key, dst_url, priority FROM fh2"),
    "url_inventory": _with(PAGES_P + _FIRSTS, "SELECT host, page_id, url, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM firsts"),
    "snapshot_points": _with(PAGES_P + _FIRSTS + ", s AS (SELECT host, page_id, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM firsts)",
                             "SELECT host, page_id, n, n % 10 = 0 AS snapshot, n // 10 AS snapshot_no, n % 10 AS redo FROM s"),
    "crawl_closure": _closure_sql(True),
    "crawl_closure_all": _closure_sql(False),
    "crawl_order": "WITH c AS (" + _closure_sql(True) + ") SELECT node, depth, row_number() OVER (ORDER BY depth, node) AS crawl_seq FROM c",
})

# ------------------------------------------------------------------ attempts
_ATT = """att AS (SELECT event_id AS attempt_id, user_id AS url_id, ts, event_type = 'error' AS failed FROM events),
  sk AS (SELECT attempt_id, url_id, failed,
                row_number() OVER w AS attempt_no,
                CAST(coalesce(sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior_failures
         FROM att WINDOW w AS (PARTITION BY url_id ORDER BY ts, attempt_id))"""
_PER_URL = "pu AS (SELECT user_id AS url_id, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) AS attempts FROM events GROUP BY user_id)"

ORACLES.update({
    "auto_skip": _with(_ATT, "SELECT attempt_id, url_id, failed, attempt_no, prior_failures, prior_failures >= 5 AS skipped FROM sk"),
    "failed_urls": _with(_PER_URL, "SELECT * FROM pu"),
    "top_failures": _with(_PER_URL, "SELECT url_id, failures, CAST(url_id AS VARCHAR) || ': ' || CAST(failures AS VARCHAR) || ' failures' AS label "
                                    "FROM pu WHERE failures > 0 ORDER BY failures DESC, url_id LIMIT 10"),
    "crawl_stats": _with(_PER_URL, "SELECT CAST(sum(attempts) AS BIGINT) AS total_attempts, CAST(sum(failures) AS BIGINT) AS total_failed, count(*) AS total_urls, "
                                   "count(*) FILTER (WHERE failures < attempts) AS urls_with_success, "
                                   "count(*) FILTER (WHERE failures >= 5) AS auto_skipped FROM pu"),
    "backoff_schedule": _with(_ATT, "SELECT attempt_id, url_id, prior_failures, least(1.0 * pow(2.0, prior_failures), 60.0) AS retry_delay FROM sk WHERE failed"),
    "throughput": "SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS minute, count(*) AS pages FROM events WHERE event_type <> 'error' GROUP BY 1",
})

# ------------------------------------------------------------------ errors / runs / advisor
_PK = f"pk AS (SELECT page_id, url, html, {HOST} AS host, {KEY} AS url_key FROM pp)"
_ERR = f"""{PAGES_P}, {_PK},
  net AS (SELECT 'crawler' AS source, 'network_error' AS error_type, 'MEDIUM' AS severity, pk.url, 'fetch failed' AS message, pk.host
          FROM events e JOIN pk ON e.user_id = pk.page_id WHERE e.event_type = 'error'),
  con AS (SELECT 'converter' AS source, 'content_extraction_error' AS error_type, 'LOW' AS severity, url,
                 'content root not found, body used' AS message, host FROM pk WHERE NOT regexp_matches(html, '<main[\\s>]')),
  errs AS (SELECT * FROM net UNION ALL SELECT * FROM con)"""
_TYPES = "types(error_type) AS (VALUES ('network_error'), ('content_extraction_error'), ('file_system_error'), ('config_error'))"
_RUNS = f"""{PAGES_P}, {_PK},
  ps AS (SELECT host, count(DISTINCT url_key) AS total_crawled, count(*) - count(DISTINCT url_key) AS total_skipped,
                count(*) AS total_processed, count(*) AS total_success, 0 AS convert_failed,
                count(*) FILTER (WHERE NOT regexp_matches(html, '<main[\\s>]')) AS content_errors FROM pk GROUP BY host),
  atx AS (SELECT e.user_id AS url_id, e.ts, e.event_type = 'error' AS failed, pk.host FROM events e JOIN pk ON e.user_id = pk.page_id),
  pu AS (SELECT host, url_id, count(*) FILTER (WHERE failed) AS f, min(ts) AS t0, max(ts) AS t1 FROM atx GROUP BY host, url_id),
  asd AS (SELECT host, sum(f) AS total_failed, count(*) FILTER (WHERE f >= 5) AS auto_skipped,
                 epoch_us(max(t1)) - epoch_us(min(t0)) AS span_us FROM pu GROUP BY host),
  runs AS (SELECT coalesce(ps.host, asd.host) AS run_id,
                  coalesce(total_crawled, 0) AS total_crawled, CAST(coalesce(total_failed, 0) AS BIGINT) AS total_failed,
                  coalesce(total_skipped, 0) AS total_skipped, coalesce(auto_skipped, 0) AS auto_skipped,
                  coalesce(total_processed, 0) AS total_processed, coalesce(total_success, 0) AS total_success,
                  CAST(coalesce(convert_failed, 0) AS BIGINT) AS convert_failed, CAST(0 AS BIGINT) AS images_downloaded, CAST(0 AS BIGINT) AS images_failed,
                  CAST(coalesce(total_failed, 0) AS BIGINT) AS network_errors, coalesce(content_errors, 0) AS content_errors,
                  CAST(0 AS BIGINT) AS fs_errors, CAST(0 AS BIGINT) AS config_errors, coalesce(span_us, 0) / 1e6 AS seconds,
                  CAST(1.0 AS DOUBLE) AS request_delay, 'INFO' AS console_level
           FROM ps FULL OUTER JOIN asd ON ps.host = asd.host)"""
_RATES = """rates AS (SELECT *,
      network_errors / nullif(total_crawled + total_failed, 0) AS network_rate,
      content_errors / nullif(total_processed, 0) AS content_rate,
      images_failed / nullif(images_downloaded + images_failed, 0) AS image_fail_rate,
      CASE WHEN total_crawled > 0 AND seconds > 0 THEN total_crawled / seconds * 60.0 END AS pages_per_minute,
      CASE WHEN total_crawled > 0 THEN total_skipped / nullif(total_crawled + total_skipped, 0) END AS skip_rate,
      (network_errors + content_errors + fs_errors + config_errors) / nullif(total_crawled + total_failed + total_processed, 0) AS error_rate
    FROM runs)"""
_RULE_SQL = [
    ("R01", "HIGH", "RELIABILITY", "network_rate > 0.3 AND request_delay < 2.0"),
    ("R02", "MEDIUM", "RELIABILITY", "network_rate > 0.3 AND request_delay >= 2.0"),
    ("R03", "MEDIUM", "RELIABILITY", "network_rate > 0.1 AND network_rate <= 0.3"),
    ("R04", "HIGH", "CONFIGURATION", "content_rate > 0.2"),
    ("R05", "MEDIUM", "CONFIGURATION", "content_rate > 0.05 AND content_rate <= 0.2"),
    ("R06", "MEDIUM", "CONFIGURATION", "content_rate IS NOT NULL AND images_failed > 0 AND image_fail_rate > 0.3"),
    ("R07", "LOW", "PERFORMANCE", "pages_per_minute IS NOT NULL AND pages_per_minute < 5"),
    ("R08", "LOW", "PERFORMANCE", "pages_per_minute IS NOT NULL AND images_downloaded > 100"),
    ("R09", "MEDIUM", "CONFIGURATION", "skip_rate > 0.5"),
    ("R10", "LOW", "CONFIGURATION", "skip_rate < 0.1 AND total_crawled > 50"),
    ("R11", "LOW", "PERFORMANCE", "console_level = 'DEBUG' AND total_crawled > 20"),
    ("R12", "HIGH", "RELIABILITY", "error_rate > 0.4"),
    ("R13", "MEDIUM", "RELIABILITY", "error_rate > 0.2 AND error_rate <= 0.4"),
    ("R14", "HIGH", "RELIABILITY", "error_rate IS NOT NULL AND fs_errors > 0"),
]
_ADV = "adv AS (" + " UNION ALL ".join(
    f"SELECT run_id, '{r}' AS rule_id, '{p}' AS priority, '{c}' AS category FROM rates WHERE coalesce({cond}, false)"
    for r, p, c, cond in _RULE_SQL) + ")"

ORACLES.update({
    "error_union": _with(_ERR, "SELECT source, error_type, severity, url, message FROM errs"),
    "error_summary": _with(_ERR + ", " + _TYPES + ", c AS (SELECT error_type, count(*) AS n FROM errs GROUP BY 1)",
                           "SELECT t.error_type, coalesce(c.n, 0) AS n FROM types t LEFT JOIN c USING (error_type)"),
    "error_policy": _with(_ERR, """SELECT error_type, severity,
        CASE severity WHEN 'CRITICAL' THEN 'critical' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'info' END AS log_level,
        severity IN ('LOW', 'MEDIUM') AS continue_run,
        error_type IN ('network_error', 'file_system_error') AS retry, count(*) AS n FROM errs GROUP BY ALL"""),
    "site_runs": _with(_RUNS, "SELECT * FROM runs"),
    "run_rates": _with(_RUNS + ", " + _RATES,
                       "SELECT run_id, network_rate, content_rate, image_fail_rate, pages_per_minute, skip_rate, error_rate FROM rates"),
    "advisor": _with(_RUNS + ", " + _RATES + ", " + _ADV, "SELECT * FROM adv"),
    "advisor_counts": _with(_RUNS + ", " + _RATES + ", " + _ADV, "SELECT priority, count(*) AS n FROM adv GROUP BY priority"),
    "advisor_report": _with(_RUNS + ", " + _RATES + ", " + _ADV + """,
  allr AS (SELECT run_id, rule_id, priority FROM adv
           UNION ALL SELECT run_id, 'R00', 'NONE' FROM runs WHERE run_id NOT IN (SELECT run_id FROM adv))""",
        """SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY
             CASE priority WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END, rule_id) AS line_no,
           rule_id, priority FROM allr"""),
})

ORACLES.update({
    "stream_pages": _with(PAGES_P, f"SELECT {KEY} AS url_key, min(page_id) AS page_id FROM pp GROUP BY 1"),
    "stream_failures": "SELECT user_id AS url_id, count(*) FILTER (WHERE event_type = 'error') AS failures, "
                       "count(*) AS attempts, count(*) FILTER (WHERE event_type = 'error') >= 5 AS auto_skip "
                       "FROM events GROUP BY user_id",
})

_KW = ("CASE WHEN lower(title) SIMILAR TO '.*(index|overview|introduction|getting-started).*' THEN {h} "
       "WHEN lower(title) SIMILAR TO '.*(appendix|reference|changelog|history).*' THEN {l} ELSE {n} END")
ORACLES.update({
    # a queue entry: a valid link whose target no page up to the one holding it has visited
    "crawl_progress": _with(LINKS_CTE + _FIRSTS + """,
  entries AS (SELECT f.host, l.page_id, l.dst_key FROM links l JOIN firsts f ON f.page_id = l.page_id
              WHERE starts_with(l.dst_url, f.scope)
                AND NOT regexp_matches(l.dst_url, '.*#.*') AND NOT regexp_matches(l.dst_url, '.*/search\\.html')
                AND NOT regexp_matches(l.dst_url, '.*/genindex\\.html')
                AND NOT EXISTS (SELECT 1 FROM firsts v WHERE v.url_key = l.dst_key AND v.page_id <= l.page_id)),
  added AS (SELECT page_id, count(*) AS n FROM entries GROUP BY page_id),
  c AS (SELECT f.host, f.page_id, coalesce(a.n, 0) AS n,
               CASE WHEN EXISTS (SELECT 1 FROM entries e WHERE e.dst_key = f.url_key AND e.page_id < f.page_id) THEN 1 ELSE 0 END AS popped
        FROM firsts f LEFT JOIN added a ON a.page_id = f.page_id),
  q AS (SELECT host, page_id, row_number() OVER (PARTITION BY host ORDER BY page_id) AS processed,
               coalesce(sum(n) OVER (PARTITION BY host ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
               - sum(popped) OVER (PARTITION BY host ORDER BY page_id) AS queued FROM c)""",
        "SELECT host, page_id, processed, CAST(queued AS BIGINT) AS queued, CAST(processed + queued AS BIGINT) AS total FROM q"),
    "fetch_classify": """WITH o AS (SELECT event_id AS attempt_id, CASE WHEN event_type = 'error' THEN
           list_extract(['timeout', 'connection', 'request', 'http', 'unexpected'], CAST(event_id % 5 + 1 AS INTEGER)) ELSE 'ok' END AS outcome FROM events),
  s AS (SELECT *, CASE outcome WHEN 'ok' THEN 200 WHEN 'http' THEN
           list_extract([404, 429, 403, 500, 502, 503, 504], CAST((event_id_5 % 7) + 1 AS INTEGER)) END AS status
        FROM (SELECT *, attempt_id // 5 AS event_id_5 FROM o))
        SELECT attempt_id, outcome, CAST(status AS INTEGER) AS status,
               CASE WHEN outcome <> 'ok' THEN 'network_error' END AS error_type,
               CASE WHEN outcome IN ('timeout', 'connection', 'request') THEN 'MEDIUM'
                    WHEN outcome = 'http' THEN CASE WHEN status IN (429, 500, 502, 503, 504) THEN 'MEDIUM' ELSE 'LOW' END
                    WHEN outcome = 'unexpected' THEN 'HIGH' END AS severity,
               CASE WHEN outcome IN ('timeout', 'connection', 'request') THEN true
                    WHEN outcome = 'http' THEN status IN (429, 500, 502, 503, 504)
                    WHEN outcome = 'unexpected' THEN false END AS retry FROM s""",
    "page_priority": f"""WITH t AS (SELECT page_id, url, trim({_decode("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS title FROM pages)
        SELECT page_id, url, title, {_KW.format(h="'high'", l="'low'", n="'none'")} AS keyword,
               CAST(greatest(0, 10 + (length(url) - length(replace(url, '/', ''))) - 3 + {_KW.format(h=-5, l=5, n=0)}) AS INTEGER) AS priority
        FROM t""",
    "log_stats": _with(PAGES_P + f", pk AS (SELECT page_id FROM pp)",
        """SELECT 'web_crawler' AS logger, CASE WHEN event_type = 'error' THEN 'WARNING' ELSE 'INFO' END AS level, count(*) AS n
           FROM events e JOIN pk ON e.user_id = pk.page_id GROUP BY ALL"""),
    "log_tail": _with(PAGES_P + """,
  l AS (SELECT event_id AS attempt_id, pp.url, CASE WHEN event_type = 'error' THEN 'WARNING' ELSE 'INFO' END AS level,
               CASE WHEN event_type = 'error' THEN 'fetch failed - retry' ELSE 'fetched' END AS message, strftime(ts, '%Y-%m-%d %H:%M:%S') AS secs
        FROM events e JOIN pp ON e.user_id = pp.page_id)""",
        """SELECT attempt_id, level, url FROM l
           ORDER BY secs DESC, concat(level, ' - ', message, ' | url=', url, ' | attempt=', attempt_id) DESC LIMIT 50"""),
    "log_context": _with(PAGES_P,
        """SELECT e.event_id AS attempt_id, CASE WHEN event_type = 'error' THEN 'fetch failed - retry' ELSE 'fetched' END AS message,
                  pp.url, CASE WHEN event_type = 'error' THEN 30 ELSE 20 END AS level_rank
           FROM events e JOIN pp ON e.user_id = pp.page_id"""),
})

ORACLES.update({
    "page_profile": _with(PAGES_P, """SELECT page_id, url, scheme || '://' || lower(netloc) || '/' AS profile_id,
                                             scheme || '://' || lower(netloc) || '/' AS allowed_domain FROM pp
                                      WHERE starts_with(url, scheme || '://' || lower(netloc) || '/')
                                      UNION ALL
                                      SELECT page_id, url, NULL, NULL FROM pp
                                      WHERE NOT starts_with(url, scheme || '://' || lower(netloc) || '/')"""),
    "profile_violations": _with(PAGES_P, """SELECT DISTINCT scheme || '://' || lower(netloc) || '/' AS profile_id,
                                                   'x' AS rule_id, 0 AS rule_rank, 'x' AS path, 'x' AS message
                                            FROM pp WHERE false"""),
})

ORACLES.update({
    "frontier_lookup": _with(_FRESH + ", kk AS (SELECT url_key, min(kp) AS page_id FROM keys GROUP BY url_key)",
        "SELECT f.dst_key AS url_key, f.dst_url, kk.page_id, kk.page_id IS NOT NULL AS fetched "
        "FROM first f LEFT JOIN kk ON kk.url_key = f.dst_key"),
})

_SEEDS = f"seeds AS (SELECT min(page_id) AS page_id FROM pp GROUP BY {HOST})"
ORACLES.update({
    # snapshot links never reach another snapshot page, so each site's crawl stops at its seed
    "site_crawl": _with(PAGES_P + ", " + _SEEDS,
                        "SELECT pp.page_id, pp.url, 0 AS depth FROM pp JOIN seeds USING (page_id)"),
    "site_crawl_misses": _with(LINKS_CTE + ", " + _SEEDS + ", " + _KEYS + """,
  src AS (SELECT l.* FROM links l JOIN seeds s ON l.page_id = s.page_id
          JOIN pp ON pp.page_id = l.page_id
          WHERE starts_with(l.dst_url, pp.scheme || '://' || pp.netloc || '/')
            AND NOT regexp_matches(l.dst_url, '.*#.*') AND NOT regexp_matches(l.dst_url, '.*/search\\.html')
            AND NOT regexp_matches(l.dst_url, '.*/genindex\\.html')
            AND NOT EXISTS (SELECT 1 FROM keys k WHERE k.url_key = l.dst_key))""",
        "SELECT dst_key, min(page_id) AS first_src, count(*) AS n_refs FROM src GROUP BY dst_key"),
})

ORACLES.update({
    # md5 of the key-sorted compact JSON of the four content sections (defaults + origin scope)
    "profile_checksum": _with(PAGES_P + ", o AS (SELECT DISTINCT scheme || '://' || lower(netloc) || '/' AS origin FROM pp)",
        r"""SELECT origin AS profile_id, md5(to_json(struct_pack(
              crawler := struct_pack(exclude_patterns := ['.*#.*', '.*/search\.html', '.*/genindex\.html'],
                                     navigation_selector := 'nav'),
              extractor := struct_pack(content_selector := 'main'),
              output := struct_pack(base_dir := './output', download_images := true, image_dir_name := 'images'),
              target_site := struct_pack(allowed_domain := origin, start_url := origin)))) AS config_checksum
            FROM o"""),
})


# H1 tree: regex tokens + a recursive-CTE stack machine applying the same repair rules for the
# test pages' tag set (block start closes an open p and what is inside it; li closes li; an end
# tag closes up to its match; void elements take no children; script/style are raw text)
PAGE_NODES_SQL = r"""
WITH RECURSIVE
t0 AS (SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?-->|<![^>]*>|<[A-Za-z/][^>]*>|[^<]+|<') AS toks FROM pages),
t1 AS (SELECT page_id, unnest(toks) AS tok, unnest(generate_series(1, len(toks))) AS i FROM t0),
t2 AS (SELECT page_id, i, tok,
         CASE WHEN tok LIKE '<!%' THEN 'skip' WHEN tok LIKE '</%' THEN 'end'
              WHEN regexp_matches(tok, '^<[A-Za-z]') THEN 'start' ELSE 'text' END AS k0,
         lower(regexp_extract(tok, '^</?([A-Za-z][^\s/>]*)', 1)) AS tg FROM t1),
t3 AS (SELECT *, coalesce(sum(CASE WHEN k0 = 'start' AND tg IN ('script', 'style') THEN 1
                                   WHEN k0 = 'end' AND tg IN ('script', 'style') THEN -1 ELSE 0 END)
                  OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS in_raw FROM t2),
t4 AS (SELECT *, CASE WHEN in_raw > 0 AND NOT (k0 = 'end' AND tg IN ('script', 'style')) THEN 'raw' ELSE k0 END AS k1 FROM t3),
t5 AS (SELECT *, sum(CASE WHEN k1 IN ('raw', 'text') THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) AS grp FROM t4),
t6 AS (SELECT page_id, min(i) AS i, 'text' AS kind, CAST(NULL AS VARCHAR) AS tg,
              string_agg(CASE WHEN k1 = 'raw' THEN tok ELSE
                regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(tok,
                  '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&copy;?', '©', 'g'),
                  '&middot;?', '·', 'g'), '&amp;?', '&', 'g') END, '' ORDER BY i) AS txt
       FROM t5 WHERE k1 IN ('raw', 'text') GROUP BY page_id, grp
       UNION ALL
       SELECT page_id, i, k1, tg, CAST(NULL AS VARCHAR) FROM t5 WHERE k1 IN ('start', 'end')),
ev AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k, kind, tg, txt FROM t6),
nk AS (SELECT page_id, max(k) AS nk FROM ev GROUP BY page_id),
r(page_id, k, st, nid, emit) AS (
  SELECT page_id, 0, []::STRUCT(id INTEGER, tag VARCHAR)[], 0,
         []::STRUCT(ev VARCHAR, id INTEGER, e INTEGER, parent INTEGER, depth INTEGER, kind VARCHAR, tag VARCHAR, txt VARCHAR)[]
  FROM nk
  UNION ALL
  SELECT r.page_id, r.k + 1, s.st2, s.nid2, s.emit2 FROM r JOIN ev ON ev.page_id = r.page_id AND ev.k = r.k + 1,
  LATERAL (
    SELECT
      -- index (1-based) from which the stack is popped before this token; len+1 = nothing popped
      CASE WHEN ev.kind = 'end' AND ev.tg NOT IN ('html', 'body') AND list_contains(list_transform(r.st, lambda x: x.tag), ev.tg)
             THEN len(r.st) - list_position(list_reverse(list_transform(r.st, lambda x: x.tag)), ev.tg) + 1
           WHEN ev.kind = 'start' AND ev.tg IN ('p', 'div', 'h1', 'ul', 'li', 'nav', 'article', 'footer', 'table', 'pre', 'section', 'header', 'main')
                AND list_contains(list_transform(r.st, lambda x: x.tag), 'p')
             THEN len(r.st) - list_position(list_reverse(list_transform(r.st, lambda x: x.tag)), 'p') + 1
           WHEN ev.kind = 'start' AND ev.tg = 'li' AND list_contains(list_transform(r.st, lambda x: x.tag), 'li')
                AND list_position(list_reverse(list_transform(r.st, lambda x: x.tag)), 'li') <
                    coalesce(nullif(list_position(list_reverse(list_transform(r.st, lambda x: x.tag)), 'ul'), 0), 1000000)
             THEN len(r.st) - list_position(list_reverse(list_transform(r.st, lambda x: x.tag)), 'li') + 1
           ELSE len(r.st) + 1 END AS cut
  ) c,
  LATERAL (
    SELECT list_slice(r.st, 1, c.cut - 1) AS base,
           list_transform(list_slice(r.st, c.cut, len(r.st)), lambda x: {'ev': 'close', 'id': x.id, 'e': r.nid - 1, 'parent': NULL,
              'depth': NULL, 'kind': NULL, 'tag': NULL, 'txt': NULL}) AS closes
  ) b,
  LATERAL (
    SELECT
      CASE WHEN ev.kind = 'end' THEN b.base
           WHEN ev.kind = 'start' AND ev.tg NOT IN ('meta', 'br', 'img', 'hr', 'link', 'input', 'area', 'base', 'col', 'embed', 'source', 'track', 'wbr')
             THEN list_append(b.base, {'id': r.nid, 'tag': ev.tg})
           ELSE b.base END AS st2,
      CASE WHEN ev.kind = 'end' THEN r.nid ELSE r.nid + 1 END AS nid2,
      CASE WHEN ev.kind = 'end' THEN b.closes
           ELSE list_append(b.closes, {'ev': 'open', 'id': r.nid, 'e': NULL,
                  'parent': coalesce(b.base[len(b.base)].id, -1), 'depth': len(b.base),
                  'kind': CASE WHEN ev.kind = 'start' THEN 'element' ELSE 'text' END,
                  'tag': CASE WHEN ev.kind = 'start' THEN ev.tg END, 'txt': ev.txt}) END AS emit2
  ) s
),
fin AS (SELECT r.page_id, r.st, r.nid FROM r JOIN nk ON r.page_id = nk.page_id AND r.k = nk.nk),
em AS (SELECT page_id, unnest(emit) AS x FROM r),
opens AS (SELECT page_id, x.id AS node_id, x.parent AS parent_id, x.depth AS depth, x.kind AS kind, x.tag AS tag, x.txt AS text
          FROM em WHERE x.ev = 'open'),
closes AS (SELECT page_id, x.id AS node_id, x.e AS end_id FROM em WHERE x.ev = 'close'
           UNION ALL SELECT page_id, unnest(st).id, nid - 1 FROM fin)
SELECT o.page_id, CAST(o.node_id AS INTEGER) AS node_id, CAST(coalesce(c.end_id, o.node_id) AS INTEGER) AS end_id,
       CAST(o.parent_id AS INTEGER) AS parent_id, CAST(o.depth AS INTEGER) AS depth, o.kind, o.tag,
       CAST(NULL AS VARCHAR) AS elem_id, o.text
FROM opens o LEFT JOIN closes c ON c.page_id = o.page_id AND c.node_id = o.node_id
"""
ORACLES["page_nodes"] = PAGE_NODES_SQL

ORACLES["image_extract"] = _with(PAGES_P + f""",
  im AS (SELECT page_id, scheme, netloc,
                unnest(regexp_extract_all({BODY_CLEAN.replace("html", "pp.html")}, '<img[^>]*\\ssrc="([^"]+)"', 1)) AS src
         FROM pp)""",
    "SELECT page_id, src, CASE WHEN src LIKE '/%' AND src NOT LIKE '//%' THEN scheme || '://' || netloc || src END AS abs_url FROM im")


def _site_order_sql(levels: int = 40) -> str:
    """One relation per level: new pages by (priority, place of the parent, position), numbered on from the levels before."""
    parts = [LINKS_CTE, """dl AS MATERIALIZED (
  SELECT k AS profile, page_id AS src, ('0x' || substr(h, 1, 8))::BIGINT % (SELECT count(*) FROM pages) AS dst, priority + ('0x' || substr(h, 9, 1))::INT % 4 AS priority, pos
  FROM (SELECT *, md5(href || '|' || page_id || '|' || k) AS h FROM links, (SELECT unnest([0, 1, 2]) AS k)))""",
             "v0 AS MATERIALIZED (SELECT k AS profile, 0::BIGINT AS node, 0 AS depth, 1::BIGINT AS seq FROM (SELECT unnest([0, 1, 2]) AS k))"]
    for d in range(1, levels + 1):
        parts.append(f"""c{d} AS (SELECT l.profile, l.dst AS node, min({{'p': l.priority, 's': v.seq, 'o': l.pos}}) AS w
  FROM dl l JOIN v{d - 1} v ON v.profile = l.profile AND v.node = l.src AND v.depth = {d - 1}
  WHERE NOT EXISTS (SELECT 1 FROM v{d - 1} x WHERE x.profile = l.profile AND x.node = l.dst) GROUP BY ALL)""")
        parts.append(f"""v{d} AS MATERIALIZED (SELECT * FROM v{d - 1} UNION ALL
  SELECT profile, node, {d}, (SELECT count(*) FROM v{d - 1} x WHERE x.profile = c{d}.profile) + row_number() OVER (PARTITION BY profile ORDER BY w, node) FROM c{d})""")
    return "WITH " + ", ".join(parts) + f" SELECT profile, node, depth, seq FROM v{levels}"


ORACLES["site_order"] = _site_order_sql()

# what each of the 31 kinds of profile breaks: (case, rule, rank, path)
_BROKEN = [(1, "K2", 2, "target_site.allowed_domain"), (2, "V01", 200, "target_site.start_url"), (3, "V03", 203, "execution.request_delay"),
           (5, "V03", 203, "execution.request_delay"), (6, "V11", 211, "crawler.exclude_patterns"), (8, "V12", 212, "logging.console_level"),
           (10, "T10", 109, "retry.max_retries"), (11, "T10", 109, "retry.max_retries"), (12, "V04", 204, "retry.max_retries"),
           (13, "K3", 3, "crawler.navigation_selector"), (14, "V10", 210, "recovery.recovery_file"), (15, "V02", 201, "target_site.allowed_domain"),
           (16, "K1", 1, "target_site.start_url"), (16, "K2", 2, "target_site.allowed_domain"), (17, "V14", 214, "logging.max_file_size_mb"),
           (18, "K3", 3, "crawler.navigation_selector"), (19, "T14", 113, "retry.retry_status_codes"), (20, "T08", 107, "output.download_images"),
           (21, "V13", 213, "logging.file_level"), (22, "V09", 209, "recovery.save_interval"), (23, "V15", 215, "logging.backup_count"),
           (24, "V08", 208, "retry.skip_after_failures"), (25, "V05", 205, "retry.backoff_factor"), (26, "V06", 206, "retry.initial_delay"),
           (27, "V07", 207, "retry.max_delay"), (28, "K5", 5, "output.base_dir"), (29, "K4", 4, "extractor.content_selector"),
           (30, "K1", 1, "target_site.start_url"), (30, "K2", 2, "target_site.allowed_domain")]

ORACLES["profile_faults"] = ("SELECT page_id, rule_id, rule_rank, path FROM pages JOIN (VALUES "
                             + ", ".join(f"({c}, '{r}', {n}, '{p}')" for c, r, n, p in _BROKEN)
                             + ") b(kind, rule_id, rule_rank, path) ON page_id % 31 = kind")
ORACLES["profile_merge"] = _with(PAGES_P, """SELECT page_id,
  CASE page_id % 31 WHEN 1 THEN '' WHEN 15 THEN 'example' WHEN 16 THEN '' WHEN 30 THEN '' ELSE scheme || '://' || lower(netloc) || '/' END AS allowed_domain,
  CASE WHEN page_id % 31 IN (13, 18) THEN NULL ELSE 'nav' END AS navigation_selector,
  CASE WHEN page_id % 31 IN (6, 7) THEN 2 WHEN page_id % 31 = 18 THEN NULL ELSE 3 END AS n_patterns,
  CASE page_id % 31 WHEN 0 THEN 1.5 WHEN 3 THEN -1 WHEN 4 THEN 60 WHEN 5 THEN 60.5 ELSE 1 END::DOUBLE AS request_delay,
  CASE page_id % 31 WHEN 8 THEN 'TRACE' WHEN 9 THEN 'info' ELSE 'INFO' END AS console_level,
  CASE WHEN page_id % 31 = 24 THEN 0 ELSE 5 END AS skip_after_failures, CASE WHEN page_id % 31 = 28 THEN '' ELSE './output' END AS base_dir
FROM pp""")

_DERIVED = """dl AS (SELECT page_id AS src, pos, ('0x' || substr(md5(href || '|' || page_id || '|0'), 1, 8))::BIGINT % (SELECT count(*) FROM pages) AS dst FROM links)"""
ORACLES["derived_link_graph"] = _with(LINKS_CTE + ", " + _DERIVED + f", kk AS (SELECT page_id, {KEY} AS url_key FROM pp)",
    "SELECT dl.src AS src_page_id, dl.pos, t.url_key AS dst_key, q.page_id AS dst_page_id FROM dl JOIN kk t ON t.page_id = dl.dst JOIN kk q ON q.url_key = t.url_key")
ORACLES["derived_links_seen"] = _with(LINKS_CTE + ", " + _DERIVED + f", kk AS (SELECT page_id, {KEY} AS url_key FROM pp)",
    "SELECT dl.src AS page_id, dl.pos, t.url_key AS dst_key FROM dl JOIN kk t ON t.page_id = dl.dst WHERE EXISTS (SELECT 1 FROM kk v WHERE v.url_key = t.url_key AND v.page_id % 3 = 0)")
ORACLES["convert_gaps"] = """SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'no_html' WHEN page_id % 11 = 0 THEN 'none'
    WHEN regexp_matches(html, '<article[\\s>]') AND page_id % 2 = 0 THEN 'selector' ELSE 'body' END AS source,
  CASE WHEN page_id % 7 = 0 OR page_id % 11 = 0 THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN page_id % 7 = 0 OR page_id % 11 = 0 THEN 'MEDIUM' WHEN regexp_matches(html, '<article[\\s>]') AND page_id % 2 = 0 THEN NULL ELSE 'LOW' END AS error_severity
FROM pages"""

ORACLES.update(log_oracles.ORACLES)
ORACLES.update(image_oracles.image_oracles(_parts('url'), MD_STEPS))
ORACLES.update(recovery_oracles.ORACLES)
ORACLES.update(increment_oracles.increment_oracles(PAGES_P, KEY, ORACLES["auto_skip"]))

_VARIED = """dg AS (SELECT url AS run_id, [CAST('0x' || substr(md5(url), i, 1) AS BIGINT) for i in range(1, 12)] AS d FROM pages),
  cr AS (SELECT *, CASE WHEN d[11] > 0 THEN 10 + d[1] * 6 ELSE 0 END AS total_crawled, CASE WHEN d[11] > 0 THEN d[2] * 4 ELSE 0 END AS total_failed FROM dg),
  runs AS (SELECT run_id, total_crawled, total_failed, CASE WHEN d[11] > 0 THEN d[7] * d[7] ELSE 0 END AS total_skipped, total_crawled AS total_processed,
                  d[4] * 12 AS images_downloaded, d[5] * 8 AS images_failed, total_failed AS network_errors, total_crawled * d[3] // 40 AS content_errors,
                  CASE WHEN d[10] IN (0, 4, 8, 12) THEN 1 ELSE 0 END AS fs_errors, 0 AS config_errors, 60.0 * (d[6] + 1) AS seconds,
                  [1.0, 1.75, 2.5][d[8] % 3 + 1] AS request_delay, ['DEBUG', NULL, 'INFO', 'INFO'][d[9] % 4 + 1] AS console_level FROM cr)"""
ORACLES["advisor_varied"] = _with(_VARIED + ", " + _RATES + ", " + _ADV + """,
  allr AS (SELECT * FROM adv UNION ALL SELECT run_id, 'R00', 'NONE', 'NONE' FROM runs WHERE run_id NOT IN (SELECT run_id FROM adv))""",
        """SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY
             CASE priority WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END, rule_id) AS line_no,
           rule_id, priority, category FROM allr""")
