"""DuckDB SQL of the log file queries, from the attempts themselves."""

_LINES = """WITH att AS (SELECT e.event_id AS id, p.url, strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS secs,
                CASE WHEN e.event_id % 7 = 0 THEN 'CRITICAL' ELSE 'ERROR' END AS level
         FROM events e JOIN pages p ON e.user_id = p.page_id WHERE e.event_type = 'error'),
  ln AS (SELECT id AS attempt_id, url, level, CAST(0 AS BIGINT) AS place,
                concat(secs, ' - web_crawler - ', level, ' - fetch failed | url=', url, ' | attempt=', id) AS value FROM att
         UNION ALL SELECT id, url, level, 1, 'Traceback (most recent call last):' FROM att WHERE id % 4 >= 1
         UNION ALL SELECT id, url, level, 2, concat('  File "fetch.py", line ', id % 500, ', in get') FROM att WHERE id % 4 >= 2
         UNION ALL SELECT id, url, level, 3, concat('TimeoutError: attempt ', id) FROM att WHERE id % 4 = 3)
"""

ORACLES = {
    "log_errors": _LINES + "SELECT attempt_id, level, place, value FROM ln",
    "log_error_records": _LINES + """SELECT attempt_id, level, count(*) AS n_lines, arg_max(value, place) AS last_line
        FROM ln WHERE contains(url, '.example.net/') GROUP BY attempt_id, level""",
}
