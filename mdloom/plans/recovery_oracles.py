"""DuckDB SQL of the state queries: windows over the attempts instead of a log of deltas."""

_ATT = """WITH b AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events),
  att AS (SELECT lpad(CAST(user_id % 16 AS VARCHAR), 3, '0') AS run_id, CAST(user_id AS VARCHAR) AS key, event_id AS id, event_type = 'error' AS failed,
                 CAST(least(4, (epoch_us(ts) - lo) * 5 // (hi - lo + 1)) AS INTEGER) AS save FROM events, b),
  ok AS (SELECT * FROM att WHERE save < 4)"""
# of the URL's fetches in the first save that has one, the least id
_CRAWLED = "SELECT run_id, key, save, min(id) AS value FROM ok WHERE NOT failed GROUP BY run_id, key, save QUALIFY row_number() OVER (PARTITION BY run_id, key ORDER BY save) = 1"

ORACLES = {
    "state_snapshot": _ATT + f"""
SELECT run_id, 'visited' AS kind, key, CAST(0 AS BIGINT) AS value, min(save) AS save FROM ok GROUP BY run_id, key
UNION ALL SELECT run_id, 'crawled', key, value, save FROM ({_CRAWLED})
UNION ALL SELECT run_id, 'failures', key, CAST(sum(count(*)) OVER (PARTITION BY run_id, key ORDER BY save) AS BIGINT), save
          FROM ok WHERE failed GROUP BY run_id, key, save""",
    "state_restore": _ATT + f"""
SELECT DISTINCT run_id, 'visited' AS kind, key, CAST(0 AS BIGINT) AS value FROM ok
UNION ALL SELECT run_id, 'crawled', key, value FROM ({_CRAWLED})
UNION ALL SELECT run_id, 'failures', key, count(*) FROM ok WHERE failed GROUP BY run_id, key
UNION ALL SELECT run_id, 'processed', '', count(*) FROM ok GROUP BY run_id
UNION ALL SELECT run_id, 'success', '', count(*) FILTER (WHERE NOT failed) FROM ok GROUP BY run_id
UNION ALL SELECT run_id, 'failed', '', count(*) FILTER (WHERE failed) FROM ok GROUP BY run_id""",
    "resume_gate": """WITH n AS (SELECT user_id AS page_id, count(*) AS c FROM events GROUP BY 1)
SELECT p.page_id, p.page_id % 4 IN (0, 3) AS recovery_enabled, c IS NOT NULL AS has_snapshot,
       c IS NOT NULL AND p.page_id % 3 <> 0 AS checksum_match,
       p.page_id % 4 IN (0, 3) AND c IS NOT NULL AND p.page_id % 3 <> 0 AS can_resume, c AS resume_processed
FROM pages p LEFT JOIN n USING (page_id)""",
}
