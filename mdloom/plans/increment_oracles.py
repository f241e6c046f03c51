"""DuckDB SQL of the resumable streams: what one pass over the slices must give."""


def increment_oracles(pages_cte: str, key: str, auto_skip: str) -> dict[str, str]:
    """``pages_cte`` names the page parts pp, ``key`` is the URL key over them, ``auto_skip`` the batch form."""
    sliced = """b AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events),
  s AS (SELECT event_id AS id, ts, event_type = 'error' AS failed, least(3, (epoch_us(ts) - lo) * 4 // (hi - lo + 1)) AS sl FROM events, b)"""
    return {
        "stream_restart": f"""WITH {pages_cte},
  r AS (SELECT min(page_id) AS lo, max(page_id) AS hi FROM pages),
  k AS (SELECT page_id, {key} AS url_key, least(3, (page_id - lo) * 4 // (hi - lo + 1)) AS sl FROM pp, r),
  u AS (SELECT * FROM k UNION ALL SELECT -page_id - 1, url_key, sl + 1 FROM k WHERE page_id % 2 = 0 AND sl < 3)
SELECT url_key, page_id FROM u QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY sl, page_id) = 1""",
        "stream_auto_skip": auto_skip,
        "stream_throughput": f"""WITH {sliced},
  a AS (SELECT id, ts, CASE WHEN id % 5 = 0 THEN least(sl + 1, 3) ELSE sl END AS sl FROM s WHERE NOT failed),
  mark AS (SELECT sl, max(epoch_ms(ts)) - 2 * 86400000 AS m FROM a GROUP BY sl),
  seen AS (SELECT sl, max(m) OVER (ORDER BY sl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM mark),
  kept AS (SELECT date_trunc('minute', ts) AS minute FROM a JOIN seen USING (sl)
           WHERE m IS NULL OR epoch_ms(date_trunc('minute', ts)) + 60000 > m)
SELECT minute, count(*) AS pages FROM kept WHERE epoch_ms(minute) + 60000 <= (SELECT max(m) FROM mark) GROUP BY minute""",
    }
