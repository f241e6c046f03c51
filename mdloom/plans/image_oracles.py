"""DuckDB SQL of the image queries: every source's absolute URL and file name said case by case."""


def image_oracles(parts_sql: str, md_steps: str) -> dict[str, str]:
    """``parts_sql`` selects scheme, netloc and path of url; ``md_steps`` are the Markdown steps over ``pages``."""
    cases = f"""
  up AS (SELECT page_id, url, {parts_sql} FROM pages),
  dirs AS (SELECT page_id, scheme, scheme || '://' || netloc AS o, regexp_replace(path, '[^/]*$', '') AS d FROM up WHERE page_id % 10 <> 0),
  pick AS (SELECT page_id, scheme, CASE page_id % 9
      WHEN 0 THEN {{'src': concat('/img/logo ', page_id, '.png'), 'url': concat(o, '/img/logo ', page_id, '.png'), 'stem': concat('logo_', page_id)}}
      WHEN 1 THEN {{'src': concat('shots/pic-', page_id, '.v2.png'), 'url': concat(o, d, 'shots/pic-', page_id, '.v2.png'), 'stem': concat('pic-', page_id, '.v2')}}
      WHEN 2 THEN {{'src': concat('https://cdn.example.net/a/b-', page_id, '.svg?x=1'), 'url': concat('https://cdn.example.net/a/b-', page_id, '.svg?x=1'), 'stem': concat('b-', page_id)}}
      WHEN 3 THEN {{'src': '//cdn.example.net/shared.gif', 'url': concat(scheme, '://cdn.example.net/shared.gif'), 'stem': 'shared'}}
      WHEN 4 THEN {{'src': 'data:image/png;base64,AAAA', 'url': 'data:image/png;base64,AAAA', 'stem': NULL}}
      WHEN 5 THEN {{'src': '', 'url': '', 'stem': NULL}}
      WHEN 6 THEN {{'src': concat('../up/', page_id, '.webp'), 'url': concat(o, CASE WHEN d IN ('', '/') THEN '/' ELSE regexp_replace(d, '[^/]*/$', '') END, 'up/', page_id, '.webp'), 'stem': CAST(page_id AS VARCHAR)}}
      WHEN 7 THEN {{'src': concat('/img/.hidden-', page_id), 'url': concat(o, '/img/.hidden-', page_id), 'stem': NULL}}
      ELSE {{'src': concat('https://cdn.example.net/dir-', page_id, '/'), 'url': concat('https://cdn.example.net/dir-', page_id, '/'), 'stem': NULL}} END AS c FROM dirs),
  imgs AS (SELECT page_id, c.src AS src, 'one' AS alt, c.url AS abs_url, c.stem AS stem FROM pick WHERE c.src <> ''
           UNION ALL SELECT page_id, c.src, NULL, c.url, c.stem FROM pick WHERE c.src <> ''
           UNION ALL SELECT page_id, '//cdn.example.net/shared.gif', 'all', concat(scheme, '://cdn.example.net/shared.gif'), 'shared' FROM pick),
  hx AS (SELECT *, md5(abs_url) AS h FROM imgs),
  num AS (SELECT *, CAST('0x' || h[1:4] AS BIGINT) AS a, CAST('0x' || h[5:8] AS BIGINT) AS b, CAST('0x' || h[9:12] AS BIGINT) AS k,
                 CAST('0x' || h[13:16] AS BIGINT) AS z, CAST('0x' || h[1:8] AS BIGINT) AS w FROM hx),
  oc AS (SELECT *, CASE WHEN starts_with(abs_url, 'data:') THEN 'invalid_url' WHEN a % 8 = 0 THEN 'not_fetched' WHEN b % 6 = 0 THEN 'http_error'
                        WHEN k % 7 = 6 THEN 'not_image' WHEN z % 5 = 0 THEN 'too_large' ELSE 'downloaded' END AS outcome,
                 ['.png', '.jpg', '.gif', '.svg', '.webp', '.jpg', '.jpg'][k % 7 + 1] AS ext FROM num),
  lp AS (SELECT *, CASE WHEN outcome = 'downloaded' THEN concat('./images/', coalesce(stem, 'image_' || lpad(CAST(w % 100000 AS VARCHAR), 5, '0')), ext) END AS local_path FROM oc),
  man AS (SELECT page_id, src, alt, abs_url, outcome, local_path, coalesce(local_path, abs_url) AS new_src,
                 CASE WHEN local_path IS NULL THEN 'failed' ELSE 'downloaded' END AS counted FROM lp)"""
    mark = "chr(57360)"
    marked = (f" mpages AS (SELECT page_id, url, CASE WHEN page_id % 10 = 0 THEN html ELSE replace(html, '<article>', "
              f"'<article><p>' || {mark} || '</p>') END AS html FROM pages),")
    line = """  sh AS (SELECT page_id, any_value(new_src) AS s FROM man WHERE alt = 'all' GROUP BY page_id),
  pk AS (SELECT page_id, any_value(new_src) AS s FROM man WHERE alt = 'one' GROUP BY page_id),
  cnt AS (SELECT page_id, count(*) FILTER (WHERE counted = 'downloaded') AS dn, count(*) FILTER (WHERE counted = 'failed') AS fl FROM man GROUP BY page_id)"""
    return {
        "image_manifest": f"WITH {cases} SELECT * FROM man",
        "image_markdown": f"WITH {cases}, {marked} {md_steps.replace('FROM pages', 'FROM mpages')}, {line}\n"
                          f"SELECT md.page_id, replace(markdown, {mark}, concat('![one](', coalesce(pk.s, ''), ')![](', coalesce(pk.s, ''), ')![all](', sh.s, ')')) AS markdown, "
                          "coalesce(dn, 0) AS images_downloaded, coalesce(fl, 0) AS images_failed "
                          "FROM md LEFT JOIN sh USING (page_id) LEFT JOIN pk USING (page_id) LEFT JOIN cnt USING (page_id)",
    }
