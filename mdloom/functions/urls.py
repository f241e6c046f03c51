"""URL rules as Column expressions (no Python per row).

Every function takes and returns ``Column`` so it composes inside
``select``/``filter``/``join`` conditions and stays in whole-stage codegen.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values that must equal the reference's behaviour ----------------
# RFC 3986 style split: scheme, authority (netloc), path, query, fragment.
URL_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# characters replaced by "_" in Markdown output paths
PATH_BAD_CHARS = r'[<>:"|?*]'
# link-text keywords that raise (high) or lower (low) link priority
HIGH_PRIORITY_WORDS = ["index", "overview", "introduction", "getting-started"]
LOW_PRIORITY_WORDS = ["appendix", "reference", "changelog", "history"]
# exclude patterns of the default profile
DEFAULT_EXCLUDE_PATTERNS = [r".*#.*", r".*/search\.html", r".*/genindex\.html"]
# schemes whose unparse form carries "//" even with an empty host
NETLOC_SCHEMES = ["http", "https", "ftp", "ws", "wss", "file", "sftp", "git"]
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a lambda
    variable, so a sub-expression used many times is not re-inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_url(url) -> Column:
    """Leading control/space characters and embedded tab/CR/LF are dropped
    before parsing, as URL parsers do."""
    u = _c(url)
    return F.regexp_replace(F.regexp_replace(u, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def url_part(url, part: str) -> Column:
    idx = {"scheme": 1, "netloc": 2, "path_params": 3, "query": 4, "fragment": 5}[part]
    return F.regexp_extract(clean_url(url), URL_SPLIT, idx)


def url_scheme(url) -> Column:
    return F.lower(url_part(url, "scheme"))


def url_netloc(url) -> Column:
    return url_part(url, "netloc")


def url_path(url) -> Column:
    """Path without ``;params`` of the last segment (params live only there)."""
    return F.regexp_replace(url_part(url, "path_params"), r";[^/]*$", "")


def url_host(url) -> Column:
    """Lower-case host: netloc without user info and port."""
    return F.lower(F.regexp_extract(url_netloc(url), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))


def has_netloc(url) -> Column:
    return F.regexp_extract(clean_url(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(//)", 1) != ""


def normalize_url(url) -> Column:
    """Dedup key. Lower-case scheme and netloc; path ``rstrip('/')`` unless it is
    exactly ``/``; params, query and fragment dropped. ``http://h`` and ``http://h/``
    remain distinct keys."""
    return let(parse_url(url), _normalize_parts)


def _normalize_parts(p: Column) -> Column:
    scheme, netloc, path = p["scheme"], F.lower(p["netloc"]), p["path"]
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    with_netloc = p["has_auth"] | scheme.isin(NETLOC_SCHEMES)
    path = F.when(with_netloc & (path != "") & ~path.startswith("/"),
                  F.concat(F.lit("/"), path)).otherwise(path)
    body = F.when(with_netloc, F.concat(F.lit("//"), netloc, path)).otherwise(path)
    return F.when(scheme != "", F.concat(scheme, F.lit(":"), body)).otherwise(body)


def md_path(url) -> Column:
    """Relative Markdown file path mirroring the URL path (host not included)."""
    p0 = url_path(url)

    def strip_ext(p):
        return (F.when(p.rlike(r"/index\.html?$"), F.regexp_replace(p, r"/index\.html?$", ""))
                # extension dropped only when the file name has a non-dot char before it
                .when(p.rlike(r"[^/.][^/]*\.html?$"), F.regexp_replace(p, r"\.html?$", ""))
                .otherwise(p))

    def to_file(p):
        return (F.when((p == "") | (p == "/"), F.lit("index.md"))
                .otherwise(F.concat(F.regexp_replace(F.regexp_replace(p, "^/+", ""),
                                                     PATH_BAD_CHARS, "_"), F.lit(".md"))))

    stripped = let(p0, lambda x: F.regexp_replace(F.when(x == "", F.lit("/")).otherwise(x), "/+$", ""))
    return let(let(stripped, strip_ext), to_file)


def fallback_name(url, prefix: str = "page_", ext: str = ".md") -> Column:
    """P8/P9 fallback: stable 5-digit name from the URL's md5."""
    n = F.pmod(F.conv(F.substring(F.md5(_c(url)), 1, 8), 16, 10).cast("long"), F.lit(100000))
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), 5, "0"), F.lit(ext))


def md_path_or_fallback(url) -> Column:
    """P7, or the P8 name for a URL that cannot be split: one bracket of an IPv6 host without the other."""
    host = F.regexp_extract(_c(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    broken = host.contains("[") != host.contains("]")
    return F.when(broken, fallback_name(url)).otherwise(md_path(url))


# --------------------------------------------------------------------------
# Resolve a reference against a base URL (urljoin semantics)
# --------------------------------------------------------------------------

# fixed values: schemes that resolve relative references / carry a netloc
RELATIVE_SCHEMES = ["", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https",
                    "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn",
                    "svn+ssh", "ws", "wss"]

_PARTS = (r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$")


def parse_url(url) -> Column:
    """Struct of URL parts: scheme (lower), has_auth, netloc, path (no params),
    params, query, fragment. Empty strings for absent parts."""
    def parts(u):
        raw_path = F.regexp_extract(u, _PARTS, 4)
        return F.struct(
            F.lower(F.regexp_extract(u, _PARTS, 1)).alias("scheme"),
            (F.regexp_extract(u, _PARTS, 2) != "").alias("has_auth"),
            F.regexp_extract(u, _PARTS, 3).alias("netloc"),
            F.regexp_replace(raw_path, r";[^/]*$", "").alias("path"),
            F.regexp_extract(raw_path, r";([^/]*)$", 1).alias("params"),
            F.regexp_extract(u, _PARTS, 6).alias("query"),
            F.regexp_extract(u, _PARTS, 8).alias("fragment"),
        )
    return let(clean_url(url), parts)


def unparse_url(scheme, netloc, path, params, query, fragment) -> Column:
    """Inverse of ``parse_url`` for schemes with a netloc; empty parts dropped."""
    p = F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    p = F.when(params != "", F.concat(p, F.lit(";"), params)).otherwise(p)
    out = F.concat(scheme, F.lit("://"), netloc, p)
    out = F.when(query != "", F.concat(out, F.lit("?"), query)).otherwise(out)
    return F.when(fragment != "", F.concat(out, F.lit("#"), fragment)).otherwise(out)


def _fold_dots(segs) -> Column:
    res = F.aggregate(
        segs, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.array_append(acc, s)))
    last = F.element_at(segs, -1)
    res = F.when(last.isin(".", ".."), F.array_append(res, F.lit(""))).otherwise(res)
    out = F.array_join(res, "/")
    return F.when(out == "", F.lit("/")).otherwise(out)


# a plain absolute path: no dot segments, query, fragment, params or control chars
_PLAIN_ABS_PATH = r"^/(?!/)(?:[^/?#;\t\r\n.]|\.(?![./]|$)|\.\.(?=[^/]))*(?:/(?:(?!\.\.?(?:/|$))[^/?#;\t\r\n]*))*$"


def origin_of(url) -> Column:
    """``scheme://netloc`` of a URL (scheme lower-cased), '' when either is missing."""
    p = parse_url(url)
    return F.when((p["scheme"] != "") & (p["netloc"] != ""),
                  F.concat(p["scheme"], F.lit("://"), p["netloc"])).otherwise(F.lit(""))


def resolve_url(base, ref, origin=None) -> Column:
    """Absolute URL of ``ref`` (stripped) seen from page ``base``;
    NULL for an empty reference. References with another scheme are kept as-is.

    ``origin`` (from ``origin_of(base)``, computed once per page) enables the
    fast path for plain absolute paths, the common case of navigation links."""
    r = F.regexp_replace(_c(ref), r"^\s+|\s+$", "")
    v = F.struct(parse_url(base).alias("b_parts"), parse_url(r).alias("r_parts"), r.alias("ref"))
    general = let(v, lambda x: _resolve_parts(x["b_parts"], x["r_parts"], x["ref"]))
    if origin is None:
        return general
    o = _c(origin)
    fast = o.rlike(r"^https?://") & r.rlike(_PLAIN_ABS_PATH)
    return F.when(fast, F.concat(o, r)).otherwise(general)


def _merge_segments(B: Column, R: Column) -> Column:
    # base directory + relative segments, empty middle segments dropped
    bseg = F.split(B["path"], "/", -1)
    bdir = F.when(F.element_at(bseg, -1) != "", F.slice(bseg, F.lit(1), F.size(bseg) - 1)).otherwise(bseg)
    merged = F.concat(bdir, F.split(R["path"], "/", -1))

    def squeeze(m):
        n = F.size(m)
        return F.when(n <= 2, m).otherwise(F.concat(
            F.slice(m, 1, 1), F.filter(F.slice(m, F.lit(2), n - 2), lambda s: s != ""), F.slice(m, n, 1)))
    return let(merged, squeeze)


def _resolve_parts(B: Column, R: Column, r: Column) -> Column:
    scheme = F.when(R["scheme"] != "", R["scheme"]).otherwise(B["scheme"])
    segs = F.when(R["path"].startswith("/"), F.split(R["path"], "/", -1)).otherwise(_merge_segments(B, R))
    path = let(segs, _fold_dots)
    return (
        F.when(r == "", F.lit(None).cast("string"))
        .when((scheme != B["scheme"]) | ~scheme.isin(RELATIVE_SCHEMES[1:]), r)
        .when(R["has_auth"] & (R["netloc"] != ""),
              unparse_url(scheme, R["netloc"], R["path"], R["params"], R["query"], R["fragment"]))
        .when((R["path"] == "") & (R["params"] == ""),
              unparse_url(scheme, B["netloc"], B["path"], B["params"],
                          F.when(R["query"] != "", R["query"]).otherwise(B["query"]), R["fragment"]))
        .otherwise(let(path, lambda pth: unparse_url(scheme, B["netloc"], pth, R["params"], R["query"],
                                                      R["fragment"]))))


# --------------------------------------------------------------------------
# Scope filters
# --------------------------------------------------------------------------

def allowed_prefix(url, prefix) -> Column:
    """case-sensitive prefix test on the raw URL; blank prefix allows all."""
    p = _c(prefix) if not isinstance(prefix, str) else F.lit(prefix)
    return F.when(F.coalesce(p, F.lit("")) == "", F.lit(True)).otherwise(_c(url).startswith(p))


def path_slash_count(url) -> Column:
    u = _c(url)
    return F.length(u) - F.length(F.replace(u, F.lit("/"), F.lit("")))


def link_priority(url, link_text) -> Column:
    """10 + (slashes - 3); high keyword -5, else low keyword +5; floor 0."""
    t = F.lower(F.coalesce(_c(link_text), F.lit("")))
    high = F.lit(False)
    for w in HIGH_PRIORITY_WORDS:
        high = high | F.contains(t, F.lit(w))
    low = F.lit(False)
    for w in LOW_PRIORITY_WORDS:
        low = low | F.contains(t, F.lit(w))
    base = F.lit(10) + path_slash_count(url) - F.lit(3)
    adj = F.when(high, F.lit(-5)).when(low, F.lit(5)).otherwise(F.lit(0))
    return F.greatest(F.lit(0), base + adj).cast("int")


def keyword_class(link_text) -> Column:
    t = F.lower(F.coalesce(_c(link_text), F.lit("")))
    high = F.lit(False)
    for w in HIGH_PRIORITY_WORDS:
        high = high | F.contains(t, F.lit(w))
    low = F.lit(False)
    for w in LOW_PRIORITY_WORDS:
        low = low | F.contains(t, F.lit(w))
    return F.when(high, F.lit("high")).when(low, F.lit("low")).otherwise(F.lit("none"))
