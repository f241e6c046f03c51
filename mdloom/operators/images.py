"""Image handling as a manifest join.

Downloading becomes a left join of the page's image URLs with an asset table
``(url, status, content_type, bytes)`` that a fetcher filled; the outcome and
the local file name are column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdloom.functions import urls as U
from mdloom.functions.urls import let

# --- fixed values: content type -> extension, size cap ----------------------
CONTENT_TYPE_EXT = {"image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif",
                    "image/svg+xml": ".svg", "image/webp": ".webp"}
DEFAULT_EXT = ".jpg"
MAX_IMAGE_BYTES = 10 * 1024 * 1024
DEFAULT_IMAGE_DIR = "images"
# -----------------------------------------------------------------------------


def image_url_valid(url) -> Column:
    """P10: scheme and network location both present."""
    p = U.parse_url(url)
    return (p["scheme"] != "") & (p["netloc"] != "")


def image_ext(content_type) -> Column:
    """Exact content-type match (Q17: parameters make it the default)."""
    ct = F.col(content_type) if isinstance(content_type, str) else content_type
    out = F.lit(DEFAULT_EXT)
    for t, e in reversed(list(CONTENT_TYPE_EXT.items())):
        out = F.when(ct == t, F.lit(e)).otherwise(out)
    return out


def image_filename(url, content_type) -> Column:
    """Basename without extension, ``[^\\w\\-.]`` → ``_`` (Unicode ``\\w``), plus the
    extension from the content type; a name that is empty or starts with '.' gets
    a stable ``image_NNNNN`` name instead."""
    u = F.col(url) if isinstance(url, str) else url
    ext = image_ext(content_type)
    base = F.regexp_extract(U.url_path(u), r"([^/]*)$", 1)

    def stem_of(b):
        # splitext: the last dot starts the extension unless the name is all dots before it
        stem = F.when(b.rlike(r"[^.]\.[^.]*$"), F.regexp_extract(b, r"^(.*)\.[^.]*$", 1)).otherwise(b)
        return F.struct(b.alias("b"), F.regexp_replace(stem, r"(?U)[^\w\-.]", "_").alias("s"))

    def pick(x):
        ok = (x["b"] != "") & ~x["b"].startswith(".") & (x["s"] != "")
        return F.when(ok, F.concat(x["s"], ext)).otherwise(F.concat(U.fallback_name(u, "image_", ""), ext))
    return let(let(base, stem_of), pick)


def image_manifest(images: DataFrame, assets: DataFrame, image_dir: str = DEFAULT_IMAGE_DIR) -> DataFrame:
    """S8 + P11: ``images(page_id, img_id, abs_url)`` ⋈ ``assets(url, status,
    content_type, bytes)`` → outcome and local path. A missing asset row is a
    failed download."""
    a = assets.select(F.col("url").alias("abs_url"), "status", F.lower("content_type").alias("content_type"), "bytes")
    j = images.join(a, "abs_url", "left")
    ok_url = image_url_valid(F.col("abs_url"))
    outcome = (F.when(~ok_url, F.lit("invalid_url"))
               .when(F.col("status").isNull(), F.lit("not_fetched"))
               .when((F.col("status") < 200) | (F.col("status") >= 300), F.lit("http_error"))
               .when(~F.coalesce(F.col("content_type"), F.lit("")).startswith("image/"), F.lit("not_image"))
               .when(F.col("bytes") > MAX_IMAGE_BYTES, F.lit("too_large"))
               .otherwise(F.lit("downloaded")))
    fname = image_filename(F.col("abs_url"), F.col("content_type"))
    return (j.withColumn("outcome", outcome)
            .withColumn("local_path", F.when(F.col("outcome") == "downloaded",
                                             F.concat(F.lit(f"./{image_dir}/"), fname))))


def image_rewrite(manifest: DataFrame, download_images: bool = True) -> DataFrame:
    """New ``src`` per image: the local path when downloaded, else the
    absolute URL; counters only move when downloading is enabled."""
    if not download_images:
        return manifest.withColumn("new_src", F.col("abs_url")).withColumn("counted", F.lit(None).cast("string"))
    return (manifest.withColumn("new_src", F.coalesce(F.col("local_path"), F.col("abs_url")))
            .withColumn("counted", F.when(F.col("local_path").isNotNull(), F.lit("downloaded"))
                        .otherwise(F.lit("failed"))))


def page_image_map(rewritten: DataFrame) -> DataFrame:
    """Per page ``MAP<src, new_src>`` for the Markdown renderer (bounded by the
    page's own image count)."""
    return rewritten.groupBy("page_id").agg(
        F.map_from_entries(F.collect_set(F.struct("src", "new_src"))).alias("src_map"))
