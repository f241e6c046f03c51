"""Images of pages into their Markdown.

A first pass over the pages gives their images, these meet the asset table, and each
page gets back one map from the sources it names to the new ones. The maps meet the
pages before parsing, on ``page_id``: html is shuffled at most once, parsed nodes never.
A URL that a third of all images name is one hot key of the asset join; assets are
unique by URL, so AQE splits it. Odd input: a page without images, without html or
without a content root has no images and keeps its Markdown; of repeated asset URLs the
least row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.functions import urls as U
from mdloom.operators import html as H
from mdloom.operators import images as IM
from mdloom.plans import corpus as C
from mdloom.sources.pages import read_table


def content_images(pages: DataFrame, content_selector=H.DEFAULT_CONTENT_SELECTOR) -> DataFrame:
    """H6 + P3: pages(page_id, url, html) → page_id, img_id, src, alt, abs_url of the images of the cleaned content."""
    docs = C.documents(H.parse_pages(pages.select("page_id", "url", "html")), content_selector)
    img = docs.select("page_id", "url", F.explode(H.images(F.col("kept"))).alias("i"))
    return img.select("page_id", "i.img_id", "i.src", "i.alt", U.resolve_url(F.col("url"), F.col("i.src")).alias("abs_url"))


def one_per_url(assets: DataFrame) -> DataFrame:
    """The asset table with one row per URL."""
    cols = [c for c in assets.columns if c != "url"]
    return assets.groupBy("url").agg(F.min(F.struct(*cols)).alias("a")).select("url", "a.*")


def documents_with_images(pages: DataFrame, assets: DataFrame, content_selector=H.DEFAULT_CONTENT_SELECTOR,
                          image_dir: str = IM.DEFAULT_IMAGE_DIR, download_images: bool = True) -> DataFrame:
    """H7 with new sources: the columns of ``documents`` and images_downloaded and
    images_failed of each page (both 0 where downloading is off)."""
    manifest = IM.image_manifest(content_images(pages, content_selector), one_per_url(assets), image_dir)
    new = IM.image_rewrite(manifest, download_images)
    maps = IM.page_image_map(new).join(new.groupBy("page_id").agg(
        F.count_if(F.col("counted") == "downloaded").alias("images_downloaded"),
        F.count_if(F.col("counted") == "failed").alias("images_failed")), "page_id")
    parsed = H.parse_pages(pages.select("page_id", "url", "html").join(maps, "page_id", "left"))
    docs = C.documents(parsed, content_selector, src_map="src_map")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("images_downloaded", "images_failed")]
    return docs.select("page_id", "url", "md_path", "status", "markdown", *zero)


# ---------------------------------------------------------------- registered queries
#: The pages hold no images: each gets some at the head of its article, ``@`` standing for its id, and a shared one.
SOURCES = ["/img/logo @.png", "shots/pic-@.v2.png", "https://cdn.example.net/a/b-@.svg?x=1", "//cdn.example.net/shared.gif", "data:image/png;base64,AAAA",
           "", "../up/@.webp", "/img/.hidden-@", "https://cdn.example.net/dir-@/"]
CONTENT_TYPES = ["image/png", "IMAGE/JPEG", "image/gif", "image/svg+xml", "image/webp", "image/png; charset=x", "text/html"]


def pages_with_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page but each tenth with the image that its id picks, twice, and the shared one."""
    pid = F.col("page_id")
    src = F.replace(F.get(F.array(*[F.lit(s) for s in SOURCES]), (pid % len(SOURCES)).cast("int")), F.lit("@"), pid.cast("string"))
    imgs = F.concat(F.lit('<article><p><img src="'), src, F.lit('" alt="one"><img src="'), src, F.lit('"><img alt="all" src="//cdn.example.net/shared.gif"></p>'))
    html = F.when(pid % 10 == 0, F.col("html")).otherwise(F.replace("html", F.lit("<article>"), imgs))
    return read_table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"))


def derived_assets(images: DataFrame) -> DataFrame:
    """What a fetcher would have stored: status, type and size of each URL by its digest; one in eight was never fetched."""
    part = lambda i: F.conv(F.substring(F.md5("abs_url"), i, 4), 16, 10).cast("long")
    urls = images.select("abs_url").distinct().where(part(1) % 8 != 0)
    kind = F.get(F.array(*[F.lit(c) for c in CONTENT_TYPES]), (part(9) % len(CONTENT_TYPES)).cast("int"))
    return urls.select(F.col("abs_url").alias("url"), F.when(part(5) % 6 == 0, 404).otherwise(200).alias("status"), kind.alias("content_type"),
                       F.when(part(13) % 5 == 0, IM.MAX_IMAGE_BYTES + 1).otherwise(part(13)).cast("long").alias("bytes"))


def q_image_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome, local path and new source of every image."""
    images = content_images(pages_with_images(spark, sf_dir))
    m = IM.image_rewrite(IM.image_manifest(images, derived_assets(images)))
    return m.select("page_id", "src", "alt", "abs_url", "outcome", "local_path", "new_src", "counted")


def q_image_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of the pages with the new sources, and the image counters."""
    pages = pages_with_images(spark, sf_dir)
    d = documents_with_images(pages, derived_assets(content_images(pages)))
    return d.select("page_id", "markdown", "images_downloaded", "images_failed")
