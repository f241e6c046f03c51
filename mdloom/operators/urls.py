"""URL table operators: validation verdicts (F1-F4), first-wins dedup (W2/G2),
path collisions (W3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mdloom.functions import patterns as P
from mdloom.functions import urls as U


def url_verdict(url: Column, is_duplicate: Column, allowed_prefix: str | Column,
                patterns: list[str]) -> Column:
    """ordered verdict struct(verdict, reason):
    empty → duplicate → domain → pattern → valid."""
    hit = P.first_match(url, P.compiled(patterns))
    prefix = F.lit(allowed_prefix) if isinstance(allowed_prefix, str) else allowed_prefix
    verdict = (F.when(F.coalesce(url, F.lit("")) == "", F.lit("empty"))
               .when(is_duplicate, F.lit("duplicate"))
               .when(~U.allowed_prefix(url, prefix), F.lit("domain"))
               .when(hit.isNotNull(), F.lit("pattern"))
               .otherwise(F.lit("valid")))
    reason = (F.when(verdict == "domain", prefix)
              .when(verdict == "pattern", hit))
    return F.struct(verdict.alias("verdict"), reason.alias("reason"))


def dedup_first(df: DataFrame, key: str = "url_key", order: list[str] | None = None) -> DataFrame:
    """One row per key, the first by ``order`` (default page_id) wins, plus the
    number of variants. Aggregate with ``min_by`` — partial aggregation before the
    shuffle, so a hot key costs one row per map task, not all its rows."""
    order = order or ["page_id"]
    ord_col = F.struct(*[F.col(c) for c in order])
    other = [c for c in df.columns if c != key]
    agg = df.groupBy(key).agg(
        F.min_by(F.struct(*[F.col(c) for c in other]), ord_col).alias("_w"),
        F.count(F.lit(1)).alias("n_variants"))
    return agg.select(key, *[F.col("_w")[c].alias(c) for c in other], "n_variants")


def mark_duplicates(df: DataFrame, key: str = "url_key", order: str = "page_id") -> DataFrame:
    """Flag every row whose key already appeared earlier in ``order`` (join of the
    per-key first position; no window over a possibly hot key)."""
    first = df.groupBy(key).agg(F.min(order).alias("_first"))
    return df.join(first, key).withColumn("is_duplicate", F.col(order) != F.col("_first")).drop("_first")


def path_collisions(df: DataFrame, path_col: str = "md_path", order: str = "page_id") -> DataFrame:
    """Per output path, how many pages write it and which one wins (last
    write in crawl order)."""
    return (df.groupBy(path_col)
            .agg(F.count(F.lit(1)).alias("n_pages"), F.max(order).alias("winner_page_id"),
                 F.min(order).alias("first_page_id"))
            .where(F.col("n_pages") > 1))
