"""Which profiles a URL belongs to: joins on prefix lengths.

A profile's scope is a plain string prefix. Each URL is cut at the distinct lengths of the
prefixes (few numbers, whatever the number of profiles) and joined on (length, hash of the
cut), the prefix itself being compared behind. So there is no join on hosts, on which all pages of a big site would meet
all its profiles, and prefixes without a host work like any other. The empty prefix, which
every URL has, takes no part in the join: its profile is the default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scopes(urls: DataFrame, prefixes: DataFrame, url: str = "url", prefix: str = "prefix") -> DataFrame:
    """The rows of ``urls`` with the columns of each row of ``prefixes`` whose ``prefix`` is not blank and begins the URL."""
    named = prefixes.where(F.coalesce(prefix, F.lit("")) != "")
    lengths = sorted(r[0] for r in named.select(F.length(prefix)).distinct().collect())  # at most one per length of a prefix
    if not lengths:
        lengths = [1]
    cut = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(url))
    cuts = urls.withColumn("_cut", F.explode(cut)).withColumn("_key", F.xxhash64(F.substr(F.col(url), F.lit(1), F.col("_cut"))))
    keyed = named.withColumns({"_n": F.length(prefix), "_h": F.xxhash64(prefix)})
    joined = cuts.join(keyed, (F.col("_cut") == F.col("_n")) & (F.col("_key") == F.col("_h")))
    return joined.where(F.startswith(F.col(url), F.col(prefix))).drop("_cut", "_key", "_n", "_h")


def longest_scope(urls: DataFrame, prefixes: DataFrame, key: str, name: str, url: str = "url", prefix: str = "prefix") -> DataFrame:
    """(key, name, prefix) per row of ``urls`` (``key`` is unique): the profile ``name`` of the longest prefix; among
    equal prefixes the last name. A profile with a blank prefix takes what no other one does; else both are null."""
    best = (scopes(urls.select(key, url), prefixes.select(name, prefix), url, prefix)
            .groupBy(key).agg(F.max(F.struct(F.length(prefix).alias("n"), F.col(name).alias("name"), F.col(prefix).alias("prefix"))).alias("b")))
    blank = prefixes.where(F.coalesce(prefix, F.lit("")) == "").agg(F.max(name)).scalar()  # one value
    return (urls.select(key).join(best, key, "left")
            .select(key, F.coalesce("b.name", blank).alias(name), F.when(F.col("b.name").isNotNull(), F.col("b.prefix")).when(blank.isNotNull(), F.lit("")).alias(prefix)))
