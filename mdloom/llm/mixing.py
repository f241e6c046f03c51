"""Mixing sources to target weights by Sainte-Lague apportionment (operator 2).

All steps are DataFrame operations.

1. Each document's size is its number of words; each source's target is its
   weight's share of all sizes, at most ``most_passes`` times its own size, the
   excess reshared by weight (water filling, in closed form by a window over the sources).
2. The mix is cut into about ``BLOCKS`` blocks of equal length. Blocks are
   given to sources by the highest quotients target / (2k + 1) (Sainte-Lague).
   Consecutive blocks make a shard, so each shard has an integer quota per
   source, and the sums over shards stay apportioned.
3. Each source's documents, in a seeded order, are a stream of words cut into
   blocks of that length. Shards draw the blocks of their quota one after the
   other along a seeded permutation of the stream's blocks, which starts again once all
   are drawn: the running sums of a source's quotas say which shard makes a draw.
   A document is taken with the words it has in drawn blocks, once per draw;
   ``shard_words`` tells how many of them each shard takes.

``as_mixed`` returns whole documents: shares taken of them are rounded without
bias, so that each source keeps its sum (see ``rounded``).

The stream order of a source is numbered by range partitions and offsets, so a
source that holds a third of all rows spans many tasks. The number of sources
is taken to be far smaller than that of documents; quotients are BLOCKS + 16 per source at most.

Results for odd input: null and empty texts have size 0 and are taken with 0; a
null source is a source of its own, last in order; null doc_ids and repeated
rows are documents like others (equal rows are taken in an order that repeats,
with equal outcomes up to their place in the stream); a source without words has
target 0; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mdloom.llm.common import WORD, load, text_key, whole_row, written
from mdloom.operators.order import ranked

BLOCKS = 1 << 17
SHARDS = 64
SEED = 17
PASSES = 3
#: Multipliers of the seeded permutation: primes, of which the first that does not divide the number of blocks is used.
PRIMES = (1_000_003, 2_147_483_647)
#: Shares of documents are summed as whole numbers of 2**-ONE_BITS, so that every task gets the same sums.
ONE_BITS = 20
ONE = 1 << ONE_BITS
#: Stands for a null doc_id in joins.
NO_ID = -(1 << 63)


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, tkey and size (words of the text)."""
    return docs.select("doc_id", "source", text_key().alias("tkey"),
                       F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))


def targets(sizes: DataFrame, weight: Column | None = None, passes: int = PASSES) -> DataFrame:
    """source, source_size, weight, target. ``weight`` may use ``rank``, the source's place by code point (nulls last)."""
    weight = (F.col("rank") % 3 + 1) if weight is None else weight
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranks = (by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
             .withColumn("weight", weight.cast("double")).withColumn("cap", (F.col("source_size") * passes).cast("double")))
    # sources in order of cap/weight: those in front reach their cap, the rest share what is left
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    front = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(front), F.lit(0.0))) / F.sum("weight").over(rest))
    leveled = ranks.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") < F.col("cap"))
    # the level at the first source that stays below its cap holds for all behind it
    settled = leveled.withColumn("settled", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(
        fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return settled.select("source", "source_size", "rank", "weight", F.when(
        F.col("settled").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("settled") * F.col("weight"))).alias("target"))


def block_length(blocks: int) -> Column:
    """Words per block, over the rows of the sources."""
    shares = Window.partitionBy()
    return F.greatest(F.ceil(F.sum("target").over(shares) / F.greatest(F.lit(blocks), 16 * F.count(F.lit(1)).over(shares))), F.lit(1))


def quotas(goal: DataFrame, blocks: int = BLOCKS, shards: int = SHARDS) -> DataFrame:
    """(source, rank, shard, quota): blocks each shard draws from each source, by the highest quotients."""
    total = F.sum("target").over(Window.partitionBy())
    seats = (goal.withColumn("n", F.round(total / block_length(blocks)).cast("long")).withColumn("share", F.when(total > 0, F.col("target") / total).otherwise(F.lit(0.0)))
             .where(F.col("share") > 0)
             .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("share") * F.col("n")) + 1))))
    order = Window.orderBy(F.col("quotient").desc(), "rank")
    drawn = (seats.select("source", "rank", "n", (F.col("share") / (2 * F.col("k") + 1)).alias("quotient"))
             .withColumn("seat", F.row_number().over(order) - 1).where(F.col("seat") < F.col("n")))
    per_shard = F.ceil(F.col("n") / shards)
    return drawn.withColumn("shard", F.floor(F.col("seat") / per_shard)).groupBy("source", "rank", "shard").agg(F.count(F.lit(1)).alias("quota"))


def mixed(sizes: DataFrame, weight: Column | None = None, blocks: int = BLOCKS, seed: int = SEED, passes: int = PASSES,
          shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """The documents with source_size, target, taken and draws (shard and words of each draw), and the table of quotas per shard."""
    table = written(sizes, "mix-sizes")
    goal = written(targets(table, weight, passes), "mix-targets")
    per_shard = written(quotas(goal, blocks, shards), "mix-quotas")
    # a source's draws are numbered through its shards: each ends where the running sum of quotas does
    sums = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    drawn = (per_shard.withColumn("end", F.sum("quota").over(sums)).groupBy("rank")
             .agg(F.max("end").alias("quota"), F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends")))
    plan = (goal.withColumn("length", block_length(blocks)).join(drawn, "rank", "left")
            .withColumn("blocks", F.greatest(F.ceil(F.col("source_size") / F.col("length")), F.lit(1)))
            .withColumn("quota", F.least(F.coalesce("quota", F.lit(0)), F.col("blocks") * passes))
            .withColumn("step", F.when(F.col("blocks") % PRIMES[0] != 0, F.lit(PRIMES[0])).otherwise(F.lit(PRIMES[1])) % F.col("blocks"))
            .withColumn("shift", F.pmod(F.xxhash64("rank", F.lit(seed)), F.col("blocks")))
            .select("rank", F.col("source").alias("of"), "source_size", "target", "length", "blocks", "quota", "ends", "step", "shift"))
    # numbering joins on its group columns, so a null source is told by a flag
    marked = table.withColumns({"mark": F.xxhash64("doc_id", "tkey", F.lit(seed)), "named": F.coalesce("source", F.lit("")), "nameless": F.col("source").isNull()})
    stream = ranked(marked, ["named", "nameless"], ["mark", "doc_id", "tkey"],
                    seq_col="place", sum_cols={"upto": "size"})
    rows = stream.join(plan, F.col("source").eqNullSafe(F.col("of")))
    start = F.col("upto") - F.col("size")
    first, last = F.floor(start / F.col("length")), F.floor((F.col("upto") - 1) / F.col("length"))

    def draws_of(b: Column) -> Column:
        place = (b * F.col("step") + F.col("shift")) % F.col("blocks")
        inside = F.least(F.col("upto"), (b + 1) * F.col("length")) - F.greatest(start, b * F.col("length"))
        turns = F.floor((F.col("quota") - 1 - place) / F.col("blocks"))  # the last pass in which the block is drawn
        return F.when(place < F.col("quota"), F.transform(F.sequence(F.lit(0).cast("long"), turns), lambda k: F.struct(
            shard_at(k * F.col("blocks") + place).alias("shard"), inside.cast("long").alias("words"))))

    def shard_at(draw: Column) -> Column:
        return F.element_at("ends", F.size(F.filter("ends", lambda e: e["end"] <= draw)) + 1)["shard"]

    draws = F.when((F.col("size") > 0) & (F.col("quota") > 0), F.flatten(F.filter(
        F.transform(F.sequence(first, last), draws_of), lambda x: x.isNotNull())))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda acc, d: acc + d["words"])
    return (rows.withColumn("draws", draws)
            .select("doc_id", "tkey", "source", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"), "draws"), per_shard)


def shard_words(found: DataFrame) -> DataFrame:
    """(shard, source, doc_id, words): the words that each shard takes of each document, repeats counted."""
    return (found.withColumn("draw", F.explode("draws")).groupBy("draw.shard", "source", "doc_id", "tkey")
            .agg(F.sum("draw.words").alias("words")).drop("tkey"))


def rounded(found: DataFrame) -> DataFrame:
    """(_id, _tkey, _of, _rows, _times): how often the mix takes each document whole.

    Equal rows of a source are one document with ``_rows`` rows. Along each source's documents in the
    order of their sizes, the share taken / size is summed up from a seeded start, and a document is
    taken once for each whole number that the sum passes. So each is taken its share on average, rounded
    up or down, and the words of a source differ from those taken by less than two of its longest documents.
    """
    share = F.round(F.col("t").cast("double") / F.col("size") * ONE).cast("long")
    units = (found.where("size > 0").groupBy("doc_id", "tkey", "source").agg(F.sum("taken").alias("t"), F.first("size").alias("size"), F.count(F.lit(1)).alias("_rows"))
             .withColumns({"share": share, "mark": F.xxhash64("doc_id", "tkey", F.lit(SEED)), "named": F.coalesce("source", F.lit("")), "nameless": F.col("source").isNull()}))
    along = ranked(units, ["named", "nameless"], ["size", "mark", "doc_id", "tkey"], seq_col="place", sum_cols={"upto": "share"})
    upto = F.col("upto") + F.pmod(F.xxhash64("named", "nameless", F.lit(SEED)), F.lit(ONE))
    return along.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.col("tkey").alias("_tkey"), F.col("source").alias("_of"), "_rows",
                        (F.shiftright(upto, ONE_BITS) - F.shiftright(upto - F.col("share"), ONE_BITS)).cast("int").alias("_times")).where("_times > 0")


def as_mixed(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """The rows of docs, each 0 to PASSES times, so that the words of each source come to those taken."""
    found, _ = mixed(sizes_of(docs), weight)
    times = written(rounded(found), "mix-times")
    # a row travels whole as one struct, so its columns may have any names
    keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), text_key().alias("_tkey"), "source", whole_row(docs))

    def emitted(rows: DataFrame, n: Column) -> DataFrame:
        return (rows.withColumn("_n", n.cast("int")).where("_n > 0").withColumn("_pass", F.explode(F.sequence(F.lit(1), F.col("_n"))))
                .select("row.*"))

    def joined(part: DataFrame) -> DataFrame:
        return keyed.join(part.withColumnsRenamed({"_id": "_i", "_tkey": "_t"}),
                          (F.col("_id") == F.col("_i")) & (F.col("_tkey") == F.col("_t")) & F.col("source").eqNullSafe(F.col("_of")))

    uneven = times.where(F.col("_times") % F.col("_rows") != 0)
    if uneven.isEmpty():
        return emitted(joined(times), F.col("_times") / F.col("_rows"))
    # of equal rows, the first _times % _rows are taken once more
    even = emitted(joined(times.where(F.col("_times") % F.col("_rows") == 0)), F.col("_times") / F.col("_rows"))
    row = joined(uneven).withColumns({"_mark": F.xxhash64("row"), "_o": F.coalesce("_of", F.lit("")), "_null": F.col("_of").isNull()})
    placed = ranked(row, ["_id", "_tkey", "_o", "_null"], ["_mark"], seq_col="_place")
    return even.unionByName(emitted(placed, F.floor(F.col("_times") / F.col("_rows")) + (F.col("_place") <= F.col("_times") % F.col("_rows")).cast("int")))


def q_op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = mixed(sizes_of(load(spark, sf_dir, "documents")))
    return docs.select("doc_id", "size", "source_size", "target", "taken")
