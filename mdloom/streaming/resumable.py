"""Streams that stop and go on: pages not seen before (T1, T3) and failed attempts
flagged as they arrive (T2), both over ``KeyedState``.

Every sink writes ``batch=<id>`` folders, so a batch that ran before a crash and runs
again after it leaves the same rows. ``crash_at`` loses the driver after the writes of
that batch and before its commit; tests and the restart queries use it.
"""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdloom.operators.attempts import DEFAULT_SKIP_AFTER, auto_skip
from mdloom.streaming.keyed_state import KeyedState


class Crash(RuntimeError):
    """The loss of the driver between a batch's writes and its commit."""


def _run(stream: DataFrame, sink, checkpoint: str, crash_at: int | None) -> bool:
    """Run to the end of what is there; False if the crash came first."""
    def step(batch: DataFrame, batch_id: int) -> None:
        sink(batch, batch_id)
        if batch_id == crash_at:
            raise Crash(f"batch {batch_id}")
    q = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    except StreamingQueryException as e:
        if crash_at is None or "Crash" not in str(e):
            raise
        return False
    return True


def run_new_pages(stream: DataFrame, base: str, key: str = "url_key", order: str = "page_id", crash_at: int | None = None, **state) -> bool:
    """Of the pages whose key no earlier batch holds, the least by ``order`` → base/out/batch=<id>."""
    seen = KeyedState(f"{base}/seen", key, ["n"], **state)
    ddl = f"{key} {stream.schema[key].dataType.simpleString()}"

    def sink(batch: DataFrame, batch_id: int) -> None:
        cols = [c for c in batch.columns if c != key]
        first = batch.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("r"), F.count(F.lit(1)).alias("n"))
        old = seen.below(batch.sparkSession, batch_id, ddl, seen.touched(batch)).select(F.col(key).alias("old"))
        fresh = first.join(old, F.col(key).eqNullSafe(F.col("old")), "left_anti")
        fresh.select(key, "r.*").write.mode("overwrite").parquet(f"{base}/out/batch={batch_id:010d}")
        seen.write(batch_id, batch.groupBy(key).agg(F.count(F.lit(1)).alias("n")), ddl)
    return _run(stream, sink, f"{base}/checkpoint", crash_at)


def run_auto_skip(stream: DataFrame, base: str, url: str = "url_id", skip_after: int = DEFAULT_SKIP_AFTER, crash_at: int | None = None, **state) -> bool:
    """attempts(attempt_id, url, ts, failed) → base/out/batch=<id>: number of the
    attempt within its URL, failures before it and whether it was to be skipped. Inside a
    batch attempts count in time order (a hot URL spans tasks, ``operators.order``), batches
    in theirs. Only sums per URL are kept."""
    totals = KeyedState(f"{base}/totals", url, ["failures", "attempts"], **state)
    ddl = f"{url} {stream.schema[url].dataType.simpleString()}"

    def sink(batch: DataFrame, batch_id: int) -> None:
        old = totals.below(batch.sparkSession, batch_id, ddl, totals.touched(batch)).withColumnRenamed(url, "old")
        # as a struct the missing URL is a key like the others
        flagged = auto_skip(batch.withColumn("url_key_", F.struct(url)), "url_key_", skip_after=skip_after).drop("url_key_")
        j = flagged.join(old, F.col(url).eqNullSafe(F.col("old")), "left")
        prior = F.col("prior_failures") + F.coalesce("failures", F.lit(0))
        out = j.select("attempt_id", url, "failed", (F.col("attempt_no") + F.coalesce("attempts", F.lit(0))).alias("attempt_no"),
                       prior.alias("prior_failures"), (prior >= skip_after).alias("skipped"))
        out.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id:010d}")
        totals.write(batch_id, batch.groupBy(url).agg(F.count_if("failed").alias("failures"), F.count(F.lit(1)).alias("attempts")), ddl)
    return _run(stream, sink, f"{base}/checkpoint", crash_at)
