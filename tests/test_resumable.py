"""Streams that stop, lose a run and go on, over keyed state in buckets."""

import random
import tempfile
from datetime import datetime, timedelta

from mdloom.operators.attempts import auto_skip
from mdloom.streaming import resumable as RS
from mdloom.streaming.keyed_state import KeyedState

DDL = "attempt_id long, url_id long, ts timestamp, failed boolean"


def _slices(spark, rows, ddl, base, run, lost):
    for n, part in enumerate(rows):
        spark.createDataFrame(part, ddl).write.mode("append").parquet(f"{base}/in")
        for crash_at in ([n, None] if n in lost else [None]):
            done = run(spark.readStream.schema(ddl).parquet(f"{base}/in"), crash_at)
            assert done == (crash_at is None)


def test_auto_skip_equals_the_batch_form(spark):
    base = tempfile.mkdtemp(prefix="mdloom-skip-", dir="/tmp")
    rng, t0 = random.Random(3), datetime(2024, 1, 1)
    # one URL makes a third of the attempts, some have no URL
    rows = [(i, rng.choice([1, 1, 1, 2, 3, 4, 5, 6, None]), t0 + timedelta(seconds=i // 2), rng.random() < 0.4) for i in range(240)]
    parts = [rows[:80], rows[80:82], rows[82:160], rows[160:]]
    _slices(spark, parts, DDL, base, lambda s, c: RS.run_auto_skip(s, base, crash_at=c, buckets=4, fold_every=2), lost={1, 3})
    got = {r.attempt_id: (r.attempt_no, r.prior_failures, r.skipped) for r in spark.read.parquet(f"{base}/out").collect()}
    fails, tries, want = {}, {}, {}
    for i, url, _ts, failed in rows:
        tries[url] = tries.get(url, 0) + 1
        want[i] = (tries[url], fails.get(url, 0), fails.get(url, 0) >= 5)
        fails[url] = fails.get(url, 0) + failed
    assert got == want and len(got) == 240
    batch = auto_skip(spark.createDataFrame([r for r in rows if r[1] is not None], DDL))
    assert {r.attempt_id: r.skipped for r in batch.collect()} == {r[0]: want[r[0]][2] for r in rows if r[1] is not None}


def test_new_pages_after_lost_runs(spark):
    base = tempfile.mkdtemp(prefix="mdloom-new-", dir="/tmp")
    parts = [[(1, "a"), (2, "a"), (3, "b"), (4, None)], [(0, "a"), (5, "c")], [(9, None), (6, "c"), (7, "d"), (8, "d")], [(10, "a")]]
    _slices(spark, parts, "page_id long, url_key string", base, lambda s, c: RS.run_new_pages(s, base, crash_at=c, buckets=4, fold_every=2), lost={0, 1, 2})
    got = sorted(((r.url_key, r.page_id) for r in spark.read.parquet(f"{base}/out").collect()), key=str)
    assert got == [("a", 1), ("b", 3), ("c", 5), ("d", 7), (None, 4)]


def test_a_batch_reads_only_its_buckets(spark):
    base = tempfile.mkdtemp(prefix="mdloom-keys-", dir="/tmp")
    state = KeyedState(base, "k", ["n"], buckets=16)
    state.write(0, spark.range(1000).selectExpr("cast(id as string) k", "id n"), "k string")
    batch = spark.createDataFrame([("5",)], "k string")
    touched = state.touched(batch)
    old = state.below(spark, 1, "k string", touched)
    files = {f.split("bucket=")[1].split("/")[0] for f in old.inputFiles()}
    scans = [line for line in old._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in line]
    assert len(touched) == 1 and files and any("bucket" in s.split("PartitionFilters")[1] for s in scans)
    assert 0 < old.count() < 200 and old.where("k = '5'").collect()[0].n == 5
    assert state.below(spark, 0, "k string").count() == 0     # nothing lies below the first batch
