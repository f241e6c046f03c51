"""The state log: merge on read, torn saves, compaction, replay and typed names."""

import random
import tempfile

from mdloom.sources import state_log as SL

ATT = "run_id string, url string, attempt_id long, failed boolean, ts timestamp"


def _attempts(spark, rows):
    from datetime import datetime
    return spark.createDataFrame([(*r, datetime(2024, 1, 1)) for r in rows], ATT)


def _save(spark, base, n, rows, header=True):
    att = _attempts(spark, rows)
    profiles = spark.createDataFrame([("007", "p", "c")], "run_id string, profile_id string, config_checksum string")
    delta, head = SL.changes(spark, base, att), SL.moved_headers(spark, base, att, profiles)
    if header:
        SL.write_save(base, n, delta, head)
    else:
        delta.write.mode("overwrite").parquet(f"{base}/delta/save={n:08d}")


def _state(spark, base, upto=None):
    return {(r.run_id, r.kind, r.key): r.value for r in SL.read_state(spark, base, upto).collect()}


def _plain(rows_by_save):
    state = {}
    for rows in rows_by_save:
        fetched = {}
        for run, url, aid, failed in rows:
            state[(run, "visited", url)] = 0
            if failed:
                state[(run, "failures", url)] = state.get((run, "failures", url), 0) + 1
            else:
                fetched[(run, url)] = min(aid, fetched.get((run, url), aid))
        for (run, url), aid in fetched.items():
            state.setdefault((run, "crawled", url), aid)
    return state


def test_saves_merge_and_compact(spark):
    base = tempfile.mkdtemp(prefix="mdloom-state-", dir="/tmp")
    assert SL.saves(spark, base) == [] and SL.read_state(spark, base).count() == 0 and SL.compact(spark, base) is None
    rng = random.Random(5)
    # one run makes a third of all attempts; null urls and runs are their own keys
    parts = [[(rng.choice(["007", "007", "7", "x", None]), rng.choice(["a", "b", "c", None]), 100 * n + i, rng.random() < 0.5) for i in range(20)] for n in range(4)]
    for n, rows in enumerate(parts):
        _save(spark, base, n, rows, header=n < 3)
        if n == 1:
            assert SL.compact(spark, base) == 1
    assert SL.saves(spark, base) == [0, 1, 2]
    assert _state(spark, base) == _plain(parts[:3])        # the torn save is not read
    assert _state(spark, base, upto=0) == _plain(parts[:1])
    assert _state(spark, base, upto=1) == _plain(parts[:2])
    _save(spark, base, 3, parts[3])                        # the save again, now whole
    assert _state(spark, base) == _plain(parts)
    heads = {r.run_id: (r.processed_count, r.failed_count, r.profile_id) for r in SL.read_headers(spark, base).collect()}
    flat = [r for p in parts for r in p]
    assert heads["007"] == (sum(r[0] == "007" for r in flat), sum(r[0] == "007" and r[3] for r in flat), "p") and heads["7"][2] is None
    assert heads[None][0] == sum(r[0] is None for r in flat)


def test_a_delta_holds_only_changes(spark):
    base = tempfile.mkdtemp(prefix="mdloom-state-", dir="/tmp")
    _save(spark, base, 0, [("007", "a", 1, True), ("007", "b", 2, False)])
    again = SL.changes(spark, base, _attempts(spark, [("007", "a", 3, True), ("007", "b", 4, False)]))
    assert [tuple(r) for r in again.collect()] == [("007", "failures", "a", 2)]
    _save(spark, base, 1, [])
    assert SL.saves(spark, base) == [0, 1] and len(_state(spark, base)) == 4
