"""The scheduler's state over a stream: equal to the batch answer, also after an attempt that dies."""

import random

import pytest

from scenery.plans.q_batch import stream_files
from scenery.session import scratch
from scenery.streaming import scheduler

TARGETS = {"room_size": 0.5}


def _rows(seed, questions):
    r = random.Random(seed)
    out = []
    for u in questions:
        for i in range(r.randint(1, 6)):
            task = r.choice(["room_size", " object_counting", "object_counting", "unknown", "", None])
            out.append((f"u{u}", i, task, r.random() < 0.7, r.choice([None, -0.2, 0.3, 0.9, 1.4]), r.choice([0.0, 1.0, 3.0]), r.random() < 0.2))
    return out


def _whole(rows):
    """Totals by a loop over all rows, in order."""
    sums, questions = {}, {}
    for uid, _, task, valid, acc, weight, padding in rows:
        t = sums.setdefault((task or "").lower().strip(), [0, 0, 0.0, 0.0, 0.0])
        t[0] += 1
        t[1] += valid
        if padding:
            continue
        q = questions.setdefault(uid, [(task or "").strip(), max(1.0, weight), []])
        if not valid:
            q[2].append(0.0)
        elif acc is not None:
            q[2].append(acc)
    for task, w, accs in questions.values():
        if task in ("", "unknown") or not accs:
            continue
        mean = sum(accs) / len(accs)
        share = min(1.0, max(0.0, min(1.0, max(0.0, mean)) / TARGETS.get(task, 1.0)))
        for k, v in zip((2, 3, 4), (w, mean * w, share * w)):
            sums.setdefault(task, [0, 0, 0.0, 0.0, 0.0])[k] += v
    return sums


def test_stops_dies_and_goes_on(spark, monkeypatch):
    source, out, checkpoint = (scratch(spark, f"scheduler-{k}") for k in ("in", "out", "state"))
    first, second = _rows(1, range(60)), _rows(2, range(60, 140))
    spark.createDataFrame(first, scheduler.ROWS).repartition(1).write.parquet(source)
    scheduler.follow(spark, source, out, checkpoint, TARGETS, buckets=5).awaitTermination()
    spark.createDataFrame(second, scheduler.ROWS).repartition(2, "uid").write.mode("append").parquet(source)

    # The first attempt at the next batch dies in the state's task.
    broken = type("Broken", (scheduler.Scheduler,), {"handleInputRows": lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))})
    with monkeypatch.context() as m:
        m.setattr(scheduler, "Scheduler", broken)
        with pytest.raises(Exception, match="lost"):
            scheduler.follow(spark, source, out, checkpoint, TARGETS, buckets=5, files=1).awaitTermination()
    scheduler.follow(spark, source, out, checkpoint, TARGETS, buckets=5, files=1).awaitTermination()

    want = _whole(first + second)
    for by_increments in (False, True):
        got = {r["task"]: [r[c] for c in scheduler.SUMS] for r in scheduler.statistics(spark, out, by_increments).collect()}
        assert got.keys() == want.keys()
        for task, sums in want.items():
            assert got[task] == pytest.approx(sums), task


def test_files_and_micro_batches_grow_with_the_rows():
    """Small streams keep two files a half, one at a time; large ones more files, and micro-batches of bounded size."""
    assert stream_files(0) == stream_files(600_000) == stream_files(8_000_000) == (2, 1)
    assert stream_files(36_000_000) == (9, 5)
    for rows in (10**6, 10**8, 10**10):
        count, files = stream_files(rows)
        assert count * 2 * 2_000_000 >= rows and 1 <= files <= 8 and rows / 2 / count * files <= 16_000_000
