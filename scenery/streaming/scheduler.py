"""The scheduler's statistics as keyed state of a stream: increments and totals, batch after batch.

A question's task is that of its first row, so questions, not tasks, decide where rows go: they
are dealt into buckets, and a bucket's state maps a task to its totals. A task with most of all
rows is thus spread over all buckets. The state holds a row per bucket and task and no question.
Each micro-batch is one update: a question in two of them counts in both, so files (or whatever
the source's unit is) hold whole questions. Batches may be cut anywhere between questions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

SUMS = ("total", "valid", "n", "acc_sum", "scheduler_acc_sum")
SUMS_TYPE = "total long, valid long, n double, acc_sum double, scheduler_acc_sum double"
ROWS = "uid string, pos long, task string, is_valid boolean, accuracy double, duplicate_weight double, is_padding boolean"
OUT = "bucket int, task string, " + ", ".join(f"{p}{f}" for p in ("new_", "") for f in SUMS_TYPE.split(", "))
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def increments(rows: pd.DataFrame, targets: dict[str, float]) -> pd.DataFrame:
    """What rows of whole questions add to each task: SUMS by task.

    `total` and `valid` count rows by their own type, in lower case and without outer blanks. The
    others weigh a question by at least 1, as its first row says: its mean accuracy, in which
    invalid rows are 0 and rows without accuracy don't count, as it is and as a share of the
    task's target. Padding rows count for the first two only; a null task is '', which, like
    `unknown`, has no questions; null weights are 1, other nulls false.
    """
    valid = rows["is_valid"].eq(True)
    task = rows["task"].fillna("")
    kind = task.map({t: t.lower().strip() for t in task.unique()})
    counters = pd.DataFrame({"total": 1, "valid": valid.astype(int)}).groupby(kind).sum()
    live = rows[~rows["is_padding"].eq(True)].sort_values("pos", kind="stable")
    accuracy = live["accuracy"].where(live["is_valid"].eq(True), 0.0)
    # Questions are numbered as they come, so their first rows are in the order of their numbers.
    question, _ = pd.factorize(live["uid"], use_na_sentinel=False)
    first = live[~pd.Series(question, index=live.index).duplicated()]
    one = pd.DataFrame({"task": first["task"].fillna("").str.strip(), "w": first["duplicate_weight"].fillna(1.0).clip(lower=1.0)}).reset_index(drop=True)
    one["acc"] = accuracy.groupby(question).mean()
    one = one[one["acc"].notna() & ~one["task"].isin(["", "unknown"])]
    share = (one["acc"].clip(0, 1) / one["task"].map(targets).fillna(1.0)).clip(0, 1)
    sums = pd.DataFrame({"n": one["w"], "acc_sum": one["acc"] * one["w"], "scheduler_acc_sum": share * one["w"]}).groupby(one["task"]).sum()
    return counters.join(sums, how="outer").reindex(columns=SUMS).fillna(0.0)


class Scheduler(StatefulProcessor):
    """Adds a micro-batch's increments to its bucket's map of totals."""

    def __init__(self, targets: dict[str, float]) -> None:
        self.targets = targets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getMapState("totals", "task string", SUMS_TYPE)

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for task, add in increments(pd.concat(list(rows), ignore_index=True), self.targets).iterrows():
            new = [int(add[c]) if c in ("total", "valid") else float(add[c]) for c in SUMS]
            old = self.totals.getValue((task,)) if self.totals.containsKey((task,)) else (0, 0, 0.0, 0.0, 0.0)
            now = tuple(a + b for a, b in zip(old, new, strict=True))
            self.totals.updateValue((task,), now)
            out.append((key[0], task, *new, *now))
        if out:
            yield pd.DataFrame(out, columns=["bucket", "task", *[f"new_{c}" for c in SUMS], *SUMS])

    def close(self) -> None:
        pass


def tracked(rows: DataFrame, targets: dict[str, float], buckets: int = 64) -> DataFrame:
    """A stream of ROWS as a stream of OUT, in update mode: a row per bucket and task that a micro-batch touched."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").transformWithStateInPandas(Scheduler(targets), OUT, "Update", "none")


def follow(spark: SparkSession, path: str, out: str, checkpoint: str, targets: dict[str, float], buckets: int = 64, files: int = 1000) -> StreamingQuery:
    """Starts on, or goes on with, the Parquet files of ROWS that arrive in a folder, `files` at a time, until none is left.

    Each micro-batch writes its rows to a folder of its own below `out`, over what an attempt that
    was lost left there; nothing that is written before is rewritten. Both paths, and the
    checkpoint, lie in storage that all executors share.
    """
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", files).parquet(path)
    write = lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/batch={k}")
    name, provider = _PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)  # the query keeps its own copy of the settings
    try:
        query = tracked(stream, targets, buckets).writeStream.outputMode("update").foreachBatch(write)
        return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def statistics(spark: SparkSession, out: str, by_increments: bool = False) -> DataFrame:
    """SUMS of each task, from the last totals of every bucket or, to the same end, from all increments."""
    rows = spark.read.schema(f"{OUT}, batch long").option("basePath", out).parquet(out)
    if by_increments:
        return rows.groupBy("task").agg(*[F.sum(f"new_{c}").alias(c) for c in SUMS])
    last = rows.groupBy("bucket", "task").agg(F.max_by(F.struct(*SUMS), "batch").alias("s"))
    return last.groupBy("task").agg(*[F.sum(f"s.{c}").alias(c) for c in SUMS])
