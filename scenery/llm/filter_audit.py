"""Filter interaction audit: what five filters do to every part of a corpus, in each of their 120 orders.

Every document gets a mask of the filters it fails. Per part (a source) the documents are
counted by mask: all of them, those labelled good and those labelled toxic. These counts
are the rows of a matrix of 32 columns, and integer matrices of 32 rows and 600 columns
(an order of the filters and a step of it) hold which masks are kept after the step, are
removed at it, fail its filter but were removed earlier, or fail its filter alone. Four
products give all 600 rows of a part, however many documents it has.

A filter that looks at other documents (E, equal texts) is settled before counting: rows
are first added up by text digest, id, part and mask, so that copies and repeated rows
collapse in the tasks that read them; the smallest id of each digest comes from these sums
and is joined back by digest and id, so that no group of copies meets in one task.

Defined results: a null text is empty; words are runs of other than white space; a text of
any length is read whole; the digest is SHA-256; an empty text fails A only (0 words is
under 200, and 0 is not less than 50 times 0), and E where a smaller id has an empty text;
rows of the smallest doc_id of a text are not copies of each other, later ids are; a null
doc_id is smaller than none and larger than none, so that such a row is no copy and has no
labels; labels that repeat a doc_id count as good or toxic if one of them does; a null
source is the part of the empty string; other columns, whatever their names, are not read;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenery.llm.common import words_of

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = [(order, step) for order in ORDERS for step in range(len(FILTERS))]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
ROW = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
#: Parts that are multiplied and given out together: 600 rows each.
PARTS = 64


def own_mask(text: Column) -> Column:
    """Bits 0 to 3: filters A to D, which look at the text alone."""
    whole = F.coalesce(text, F.lit(""))
    words = words_of(text)
    n = F.size(words)
    fails = [
        n < 200,
        100 * F.size(F.array_distinct(words)) < 50 * n,
        100 * (F.length(whole) - F.length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) > 2 * F.length(whole),
        F.length(F.translate(whole, "#$%&*|", "")) < F.length(whole),
    ]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0)).cast("int")


def matrices() -> dict[str, np.ndarray]:
    """Which masks count, per order and step: kept, removed, redundant, unique; and each filter's removals over all orders."""
    out = {name: np.zeros((MASKS, len(STEPS)), np.int64) for name in ("kept", "removed", "redundant", "unique")}
    for column, (order, step) in enumerate(STEPS):
        bit = 1 << FILTERS.index(order[step])
        earlier = sum(1 << FILTERS.index(f) for f in order[:step])
        for mask in range(MASKS):
            failed, gone = mask & bit > 0, mask & earlier > 0
            out["kept"][mask, column] = not failed and not gone
            out["removed"][mask, column] = failed and not gone
            out["redundant"][mask, column] = failed and gone
            out["unique"][mask, column] = mask == bit
    letter = np.array([FILTERS.index(order[step]) for order, step in STEPS])
    total = np.stack([out["removed"][:, letter == k].sum(1) for k in range(len(FILTERS))], 1)
    out["shapley"] = total[:, letter]
    return out


def masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows of (doc_id, part, mask, n): n documents of an id and a part that fail just the filters of the mask."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("part"), own_mask(F.col(text)).alias("own"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest")
    )
    added = rows.groupBy("digest", "doc_id", "part", "own").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = added.join(first, ["digest", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return marked.select("doc_id", "part", (F.col("own") + F.when(copy, 16).otherwise(0)).alias("mask"), "n")


def histograms(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per part and mask: documents, good ones and toxic ones."""
    known = labels.groupBy(F.col("doc_id").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = masks(docs, doc_id, text, source).join(known, "doc_id", "left")
    n = F.col("n")
    return rows.groupBy("part", "mask").agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good") == 1, n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic") == 1, n).otherwise(0)).alias("toxic"))


def _products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = matrices()
    orders, steps = [o for o, _ in STEPS], [s + 1 for _, s in STEPS]
    for whole in batches:
        for begin in range(0, whole.num_rows, PARTS):
            batch = whole.slice(begin, PARTS)
            parts = batch.column("part").to_pylist()
            rows = np.zeros((3, len(parts), MASKS), np.int64)
            for k, counts in enumerate(batch.column("counts").to_pylist()):
                for c in counts:
                    rows[:, k, c["mask"]] = c["n"], c["good"], c["toxic"]
            every, good, toxic = rows
            values = [every @ m["kept"], every @ m["removed"], every @ m["redundant"], every @ m["unique"], good @ m["removed"], toxic @ m["removed"], every @ m["shapley"]]
            columns = [pa.array(np.repeat(np.array(parts, object), len(STEPS)), pa.string()), pa.array(orders * len(parts)), pa.array(steps * len(parts), pa.int32()), *[pa.array(v.ravel()) for v in values]]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *COUNTS])


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per part, order and step (1 to 5); a part's counts are 32 short rows at most."""
    counts = histograms(docs, labels, doc_id, text, source)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    return parts.mapInArrow(_products, ROW)
