"""Line dedup by pairwise alignment.

Lines are hashed, and every line names the shortest run of lines of MIN_WORDS words or
more that begins there, and the shortest that ends there: any block that is long enough
to be deleted is covered by such runs. A run that several documents hold names its
earliest holder as the partner of each later one, however many hold it, so frequent
lines need no cap, and a group of any size gives one alignment per later document and
earliest holder, never all pairs. Rarer runs tell a document's other partners apart.
A document and a partner are aligned with patience diff: lines that are unique in both
anchor the longest increasing chain, and equal lines around an anchor join its block.
What is left is aligned again, so that moved blocks are found; passages that hold no
line unique on both sides are then found as runs of lines that stand in both.
Aligned common blocks of at least MIN_WORDS words are deleted from the later document.
So a line goes exactly if a run of lines around it, of MIN_WORDS words or more, stands
in an earlier document as well.

Defined results: lines are split at \\n; a line without a word is never counted, matched
or deleted; null and empty texts have no lines; texts of any length are hashed and
aligned whole; the earlier document is the one of the smaller doc_id, a null doc_id
coming last, and of the smaller text hash among equals; rows that repeat a doc_id and
text are one document and are cleaned alike; an empty table gives no rows; input columns
named n_lines, n_removed or removed are replaced, others are returned as they are.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenery.llm.common import SPACE, SPACES, discard, materialise

#: Blocks of fewer words are too short to be a passage and stay.
MIN_WORDS = 5
#: Parts into which the later documents of one partner are dealt for alignment.
PARTS = 64


def _chain(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The longest chain, rising in both, of places of lines that are unique in both: piles by binary search."""
    na, nb = Counter(a), Counter(b)
    at = {x: i for i, x in enumerate(a) if na[x] == 1}
    anchors = [(at[x], j) for j, x in enumerate(b) if nb[x] == 1 and x in at]
    tops: list[int] = []
    pile: list[int] = []
    back: list[int] = []
    for k, (i, _) in enumerate(anchors):
        p = bisect_left(tops, i)
        if p == len(tops):
            tops.append(i)
            pile.append(k)
        else:
            tops[p], pile[p] = i, k
        back.append(pile[p - 1] if p else -1)
    chain, k = [], pile[-1] if pile else -1
    while k >= 0:
        chain.append(anchors[k])
        k = back[k]
    return chain[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Aligned blocks (start in a, start in b, length) of two lists of line hashes.

    Equal heads and tails of a range are matched first, then the anchors; the ranges
    between anchors, where more lines may be unique, are aligned in the same way.
    """
    pairs: list[tuple[int, int]] = []
    ranges = [(0, len(a), 0, len(b))]
    while ranges:
        i, ie, j, je = ranges.pop()
        while i < ie and j < je and a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            pairs.append((ie, je))
        if i == ie or j == je:
            continue
        last = (i, j)
        for x, y in _chain(a[i:ie], b[j:je]):
            pairs.append((i + x, j + y))
            ranges.append((last[0], i + x, last[1], j + y))
            last = (i + x + 1, j + y + 1)
        if last != (i, j):
            ranges.append((last[0], ie, last[1], je))
    blocks: list[tuple[int, int, int]] = []
    for i, j in sorted(pairs):
        if blocks and (blocks[-1][0] + blocks[-1][2], blocks[-1][1] + blocks[-1][2]) == (i, j):
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def common_runs(a: list[int], b: list[int], words: list[int], least: int) -> set[int]:
    """Positions in b within any run of lines that stands somewhere in a too and holds at least `least` words.

    A suffix automaton of a gives for every place in b the longest run that ends there;
    the work is linear in both however often lines repeat.
    """
    after: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for x in a:
        new, p = len(after), last
        after.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and x not in after[p]:
            after[p][x] = new
            p = link[p]
        if p >= 0:
            q = after[p][x]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(after)
                after.append(dict(after[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and after[p].get(x) == q:
                    after[p][x] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    total = [0]
    for w in words:
        total.append(total[-1] + w)
    starts, state, n = [], 0, 0
    for j, x in enumerate(b):
        while state and x not in after[state]:
            state = link[state]
            n = length[state]
        state, n = (after[state][x], n + 1) if x in after[state] else (0, 0)
        starts.append(j + 1 - n if total[j + 1] - total[j + 1 - n] >= least else j + 1)
    found, first = set(), len(b)
    for j in range(len(b) - 1, -1, -1):
        first = min(first, starts[j])
        if first <= j:
            found.add(j)
        else:
            first = len(b)
    return found


def common_lines(a: list[int], b: list[int], words: list[int], least: int = MIN_WORDS) -> list[int]:
    """Positions in b of the lines in aligned blocks that hold at least `least` words.

    What is left of b is aligned again until nothing more is found, so blocks whose order
    differs between the two documents are found as well; then come runs without an anchor.
    A line that was found parts what stands before it from what stands after it.
    """
    found: set[int] = set()
    held = set(a)
    while True:
        rest: list = [(k,) if k in found else x for k, x in enumerate(b)]
        blocks = patience(a, rest)
        new = {k for _, j, n in blocks if sum(words[j : j + n]) >= least for k in range(j, j + n)}
        if not new and any(x in held for x in rest):
            new = common_runs(a, b, words, least) - found
        if not new:
            return sorted(found)
        found |= new


def _align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Later documents of a partner's part follow the partner's own row: each is aligned with that."""
    theirs: list[int] = []
    for batch in batches:
        rows = batch.to_pydict()
        ids, gone = [], []
        for key, lines, words in zip(rows["later"], rows["lines"], rows["words"], strict=True):
            if key is None:
                theirs = lines
                continue
            found = common_lines(theirs, lines, words)
            if found:
                ids.append(key)
                gone.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(gone, pa.list_(pa.int64()))], names=["later", "gone"])


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Adds a key that sorts as the documents do and tells equal ids with different texts apart."""
    place = F.coalesce(F.col(doc_id).cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)"), F.lit(str(2**64)).cast("decimal(20,0)"))
    return docs.withColumn("__key", F.concat_ws(":", F.lpad(place.cast("decimal(20,0)").cast("string"), 20, "0"), F.hex(F.xxhash64(text))))


def _runs(lines: str, words: str) -> Column:
    """Hashes of the shortest runs of MIN_WORDS words or more that begin or end at each line."""

    def shortest(i: Column, step: int) -> Column:
        out, total, run = F.lit(None).cast("long"), F.lit(0), []
        cases = []
        for k in range(MIN_WORDS):
            at = i + step * k
            inside = (at >= 0) & (at < F.size(words))
            total = total + F.when(inside, F.get(words, at))
            run = [*run, F.get(lines, at)]
            cases.append((total >= MIN_WORDS, F.xxhash64(*(run if step > 0 else run[::-1]))))
        for enough, value in reversed(cases):
            out = F.when(enough, value).otherwise(out)
        return out

    both = F.flatten(F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array(shortest(i, 1), shortest(i, -1))))
    return F.array_distinct(F.array_compact(both))


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document that loses lines: its key and the positions of those lines among its lines with words."""
    rows = _keyed(docs, doc_id, text)
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    rows = rows.select("__key", lines.alias("__lines")).where(F.size("__lines") > 0)
    rows = rows.select(
        "__key",
        F.transform("__lines", lambda x: F.xxhash64(x)).alias("lines"),
        F.transform("__lines", lambda x: F.size(F.split(F.btrim(x, F.lit(SPACE)), SPACES))).alias("words"),
    )
    hashed = materialise(rows.dropDuplicates(["__key"]), "lines-hashed")
    marks = hashed.select("__key", F.explode(_runs("lines", "words")).alias("run"))
    holders = marks.groupBy("run").agg(F.min("__key").alias("partner"), F.count(F.lit(1)).alias("df")).where("df > 1").drop("df")
    pairs = marks.join(holders, "run").where("__key > partner").select("partner", F.col("__key").alias("later")).distinct()
    # A partner's lines travel once for each of its PARTS of later documents, and a task streams through those.
    pairs = materialise(pairs.withColumn("part", F.pmod(F.xxhash64("later"), F.lit(PARTS)).cast("int")), "lines-pairs")
    heads = pairs.select("partner", "part").distinct().join(hashed.withColumnRenamed("__key", "partner"), "partner")
    heads = heads.select("partner", "part", F.lit(None).cast("string").alias("later"), "lines", "words")
    rest = pairs.join(hashed.withColumnRenamed("__key", "later"), "later").select("partner", "part", "later", "lines", "words")
    both = heads.unionByName(rest).repartition("partner", "part").sortWithinPartitions("partner", "part", F.col("later").asc_nulls_first())
    found = both.select("later", "lines", "words").mapInArrow(_align, "later string, gone array<long>")
    out = found.groupBy("later").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("removed"))
    out = materialise(out, "lines-removed")
    discard(hashed, pairs)
    return out


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Replaces the text by what is left of it, and adds n_lines, n_removed and removed, in place of columns of these names.

    n_lines counts lines with a word; removed lists the deleted ones by position among
    those. Other lines stay as they are, line breaks included.
    """
    docs = docs.drop("n_lines", "n_removed", "removed")
    rows = _keyed(docs, doc_id, text).join(removals(docs, doc_id, text).withColumnRenamed("later", "__key"), "__key", "left")
    rows = rows.withColumn("__all", F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    blank = lambda x: F.btrim(x, F.lit(SPACE)) == ""
    rows = rows.withColumn("removed", F.coalesce("removed", F.array().cast("array<long>")))
    worded = F.filter(F.transform("__all", lambda x, i: F.when(~blank(x), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("__worded", worded).withColumn("n_lines", F.size("__worded").cast("long"))
    rows = rows.withColumn("__gone", F.transform("removed", lambda k: F.get("__worded", k.cast("int"))))
    rows = rows.withColumn("n_removed", F.size("removed").cast("long"))
    # Positions in order let the lines that stay be taken slice by slice between deleted ones.
    edges = F.concat(F.array(F.lit(-1)), F.col("__gone"), F.array(F.size("__all")))
    rows = rows.withColumn("__edges", edges)
    parts = F.transform(
        F.filter(F.sequence(F.lit(1), F.size("__edges") - 1), lambda k: F.get("__edges", k) - F.get("__edges", k - 1) > 1),
        lambda k: F.array_join(F.slice("__all", F.get("__edges", k - 1) + 2, F.get("__edges", k) - F.get("__edges", k - 1) - 1), "\n"),
    )
    kept = F.when(F.size("removed") == 0, F.col(text)).otherwise(F.array_join(parts, "\n"))
    return rows.withColumn(text, kept).drop("__key", "__all", "__worded", "__gone", "__edges")
