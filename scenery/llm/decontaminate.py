"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

Test items are partitioned by size: an item of n distinct five-word shingles is in the
class of log2 n, an item of one to four words, which is a single shingle of all its
words, in a class for its number of words. An item's MinHash sketch is its
n - ceil(t n) + 1 smallest shingle hashes: a document that holds at least the share t
of the item must share one of them, so the search loses nothing. Every class has its
own threshold, the largest value in its sketches, and its own least size; a document
looks up, class by class, the hashes below that class's threshold if it is long enough
for the class. The shingles of the documents that were found are then counted exactly
against the items', as words and not as hashes.

Defined results: words are runs of letters, marks and digits in lower case; null,
empty and wordless texts have no shingles and are in no pair; a document of any length
is searched whole, and its shingles are rows of their own when they are counted; an
item that is held to exactly the share asked for counts as held; repeated documents or
items each give their pairs once per doc_id, text and item_id; items with a null id are
one item if their texts are equal; other columns, whatever their names, are not read,
and `clean` returns them as they are; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenery.llm.common import materialise, packed, unpacked

WORDS = 5
PERCENT = 80
NO_ID = -(2**63)


def normal_words(text: Column) -> Column:
    """Runs of letters, marks and digits, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def _windows(words: str, size: int, whole: Column, each) -> Column:
    """What `each` makes of every window of so many words, from its first index on; none where there are too few."""
    n = F.size(words)
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), each)).otherwise(F.array().cast(whole))


def _hashes(words: str, size: int) -> Column:
    return _windows(words, size, "array<long>", lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))


def _shingles(words: str, size: int) -> Column:
    return F.array_distinct(_windows(words, size, "array<string>", lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(size)])))


def _by_size(words: str, of) -> Column:
    """Five-word windows, or the one window of all words where there are fewer."""
    out = of(words, WORDS)
    for size in range(1, WORDS):
        out = F.when(F.size(words) == size, of(words, size)).otherwise(out)
    return out


def sketches(items: DataFrame, percent: int = PERCENT, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per item: its distinct shingles, their number, the words of each, its size class and its sketch."""
    rows = items.select(F.col(item_id).alias("item_id"), normal_words(F.col(text)).alias("__w")).where(F.size("__w") > 0)
    rows = rows.select(
        "item_id", F.least(F.size("__w"), F.lit(WORDS)).alias("words"), _by_size("__w", _shingles).alias("shingles"), F.sort_array(F.array_distinct(_by_size("__w", _hashes))).alias("__h")
    ).distinct()
    n = F.size("shingles")
    need = F.floor((F.lit(percent) * n + 99) / 100).cast("int")
    size_class = F.when(F.col("words") < WORDS, F.col("words") - WORDS).otherwise(F.floor(F.log2(n.cast("double")))).cast("int")
    return rows.select("item_id", "words", "shingles", n.alias("n_item"), need.alias("need"), size_class.alias("size_class"), F.slice("__h", F.lit(1), n - need + 1).alias("sketch"))


def search(docs: DataFrame, items: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, list]:
    """Pairs of doc_id, the document's text hash and item_id that share a sketch value in a size class; the items; the classes."""
    index = materialise(sketches(items, percent), "decontaminate-items")
    limits = F.max(F.array_max("sketch")).alias("threshold"), F.min("need").alias("least")
    # One row per power of two of the items' sizes: some tens at most.
    classes = sorted(index.groupBy("size_class", "words").agg(*limits).collect(), key=lambda r: r["size_class"])
    values = materialise(index.select("item_id", "size_class", "need", F.explode("sketch").alias("h")), "decontaminate-sketches")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), normal_words(F.col(text)).alias("__w"))
    sizes = sorted({r["words"] for r in classes})
    rows = rows.where(F.size("__w") >= min([r["words"] + r["least"] - 1 for r in classes], default=1))
    rows = rows.select("doc_id", "text_hash", *[_hashes("__w", k).alias(f"__h{k}") for k in sizes])

    def low(r) -> Column:
        own = F.col(f"__h{r['words']}")
        found = F.transform(F.filter(own, lambda h: h <= r["threshold"]), lambda h: F.struct(F.lit(r["size_class"]).alias("size_class"), h.alias("h")))
        return F.when(F.size(own) >= r["least"], found).otherwise(F.array().cast("array<struct<size_class:int,h:bigint>>"))

    each = F.concat(*[low(r) for r in classes]) if classes else F.array().cast("array<struct<size_class:int,h:bigint>>")
    seen = rows.select("doc_id", "text_hash", *[f"__h{k}" for k in sizes], F.explode(each).alias("v")).select("doc_id", "text_hash", "v.*")
    # The sketch values are a table of known size: the planner broadcasts it below its threshold.
    pairs = seen.join(values, ["size_class", "h"]).select("doc_id", "text_hash", "item_id").distinct()
    return materialise(pairs, "decontaminate-pairs"), index, sizes


def contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and test item of which it holds at least the share asked for.

    A document's shingles are counted once, as rows, whatever the number of items it may hold.
    """
    pairs, index, sizes = search(docs, items, percent, doc_id, text)
    asked = pairs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__k"), "text_hash").distinct()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("__text")).withColumn("__k", F.coalesce("doc_id", F.lit(NO_ID)))
    held = rows.join(asked, ["__k", "text_hash"], "left_semi").dropDuplicates(["__k", "text_hash"]).withColumn("__w", normal_words(F.col("__text")))

    def marked(size: int) -> Column:
        return F.transform(_shingles("__w", size), lambda s: F.struct(F.lit(size).alias("words"), s.alias("shingle")))

    each = F.concat(*[marked(k) for k in sizes]) if sizes else F.array().cast("array<struct<words:int,shingle:string>>")
    held = held.select("doc_id", "text_hash", F.explode(each).alias("v")).select("doc_id", "text_hash", "v.*")
    wanted = index.select("item_id", "words", "n_item", "need", F.explode("shingles").alias("shingle"))
    both = held.join(wanted, ["words", "shingle"]).groupBy("doc_id", "text_hash", "item_id", "words", "n_item", "need").agg(F.count(F.lit(1)).alias("n_shared"))
    both = both.where("n_shared >= need").withColumn("n_item", F.col("n_item").cast("long"))
    return both.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"), "text_hash")


def clean(docs: DataFrame, items: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no test item, with the columns of the input."""
    bad = contaminated(docs, items, percent, doc_id, text).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__k"), F.col("text_hash").alias("__t")).distinct()
    bad = materialise(bad, "decontaminate-found")
    rows = packed(docs, F.coalesce(F.col(doc_id), F.lit(NO_ID)).alias("__k"), F.xxhash64(text).alias("__t"))
    return unpacked(rows.join(bad, ["__k", "__t"], "left_anti"))
