"""What prompts say of the labels a scene or an image shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenery.operators.lookup import anchors


def label_context(counts: DataFrame, *keys: str) -> DataFrame:
    """Adds context: usable labels with their numbers, then the unique and the repeated ones; counts has label and n."""
    own = anchors(counts)
    line = F.concat("label", F.when(F.col("n") == 1, " (unique)").otherwise(F.concat(F.lit(" (x"), F.col("n").cast("string"), F.lit(")"))))
    listed = lambda pool, c: F.array_join(F.transform(F.array_sort(pool), lambda x: x[c]), ", ")
    pairs = own.groupBy(*keys).agg(F.collect_list(F.struct("label", line.alias("line"), "n")).alias("p"))
    some = lambda test: F.coalesce(F.nullif(listed(F.filter("p", test), "label"), F.lit("")), F.lit("none"))
    text = F.concat(F.lit("Visible labels: "), listed(F.col("p"), "line"), F.lit(".\nUnique labels: "), some(lambda x: x["n"] == 1), F.lit(".\nRepeated labels: "), some(lambda x: x["n"] > 1), F.lit("."))
    return pairs.select(*keys, text.alias("context"))


def examples(labels: DataFrame, keys: list[str], template: str, n: int, seed: int) -> DataFrame:
    """Adds example, a template with {1}, {2} and so on replaced by labels of the group, drawn by a seeded hash; smaller groups are left out."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], "label"))
    pool = labels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order.alias("k"), "label"))).alias("p")).where(F.size("p") >= n)
    text = F.lit(template)
    for i in range(n):
        text = F.replace(text, F.lit("{%d}" % (i + 1)), F.get("p", F.lit(i))["label"])
    return pool.select(*keys, text.alias("example"))
