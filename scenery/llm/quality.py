"""Quality rules: robust multivariate outliers among the documents of a language and source.

Every document gets a vector of four transformed statistics. Within each language
and source the minimum-covariance-determinant estimate (location and scatter of the
tightest share of the vectors) is found by concentration steps, and documents far
from it in Mahalanobis distance are rejected. Steps go on from several starts until no
group's determinant falls any more; the tightest end is taken. All of it is DataFrame
operations: one pass over the texts, then passes over four numbers per document.

Defined results: a null or empty text has no words and fails the base rule; a text of
any length is read whole; null languages and sources are groups of their own; groups
with too few documents are judged by their language's pooled estimate, then by all
documents'; with too few documents in all, only the base rule speaks. A document at the
cutoff is kept; of equally tight ends the first start's is taken; rows at the same
distance are in or out of the tightest share together; repeated rows are judged alike
and each counts in the estimates. Input columns named as the statistics, distance or
kept are replaced, others are returned as they are; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenery.llm.common import SPACE, chi_square, discard, materialise, nullable_key, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Up to so many repeated windows are looked up one by one; the result is the same either way.
FEW = 40

#: Smallest scatter of each statistic; a statistic that hardly varies must not reject on trifles. On the angular scale
#: a share out of n varies by 1 / (2 sqrt n): 0.1 is that of 25 lines or words, fewer than the offsets below leave.
FLOORS = (0.06, 0.08, 0.10, 0.10)
P = len(FLOORS)
X = [f"x{i}" for i in range(P)]
CELLS = [(i, j) for i in range(P) for j in range(i + 1)]


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    out = docs.withColumns({"__w": words_of(F.col(text)), "__lines": lines}).withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.char_length(F.array_join("__w", "")).cast("long"),
            "n_symbols": (F.char_length(body) - F.char_length(F.regexp_replace(body, f"[{SYMBOLS}]", ""))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__h": F.when(
                F.size("__w") >= 3,
                F.transform(F.sequence(F.lit(0), F.size("__w") - 3), lambda i: F.xxhash64(*[F.get("__w", i + k) for k in range(3)])),
            ).otherwise(F.array().cast("array<long>")),
        }
    )
    # Texts without equal windows need no more. Else the hashes found twice, by sorting.
    out = out.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array("__h")))
    twice = F.array_distinct(F.filter("__s", lambda h, i: (i > 0) & (h == F.get("__s", i - 1))))
    out = out.withColumn("__twice", F.when(F.size("__s") > 0, twice))
    few = F.filter(F.transform("__h", lambda h, i: F.when(F.array_contains("__twice", h), i)), lambda i: i.isNotNull())
    out = out.withColumn("__starts", F.when(F.size("__twice") <= FEW, few))
    # With many of them, windows sorted by hash, where equal ones are neighbours, and back into order.
    out = out.withColumn("__p", F.when(F.size("__twice") > FEW, F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda k, d: F.coalesce(F.get("__p", k)["h"] == F.get("__p", k + d)["h"], F.lit(False))
    marked = F.filter("__p", lambda v, k: same(k, 1) | ((k > 0) & same(k, -1)))
    many = F.sort_array(F.transform(marked, lambda v: v["i"]))
    out = out.withColumn("__starts", F.when(F.size("__p") > 0, many).otherwise(F.col("__starts")))
    covered = F.aggregate(
        F.col("__starts"),
        F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(3), i - a["at"])).alias("n")),
        lambda a: a["n"],
    )
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("__w", "__lines", "__h", "__s", "__twice", "__p", "__starts")


def vector() -> dict[str, Column]:
    """Mean word length on a log scale, and three shares on the angular scale.

    The angular scale keeps a share of nought at nought whatever the length; the
    added 10 lines and 100 words keep one repeat in a short text from standing out.
    """
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), a / F.greatest(b, F.lit(1.0)))))
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "x0": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "x1": share(F.col("n_symbols"), F.col("word_chars").cast("double")),
        "x2": share(F.col("n_dup_lines"), F.col("n_lines") + 10.0),
        "x3": share(F.col("n_repeat_words"), F.col("n_words") + 100.0),
    }


def _groups(rows: DataFrame, lang: Column, source: Column) -> DataFrame:
    return rows.withColumns({"__lang": nullable_key(lang), "__source": nullable_key(source)})


def _levels(rows: DataFrame, least: int) -> DataFrame:
    """The group each language and source is judged in; one row per language and source."""
    n = rows.groupBy("__lang", "__source").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("n_lang", F.sum("n").over(Window.partitionBy("__lang")))
    return n.select(
        "__lang",
        "__source",
        F.when(F.col("n") >= least, F.concat_ws("\x1f", "__lang", "__source")).when(F.col("n_lang") >= least, F.col("__lang")).otherwise("").alias("grp"),
    )


def _starts(rows: DataFrame) -> DataFrame:
    """Three starting estimates per group: medians with interquartile scatters, medians with the floors, and plain moments."""
    long = rows.select("grp", F.posexplode(F.array(*X)).alias("k", "x")).select("grp", "k", F.round(F.col("x") * 500).cast("long").alias("b"))
    w = Window.partitionBy("grp", "k").orderBy("b")
    cum = long.groupBy("grp", "k", "b").agg(F.count(F.lit(1)).alias("n")).select(
        "grp", "k", "b", F.sum("n").over(w).alias("c"), F.sum("n").over(Window.partitionBy("grp", "k")).alias("n")
    )
    at = lambda q: F.min(F.when(F.col("c") >= q * F.col("n"), F.col("b"))) / 500.0
    q = cum.groupBy("grp", "k").agg(at(0.5).alias("m"), ((at(0.75) - at(0.25)) / 1.349).alias("s"))
    wide = q.groupBy("grp").agg(*[F.max(F.when(F.col("k") == i, F.col(c))).alias(f"{c}{i}") for c in "ms" for i in range(P)])
    one = lambda start, s: wide.select(
        "grp", F.lit(start).alias("start"), *[f"m{i}" for i in range(P)], *[(s(i) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in CELLS]
    )
    plain = rows.groupBy("grp").agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(X)], *[F.covar_pop(X[i], X[j]).alias(f"c{i}{j}") for i, j in CELLS]).withColumn("start", F.lit(2))
    return one(0, lambda i: F.pow(F.col(f"s{i}"), 2)).unionByName(one(1, lambda i: F.lit(FLOORS[i] ** 2))).unionByName(plain)


def _factor(estimates: DataFrame) -> DataFrame:
    """Replaces the scatter by the rows of its Cholesky factor, and adds the log of its determinant."""
    low: dict[tuple[int, int], Column] = {}
    for i, j in CELLS:
        rest = F.col(f"c{i}{j}") + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        low[i, j] = F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 * 1e-3))) if i == j else rest / F.col(f"l{j}{j}")
        estimates = estimates.withColumn(f"l{i}{j}", low[i, j])
    logdet = sum((F.log(F.col(f"l{i}{i}")) * 2 for i in range(P)), F.lit(0.0))
    return estimates.withColumn("logdet", logdet).drop(*[f"c{i}{j}" for i, j in CELLS])


def _distance() -> Column:
    """The squared Mahalanobis distance, by forward substitution."""
    y: list[Column] = []
    for i in range(P):
        rest = F.col(X[i]) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * y[j]
        y.append(rest / F.col(f"l{i}{i}"))
    return sum((v * v for v in y), F.lit(0.0))


def _concentrate(rows: DataFrame, estimates: DataFrame, keep: float) -> DataFrame:
    """One concentration step: the moments of the share of rows nearest to each estimate.

    Distances are counted in narrow bins with the moments of each bin, so a group of
    any size comes down to a few hundred rows before anything is put in order.
    """
    near = rows.join(estimates, "grp").withColumn("d2", _distance())
    bins = near.groupBy("grp", "start", F.floor(F.log2(F.col("d2") + 1e-3) * 16).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s_{x}") for x in X], *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"p{i}{j}") for i, j in CELLS]
    )
    up = Window.partitionBy("grp", "start").orderBy("bin")
    moments = ["n", *[f"s_{x}" for x in X], *[f"p{i}{j}" for i, j in CELLS]]
    cum = bins.select("grp", "start", "bin", *[F.sum(c).over(up).alias(c) for c in moments], F.sum("n").over(Window.partitionBy("grp", "start")).alias("all"))
    cut = cum.where(F.col("n") >= keep * F.col("all")).groupBy("grp", "start").agg(F.min_by(F.struct(*moments, F.col("all").alias("size"), F.pow(F.lit(2.0), (F.col("bin") + 1) / 16).alias("edge")), "bin").alias("v"))
    cut = cut.select("grp", "start", "v.*")
    mean = [F.col(f"s_{x}") / F.col("n") for x in X]
    return cut.select(
        "grp", "start", "edge", "size", *[mean[i].alias(f"m{i}") for i in range(P)], *[(F.col(f"p{i}{j}") / F.col("n") - mean[i] * mean[j]).alias(f"c{i}{j}") for i, j in CELLS]
    )


def estimate(statistics: DataFrame, lang: str = "lang", source: str = "source", steps: int = 30, keep: float = 0.7, level: float = 0.99999, least: int = 100) -> DataFrame:
    """One row per language and source: the estimate its documents are judged by, and the cutoff."""
    rows = _groups(statistics.where("n_words > 0"), F.col(lang), F.col(source)).withColumns(vector())
    rows = materialise(rows.select("__lang", "__source", *X), "quality-vectors")
    levels = materialise(_levels(rows, least), "quality-levels")
    pools = levels.select("__lang", "__source", F.explode(F.array_distinct(F.array("grp", F.lit("")))).alias("grp"))
    pools = pools.unionByName(levels.select("__lang", "__source", F.col("__lang").alias("grp"))).distinct()
    used = levels.select("grp").distinct()
    rows = rows.join(pools.join(used, "grp", "left_semi"), ["__lang", "__source"])
    now = materialise(_factor(_starts(rows)), "quality-start")
    spread = None
    for _ in range(steps):
        last, now = now, materialise(_factor(_concentrate(rows, now, keep)), "quality-step")
        discard(last)
        # A concentration step never widens the share it settles on; where none narrows it, all are settled.
        before, spread = spread, now.agg(F.sum("logdet")).first()[0]
        if spread is None or (before is not None and spread >= before - 1e-9 * abs(before)):
            break
    best = Window.partitionBy("grp").orderBy("logdet", "start")
    now = now.withColumn("__k", F.row_number().over(best)).where("__k = 1")
    # The scatter of the nearest share is too small for all; its edge tells by how much.
    scale = F.greatest(F.lit(1.0), F.col("edge") / F.lit(chi_square(P, keep)))
    now = now.withColumn("cutoff", scale * F.lit(chi_square(P, level)))
    now = now.where(F.col("size") >= least).drop("__k", "start", "logdet", "edge", "size")
    return materialise(levels.join(now, "grp").drop("grp"), "quality-estimates")


def judge(statistics: DataFrame, estimates: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Adds distance (null where no estimate applies) and kept."""
    rows = _groups(statistics, F.col(lang), F.col(source)).withColumns(vector())
    out = rows.join(estimates, ["__lang", "__source"], "left")
    out = out.withColumn("distance", F.sqrt(_distance()))
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("distance") > F.sqrt("cutoff"), F.lit(False))
    return out.withColumn("kept", kept).drop(*X, "__lang", "__source", "cutoff", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in CELLS])


def clean(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """The documents that the rules keep, with the columns of the input.

    The statistics are written beside the documents, so that the texts are read once and
    the verdict is a filter on what was written.
    """
    columns = docs.columns
    own = docs.select(F.struct(*[F.col(c) for c in columns]).alias("__row"), F.col(lang).alias("__row_lang"), F.col(source).alias("__row_source"), F.col(text).alias("__text"))
    statistics = materialise(base_statistics(own, "__text").drop("__text"), "quality-rows")
    judged = judge(statistics, estimate(statistics.drop("__row"), "__row_lang", "__row_source"), "__row_lang", "__row_source")
    return judged.where("kept").select("__row.*")
