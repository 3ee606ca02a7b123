"""Votes over equal answers: answers of one value in several forms count as one.

Two answers are equal if their normal forms are: an exact rational number where the text is
one (integers, decimals, fractions, mixed numbers, powers of ten, signs, with a unit or a
currency or percent sign, which count for nothing), the normal forms of its parts for a list
in brackets, and else the text without mark-up, case and blanks. All answers that speak of
"no ..." are equal too. Classes are thus keys: votes are a partial aggregate, and only
distinct texts reach Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units that a number may carry, singular; an exponent may follow.
UNITS = "degree cm centimeter mm millimeter m meter metre km kilometer mile second minute hour day week month year foot feet inch yard kg gram g s"
#: Words for powers of ten.
SCALES = {"thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}
#: Longer exponents stay text: their numbers would not be short.
EXPONENT = 400

_PLAIN = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d*)?|\.\d+"
_FORM = re.compile(
    rf"(?P<sign>[+-]?)\s*(?:(?:(?P<whole>\d+)\s+(?:and\s+)?)?(?P<up>{_PLAIN})\s*/\s*(?P<down>{_PLAIN})"
    rf"|(?P<number>{_PLAIN})(?:\s*(?:e|[x*]\s*10\s*\^)\s*(?P<power>[+-]?\d+))?)"
    rf"\s*(?P<scale>{'|'.join(SCALES)})?s?\s*(?:(?:{'|'.join(UNITS.split())})(?:e?s)?(?:\^\d+)?)?"
)
_FRACTION = re.compile(r"\\[dt]?frac\s*(?:\{([^{}]*)\}|(\d))\s*(?:\{([^{}]*)\}|(\d))")
_MARKED = re.compile(r"\\(?:text|mathrm|mathbf|textbf|mbox)\s*\{([^{}]*)\}")
_DROPPED = re.compile(r"\\(?:left|right|[,;:! ])|\\?[$%]|\^\{?\\circ\}?|°")


def _number(text: str) -> Fraction | None:
    m = _FORM.fullmatch(text)
    if not m:
        return None
    exact = lambda s: Fraction(s.replace(",", "").rstrip(".") if not s.startswith(".") else "0" + s)
    if m["up"]:
        down = exact(m["down"])
        if not down:
            return None
        value = int(m["whole"] or 0) + exact(m["up"]) / down
    else:
        power = int(m["power"] or 0)
        if abs(power) > EXPONENT:
            return None
        value = exact(m["number"]) * Fraction(10) ** power
    return (-1 if m["sign"] == "-" else 1) * value * SCALES.get(m["scale"], 1)


def _parts(text: str) -> list[str]:
    """Cut at the commas outside brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def normal_form(text: str) -> str:
    """The same for equal answers: `=` and a reduced fraction for a number, brackets around the forms of a list, or bare text."""
    t = _DROPPED.sub("", text.replace("\u2212", "-")).lower()
    t = re.sub(r"\\(?:times|cdot)", "x", t)
    while (u := _MARKED.sub(r" \1 ", t)) != t:
        t = u
    while (u := _FRACTION.sub(lambda m: f" {m[1] or m[2] or ''}/{m[3] or m[4] or ''} ", t)) != t:
        t = u
    t = re.sub(r"\s+", " ", re.sub(r"10\^\{([+-]?\d+)\}", r"10^\1", t)).strip()
    t = re.sub(r"[.,;:!?]$", "", t).strip()
    t = re.sub(r"^([+-])\s+", r"\1", t)
    value = _number(t)
    if value is not None:
        return f"={value.numerator}/{value.denominator}"
    if len(t) > 2 and t[0] in "([" and t[-1] in ")]" and len(parts := _parts(t[1:-1])) > 1:
        return t[0] + ",".join(normal_form(p) for p in parts) + t[-1]
    return t.replace(" ", "")


def with_form(rows: DataFrame, answer: str, form: str = "form") -> DataFrame:
    """Adds the class of each answer: `no` for those that hold "no " in any case, else `:` and the normal form; null for null.

    Texts are brought to their form once each, however often they occur.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([":" + normal_form(t) for t in texts], pa.string())], names=["__a", "__f"])

    others = rows.select(F.col(answer).cast("string").alias("__a")).where(~F.lower("__a").contains("no ")).distinct()
    forms = others.mapInArrow(run, "__a string, __f string")
    joined = rows.join(forms, F.col(answer).cast("string") == F.col("__a"), "left")
    own = F.when(F.lower(F.col(answer).cast("string")).contains("no "), "no").otherwise(F.col("__f"))
    return joined.withColumn(form, own).drop("__a", "__f")


def majority(rows: DataFrame, key: str, pos: str, answer: str) -> DataFrame:
    """One row per question: key, answer, votes, and score, the share of the votes in all its responses.

    The answer is the first seen text of the largest class, of equal classes the one seen first.
    Null and empty answers have no vote but count as responses; a question with no others has
    the answer '' and 0. Ties at one position go to the lesser text.
    """
    r = with_form(rows.select(key, pos, F.nullif(F.col(answer).cast("string"), F.lit("")).alias("__t")), "__t", "__c")
    first = F.min(F.when(F.col("__t").isNotNull(), F.struct(F.col(pos).alias("pos"), F.col("__t").alias("t"))))
    classes = r.groupBy(key, "__c").agg(F.count(F.lit(1)).alias("__n"), first.alias("__first"))
    voted = F.col("__c").isNotNull()
    # The least of (-votes, first seen): structs without a vote are null and left out by min.
    best = F.min(F.when(voted, F.struct((-F.col("__n")).alias("n"), F.col("__first").alias("first"))))
    all_of = classes.groupBy(key).agg(best.alias("b"), F.sum("__n").alias("total"))
    votes = F.coalesce(-F.col("b.n"), F.lit(0)).cast("long")
    return all_of.select(key, F.coalesce("b.first.t", F.lit("")).alias("answer"), votes.alias("votes"), (votes / F.col("total")).alias("score"))


def same_answer(rows: DataFrame, predicted: str, truth: str, out: str = "same") -> DataFrame:
    """Whether two answers are equal: by case, blanks and a last stop, or by their values. False where one is missing or empty."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.btrim(F.col(c), F.lit(" \t\r\n\f\v"))), r"[.,;:!?]$", ""), r"\s+", " ")
    r = with_form(with_form(rows, predicted, "__p"), truth, "__q")
    by_value = F.col("__p").startswith(":=") & (F.col("__p") == F.col("__q"))
    there = (F.coalesce(F.col(predicted), F.lit("")) != "") & (F.coalesce(F.col(truth), F.lit("")) != "")
    return r.withColumn(out, there & F.coalesce((bare(predicted) == bare(truth)) | by_value, F.lit(False))).drop("__p", "__q")
