"""Text functions as columns: labels, answers, tags, numbers and directions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that mean a direction, and the six directions.
DIRECTION_ALIASES = {
    "behind": "back",
    "backward": "back",
    "backwards": "back",
    "rear": "back",
    "forward": "front",
    "forwards": "front",
    "ahead": "front",
    "above": "up",
    "below": "down",
}
DIRECTIONS = ("left", "right", "front", "back", "up", "down")
# Number words.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBER_WORDS = {w: i for i, w in enumerate(UNITS)} | {w: 20 + 10 * i for i, w in enumerate(TENS)}
NUMBER = r"[-+]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][-+]?\d+)?"


def normalise_label(c: Column) -> Column:
    """Lower case, underscores and hyphens as blanks, single blanks."""
    return F.regexp_replace(F.trim(F.translate(F.lower(c), "_-", "  ")), r"\s+", " ")


def compact_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def task_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[\s_()\[\]{}<>]", "")


def clean_text(c: Column) -> Column:
    """Line breaks as blanks, or gone after a blank; trimmed, without final full stops, in lower case."""
    c = F.coalesce(c, F.lit(""))
    for brk in (r"\n", r"\r"):
        c = F.regexp_replace(F.regexp_replace(c, rf"(?<=\s){brk}", ""), rf"(?<!\s){brk}", " ")
    return F.lower(F.regexp_replace(F.trim(c), r"\.+$", ""))


def normalise_answer(c: Column) -> Column:
    """Trimmed lower case without one final punctuation mark, single blanks."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[.,;:!?]$", ""), r"\s+", " ")


def exact_answer(c: Column) -> Column:
    """clean_text with blanks for _ and -, known equivalents, and without one leading article."""
    t = F.trim(F.regexp_replace(F.translate(clean_text(c), "_-", "  "), r"\s+", " "))
    t = F.when(t.isin("same level", "samelevel"), "same_level").otherwise(t)
    return F.trim(F.regexp_replace(t, "^(the|an|a) ", ""))


def last_group(c: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)))


def final_answer(c: Column) -> Column:
    """The last boxed answer, else the last answer tag's content."""
    return F.coalesce(last_group(c, r"\\boxed\{([^}]+)\}"), last_group(c, r"(?s)<answer>(.+?)</answer>"))


def answer_format(c: Column) -> dict[str, Column]:
    """Number of answer tags, other tags, the format score (-1, 0 or 1) and the answer."""
    answers = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?is)<answer>\s*(.*?)\s*</answer>"), F.lit(1))
    tags = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"<\s*/?\s*([A-Za-z][A-Za-z0-9_-]*)[^>]*>"), F.lit(1))
    others = F.size(F.filter(tags, lambda t: F.lower(t) != "answer"))
    n = F.size(answers)
    return {
        "n_answers": n,
        "other_tags": others,
        "format_score": F.when((n > 1) | (others > 0), -1.0).when(n == 0, 0.0).otherwise(1.0),
        "answer": F.when(n == 1, F.trim(F.element_at(answers, -1))).otherwise(""),
    }


def directions(c: Column, motion: bool = False) -> Column:
    """The sorted set of directions a text names; compounds such as frontleft are split.

    A word that is not made up wholly of one to three directions counts for nothing.
    """
    t = F.translate(clean_text(c), "_-", "  ")
    if motion:
        t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "counter clockwise", "counterclockwise"), r"\bcounterclockwise\b", "left"), r"\bclockwise\b", "right")
    names = F.create_map(*[F.lit(x) for kv in DIRECTION_ALIASES.items() for x in kv])
    words = F.transform(F.regexp_extract_all(t, F.lit("([a-z]+)"), F.lit(1)), lambda w: F.coalesce(F.try_element_at(names, w), w))
    any_of = "|".join(DIRECTIONS)
    whole = F.filter(words, lambda w: w.rlike(f"^(?:{any_of}){{1,3}}$"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(whole, lambda w: F.regexp_extract_all(w, F.lit(f"({any_of})"), F.lit(1))))))


def parse_number(c: Column) -> Column:
    """The first number of a text, in digits or in words; null where there is none.

    The words are folded over a state of total, current group, words used and whether the
    run of number words goes on; it ends at the first other word.
    """
    digits = F.regexp_extract(F.translate(F.trim(c), ",", ""), f"({NUMBER})", 1)
    words = F.regexp_extract_all(F.translate(clean_text(c), "-", " "), F.lit("([a-z]+)"), F.lit(1))
    value = F.create_map(*[x for w, v in NUMBER_WORDS.items() for x in (F.lit(w), F.lit(float(v)))])
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("now"), F.lit(0).alias("used"), F.lit(True).alias("on"))

    def step(s: Column, w: Column) -> Column:
        v = F.try_element_at(value, w)
        known = v.isNotNull() | w.isin("and", "hundred", "thousand")
        go = s["on"] & known
        big = F.greatest(s["now"], F.lit(1.0))
        total = F.when(go & (w == "thousand"), s["total"] + big * 1000).otherwise(s["total"])
        now = F.when(~go | (w == "and"), s["now"]).when(w == "hundred", big * 100).when(w == "thousand", 0.0).otherwise(s["now"] + F.coalesce(v, F.lit(0.0)))
        return F.struct(total.alias("total"), now.alias("now"), (s["used"] + go.cast("int")).alias("used"), go.alias("on"))

    spelled = F.aggregate(words, start, step, lambda s: F.when(s["used"] > 0, s["total"] + s["now"]))
    return F.coalesce(digits.try_cast("double"), spelled)


def first_number(c: Column) -> Column:
    """The first blank-separated token as a number."""
    return F.get(F.split(F.trim(c), r"\s+"), F.lit(0)).try_cast("double")


def first_integer(c: Column) -> Column:
    return F.regexp_extract(c, r"(-?\d+)", 1).try_cast("long")


def frame_id(path: Column) -> Column:
    """The digits at the end of a path, before its extension."""
    return F.regexp_extract(path, r"(\d+)(?:\.[A-Za-z0-9]+)?$", 1).try_cast("int")


def image_reference(question: Column) -> Column:
    """Which image a question names first."""
    return F.regexp_extract(F.lower(question), r"image\s*([12])", 1).try_cast("int")


def image_asked(question: Column) -> Column:
    """The image, 1 or 2, that a question names first, as a number or in words."""
    q = F.lower(F.coalesce(question, F.lit("")))
    named = F.regexp_extract(q, r"\bimage[\s_#]*(1|2|one|two)\b|\b(first|second)\s+image\b", 0)
    return F.when(named == "", None).when(named.rlike("1|one|first"), 1).otherwise(2)


def pair_mentioned(question: Column) -> Column:
    """The two things named in `between A and B`."""
    p = r"(?i)between (?:the )?(.+?) and (?:the )?(.+?)(?:\?|\.|,|$)"
    return F.array(F.lower(F.regexp_extract(question, p, 1)), F.lower(F.regexp_extract(question, p, 2)))


def trigrams(c: Column) -> Column:
    n = F.length(c)
    each = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(c, i, F.lit(3)))
    return F.when(n >= 3, F.array_distinct(each)).otherwise(F.array(c))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def question_issues(question: Column, task: Column) -> Column:
    """Faults of a question's wording, in a fixed order."""
    low = F.lower(question)
    words = "left|right|front|back|behind|where|direction"
    return F.array_compact(
        F.array(
            F.when(F.length(F.trim(question)) < 10, "Question is too short"),
            F.when(~question.contains("?"), "Question is missing a question mark"),
            F.when(F.lower(task).contains("position") & ~low.rlike(words), "Position task is missing direction-related wording"),
        )
    )


def confidence(calls: Column, issues: Column, base: float = 1.0, penalty: float = 0.05, least: float = 0.2) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(1.0), base - calls * penalty - 0.01 * issues))


def signature(**parts: Column) -> Column:
    """Digest of the parts that are there, by name."""
    return F.md5(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)])))
