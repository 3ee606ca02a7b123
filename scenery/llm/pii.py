"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Everything is SQL expressions over one row, so a text is read where it lies and
nothing is shuffled. A kind's matches are taken leftmost and non-overlapping; the
text between matches gives their places, counted in code points. The patterns use
possessive repeats and only start at the head of a run, which leaves the matches as
they are but keeps the work in proportion to the text.

Defined results: null and empty texts have no spans; a text of any length is read whole;
repeated rows give the same spans; spans of different kinds at one place are all
reported, by kind and then by start; offsets count code points, ends are exclusive;
other columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 128


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    needs: a cheap test that a text holding such data passes. confirms: the check a
    match must pass. base: a contract kind, reported whatever its score.
    """

    name: str
    pattern: str
    needs: str
    confirms: Callable[[Column], Column]
    score: float
    base: bool = True


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _number(digits: Column, i: Column) -> Column:
    return F.ascii(F.substring(digits, i, F.lit(1))) - 48


def ip_parts_fit(match: Column) -> Column:
    """Every part is at most 255, leading zeros aside."""
    parts = F.split(match, "[.]")
    return F.forall(parts, lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(x, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))


def luhn(match: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    d = _digits(match)
    n = F.length(d)

    def term(i: Column) -> Column:
        v = _number(d, i)
        return F.when((n - i) % 2 == 1, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v)

    return F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + term(i)) % 10 == 0).otherwise(F.lit(False))


def mod_97(match: Column) -> Column:
    """The check of international account numbers: the first four moved to the end, letters as 10 to 35, leave 1."""
    s = F.regexp_replace(match, " ", "")
    moved = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))

    def step(a: Column, i: Column) -> Column:
        v = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(v >= 65, (a * 100 + v - 55) % 97).otherwise((a * 10 + v - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def phone_length(match: Column) -> Column:
    return F.length(_digits(match)).between(9, 15)


def plausible_ssn(match: Column) -> Column:
    """Area, group and serial numbers that are issued."""
    return ~match.rlike("^(000|666|9..)|-00-|-0000$")


always = lambda match: F.lit(True)

KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", always, 0.9),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", ".", ip_parts_fit, 0.6),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", luhn, 0.8),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", phone_length, 0.7),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", mod_97, 0.9, False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", plausible_ssn, 0.4, False),
    Kind("local_phone", r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])", "", always, 0.3, False),
]

#: Words that raise a kind's score when they stand just before a match.
CONTEXT = {
    "email": "e-?mail|mail|contact|courriel|correo",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|taxpayer",
    "local_phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
}
#: Words that lower it: what follows is some other number.
AGAINST = "version|isbn|issn|part no|order no|serial|invoice|figure|section"
REACH = 40
RAISE, LOWER, ACCEPT = 0.3, 0.3, 0.55


def _prefix(lengths: str, blocks: str, i: Column) -> Column:
    """The sum of the first i lengths: whole blocks from their running totals, then the rest."""
    whole = F.floor(i / CHUNK).cast("int")
    return F.get(blocks, whole) + F.aggregate(F.slice(lengths, whole * CHUNK + 1, i - whole * CHUNK), F.lit(0), lambda a, x: a + x)


def _lengths(k: Kind) -> Column:
    """Lengths of gap, match, gap, match and so on; a match's place is the sum before it."""
    m = F.col(f"__m_{k.name}")
    gaps = F.split("__body", k.pattern, -1)
    pairs = F.zip_with(gaps, m, lambda g, x: F.array(F.char_length(g), F.coalesce(F.char_length(x), F.lit(0))))
    return F.when(F.size(m) > 0, F.flatten(pairs))


def _block_sums(lengths: str) -> Column:
    blocks = F.sequence(F.lit(0), F.floor(F.size(lengths) / CHUNK).cast("int"))
    return F.when(F.size(lengths) > 0, F.transform(blocks, lambda b: F.aggregate(F.slice(lengths, b * CHUNK + 1, CHUNK), F.lit(0), lambda a, x: a + x)))


def _block_starts(sums: str) -> Column:
    return F.when(F.size(sums) > 0, F.transform(sums, lambda x, b: F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0), lambda a, y: a + y)))


def _placed(k: Kind) -> Column:
    """Start and size of each confirmed match."""
    m, n, b = f"__m_{k.name}", f"__l_{k.name}", f"__b_{k.name}"
    numbered = F.transform(m, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    confirmed = F.filter(numbered, lambda v: k.confirms(v["x"]))
    placed = F.transform(confirmed, lambda v: F.struct(_prefix(n, b, 2 * v["i"] + 1).alias("start"), F.char_length(v["x"]).alias("size")))
    return F.when(F.size(m) > 0, placed).otherwise(F.array().cast("array<struct<start:int,size:int>>"))


def _scored(k: Kind) -> Column:
    """Spans with the score that the words before them leave; base kinds stay whatever it is."""

    def one(v: Column) -> Column:
        start = F.greatest(v["start"] - REACH, F.lit(0))
        before = F.lower(F.substring(F.col("__body"), start + 1, v["start"] - start))
        up = F.when(before.rlike(rf"\b({CONTEXT[k.name]})\b"), RAISE).otherwise(0.0)
        down = F.when(before.rlike(rf"\b({AGAINST})\b"), LOWER).otherwise(0.0)
        return F.struct(v["start"].alias("start"), (v["start"] + v["size"]).alias("end"), F.round(F.lit(k.score) + up - down, 2).alias("score"))

    spans = F.transform(f"__p_{k.name}", one)
    return spans if k.base else F.filter(spans, lambda v: v["score"] >= ACCEPT)


def find(docs: DataFrame, kinds: list[Kind] = KINDS, text: str = "text") -> DataFrame:
    """Adds for each kind an array of start, end and score in the column `<kind>_spans`."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("__body", body)
    for k in kinds:
        there = F.col("__body").contains(k.needs) if k.needs else F.col("__body").rlike("[0-9]")
        none = F.array().cast("array<string>")
        out = out.withColumn(f"__m_{k.name}", F.when(there, F.regexp_extract_all("__body", F.lit(k.pattern), F.lit(0))).otherwise(none))
    for k in kinds:
        out = out.withColumn(f"__l_{k.name}", _lengths(k))
    for k in kinds:
        out = out.withColumn(f"__s_{k.name}", _block_sums(f"__l_{k.name}"))
    for k in kinds:
        out = out.withColumn(f"__b_{k.name}", _block_starts(f"__s_{k.name}"))
    for k in kinds:
        out = out.withColumn(f"__p_{k.name}", _placed(k))
    for k in kinds:
        out = out.withColumn(f"{k.name}_spans", _scored(k))
    return out.drop("__body", *[f"__{x}_{k.name}" for k in kinds for x in "mlsbp"])


def joined(kinds: list[Kind]) -> Column:
    """kind:start:end of the given kinds, in their order and then by start, joined by commas."""
    one = lambda k: F.transform(f"{k.name}_spans", lambda v: F.concat_ws(":", F.lit(k.name), v["start"].cast("string"), v["end"].cast("string")))
    return F.array_join(F.concat(*[one(k) for k in kinds]), ",")


def report(docs: DataFrame, *keep: str) -> DataFrame:
    """Counts and spans per document."""
    base = [k for k in KINDS if k.base]
    found = find(docs)
    return found.select(
        *keep,
        *[F.size(f"{k.name}_spans").cast("long").alias(f"n_{k.name}") for k in base],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(KINDS).alias("spans"),
        F.array_max(F.concat(*[F.transform(f"{k.name}_spans", lambda v: v["score"]) for k in KINDS])).alias("top_score"),
    )
