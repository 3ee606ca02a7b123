"""A small table with every awkward case: nulls, empty and long texts, ties, repeats, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, rank string, label string, kept string, h string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) for i in range(0, n, 12))


def rows() -> list[tuple]:
    base = prose(1, 200)
    words = base.split(" ")
    near = " ".join(words[:100] + ["changed"] + words[101:])
    far = " ".join(w if i % 3 else "x" + w for i, w in enumerate(words))
    texts = [
        (1, base, "en", "a"),
        (2, base, "en", "b"),
        (3, near, "en", "a"),
        (4, far, "en", "a"),
        (5, None, "en", "a"),
        (6, "", None, None),
        (7, " \t\n\x0b ", "de", "b"),
        (8, "two words", "en", None),
        (9, "two words", "en", "a"),
        (10, "Mail bob@example.com or ring +1 (212) 555-0100, card 4111 1111 1111 1111, host 10.0.0.300 and 10.0.0.3.", "en", "c"),
        (11, prose(2, 30_000), "en", "c"),
        (12, "| # | " * 80, "en", "a"),
        (12, "| # | " * 80, "en", "a"),
        (13, "same again\n" * 60, None, "b"),
        (14, "ünï cödé 日本 words 🎉 a@b.co " + prose(3, 60), "fr", "a"),
        (None, prose(4, 70), "en", "a"),
        (None, None, None, None),
    ]
    texts += [(100 + i, prose(100 + i, 60 + i % 40), "en", "a" if i % 3 else "b") for i in range(60)]
    return [(i, t, lang, s, len(t or ""), "clash", "clash", "clash", "clash", "clash") for i, t, lang, s in texts]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
