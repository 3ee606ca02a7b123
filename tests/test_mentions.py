"""Mentions by index against plain loops: every label, every run of words."""

import random

import pytest

from scenery.functions import fuzzy
from scenery.functions.vocabulary import REGION_OBJECTS
from scenery.operators import mentions

LABELS = sorted({y for own in REGION_OBJECTS.values() for y in own}) + ["coffee table", "office chair", "tv stand", "x", "ab", "night stand", "shower curtain rod", "é", "", "file cabinet", "trash can", "potted plant"]


def by_loops(names, question, pool):
    q = question.lower()
    own = fuzzy.words(q)
    longest = min(max([len(fuzzy.words(x)) for x in pool] + [1]) + 1, 4)
    hits = [(q.find(x), i, x) for i, x in enumerate(pool) if x in q]
    for i, label in enumerate(pool):
        best, where = 0.0, None
        if label not in q:
            for n in range(1, longest + 1):
                for j in range(len(own) - n + 1):
                    score = names.similarity(" ".join(own[j : j + n]), label)
                    if score > best:
                        best, where = score, j
        if where is not None and best >= 0.78:
            hits.append((4 * where, len(pool) + i, label))
    return list(dict.fromkeys(x for *_, x in sorted(hits))) if q.strip() else []


def questions(n, seed=2):
    rng = random.Random(seed)
    regions = ["sleeping area", "living room", "kitchen", "work space", "bathroom zone", "dining"]

    def typo(w):
        k = rng.randrange(len(w) + 1)
        return rng.choice([w, w, w.upper(), w[:k] + w[k + 1 :], w[:k] + rng.choice("aeitx") + w[k:], w[:k] + rng.choice("aei") + w[k + 1 :], w.replace(" ", "-"), w.replace(" ", ""), w + "s", w[::-1]])

    for _ in range(n):
        said = [typo(rng.choice(LABELS + regions)) if rng.random() < 0.5 else rng.choice(["where", "is", "the", "near", "between", "how", "2", "big"]) for _ in range(rng.randrange(12))]
        yield " ".join(said) + rng.choice(["?", "", "!", "  "])


def test_as_by_loops():
    names = fuzzy.Names(LABELS)
    rng = random.Random(3)
    alike = 0
    for q in questions(250):
        pool = rng.sample(LABELS, rng.randrange(len(LABELS)))
        want = by_loops(names, q, pool)
        assert fuzzy.Pool(pool, names).mentions(q) == want == names.mentions(q, pool)
        alike += sum(x not in q.lower() for x in want)
    assert alike > 100


def test_all_pairs_of_labels_are_bounded_from_above():
    """Whatever is alike survives the index and the bounds, for every label against every other."""
    names = fuzzy.Names()
    pool = fuzzy.Pool(LABELS, names)
    for x in [*LABELS, "sleeping area", "bedd", "sofaa", "tvstand"]:
        own = fuzzy.words(x.lower())
        if not own or len(own) > 3:
            continue
        found = pool.alike(own, set(range(len(pool.labels))))
        for k, y in enumerate(pool.labels):
            if names.similarity(" ".join(own), y) >= fuzzy.LIKE:
                assert k in found


@pytest.mark.parametrize("most", [10_000, 7])
def test_texts_of_many_pools(spark, monkeypatch, most):
    """A pool that most texts share, in one task or in many parts; texts that repeat, are null or have no pool."""
    monkeypatch.setattr(mentions, "TEXTS_PER_TASK", most)
    said = list(questions(60, 5))
    rows = [(i, q, 1 if i % 3 else 2) for i, q in enumerate(said)] + [(100, said[1], 1), (101, None, 1), (102, "the lamp", None), (103, "the lamp", 9)]
    pools = {1: sorted(set(LABELS)), 2: ["bed", "sofa"]}
    texts = spark.createDataFrame(rows, "id int, text string, pool_id int").repartition(3)
    labels = spark.createDataFrame([(p, x) for p, own in pools.items() for x in own], "pool_id int, label string")
    names = fuzzy.Names()
    for alike in (False, True):
        got = {r["id"]: r["named"] for r in mentions.named(texts, labels, alike, names).collect()}
        for i, q, p in rows:
            own = pools.get(p, []) if q is not None else []
            want = by_loops(names, q, own) if alike and own else [x for _, x in sorted((q.lower().find(x), x) for x in own if x in q.lower())]
            assert got[i] == want
    assert len(got) == len(rows)
