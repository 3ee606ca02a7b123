"""Operators that look at many documents, against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scenery.llm import decontaminate, line_dedup, mixing, near_dedup, sharding

from . import data

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def weighted(x, y):
    """Probability Jaccard of two multisets, by its definition."""
    every = list(x.keys() | y.keys())
    px, py = (np.array([z[k] for k in every]) / z.total() for z in (x, y))
    return sum(1 / np.maximum(px / px[i], py / py[i]).sum() for i in np.flatnonzero((px > 0) & (py > 0)))


def alike(x, y):
    """Plain or weighted similarity of 0.8; the plain one is tried first, the weighted one where there are repeats."""
    if len(x) * 5 < len(y) * 4 or len(y) * 5 < len(x) * 4:
        both = 0
    else:
        both = len(x.keys() & y.keys())
    if both and both >= 0.8 * (len(x) + len(y) - both):
        return True
    if x.total() == len(x) and y.total() == len(y):
        return False
    most = sum(min(x[k] / x.total(), y[k] / y.total()) for k in x.keys() & y.keys())
    return most >= 0.8 and weighted(x, y) >= 0.8


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and find(i) != find(j) and alike(sets[i], sets[j]):
                label[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return groups


def test_near_dedup(spark):
    rows = [(i, t) for i, t, *_ in data.rows()]
    got = near_dedup.classes(data.documents(spark)).collect()
    assert len(got) == len(rows)
    want = Counter()
    for members in brute_classes(rows).values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        for k in members:
            want[rows[k][0], min(ids, default=None) if len(members) > 1 else rows[k][0], len(members)] += 1
    assert Counter((r["doc_id"], r["class_id"], r["n_in_class"]) for r in got) == want


def test_near_dedup_keeps_one_of_each_group(spark):
    docs = data.documents(spark)
    kept = near_dedup.clean(docs)
    assert kept.columns == docs.columns
    rows = [(i, t) for i, t, *_ in data.rows()]
    assert kept.count() == len(brute_classes(rows))
    assert near_dedup.clean(data.empty(spark)).collect() == near_dedup.classes(data.empty(spark)).collect() == []


def test_near_dedup_chain(spark):
    """A chain of documents, each near the next only, is one class."""
    words = data.prose(7, 400).split()
    rows = []
    for k in range(12):
        rows.append((k, " ".join(words)))
        for i in range(6):
            words[(k * 31 + i * 60) % 400] = f"new{k}x{i}"
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {min(rows[k][0] for k in m) for m in brute_classes(rows).values()}


def variants(n):
    """Variants of one text, each with three to six changed words; some are near many others, some near few or none."""
    rng = np.random.default_rng(5)
    base = data.prose(70, 300).split()
    rows = []
    for k in range(n):
        words = list(base)
        for i in rng.choice(300, rng.integers(3, 7), replace=False):
            words[i] = f"new{k}x{i}"
        rows.append((k, " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [50, near_dedup.BLOCK])
def test_near_dedup_variants(spark, monkeypatch, block):
    """The members of a large group are in one class whether or not they are near a pivot, and however blocks are cut."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = variants(200)
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {k: min(m) for m in brute_classes(rows).values() for k in m}
    assert {r["doc_id"]: r["class_id"] for r in got} == want


def test_near_dedup_repeated_line(spark):
    """A line that one copy repeats parts the weighted vectors, not the sets; and the other way round."""
    rows = []
    for k in range(6):
        text = data.prose(400 + k, 300)
        rows += [(10 * k, text), (10 * k + 1, text + "\n" + "\n".join([data.prose(500 + k, 10)] * 200))]
    sentence = " ".join([data.prose(600, 10)] * 200)
    rows += [(900 + k, sentence + " " + data.prose(700 + k, 100)) for k in range(2)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {rows[k][0]: rows[min(m)][0] for m in brute_classes(rows).values() for k in m}
    assert all(got[10 * k + 1] == 10 * k for k in range(6)) and got[901] == 900


def test_near_dedup_very_long_texts(spark):
    """Texts of a shingle 70,000 times, and texts of 120,000 words, count whole."""
    long = data.prose(800, 120_000)
    rows = [(1, "a b c d e " * 70_000), (2, "a b c d e " * 70_000 + data.prose(801, 900)), (3, long), (4, long + " " + data.prose(802, 25_000)), (5, long + " " + data.prose(803, 40_000))]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5 if 120 / 185 < 0.8 and 120 / 160 < 0.8 else 3}


def test_near_dedup_recall_on_the_corpus(spark, sf):
    """Whole documents: classes are those of an exhaustive comparison of all pairs."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == {rows[k][0]: rows[min(m)][0] for m in brute_classes(rows).values() for k in m}


def test_prob_min_hash_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 300).astype(np.uint64), rng.integers(0, 2**63, 100).astype(np.uint64)
    x, y = np.unique(a), np.unique(np.concatenate([a[:250], b]))
    wx, wy = rng.integers(1, 4, len(x)).astype(float), rng.integers(1, 4, len(y)).astype(float)
    px, py = dict(zip(x.tolist(), wx / wx.sum())), dict(zip(y.tolist(), wy / wy.sum()))
    both = set(px) & set(py)
    every = set(px) | set(py)
    want = sum(1 / sum(max(px.get(j, 0) / px[i], py.get(j, 0) / py[i]) for j in every) for i in both)
    hits = []
    for salt in range(30):
        s = np.uint64(salt * 7919)
        e = near_dedup._mix(np.concatenate([x, y]) ^ s)
        r = near_dedup.prob_min_hash(e, np.concatenate([wx, wy]), np.repeat([0, 1], [len(x), len(y)]), 2)
        hits.append((r[0] == r[1]).mean())
    assert np.mean(hits) == pytest.approx(want, abs=0.03)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(-30, 30), st.integers(1, 2**40), min_size=1), st.dictionaries(st.integers(-30, 30), st.integers(1, 2**40), min_size=1))
def test_similarity(x, y):
    arrays = lambda d: (np.array(sorted(d), np.int64), np.array([d[k] for k in sorted(d)], np.int64))
    plain = len(x.keys() & y.keys()) / len(x.keys() | y.keys())
    assert near_dedup.similar(*arrays(x), *arrays(y)) == pytest.approx(max(plain, weighted(Counter(x), Counter(y))))


def test_decontaminate(spark):
    rng = [data.prose(300 + i, 20 + i) for i in range(12)]
    items = [(i, t) for i, t in enumerate(rng)] + [(90, None), (91, ""), (92, "only four words here"), (0, rng[0]), (93, "solitary"), (94, "..."), (95, "Two-words")]
    docs = [(1, "before " + rng[0].upper() + " after"), (2, rng[1][: len(rng[1]) // 2]), (3, data.prose(1, 5000) + " " + rng[5] + " " + rng[6]), (4, None), (5, ""), (6, "only four words here"), (7, rng[3].replace(" ", " - ")), (None, rng[2]), (7, rng[3].replace(" ", " - "))]
    drop = rng[4].split()
    docs.append((8, " ".join(drop[: len(drop) - 2])))
    docs += [(9, "A SOLITARY word"), (10, "two words"), (11, "solitary"), (12, "two other words"), (13, data.prose(350, 60_000) + " " + rng[7] + " two words " + rng[8])]
    schema = "doc_id long, text string, item_id string, n_shared string"
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in docs], schema)
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, doc_id string")
    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = set()
    for k, u in items:
        n = min(5, len(norm(u)))
        s = runs(norm(u), n) if n else set()
        want |= {(i, k, len(got & s), len(s)) for i, t in docs if s and 5 * len(got := runs(norm(t), n) & s) >= 4 * len(s)}
    assert {k for _, k, *_ in want} >= {92, 93, 95, 0, 7, 8}
    got = [(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in decontaminate.contaminated(df, bench).collect()]
    assert set(got) == want and len(got) == len(want) and want
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, t in docs if not any(w[0] == i for w in want))
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(df, none).count() == len(docs)
    assert decontaminate.contaminated(data.empty(spark), bench).collect() == []


def test_sharding(spark):
    docs = data.documents(spark)
    got = sharding.shard(docs, rows_per_bucket=7).collect()
    rows = data.rows()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    per = defaultdict(list)
    for r in got:
        per[r["shard"]].append(r["slot"])
    assert sorted(per) == list(range(16)) and all(sorted(v) == list(range(len(v))) for v in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    again = sharding.shard(data.documents(spark), rows_per_bucket=20_000).collect()
    key = lambda rs: Counter((r["doc_id"], r["shard"], r["slot"]) for r in rs)
    assert key(got) == key(again)
    assert sharding.shard(data.empty(spark)).collect() == []


def test_sharding_without_ids(spark):
    """A third of all rows has no id; texts tell them apart, and equal rows share nothing but their worth."""
    rows = [(None if i % 3 == 0 else i, f"text {i}", "a" if i % 2 else None) for i in range(900)] + [(None, "same", "a")] * 60
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, source string"), rows_per_bucket=40).collect()
    per = defaultdict(list)
    for r in got:
        per[r["shard"]].append(r["slot"])
    assert len(got) == 960 and all(sorted(v) == list(range(60)) for v in per.values()) and len(per) == 16
    key = lambda rs: Counter((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in rs)
    assert key(got) == key(sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect())


def test_sharding_follows_the_mixture(spark):
    docs = spark.range(1600).selectExpr("id AS doc_id", "'x' AS text", "CASE WHEN id % 10 < 3 THEN 'hot' ELSE concat('s', id % 7) END AS source")
    part = Counter((r["shard"], r["source"]) for r in sharding.shard(docs).select("shard", "source").collect())
    whole = Counter()
    for (_, s), n in part.items():
        whole[s] += n
    assert all(abs(part[k, s] - n / 16) <= 1.01 for s, n in whole.items() for k in range(16))


def test_mixing_targets():
    t = mixing.targets({"a": 10, "b": 1000, "c": 1000}, {"a": 5.0, "b": 2.0, "c": 1.0})
    assert t["a"] == 30 and t["b"] == pytest.approx(1980 * 2 / 3) and sum(t.values()) == pytest.approx(2010)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from([("a",), ("b",), ("c",), ("a", "b"), ("b", "c"), ("a", "b", "c")]), st.integers(1, 40), min_size=1), st.data())
def test_min_cost_flow(capacity, draw):
    """The flow is whole, within bounds, as large as can be, and no cheaper repetition exists (by a linear search over cuts)."""
    sources = sorted({s for p in capacity for s in p})
    quota = {s: float(draw.draw(st.integers(0, 90))) for s in sources}
    flow = mixing.min_cost_flow(capacity, quota)
    used = {p: sum(flow[p, s] for s in p) for p in capacity}
    assert all(f >= -1e-6 for f in flow.values()) and all(used[p] <= 3 * capacity[p] + 1e-6 for p in capacity)
    filled = {s: sum(f for (_, t), f in flow.items() if t == s) for s in sources}
    assert all(filled[s] <= quota[s] + 1e-6 for s in sources)

    def most(reads):  # max-flow equals min-cut: over all sets of sources on the sink's side
        best = math.inf
        for mask in range(2 ** len(sources)):
            cut = {s for i, s in enumerate(sources) if mask >> i & 1}
            best = min(best, sum(quota[s] for s in sources if s not in cut) + sum(reads * c for p, c in capacity.items() if set(p) & cut))
        return best

    assert sum(used.values()) == pytest.approx(most(3), abs=1e-4)
    # Convex costs: what lies in the first reading, and in the first two, is as much as can be.
    for reads in (1, 2):
        assert sum(min(used[p], reads * capacity[p]) for p in capacity) <= most(reads) + 1e-4


def test_mixing(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i * 7 % 90), f"s{i % 5}" if i % 11 else None, "clash", "clash") for i in range(800)] + [(9000, None, "s1", "c", "c"), (9001, "", None, "c", "c")], "doc_id long, text string, source string, size string, target string")
    got = mixing.mix(docs).collect()
    assert len(got) == 802
    sizes, taken, target = Counter(), Counter(), {}
    by_id = {r["doc_id"]: r for r in docs.collect()}
    for r in got:
        s = by_id[r["doc_id"]]["source"]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 3 * r["size"] and r["size"] == len(WORD.findall(by_id[r["doc_id"]]["text"] or ""))
    order = sorted(s for s in sizes if s is not None) + [None]
    want = mixing.targets({str(s): sizes[s] for s in order}, {str(s): (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)})
    for s in order:
        assert target[s] == pytest.approx(want[str(s)]) and abs(taken[s] - target[s]) <= 0.02 * target[s]
    key = lambda rs: Counter((r["doc_id"], r["taken"]) for r in rs)
    assert key(mixing.mix(docs.repartition(5)).collect()) == key(got)
    assert mixing.mix(data.empty(spark)).collect() == []


def test_mixing_passes_over_what_does_not_fit(spark):
    """One document far longer than the target comes early in the order; the others fill the target all the same."""
    import hashlib

    early = min(range(5000, 5100), key=lambda i: hashlib.md5(f"{mixing.SEED}|{i}".encode()).hexdigest()[:15])
    rows = [(i, "w " * 100, "a") for i in range(1000)] + [(early, "w " * 50_000, "a")] + [(9000 + i, "w " * 1000, "b") for i in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1.0, 16.5)).collect()
    target = {r["source"]: r["target"] for r in got}
    assert target["a"] == pytest.approx(20_000)
    assert abs(sum(r["taken"] for r in got if r["source"] == "a") - 20_000) <= 100


def near_targets(docs, got):
    """Every source is within one document of its target, and no row is taken more than three times."""
    taken, target, largest, sizes = Counter(), {}, Counter(), Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        sizes[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    want = mixing.targets({str(s): sizes[s] for s in names}, {str(s): (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)})
    for s in names:
        assert target[s] == pytest.approx(want[str(s)])
        assert abs(taken[s] - target[s]) <= largest[s], s


def test_mixing_null_and_repeated_ids(spark):
    rows = [(None if i % 2 else i, "w " * 10, f"s{i % 2}") for i in range(600)] + [(7000, "v " * 5, "s1")] * 300 + [(i, f"u{i} " * (i % 40), None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    near_targets(df, got)
    key = lambda rs: Counter((r["doc_id"], r["source"], r["taken"]) for r in rs)
    assert key(mixing.mix(df.repartition(7)).collect()) == key(got)


def test_mixing_shared_texts(spark):
    """Two sources hold the same 200 texts, and each needs less than half of them: the flow reads hardly any text twice."""
    rows = [(k * 1000 + i, " ".join(f"t{i}w{j}" for j in range(20)), s) for k, s in enumerate("ab") for i in range(200)] + [(9000 + i, f"c{i} " * 20, "c") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, weights=(1.0, 1.0, 6.0)).collect()
    taken, read = Counter(), Counter()
    text = {i: t for i, t, _ in rows}
    for r in got:
        taken[r["source"]] += r["taken"]
        if r["source"] != "c":
            read[text[r["doc_id"]]] += r["copies"]
    assert {s: taken[s] for s in "abc"} == {"a": 2000, "b": 2000, "c": 12000}
    assert max(read.values()) <= 2 and sum(n > 1 for n in read.values()) <= 10


def test_route_with_thousands_of_patterns():
    rng = np.random.default_rng(2)
    sources = [f"s{i}" for i in range(40)]
    classes = {}
    for _ in range(3000):
        p = tuple(sorted(rng.choice(sources, rng.integers(1, 5), replace=False).tolist()))
        for s in p:
            classes[p, (s,)] = int(rng.integers(1, 1000))
    texts = {p: max(n for (q, _), n in classes.items() if q == p) for p, _ in list(classes)[:1]} | {p: n for (p, _), n in classes.items()}
    size = Counter()
    for (_, (s,)), n in classes.items():
        size[s] += n
    quota = {s: round(x) for s, x in mixing.targets(size, {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(sources)}).items()}
    flow = mixing.route(classes, texts, quota)
    filled = Counter()
    for (c, s), x in flow.items():
        assert 0 <= x <= 3 * classes[c]
        filled[s] += x
    assert all(abs(filled[s] - quota[s]) <= 1 for s in sources)


def test_mixing_overlapping_sources(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "w " * 10, "a" if i % 2 else "b") for i in range(300)], "doc_id long, text string, source string")
    members = F.when(F.col("doc_id") < 100, F.array(F.lit("0a"), F.lit("0b"))).otherwise(F.array(F.concat(F.lit("0"), F.col("source"))))
    got = mixing.mix(docs, members).collect()
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    # Sizes of overlapping sources count shared documents in each; quotas are filled as far as all readings allow.
    assert sum(r["taken"] for r in got) == pytest.approx(4000, abs=20)


def brute_lines(rows):
    """All pairs: a line goes where a run of lines around it, of five words or more, stands in an earlier document."""
    order = sorted(rows, key=lambda r: (math.inf if r[0] is None else r[0]))
    lines = [[x for x in (t or "").split("\n") if WORD.search(x)] for _, t in order]
    words = [[len(WORD.findall(x)) for x in v] for v in lines]
    out = {}
    for k, (i, _) in enumerate(order):
        gone = set()
        for p in range(k):
            at = defaultdict(list)
            for x, line in enumerate(lines[p]):
                at[line].append(x)
            for j, line in enumerate(lines[k]):
                for x in at[line]:
                    n = 0
                    while j + n < len(lines[k]) and x + n < len(lines[p]) and lines[k][j + n] == lines[p][x + n]:
                        n += 1
                    if sum(words[k][j : j + n]) >= 5:
                        gone |= set(range(j, j + n))
        out[i] = sorted(gone)
    return out


def test_line_dedup_partners(spark):
    """Blocks of short lines, of which each part has an earlier holder of its own; and ids below nought."""
    rows = [(1, "aa bb\ncc dd"), (2, "cc dd\nee ff"), (3, "aa bb\ncc dd\nee ff"), (4, "aa bb\ncc dd\nee ff"), (-12, "one two three four five six"), (-10, "x\none two three four five six\ny")]
    rows += [(20, "long line of five words\nz"), (21, "long line of five words\nw"), (22, "long line of five words\nw")]
    got = {r["doc_id"]: r["removed"] for r in line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)
    assert got[4] == [0, 1, 2] and got[-12] == [] and got[-10] == [1] and got[22] == [0, 1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b c", "d e f", "g h i j k", "l m n o p q", ""]), max_size=9), min_size=2, max_size=2))
def test_alignment_finds_every_common_run(pair):
    rows = [(k, "\n".join(v)) for k, v in enumerate(pair)]
    code = {x: i for i, x in enumerate(["a", "b c", "d e f", "g h i j k", "l m n o p q"])}
    a, b = ([code[x] for x in v if x] for v in pair)
    assert line_dedup.common_lines(a, b, [len(x.split()) for x in pair[1] if x]) == brute_lines(rows)[1]


def test_line_dedup_on_the_corpus(spark, sf):
    """Whole documents, all pairs."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["removed"] for r in line_dedup.clean(docs).collect()}
    assert got == brute_lines([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_line_dedup_very_long_texts(spark):
    long = data.prose(810, 60_000)
    rows = [(1, long), (2, data.prose(811, 40) + "\n" + long)]
    got = {r["doc_id"]: r for r in line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["text"] == data.prose(811, 40)


def test_line_dedup(spark):
    shared = data.prose(50, 72)
    rows = [(1, data.prose(51, 60) + "\n" + shared + "\n" + data.prose(52, 24)), (2, data.prose(53, 30) + "\n" + shared), (3, shared + "\n\n" + data.prose(54, 12)), (4, data.prose(55, 60)), (5, None), (6, ""), (7, "short\nlines\nonly"), (8, "short\nlines\nonly"), (9, "one two three four five\n" * 4), (None, shared)]
    df = spark.createDataFrame([(i, t, "c", "c", "c") for i, t in rows], "doc_id long, text string, removed string, lines string, words string")
    got = {r["doc_id"]: r for r in line_dedup.clean(df).collect()}
    want = brute_lines(rows)
    for i, t in rows:
        keep = [x for x in (t or "").split("\n")]
        worded = [k for k, x in enumerate(keep) if WORD.search(x)]
        gone = {worded[k] for k in want[i]}
        assert got[i]["removed"] == want[i] and got[i]["n_lines"] == len(worded)
        assert got[i]["text"] == (t if not gone else "\n".join(x for k, x in enumerate(keep) if k not in gone))
    assert got[1]["n_removed"] == got[4]["n_removed"] == 0 and len(got[2]["removed"]) == 6
    assert line_dedup.clean(data.empty(spark)).collect() == []


def test_patience_diff():
    blocks = line_dedup.patience([1, 2, 3, 4, 5, 6], [9, 2, 3, 8, 5, 6])
    assert blocks == [(1, 1, 2), (4, 4, 2)]
    assert line_dedup.common_lines([1, 2], [2, 1], [6, 6]) == [0, 1]
    assert line_dedup.patience([], [1]) == []


def test_repeated_passages():
    """Lines that stand twice on either side, and every run of lines that stands in both."""
    p, q, r, x, y, z, passage = range(7)
    assert line_dedup.common_lines([p, passage, q], [x, passage, y, passage, z], [9] * 5) == [1, 3]
    assert line_dedup.common_lines([p, passage, r, passage, q], [x, passage, z], [9] * 3) == [1]
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = rng.integers(0, 5, rng.integers(0, 14)).tolist(), rng.integers(0, 5, rng.integers(0, 14)).tolist()
        words = [1 + k for k in b]
        runs = {tuple(a[i:k]) for i in range(len(a)) for k in range(i + 1, len(a) + 1)}
        want = {j for i in range(len(b)) for k in range(i + 1, len(b) + 1) if tuple(b[i:k]) in runs and sum(words[i:k]) >= 5 for j in range(i, k)}
        assert line_dedup.common_runs(a, b, words, 5) == want <= set(line_dedup.common_lines(a, b, words))


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert set(out.columns) == {*docs.columns, "shard", "slot"}
    rows = out.collect()
    n = Counter(r["shard"] for r in rows)
    assert rows and max(n.values()) - min(n.values()) <= 1
    text = dict(docs.select("doc_id", "text").collect())
    assert all(text[r["doc_id"]] == r["text"] for r in rows)
    ids = {r["doc_id"] for r in rows}
    # No two that remain are near copies, none holds a test item, none is taken more than three times.
    members = [(i, text[i]) for i in sorted(ids)]
    assert all(len(m) == 1 for m in brute_classes(members).values())
    items = {r["item_id"] for r in decontaminate.contaminated(docs.where(docs.doc_id.isin(list(ids))), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert not items
    assert max(Counter(r["doc_id"] for r in rows).values()) <= 3


def test_clean_leaves_other_columns_alone(spark):
    """Columns with the names of the operators' own helpers come back as they were."""
    rows = [(i, t, -5 - k, "mine", f"stays {k}", k * 0.5, "row") for k, (i, t, *_) in enumerate(data.rows())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __k long, __t string, __stays string, node double, __row string").repartition(3)
    items = spark.createDataFrame([(1, data.rows()[0][1].split("\n")[2])], "item_id long, text string")
    whole = set(rows)
    for kept in (near_dedup.clean(docs), decontaminate.clean(docs, items)):
        assert kept.columns == docs.columns
        got = [tuple(r) for r in kept.collect()]
        assert got and len(got) < len(rows) and set(got) <= whole
