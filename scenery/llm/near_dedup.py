"""Near-duplicate documents by ProbMinHash, banding and verification.

A document's five-word shingles, weighted by how often they occur, are normalised to a
probability vector. Every shingle starts a Poisson process with its probability as
rate; each arrival lands in a random register, and a register keeps the shingle that
came first. Two documents agree in a register with the probability Jaccard of their
vectors. Arrivals later than a document's latest register can no longer change it, so
the process ends early: the work is one draw per shingle and some thousand arrivals,
whatever the number of registers.

Two texts are similar when the probability Jaccard of their weighted shingles, or the
Jaccard of their plain shingle sets, is at least THRESHOLD. Registers are grouped in
BANDS bands of ROWS; a pair of similarity 0.8 shares no band with probability
(1 - 0.8^4)^24 = 3e-6. A text with repeats also gets the registers of its plain set;
the probability Jaccard of plain sets is at least their set Jaccard.

Equal shingle multisets are one node. Within a band's bucket every node is linked to a
pivot, its most central member: the one whose buckets hold most nodes. So a bucket of
any size gives a linear number of candidate links, and in a group of variants the
pivot is the variant nearest to all. Links are verified on the shingles themselves;
classes are connected components. Nodes that share a bucket and still lie in two
classes are then settled. Shingles that no other such node holds bound what a node can
share with any: a node with too many of its own is alone, for certain. The others meet
block against block; every pair that the bounds allow and that agrees in enough
registers is verified on the spot, unless the block's links already join its classes,
so a task gives fewer links than it has rows. A pair of similarity 0.8 fails the
comparison of registers with probability 4e-6.

Defined results: words are runs of non-space characters; a text of one to four words
is a single shingle; null and wordless texts are classes of their own; a text of any
length counts whole, and is one row of signatures and at most one of shingles; equal
texts, repeated rows included, share a class; a class is named by its smallest doc_id;
rows with a null doc_id take part and never name a class unless all its ids are null;
of equally central nodes the one of the smaller hash is the pivot, which decides no
class; other columns, whatever their names, are not read, and `clean` returns them as
they are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenery.llm.common import discard, materialise, packed, unpacked

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
M = BANDS * ROWS
HORIZON = M * (np.log(M) + 3.0)
#: Registers, of M, that two nodes must share to be verified when pairs are settled.
LEAST_SHARED = 57
#: Members of a bucket, and shingles they hold, in one block when pairs are settled; a task holds two blocks.
BLOCK = 2048
BLOCK_SHINGLES = 2_000_000
#: Parts into which the links of one pivot are dealt for verification.
PARTS = 64
ROUNDS = 200
WORDS_AT_ONCE = 400_000
SIGNATURE = "doc_id long, text_hash long, node string, keys array<long>, registers binary"
SHINGLES = "node string, hashes array<long>, counts array<long>"

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _step(number: int, odd: int) -> np.uint64:
    """An offset for the elements that differs for each draw."""
    return np.uint64(number * int(_ODD[odd]) % 2**64)


def shingles(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' 64-bit hashes in order, and how often each occurs."""
    words = text.split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < WORDS:
        one = np.array([len(h)], np.uint64)
        for i in range(len(h)):
            one = _mix(one * _ODD[i] ^ h[i : i + 1])
        return one, np.ones(1, np.int64)
    total = np.zeros(len(h) - WORDS + 1, np.uint64)
    for k in range(WORDS):
        total += _mix(h[k : len(h) - WORDS + 1 + k] * _ODD[k])
    return np.unique(_mix(total), return_counts=True)


def prob_min_hash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n_docs: int) -> np.ndarray:
    """Registers, one row per document: the element that arrived first in each.

    elements, weights and owner are aligned; owner says which document an element is of.
    Rounds go through arrivals: the first of every element, the second of those whose
    first came in time, and so on. An element is dropped when its time passes the
    horizon or its document's latest register.
    """
    scale = np.bincount(owner, weights, n_docs)[owner] / weights  # mean time between arrivals
    best = np.full(n_docs * M, np.inf)
    kept = np.zeros(n_docs * M, np.uint64)
    horizon = np.full(n_docs, HORIZON)
    time = np.zeros(len(elements))
    live = np.arange(len(elements))
    late: list[tuple[np.ndarray, np.ndarray, int]] = []
    turn = 0
    while True:
        while len(live):
            turn += 1
            draw = _mix(elements[live] + _step(2 * turn, 0))
            time[live] -= np.log((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) * scale[live]
            soon = time[live] <= horizon[owner[live]]
            late.append((live[~soon], time[live[~soon]], turn))
            live = live[soon]
            if not len(live):
                break
            slot = owner[live] * M + (_mix(elements[live] + _step(2 * turn + 1, 1)) % np.uint64(M)).astype(np.int64)
            order = np.lexsort((time[live], slot))
            first = order[np.r_[True, slot[order][1:] != slot[order][:-1]]]
            better = time[live][first] < best[slot[first]]
            at = slot[first][better]
            best[at], kept[at] = time[live][first][better], elements[live][first][better]
            horizon = np.minimum(horizon, best.reshape(n_docs, M).max(axis=1))
        short = np.isinf(best.reshape(n_docs, M)).any(axis=1)
        short &= np.bincount(owner, minlength=n_docs) > 0
        if not short.any():
            return kept.reshape(n_docs, M)
        # Few documents have a register without an arrival by now: give them all their arrivals again, with more time.
        inside = short[owner]
        redo = np.flatnonzero(inside)
        sub = np.flatnonzero(short)
        place = np.zeros(n_docs, np.int64)
        place[sub] = np.arange(len(sub))
        kept.reshape(n_docs, M)[sub] = _exhaustive(elements[redo], scale[redo], place[owner[redo]], len(sub))
        return kept.reshape(n_docs, M)


def _exhaustive(elements: np.ndarray, scale: np.ndarray, owner: np.ndarray, n_docs: int) -> np.ndarray:
    """The same registers without a horizon but the documents' own: stops when all are filled and none can improve."""
    best, kept = np.full((n_docs, M), np.inf), np.zeros((n_docs, M), np.uint64)
    time, live, turn = np.zeros(len(elements)), np.arange(len(elements)), 0
    while len(live):
        turn += 1
        draw = _mix(elements[live] + _step(2 * turn, 0))
        time[live] -= np.log((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) * scale[live]
        live = live[time[live] <= best.max(axis=1)[owner[live]]]
        register = (_mix(elements[live] + _step(2 * turn + 1, 1)) % np.uint64(M)).astype(np.int64)
        for i in np.argsort(-time[live], kind="stable"):
            e, d, r = live[i], owner[live[i]], register[i]
            if time[e] < best[d, r]:
                best[d, r], kept[d, r] = time[e], elements[e]
    return kept


def _bands(registers: np.ndarray) -> np.ndarray:
    out = np.zeros((len(registers), BANDS), np.uint64)
    for k in range(ROWS):
        out = _mix(out + registers[:, k::ROWS] * _ODD[k])
    return _mix(out + np.arange(BANDS, dtype=np.uint64) * _ODD[4])


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(ids: list, hashes: list, sets: list) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
        h = np.concatenate([h for h, _ in sets])
        c = np.concatenate([c for _, c in sets])
        registers = prob_min_hash(h, c.astype(np.float64), owner, len(sets))
        bands = _bands(registers)
        # Texts with repeats have a second row of registers, those of the plain set.
        again = np.flatnonzero(np.bincount(owner, c > 1, len(sets)) > 0)
        of = np.isin(owner, again)
        plain = prob_min_hash(h[of], np.ones(of.sum()), np.searchsorted(again, owner[of]), len(again))
        second = dict(zip(again.tolist(), range(len(again)), strict=True))
        more = _bands(plain)
        keys, kept = [], []
        for i, (a, _) in enumerate(sets):
            k = second.get(i)
            keys.append(None if not len(a) else (bands[i] if k is None else np.r_[bands[i], more[k]]).view(np.int64))
            kept.append(registers[i].astype("<u2").tobytes() + (b"" if k is None else plain[k].astype("<u2").tobytes()))
        nodes = [xxhash.xxh3_128_hexdigest(a.tobytes() + b.tobytes()) if len(a) else None for a, b in sets]
        columns = [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(nodes, pa.string()), pa.array(keys, pa.list_(pa.int64())), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SIGNATURE.split(", ")])

    for batch in batches:
        ids, hashes, sets, held = [], [], [], 0
        for doc_id, text_hash, text in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), strict=True):
            ids.append(doc_id.as_py())
            hashes.append(text_hash.as_py())
            sets.append(shingles(text.as_py() or b""))
            held += len(sets[-1][0])
            if held >= WORDS_AT_ONCE:
                yield done(ids, hashes, sets)
                ids, hashes, sets, held = [], [], [], 0
        if ids:
            yield done(ids, hashes, sets)


def _shingled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of each node's text, a few texts at a time."""
    names = [x.split()[0] for x in SHINGLES.split(", ")]
    for batch in batches:
        nodes, sets, held = [], [], 0
        for i, (node, text) in enumerate(zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True)):
            nodes.append(node.as_py())
            sets.append(shingles(text.as_py() or b""))
            held += len(sets[-1][0])
            if held >= WORDS_AT_ONCE or i == batch.num_rows - 1:
                cut = pa.array(np.r_[0, np.cumsum([len(h) for h, _ in sets])], pa.int32())
                hashes = pa.ListArray.from_arrays(cut, pa.array(np.concatenate([h for h, _ in sets]).view(np.int64)))
                counts = pa.ListArray.from_arrays(cut, pa.array(np.concatenate([c for _, c in sets])))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), hashes, counts], names=names)
                nodes, sets, held = [], [], 0


def similar(a: np.ndarray, ca: np.ndarray, b: np.ndarray, cb: np.ndarray) -> float:
    """The larger of the shingle sets' Jaccard and of the probability Jaccard of the shingles with their counts."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    plain = len(i) / (len(a) + len(b) - len(i))
    if ca.max() == 1 and cb.max() == 1:
        return plain  # the two are the same
    x, y = ca / ca.sum(), cb / cb.sum()
    only_a, only_b = x.sum() - x[i].sum(), y.sum() - y[j].sum()
    xi, yi = x[i].astype(float), y[j].astype(float)
    order = np.argsort(xi / yi, kind="stable")
    xs, ys = xi[order], yi[order]
    # max(x_j / x_i, y_j / y_i) is y_j / y_i up to i in this order, and x_j / x_i after it.
    lower, upper = np.cumsum(ys), xs.sum() - np.cumsum(xs)
    return max(plain, float(np.sum(1.0 / ((lower + only_b) / ys + (upper + only_a) / xs))))


def _arrays(batch: pa.RecordBatch, *columns: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Values and offsets of list columns."""
    part = [batch.column(k) for k in columns]
    return [(c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy(zero_copy_only=False)) for c in part]


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a pivot's part follow the pivot's own row: each is compared with that."""
    head = None
    for batch in batches:
        (h, hc), (c, cc) = _arrays(batch, 3, 4)
        a, b = batch.column(2), batch.column(0)
        ok = []
        for r in range(batch.num_rows):
            own = h[hc[r] : hc[r + 1]], c[cc[r] : cc[r + 1]]
            if not a[r].is_valid:
                head = own[0].copy(), own[1].copy()
                ok.append(False)
            else:
                ok.append(similar(*own, *head) >= THRESHOLD)
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node of its component, for every node that has an edge.

    Alternates large stars and small stars; every step is a grouped minimum and a join,
    and the number of steps grows with the logarithm of the components' size.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "dedup-edges")
    before = None
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(root.select("u", F.col("m").alias("v")))
        last, now = now, materialise(small.where("u <> v").distinct(), "dedup-edges")
        discard(last)
        # A round that changes nothing leaves stars, each around its smallest node.
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (2**31))).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not settled after {ROUNDS} rounds")
    tree = now.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    out = materialise(tree.unionByName(tree.select(F.col("label").alias("node"), "label").distinct()), "dedup-labels")
    discard(now)
    return out


def _checked(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar enough, on the shingles themselves.

    b's shingles travel once for each of its PARTS of partners, not once for each pair;
    a task streams through the partners, so a pivot may have any number of them.
    """
    part = F.pmod(F.xxhash64("a"), F.lit(PARTS)).cast("int").alias("part")
    pairs = materialise(pairs.where("a <> b").select("b", part, "a").distinct(), "dedup-pairs")
    heads = pairs.select("b", "part").distinct().join(nodes.withColumnRenamed("node", "b"), "b").select("b", "part", F.lit(None).cast("string").alias("a"), "hashes", "counts")
    rows = pairs.join(nodes.withColumnRenamed("node", "a"), "a").select("b", "part", "a", "hashes", "counts")
    both = heads.unionByName(rows).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    out = materialise(both.mapInArrow(_verify, "a string, b string"), "dedup-links")
    discard(pairs)
    return out


def _pivots(buckets: DataFrame) -> DataFrame:
    """Every member of a bucket linked to its most central one.

    A large group falls into much the same buckets band after band, so most of its links
    are to the same pivots and are checked once.
    """
    central = buckets.groupBy("node").agg(F.sum("n").alias("weight"))
    rank = F.struct(F.col("weight"), F.xxhash64("node").alias("h"), F.col("node").alias("b"))
    ends = buckets.join(central, "node").groupBy("key").agg(F.max(rank)["b"].alias("b"))
    return buckets.join(ends, "key").select(F.col("node").alias("a"), "b").where("a <> b")


CELL = ["key", "i", "j", "side", "node", "label", "is_major", "n", "u", "w", "uw", "registers", "keys", "hashes", "counts"]


def _cell(one: list[tuple], two: list[tuple], key: int) -> Iterator[tuple[str, str]]:
    """Links between different classes in two blocks of a bucket, of which no one follows from the others."""

    def side(rows: list[tuple]) -> tuple:
        node, label, major, n, u, w, uw, registers, keys, _, _ = zip(*rows, strict=True)
        r = [np.stack([np.frombuffer(x[: 2 * M] if k else x[-2 * M :], "<u2") for x in registers]) for k in (1, 0)]
        b = [np.stack([x[:BANDS] if k else x[-BANDS:] for x in keys]) for k in (1, 0)]
        return np.array(node, object), np.array(label, object), np.array(major), b, r, *[np.array(x, float) for x in (n, u, w, uw)]

    nodes, labels, _, bands, registers, n, u, w, uw = side(one)
    nodes2, labels2, major2, bands2, registers2, n2, u2, w2, uw2 = side(two)
    joined: dict[str, str] = {}

    def root(x: str) -> str:
        while x in joined:
            x = joined[x]
        return x

    for k in range(len(one)):
        # Of two members outside the largest class, each is in a first block: take the pair once.
        at = np.flatnonzero((labels2 != labels[k]) & (major2 | (nodes2 > nodes[k])))
        common = np.minimum(n[k] - u[k], n2[at] - u2[at])
        plain = common >= THRESHOLD * (n[k] + n2[at] - common) - 1e-6
        weighted = np.maximum(uw[k] / w[k], uw2[at] / w2[at]) <= 1 - THRESHOLD + 1e-6
        at = at[plain | (weighted & ((w[k] > n[k]) | (w2[at] > n2[at])))]
        at = at[np.maximum(*[(registers2[x][at] == registers[x][k]).sum(axis=1) for x in (0, 1)]) >= LEAST_SHARED]
        if not len(at):
            continue
        # A pair that shares several buckets is checked in the one of its first band.
        here = np.flatnonzero((bands[0][k] == key) | (bands[1][k] == key))[0]
        shared = np.logical_or.reduce([bands[x][k] == bands2[y][at] for x in (0, 1) for y in (0, 1)])
        for j in at[shared.argmax(axis=1) == here].tolist():
            a, b = root(labels[k]), root(labels2[j])
            if a != b and similar(*one[k][-2:], *two[j][-2:]) >= THRESHOLD:
                joined[a] = b
                yield nodes[k], nodes2[j]


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Goes through the cells of the blocks' grid; the rows of a cell lie together."""
    cell, sides, found = None, ([], []), []

    def out() -> pa.RecordBatch:
        links = list(_cell(*sides, cell[0])) if sides[0] and sides[1] else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.string()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        flat = _arrays(batch, *range(len(CELL) - 3, len(CELL)))
        for r, (key, i, j, second, *row) in enumerate(zip(*[c.to_pylist() for c in batch.columns[:-3]], strict=True)):
            if (key, i, j) != cell:
                found = out()
                if found.num_rows:
                    yield found
                cell, sides = (key, i, j), ([], [])
            sides[second].append((*row, *[v[c[r] : c[r + 1]].copy() for v, c in flat]))
    yield out()


def _bounds(nodes: DataFrame) -> DataFrame:
    """node, its numbers of shingles n and of occurrences w, and how many of each (u, uw) no other node holds."""
    sized = nodes.select("node", F.xxhash64("node").alias("nid"), F.size("hashes").cast("long").alias("n"), F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c).alias("w"))
    flat = nodes.select(F.xxhash64("node").alias("nid"), F.explode(F.arrays_zip("hashes", "counts")).alias("v")).select("nid", "v.hashes", F.col("v.counts").alias("c"))
    alone = flat.groupBy("hashes").agg(F.count(F.lit(1)).alias("df"), F.max("nid").alias("nid"), F.max("c").alias("c")).where("df = 1")
    alone = alone.groupBy("nid").agg(F.count(F.lit(1)).alias("u"), F.sum("c").alias("uw"))
    return sized.join(alone, "nid", "left").drop("nid").fillna(0, ["u", "uw"])


def _unsettled(buckets: DataFrame, uniq: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between nodes of different classes that share a bucket.

    A bucket's largest class needs no pairs within it; its other members meet the whole
    bucket, block against block, so that no task holds more than two blocks. Of a pair's
    n and m shingles at most min(n - u, m - v) are common, where u and v are those that
    no other node holds; the probability Jaccard is at most 1 less what either has alone.
    """
    flat = buckets.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))

    def mixed(rows: DataFrame) -> DataFrame:
        """The members of buckets of several classes, with their number and whether they are of the largest class."""
        per = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n_label"))
        per = per.groupBy("key").agg(F.max_by("label", F.struct("n_label", "label")).alias("major"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
        return rows.join(per, "key").withColumn("is_major", F.col("label") == F.col("major")).drop("major")

    open_ = materialise(mixed(flat).select("key", "node", "label"), "dedup-open")
    facts = _bounds(nodes.join(open_.select("node").distinct(), "node", "left_semi"))
    near = 1 - THRESHOLD + 1e-6
    facts = materialise(facts.where((F.col("u") <= near * F.col("n")) | (F.col("uw") <= near * F.col("w"))), "dedup-bounds")
    left = materialise(mixed(open_.join(facts.select("node"), "node", "left_semi")), "dedup-unsettled")
    discard(open_)
    full = left.join(facts, "node")
    size = full.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    full = full.join(size, "key").join(uniq.select("node", "keys", "registers"), "node").join(nodes, "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = full.where("NOT is_major").select("key", own.alias("i"), every.alias("j"), F.lit(0).alias("side"), *CELL[4:])
    two = full.select("key", every.alias("i"), own.alias("j"), F.lit(1).alias("side"), *CELL[4:])
    cells = one.unionByName(two).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return materialise(cells.mapInArrow(_compare, "a string, b string"), "dedup-links")


NO_ID = 2**63 - 1


def _labelled(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_hash, node and label of every document; wordless texts have neither node nor label."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    signed = materialise(rows.mapInArrow(_sign, SIGNATURE), "dedup-signatures")
    row = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), F.col("text_hash").alias("t"))
    uniq = signed.where("node IS NOT NULL").groupBy("node").agg(F.min(row).alias("row"), F.first("keys").alias("keys"), F.first("registers").alias("registers"))
    uniq = materialise(uniq.select("node", "row.*", "keys", "registers"), "dedup-nodes")
    flat = uniq.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    shared = flat.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = materialise(flat.join(shared, "key"), "dedup-buckets")
    # Only nodes that share a bucket need their shingles: they are taken from one text of each.
    asked = uniq.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "k", "t")
    texts = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), F.col("text_hash").alias("t"), "text").join(asked, ["k", "t"])
    nodes = materialise(texts.select("node", "text").dropDuplicates(["node"]).mapInArrow(_shingled, SHINGLES), "dedup-shingles")
    links = _checked(_pivots(buckets), nodes)
    labels = components(links)
    more = _unsettled(buckets, uniq, nodes, labels)
    if not more.isEmpty():
        discard(labels)
        labels = components(links.unionByName(more))
    discard(nodes, buckets, links, more, uniq)
    return signed.select("doc_id", "text_hash", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _first_of_class(labelled: DataFrame) -> DataFrame:
    """label, the id and text hash of the class's first document, and its number; only for classes of several."""
    key = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), F.col("text_hash").alias("t"))
    out = labelled.where("label IS NOT NULL").groupBy("label").agg(F.min(key).alias("first"), F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_in_class"))
    return materialise(out.where("n_in_class > 1"), "dedup-classes")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, n_in_class, and kept, which is true for one document of each class."""
    labelled = _labelled(docs, doc_id, text)
    out = labelled.join(_first_of_class(labelled), "label", "left")
    own = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), F.col("text_hash").alias("t"))
    return out.select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_in_class", F.lit(1)).cast("long").alias("n_in_class"),
        (F.col("first").isNull() | (F.col("first") == own)).alias("kept"),
    )


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The first document of each class and all others without near copies, with the columns of the input."""
    labelled = _labelled(docs, doc_id, text).where("label IS NOT NULL")
    own = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), F.col("text_hash").alias("t"))
    # A document goes where it is not the first of its class; a row that repeats one counts once.
    found = labelled.join(_first_of_class(labelled), "label").select(own.alias("own"), (F.col("first") == own).alias("stays"))
    found = found.groupBy("own").agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("n")).where("NOT stays OR n > 1")
    found = materialise(found.select("own.k", "own.t", "stays"), "dedup-found").withColumnsRenamed({"k": "__k", "t": "__t", "stays": "__stays"})
    rows = packed(docs, F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("__k"), F.xxhash64(text).alias("__t"))
    rest = rows.join(found.drop("__stays"), ["__k", "__t"], "left_anti")
    once = rows.join(found.where("__stays").drop("__stays"), ["__k", "__t"], "left_semi").dropDuplicates(["__k", "__t"])
    return unpacked(rest.unionByName(once))
