"""Mixing sources to target weights by min-cost flow.

Sources overlap where they hold equal texts. Documents are summed by membership pattern,
the set of sources that hold the document's text, and by the sources that the document
itself may be taken for. A pattern's words flow through its documents to the quotas of
their sources. Reading a pattern's texts a second or third time costs more each time,
whichever source's copy is read (convex repetition costs), so the cheapest flow repeats
as little as the quotas allow: what one source takes of a shared text, the others
leave. Documents are then chosen in a seeded order until a class's flow is used up;
classes of one pattern begin at different places of the same order of texts, one where
the other ends. Only one row per pattern and class reaches the driver, behind a checked
bound; documents meet the decision through a table of that size.

Defined results: a null source is a source of its own, in code point order after all
others; null and wordless texts have size 0 and are never taken; a text of any length
is one document, and is taken whole or not at all; rows that repeat a doc_id and text,
or have no doc_id, are chosen one by one, and which of equal ones is taken makes no
difference; of documents that fill a gap equally well the first in the seeded order is
taken; input columns named size, source_size, target, copies or taken are replaced,
others are returned as they are; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenery.llm.common import materialise, nullable_key, packed, running, seeded_hex, unpacked, words_of

WEIGHTS = (5.0, 2.0, 1.0)
MAX_READS = 3
SEED = "scenery-mix"
#: Most classes of membership patterns that may reach the driver.
MAX_PATTERNS = 200_000
#: The seeded order: texts fall into SLOTS, documents into 2^BITS places of a slot.
SLOTS = 1024
BITS = 48


def targets(sizes: dict[str, int], weights: dict[str, float], most: int = MAX_READS) -> dict[str, float]:
    """Shares of all words by weight, at most `most` times a source's size; the excess is shared again."""
    total, open_, out = float(sum(sizes.values())), set(sizes), {}
    while open_:
        rest = total - sum(out.values())
        weight = sum(weights[s] for s in open_)
        want = {s: rest * weights[s] / weight for s in open_}
        full = {s for s in open_ if want[s] > most * sizes[s]}
        if not full:
            return out | want
        out |= {s: float(most * sizes[s]) for s in full}
        open_ -= full
    return out


class _Network:
    """Maximum flow by blocking flows on level graphs; arcs may be widened and the flow continued."""

    def __init__(self):
        self.arcs: list[list] = []  # head, room; arc k and k ^ 1 are each other's reverse
        self.of: dict[object, list[int]] = {}

    def add(self, a: object, b: object, room: int) -> int:
        for tail, head, r in ((a, b, room), (b, a, 0)):
            self.of.setdefault(tail, []).append(len(self.arcs))
            self.arcs.append([head, r])
        return len(self.arcs) - 2

    def fill(self, start: object, end: object) -> None:
        while True:
            level, queue = {start: 0}, deque([start])
            while queue:
                node = queue.popleft()
                for k in self.of.get(node, ()):
                    head, room = self.arcs[k]
                    if room > 0 and head not in level:
                        level[head] = level[node] + 1
                        queue.append(head)
            if end not in level:
                return
            at = dict.fromkeys(level, 0)
            path: list[int] = []
            node = start
            while True:
                if node == end:
                    moved = min(self.arcs[k][1] for k in path)
                    for k in path:
                        self.arcs[k][1] -= moved
                        self.arcs[k ^ 1][1] += moved
                    path, node = [], start
                    continue
                own = self.of[node]
                while at[node] < len(own):
                    head, room = self.arcs[own[at[node]]]
                    if room > 0 and level.get(head) == level[node] + 1:
                        break
                    at[node] += 1
                if at[node] < len(own):
                    path.append(own[at[node]])
                    node = self.arcs[path[-1]][0]
                elif path:
                    node = self.arcs[path.pop() ^ 1][0]
                    at[node] += 1
                else:
                    break


Pattern = tuple[str, ...]


def route(classes: dict[tuple[Pattern, Pattern], int], texts: dict[Pattern, int], quota: dict[str, int], reads: int = MAX_READS) -> dict[tuple[tuple[Pattern, Pattern], str], int]:
    """Words sent from each class (a pattern, and the sources its documents may be taken for) to each source.

    A class gives at most `reads` times its size. The k-th reading of a pattern's texts
    costs k a word, all beyond the last as much as the last. Costs only depend on the
    reading, so the readings are opened one after the other, and each continues the flow.
    """
    net = _Network()
    whole: dict[Pattern, int] = {}
    for (p, _), size in classes.items():
        whole[p] = whole.get(p, 0) + reads * size
    opened = {p: net.add("start", ("pattern", p), 0) for p in whole}
    sent = {}
    for (p, own), size in classes.items():
        net.add(("pattern", p), ("class", p, own), reads * size)
        for s in own:
            sent[(p, own), s] = net.add(("class", p, own), ("source", s), reads * size)
    for s, q in quota.items():
        net.add(("source", s), "end", q)
    for reading in range(1, reads + 2):
        for p, k in opened.items():
            now = min(whole[p], reading * texts[p]) if reading <= reads else whole[p]
            net.arcs[k][1] = now - net.arcs[k ^ 1][1]
        net.fill("start", "end")
    return {x: net.arcs[k ^ 1][1] for x, k in sent.items()}


def min_cost_flow(capacity: dict[Pattern, int], quota: dict[str, float], reads: int = MAX_READS) -> dict[tuple[Pattern, str], int]:
    """The flow where every document may be taken for any source of its pattern, and no text occurs twice."""
    found = route({(p, p): c for p, c in capacity.items()}, dict(capacity), {s: round(q) for s, q in quota.items()}, reads)
    return {(p, s): x for ((p, _), s), x in found.items()}


def _later(ranked: DataFrame, gaps: DataFrame, n_units: int) -> tuple[DataFrame, DataFrame]:
    """Documents that fit after the first that didn't, and the gaps that remain, each below its smallest document.

    A round takes documents of up to half the gap in seeded order until one doesn't fit;
    where there are none it takes one larger document that fits. So two rounds at least
    halve a gap, and their number grows with the logarithm of the largest.
    """
    left, chosen = ranked, []
    while True:
        near = left.select("__class", "__o", "size").join(gaps, "__class").where("size > 0 AND size <= gap")
        near = materialise(near, "mix-near")
        n_units = min(n_units, near.count())
        if not n_units:
            break
        small = running(near.where("2 * size <= gap"), "__class", F.col("__o") / float(SLOTS << BITS), [F.col("__o")], n_units, {"upto": F.col("size")})
        one = near.groupBy("__class").agg(F.min("size").alias("least"), F.first("gap").alias("gap"), F.min(F.struct("__o", "size")).alias("v")).where("2 * least > gap")
        taken = small.where("upto <= gap").select("__class", "__o", "size").unionByName(one.select("__class", "v.*"))
        taken = materialise(taken, "mix-later")
        chosen.append(taken)
        filled = taken.groupBy("__class").agg(F.sum("size").alias("filled"))
        gaps = gaps.join(filled, "__class", "left").select("__class", (F.col("gap") - F.coalesce("filled", F.lit(0))).alias("gap"))
        gaps = materialise(gaps, "mix-gaps")
        left = near.join(taken.select("__class", "__o"), ["__class", "__o"], "left_anti")
    out = ranked.select("__class", "__o").limit(0)
    for taken in chosen:
        out = out.unionByName(taken.select("__class", "__o"))
    return materialise(out, "mix-more"), gaps


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with a number among those of equal id and text, written so that the numbers stay."""
    rows = materialise(rows.withColumn("__rid", F.monotonically_increasing_id()), "mix-rows")
    many = rows.groupBy("__unit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    equal = rows.select("__unit", "__rid").join(many, "__unit").withColumn("__key", F.conv(F.substring(F.md5(F.col("__rid").cast("string")), 1, 12), 16, 10).cast("long"))
    n = equal.count()
    ranks = running(equal, "__unit", F.col("__key") / float(16**12), [F.col("__key"), F.col("__rid")], n)
    return rows.join(materialise(ranks.select("__rid", F.col("__rank").alias("__number")), "mix-numbers"), "__rid", "left").drop("__rid")


def mix(docs: DataFrame, members: Column | None = None, weights: Sequence[float] = WEIGHTS, seed: str = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Adds size, source_size, target, copies and taken, in place of columns of these names.

    members: an array of the keys of the sources a document may be taken for; by default
    its own source alone. source_size and target are those of the document's own source.
    """
    members = F.array(nullable_key(F.col(source))) if members is None else F.array_sort(F.array_distinct(members))
    spark = docs.sparkSession
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    number = lambda *c: F.conv(F.substring(seeded_hex(seed, *c), 1, BITS // 4), 16, 10).cast("long")
    rows = docs.drop("size", "source_size", "target", "copies", "taken").withColumns(
        {
            "size": F.size(words_of(F.col(text))).cast("long"),
            "__own": members,
            "__text": F.xxhash64(digest),
            "__slot": F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % SLOTS,
            "__unit": F.xxhash64(nullable_key(F.col(doc_id)), digest, members),
            "__h": number(F.col(doc_id), digest),
        }
    )
    slim = materialise(rows.select("__own", "__text", "__slot", "__unit", "__h", "size"), "mix-sizes")
    if not slim.groupBy("__unit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        rows = _numbered(rows).withColumn("__h", F.when(F.col("__number").isNull(), F.col("__h")).otherwise(number(F.col("__h"), F.col("__number")))).drop("__number")
        slim = materialise(rows.select("__own", "__text", "__slot", "__unit", "__h", "size"), "mix-sizes")
    # Texts that several sources hold; all others have their own sources as pattern.
    code = F.xxhash64("__own")
    several = slim.where("size > 0").groupBy("__text").agg(F.min(code).alias("a"), F.max(code).alias("b")).where("a <> b").select("__text")
    shared = slim.join(several, "__text", "left_semi").groupBy("__text", "__own").agg(F.max("size").alias("size"))
    shared = shared.groupBy("__text").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("__own")))).alias("__pattern"), F.max("size").alias("size"))
    shared = materialise(shared, "mix-shared")
    named = lambda df: df.join(shared.select("__text", "__pattern"), "__text", "left").withColumn("__class", F.to_json(F.array(F.coalesce("__pattern", "__own"), F.col("__own")))).drop("__pattern")
    units = materialise(named(slim).groupBy("__class", "__slot", "__h").agg(F.sum("size").alias("size")), "mix-units")
    found = units.groupBy("__class").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} classes of membership patterns")
    found.sort(key=lambda r: r["__class"])
    key = {r["__class"]: tuple(tuple(x) for x in json.loads(r["__class"])) for r in found}
    classes = {key[r["__class"]]: int(r["size"]) for r in found}
    texts = {p: 0 for p, _ in classes}
    for (p, _), size in classes.items():
        texts[p] += size
    texts |= {tuple(r["__pattern"]): int(r["size"]) for r in shared.groupBy("__pattern").agg(F.sum("size").alias("size")).collect() if len(r["__pattern"]) > 1 and tuple(r["__pattern"]) in texts}
    sizes: dict[str, int] = {}
    for (_, own), size in classes.items():
        for s in own:
            sizes[s] = sizes.get(s, 0) + size
    order = sorted(sizes)
    goal = targets(sizes, {s: float(weights[i % len(weights)]) for i, s in enumerate(order)})
    flow = route(classes, texts, {s: round(goal[s]) for s in order})
    plan, begin = [], {}
    for c in sorted(key):
        p, own = key[c]
        size, sent = classes[p, own], sum(flow[(p, own), s] for s in own)
        reads = min(MAX_READS, sent // size) if size else 0
        rest = sent - reads * size if reads < MAX_READS else 0
        plan.append((c, reads, rest, round(begin.get(p, 0.0) * SLOTS) % SLOTS))
        begin[p] = begin.get(p, 0.0) + (rest / size if size else 0.0)
    quotas = materialise(spark.createDataFrame(plan, "__class string, __reads int, __rest long, __from int"), "mix-quotas")
    n_units = sum(r["n"] for r in found)
    placed = lambda df: df.join(quotas, "__class", "left").withColumn("__o", F.pmod(F.col("__slot") - F.col("__from"), F.lit(SLOTS)) * (1 << BITS) + F.col("__h"))
    ordered = placed(units).select("__class", "__o", "size", "__rest", F.shiftright("__o", BITS).alias("__slot"))
    # A text that very many documents hold fills its slot; each slot is dealt into as many buckets as it needs.
    parts = materialise(ordered.groupBy("__class", "__slot").agg(F.ceil(F.count(F.lit(1)) / 4_000).alias("__parts")), "mix-slots")
    within = F.floor(F.pmod(F.col("__o"), F.lit(1 << BITS)) / float(1 << BITS) * F.col("__parts"))
    ranked = running(ordered.join(parts, ["__class", "__slot"]), "__class", F.lit(0.0), [F.col("__o")], n_units, {"upto": F.col("size")}, bucket=F.col("__slot") * (1 << 32) + within)
    ranked = materialise(ranked.select("__class", "__o", "size", "upto", "__rest"), "mix-ranked")
    # Whole documents in seeded order as far as they fit, later ones that still do, then the one that best fills the gap.
    fits = ranked.where("upto <= __rest").groupBy("__class").agg(F.max("__o").alias("__to"), F.max("upto").alias("__filled"))
    fits = materialise(fits, "mix-fits")
    over = ranked.where("upto > __rest").select("__class", "__o", "size")
    gaps = quotas.join(fits, "__class", "left").select("__class", (F.col("__rest") - F.coalesce("__filled", F.lit(0))).alias("gap"))
    more, gaps = _later(over, materialise(gaps, "mix-gaps"), n_units)
    over = over.join(more, ["__class", "__o"], "left_anti").join(gaps, "__class")
    gap = F.col("gap")
    extra = over.where((F.col("size") > 0) & (F.col("size") < 2 * gap)).groupBy("__class").agg(F.min_by("__o", F.struct(F.abs(gap - F.col("size")), F.col("__o"))).alias("__extra"))
    decided = materialise(fits.select("__class", "__to").join(extra, "__class", "full"), "mix-decided")
    sources = materialise(spark.createDataFrame([(s, sizes[s], goal[s]) for s in order], "__source string, source_size long, target double"), "mix-sources")
    out = placed(named(rows)).join(decided, "__class", "left").withColumn("__source", nullable_key(F.col(source))).join(sources, "__source", "left")
    out = out.join(more.withColumn("__more", F.lit(True)), ["__class", "__o"], "left")
    once = F.coalesce(F.col("__o") <= F.col("__to"), F.lit(False)) | F.coalesce(F.col("__o") == F.col("__extra"), F.lit(False)) | F.coalesce("__more", F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("__reads") + once.cast("int")).otherwise(0)
    out = out.withColumn("copies", copies).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    return out.drop("__class", "__own", "__text", "__slot", "__unit", "__h", "__reads", "__rest", "__from", "__o", "__to", "__extra", "__more", "__source")


def mixture(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of the input."""
    rows = mix(packed(docs, "doc_id", "text", "source")).where("copies > 0")
    return unpacked(rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))
