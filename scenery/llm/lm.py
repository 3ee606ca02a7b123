"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Counting, training and scoring each read every text once, in numpy over Arrow batches:

1. Token counts of all training texts, pre-summed in each batch, then by token.
2. ROUNDS rounds of training. A training text belongs to one round and one shard, by its
   hash; a shard's share of a round is one run of noise-contrastive estimation that
   starts from the average of the round before. So every text is learned from once, the
   rounds build on each other, and the result does not depend on how rows are dealt to
   tasks. The number of shards grows with the corpus, the tokens of each do not shrink.
3. Scoring: a context of two words predicts a vector; its products with the target
   vectors, in batches, give normalised probabilities.

The model's vocabulary grows with the corpus: about 2 V^GROWTH units for V distinct words,
the most frequent words, the end token, and hash buckets for all other words. A word of
a bucket gets the bucket's probability times its smoothed share of the bucket, one share
being left for unseen words, so the probabilities of all words add up to one. Units fall
into about the root of their number of groups; a probability is that of the group times
that of the unit within its group, both normalised exactly, both trained by
noise-contrastive estimation. Counts of the KNOWN_WORDS most frequent words go to the
workers, which is a table of bounded size; other words are looked up by a join, with
the same result.

Defined results: a null or empty text is the end token alone; a text of any length is
read whole, a few megabytes at a time; a null doc_id counts as the empty text when it is
drawn; repeated rows are scored alike and each counts in training; words of equal counts
are taken by their hash; other columns, whatever their names, are not read; without
training texts every word is unknown and the model is uniform; an empty table gives no
rows.
"""

from __future__ import annotations

import ctypes
import math
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenery.llm.common import discard, materialise

END = "\n"  # no word holds white space
END_ID = 0
DIM = 16
#: Words that are units of their own, at least, where there are so many.
LEAST_WORDS = 1024
#: The power of the distinct words by which that number grows.
GROWTH = 0.6
#: Words whose counts the workers hold, unless the model's own words are more.
KNOWN_WORDS = 1 << 17
ROUNDS = 4
#: Tokens of a shard in a round, at least, and for each parameter of the model.
SHARD_TOKENS = 1_000_000
TOKENS_PER_PARAMETER = 2
GROUP_NOISE, UNIT_NOISE = 16, 1
BATCH = 2048
CHUNK = 512  # contexts that are normalised at once
BLOCK = 1 << 17  # contexts that are dealt to their groups at once
RATE = 0.1
SEED = 7
PIECE = 4 << 20  # bytes of texts that are split into words at once
HELD = 1_000_000  # words and counts that a task adds up before it hands them on
LN10 = np.log(10.0)


def one_thread() -> None:
    """Keeps numpy's matrix products in the task's own thread.

    Products of vectors as short as these gain nothing from a second thread, which waits by
    spinning and takes its time from the other tasks. Where numpy has another library than
    the one it comes with, nothing changes but the time.
    """
    for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lower case as far as A to Z go, a few megabytes at a time."""
    at = 0
    while len(text) - at > PIECE:
        stop = at + PIECE
        while stop < len(text) and text[stop] not in b" \t\n\x0b\x0c\r":
            stop += 1
        yield text[at:stop].lower().split()
        at = stop
    yield text[at:].lower().split()


def _words(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, bool]]:
    """Rows of PIECE bytes of text at most, their words, how many each row has, and whether the texts end there.

    A longer text comes by itself, in pieces, of which only the last ends it.
    """
    for batch in batches:
        text = batch.column("text").cast(pa.string()).fill_null("")
        upto, i = np.cumsum(pc.binary_length(text).to_numpy(), dtype=np.int64), 0
        while i < len(text):
            held = upto[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(upto, held + PIECE, "right")))
            rows = batch.slice(i, j - i)
            if upto[j - 1] - held <= PIECE:
                # These split at the same six characters as bytes.split does, but leave empty words at the ends.
                lists = pc.ascii_split_whitespace(pc.ascii_lower(text.slice(i, j - i)))
                words, cut = lists.flatten().cast(pa.binary()), lists.offsets.to_numpy()
                full = pc.binary_length(words).to_numpy() > 0
                yield rows, words.filter(pa.array(full)), np.diff(np.r_[0, np.cumsum(full)][cut - cut[0]]), True
            else:
                ahead = pieces(text[i].as_buffer().to_pybytes())
                now = next(ahead, None)
                while now is not None:
                    coming = next(ahead, None)
                    if now or coming is None:
                        yield rows, pa.array(now, pa.binary()), np.array([len(now)]), coming is None
                    now = coming
            i = j


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def added(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("token", use_threads=False).aggregate([("c", "sum")]).rename_columns(["token", "c"])

    def out(counts: pa.Table) -> Iterator[pa.RecordBatch]:
        return iter(counts.set_column(0, "token", counts.column("token").cast(pa.string())).combine_chunks().to_batches())

    parts, held, ends = [], 0, 0
    for rows, words, _, last in _words(batches):
        ends += rows.num_rows * last
        parts.append(pa.table(words.value_counts().flatten(), names=["token", "c"]))
        held += parts[-1].num_rows
        if held > HELD:
            parts = [added(parts)]
            # With less than half the room left, sums would be made too often.
            if parts[0].num_rows > HELD // 2:
                yield from out(parts.pop())
            held = sum(p.num_rows for p in parts)
    parts.append(pa.table([pa.array([END.encode()], pa.binary()), pa.array([ends], pa.int64())], names=["token", "c"]))
    yield from out(added(parts))


def count_tokens(train: DataFrame, text: str = "text") -> DataFrame:
    """token and c over all training texts, the end token included."""
    part = train.select(F.col(text).alias("text")).mapInArrow(_count, "token string, c long")
    return materialise(part.groupBy("token").agg(F.sum("c").alias("c")).where("c > 0"), "lm-counts")


def most_frequent(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """About so many of the most frequent words, never more, in order, without the end token.

    Counts are binned first, so that the driver gets the words above a bin and nothing
    else: a sorted limit would send it that many words from every task. Of the bin that
    does not fit whole, words come in order of their hash.
    """
    words = counts.where(F.col("token") != END).withColumn("bin", F.floor(F.log2("c") * 16))
    words = words.withColumn("part", F.crc32(F.col("token").cast("binary")) % 4096)
    held, least, edge = 0, None, None
    for r in sorted(words.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["bin"]):
        if held + r["n"] > most:
            edge = r["bin"]
            break
        held, least = held + r["n"], r["bin"]
    chosen = F.col("bin") >= least if least is not None else F.lit(False)
    if edge is not None:
        up_to = -1
        for r in sorted(words.where(F.col("bin") == edge).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["part"]):
            if held + r["n"] > most:
                break
            held, up_to = held + r["n"], r["part"]
        chosen = chosen | ((F.col("bin") == edge) & (F.col("part") <= up_to))
    return sorted(((r["token"], r["c"]) for r in words.where(chosen).select("token", "c").collect()), key=lambda x: (-x[1], x[0]))


class Vocabulary:
    """What every worker needs of the counts. Units: the end token, the most frequent words, buckets of the others."""

    def __init__(self, top: list[tuple[str, int]], n_words: int, buckets: list[tuple[int, int]], n: int, v: int, n_end: int):
        """buckets: for each, how many words it holds that are no units, and how often those occur."""
        self.words = pa.array([END.encode(), *[t.encode() for t, _ in top]], pa.binary())
        self.c = np.array([n_end, *[c for _, c in top]], np.float64)
        self.n, self.v, self.n_words, self.n_buckets = n, v, n_words, len(buckets)
        self.unit = np.arange(len(self.c), dtype=np.int32)
        for i, (t, _) in enumerate(top[n_words:], n_words + 1):
            self.unit[i] = self.bucket(t.encode())
        self.n_units = 1 + n_words + len(buckets)
        #: Smoothed size of each bucket, an unseen word included.
        self.other = np.array([c + k + 1 for k, c in buckets], np.float64)
        self.noise = np.r_[n_end + 1, self.c[1 : n_words + 1] + 1, self.other]

    def bucket(self, word: bytes) -> int:
        return 1 + self.n_words + zlib.crc32(word) % self.n_buckets

    def distinct(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """The different words, the place of each word among them, and the ids of the different words."""
        found = words.dictionary_encode()
        at = pc.index_in(found.dictionary, value_set=self.words).fill_null(len(self.c)).to_numpy()
        units = self.unit[np.minimum(at, len(self.c) - 1)]
        missing = np.flatnonzero(at == len(self.c))
        others = found.dictionary.take(pa.array(missing)).to_numpy(zero_copy_only=False)
        units[missing] = 1 + self.n_words + np.fromiter(map(zlib.crc32, others), np.int64, len(missing)) % self.n_buckets
        return found.dictionary, found.indices.to_numpy(), at, units

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places among the counts, one past the end for words that aren't there, and units."""
        _, code, at, units = self.distinct(pa.array(words, pa.binary()))
        return at[code], units[code]


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.sum(F.when(F.col("token") == END, F.col("c"))), F.lit(0)).alias("n_end")).first()
    n_words = max(LEAST_WORDS, math.ceil(total["v"] ** GROWTH))
    top = most_frequent(counts, max(KNOWN_WORDS, n_words))
    n_words = min(n_words, len(top))
    n_buckets = max(1, min(n_words, (total["v"] - n_words) // 8))
    words, times = [0] * n_buckets, [0] * n_buckets
    place = (F.crc32(F.col("token").cast("binary")) % n_buckets).alias("k")
    for r in counts.where(F.col("token") != END).groupBy(place).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect():
        words[r["k"]], times[r["k"]] = r["n"], r["c"]
    for t, c in top[:n_words]:
        k = zlib.crc32(t.encode()) % n_buckets
        words[k] -= 1
        times[k] -= c
    return Vocabulary(top, n_words, list(zip(words, times, strict=True)), total["n"], total["v"], total["n_end"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Context vectors R, a matrix for each of two context places, target vectors and biases of groups (G, a) and units (Q, b).

    Unit u is in group u modulo the number of groups.
    """

    NAMES = ("R", "Q", "G", "C", "b", "a")

    def __init__(self, noise: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.groups = max(1, math.isqrt(len(noise) - 1) + 1)
        self.width = -(-len(noise) // self.groups)
        n = self.groups * self.width
        self.noise = np.r_[noise, np.zeros(n - len(noise))] / noise.sum()
        self.mass = self.noise.reshape(self.width, self.groups).sum(axis=0)
        own = self.noise / self.mass[np.arange(n) % self.groups]
        self.own = np.maximum(own, 1e-12)
        self.R = rng.normal(0, 0.05, (n, DIM)).astype(np.float32)
        self.Q = rng.normal(0, 0.05, (n, DIM)).astype(np.float32)
        self.G = rng.normal(0, 0.05, (self.groups, DIM)).astype(np.float32)
        self.C = np.stack([np.eye(DIM), 0.5 * np.eye(DIM)]).astype(np.float32)
        self.b = np.where(self.noise > 0, np.log(self.own), -np.inf).astype(np.float32)
        self.a = np.log(self.mass).astype(np.float32)
        #: What each unit adds to the prediction from either place, and targets by group; made when the model is first asked.
        self.after: tuple[np.ndarray, ...] | None = None

    def size(self) -> int:
        return sum(getattr(self, k).size for k in self.NAMES)

    def values(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def load(self, values: np.ndarray) -> Model:
        at, self.after = 0, None
        for k in self.NAMES:
            old = getattr(self, k)
            new = values[at : at + old.size].astype(np.float32).reshape(old.shape)
            setattr(self, k, np.where(np.isfinite(old), new, old))
            at += old.size
        return self

    def train(self, batches: Iterator[np.ndarray], seed: int, rate: float = RATE) -> int:
        """Adagrad over minibatches of (second to last, last, next) units; returns the tokens seen.

        A row's gradient is the mean over its uses in the minibatch, so rare words move as far as frequent ones.
        """
        self.after = None
        rng = np.random.default_rng([SEED, seed])
        seen = {k: np.full(getattr(self, k).shape, 1e-3 if k == "C" else 1e-2, np.float32) for k in self.NAMES}
        groups, total, mass = self.groups, 0, np.cumsum(self.mass)
        by_group = np.arange(len(self.noise)).reshape(self.width, groups).T.ravel()
        cum = np.cumsum(self.noise[by_group])
        start = np.r_[0, cum[self.width - 1 :: self.width][:-1]]
        off_group = np.log(GROUP_NOISE * self.mass).astype(np.float32)
        off_unit = np.log(UNIT_NOISE * self.own).astype(np.float32)
        #: A unit's bias less its noise; a padding unit that rounding drew has no probability and learns nothing.
        lift = np.where(np.isfinite(self.b), self.b, 0).astype(np.float32) - off_unit
        real = (self.noise > 0).astype(np.float32)

        def sort(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Uses in the order of their rows, the rows, where each one's uses begin, and their number."""
            bits = len(at).bit_length()
            kind = np.uint32 if len(self.noise) << bits < 1 << 32 else np.uint64
            # Keys with their places are sorted much faster than places by key.
            keys = np.sort((at.astype(kind) << kind(bits)) | np.arange(len(at), dtype=kind))
            order, rows = (keys & kind((1 << bits) - 1)).astype(np.int64), (keys >> kind(bits)).astype(np.int64)
            first = np.r_[0, np.flatnonzero(rows[1:] != rows[:-1]) + 1]
            return order, rows.take(first), first, np.diff(np.r_[first, len(rows)]).astype(np.float32)

        def step(k: str, to: np.ndarray, values: np.ndarray, rows: np.ndarray, first: np.ndarray, uses: np.ndarray) -> None:
            """Moves the rows that were used, each by the mean of its gradients; the work is in the uses, not in the table."""
            if values.ndim == 2:
                # Two columns are added at once as the parts of a complex number.
                move = np.add.reduceat(values.view(np.complex64), first, axis=0).view(np.float32)
                move /= uses[:, None]
            else:
                move = np.add.reduceat(values, first) / uses
            now = seen[k].take(rows, axis=0)
            now += move * move
            seen[k][rows] = now
            move *= np.float32(rate)
            move /= np.sqrt(now, out=now)
            move += to.take(rows, axis=0)
            to[rows] = move

        for x in batches:
            n, t = len(x), x[:, 2]
            total += n
            g, w = t % groups, x[:, 1::-1].ravel()
            both = self.C.reshape(2 * DIM, DIM)
            r = self.R.take(w, axis=0).reshape(n, 2 * DIM)
            h = r @ both
            k = np.minimum(np.searchsorted(mass, rng.random(GROUP_NOISE)), groups - 1)
            own, noise = self.G.take(g, axis=0), self.G.take(k, axis=0)
            offset = off_group - self.a
            up = _sigmoid(offset.take(g) - np.einsum("ij,ij->i", h, own))
            down = -_sigmoid(h @ noise.T - offset.take(k))
            dh = up[:, None] * own
            dh += down @ noise
            # Noise groups are shared, so each one's mean over the minibatch stands for as many uses.
            dg, da = np.empty((n + GROUP_NOISE, DIM), np.float32), np.r_[up, down.mean(axis=0)].astype(np.float32)
            np.multiply(up[:, None], h, out=dg[:n])
            dg[n:] = down.T @ h / n
            drawn = start.take(g)[:, None] + rng.random((n, UNIT_NOISE)) * self.mass.take(g)[:, None]
            last = (g[:, None] + 1) * self.width - 1
            u = np.concatenate([t[:, None], by_group.take(np.clip(np.searchsorted(cum, drawn), last - self.width + 1, last))], axis=1)
            q = self.Q.take(u, axis=0)
            pull = -_sigmoid(np.einsum("ij,ikj->ik", h, q) + lift.take(u))
            pull[:, 0] += 1
            pull *= real.take(u)
            dh += np.einsum("ik,ikj->ij", pull, q)
            order, *at = sort(u.ravel())
            one = pull.ravel().take(order)
            values = h.take(order // (1 + UNIT_NOISE), axis=0)
            values *= one[:, None]
            step("Q", self.Q, values, *at)
            step("b", lift, one, *at)
            order, *at = sort(np.r_[g, k])
            step("G", self.G, dg.take(order, axis=0), *at)
            step("a", self.a, da.take(order), *at)
            order, *at = sort(w)
            step("R", self.R, (dh @ both.T).reshape(-1, DIM).take(order, axis=0), *at)
            dc = (r.T @ dh).reshape(self.C.shape) / np.float32(n)
            seen["C"] += dc * dc
            self.C += np.float32(rate) * dc / np.sqrt(seen["C"])
        self.b = np.where(np.isfinite(self.b), lift + off_unit, self.b)
        return total

    def log10(self, rows: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of units after two others."""
        return np.concatenate([np.empty(0), *[self._log10(rows[i : i + BLOCK]) for i in range(0, len(rows), BLOCK)]])

    def _log10(self, rows: np.ndarray) -> np.ndarray:
        w2, w1, t = rows[:, 0], rows[:, 1], rows[:, 2]
        if self.after is None:
            targets = np.ascontiguousarray(self.Q.reshape(self.width, self.groups, DIM).transpose(1, 2, 0))
            longest = max(math.sqrt(np.einsum("ij,ij->i", x, x).max()) for x in (self.Q, self.G))
            self.after = self.R @ self.C[0], self.R @ self.C[1], targets, np.ascontiguousarray(self.b.reshape(self.width, self.groups).T), longest
        last, second, targets, biases, longest = self.after
        h = last.take(w1, axis=0)
        h += second.take(w2, axis=0)
        g, out = t % self.groups, np.empty(len(t), np.float64)
        room, line = np.empty(CHUNK * max(self.groups, self.width), np.float32), np.arange(CHUNK)
        # Products are far from the range's ends, as a rule, and then need no bound.
        far = longest * math.sqrt(np.einsum("ij,ij->i", h, h).max()) > 80

        def share(h: np.ndarray, target: np.ndarray, bias: np.ndarray, weight: np.ndarray, at: np.ndarray) -> np.ndarray:
            logits = room[: len(at) * len(bias)].reshape(len(at), len(bias))
            np.matmul(h, target, out=logits)
            own = logits.ravel().take(line[: len(at)] * len(bias) + at) + bias.take(at)
            np.exp(np.minimum(logits, 80, out=logits) if far else logits, out=logits)
            return own - np.log(logits @ weight)

        target, weight = np.ascontiguousarray(self.G.T), np.exp(self.a)
        for i in range(0, len(t), CHUNK):
            out[i : i + CHUNK] = share(h[i : i + CHUNK], target, self.a, weight, g[i : i + CHUNK])
        order = np.argsort(g.astype(np.uint16) if self.groups < 1 << 16 else g, kind="stable")
        cut = np.r_[0, np.cumsum(np.bincount(g, minlength=self.groups))]
        h, place, weights = h.take(order, axis=0), (t // self.groups).take(order), np.exp(biases)
        part = np.empty(len(t))
        for k in range(self.groups):
            for i in range(cut[k], cut[k + 1], CHUNK):
                j = min(i + CHUNK, cut[k + 1])
                part[i:j] = share(h[i:j], targets[k], biases[k], weights[k], place[i:j])
        out[order] += part
        return out / LN10


def _contexts(ids: np.ndarray, starts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Rows of (second to last, last, next); starts and before: where a piece begins, and the two ids before it."""
    w1, w2 = np.empty_like(ids), np.empty_like(ids)
    w1[1:], w2[2:] = ids[:-1], ids[:-2]
    second = starts + 1
    inside = second < np.r_[starts[1:], len(ids)]
    w1[starts], w2[starts] = before[:, 1], before[:, 0]
    w2[second[inside]] = before[inside, 1]
    return np.stack([w2, w1, ids], axis=1)


def _tokens(batches: Iterable[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[tuple]:
    """Rows, their tokens' places and units, starts of pieces, the ids before them, unlisted words by piece, whether they end."""
    tail = np.full(2, END_ID, np.int32)
    for rows, words, sizes, last in _words(batches):
        different, code, place, unit = vocabulary.distinct(words)
        stops = np.cumsum(sizes + last)
        starts, word = stops - sizes - last, np.ones(stops[-1], bool)
        if last:
            word[stops - 1] = False
        at, units = np.full(len(word), END_ID, np.int32), np.full(len(word), END_ID, np.int32)
        at[word], units[word] = place.take(code), unit.take(code)
        before = np.full((len(sizes), 2), END_ID, np.int32)
        before[0] = tail
        tail = np.full(2, END_ID, np.int32) if last else np.r_[tail, units][-2:]
        yield rows, at, units, starts, before, (different, code, np.repeat(np.arange(len(sizes)), sizes)), last


PARAMETERS = "part int, n double, v array<float>"
#: Parameters that are averaged together, as one row.
PART = 4096


def _trainer(vocabulary, model, turn: int, batch_size: int):
    """Trains a copy of the model on each shard; the rows of a shard lie together and in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        v = vocabulary.value

        def runs() -> Iterator[tuple[int, pa.RecordBatch]]:
            for batch in batches:
                shards = batch.column("shard").to_numpy()
                cut = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
                yield from ((int(shards[i]), batch.slice(i, j - i)) for i, j in zip(cut, cut[1:], strict=False) if i < j)

        def minibatches(texts: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
            """Rows of contexts, as many each time, however the texts come."""
            rest = np.empty((0, 3), np.int32)
            for _, _, units, starts, before, _, _ in _tokens(texts, v):
                rows = np.concatenate([rest, _contexts(units, starts, before)])
                whole = len(rows) - len(rows) % batch_size
                yield from (rows[i : i + batch_size] for i in range(0, whole, batch_size))
                rest = rows[whole:]
            if len(rest):
                yield rest

        for shard, texts in groupby(runs(), itemgetter(0)):
            own = Model(v.noise)
            if model is not None:
                own.load(model.value)
            n = own.train(minibatches(map(itemgetter(1), texts)), shard * ROUNDS + turn, RATE / (1 + turn))
            values = np.where(np.isfinite(values := own.values()), values, 0.0).astype(np.float32)
            parts = [values[i : i + PART] for i in range(0, len(values), PART)]
            cut = pa.array(np.r_[0, np.cumsum([len(p) for p in parts])], pa.int32())
            columns = [pa.array(range(len(parts)), pa.int32()), pa.array([float(n)] * len(parts)), pa.ListArray.from_arrays(cut, pa.array(values))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "n", "v"])

    return run


def _sum_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of each part over its shards, weighted by their tokens; all copies of a part are in one task."""
    sums: dict[int, list] = {}
    for batch in batches:
        for part, n, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            own = v.values.to_numpy(zero_copy_only=False).astype(np.float64) * n
            if part in sums:
                sums[part][0] += n
                sums[part][1] += own
            else:
                sums[part] = [n, own]
    for part, (n, v) in sums.items():
        mean = (v / n).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n]), pa.array([mean], pa.list_(pa.float32()))], names=["part", "n", "v"])


def fit(train: DataFrame, vocabulary, doc_id: str = "doc_id", text: str = "text") -> Model:
    """ROUNDS rounds, each the average of its shards' models; only averages reach the driver, part by part."""
    spark, words = train.sparkSession, vocabulary.value
    model = Model(words.noise)
    a_round = words.n / ROUNDS
    shards = max(1, math.ceil(a_round / max(SHARD_TOKENS, TOKENS_PER_PARAMETER * model.size())))
    batch_size = int(min(BATCH, max(128, a_round / shards // 500)))
    key = F.xxhash64(F.col(doc_id), F.col(text))
    rows = train.select(F.pmod(key, F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64(key), F.lit(ROUNDS)).alias("turn"), key.alias("key"), F.col(text).alias("text"))
    now = None
    for turn in range(ROUNDS):
        own = rows.where(F.col("turn") == turn).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key").select("shard", "text")
        parts = materialise(own.mapInArrow(_trainer(vocabulary, now, turn, batch_size), PARAMETERS), "lm-shards")
        done = parts.repartition(F.col("part")).mapInArrow(_sum_parts, PARAMETERS)
        found = sorted(done.collect(), key=lambda r: r["part"])
        discard(parts)
        if found:
            model.load(np.concatenate([np.array(r["v"]) for r in found]))
            now = spark.sparkContext.broadcast(model.values())
    return model


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<string>, times array<int>"


def _scorer(vocabulary, model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        v, scorer = vocabulary.value, model.value
        first = TaskContext.get().partitionId() << 40
        known = np.r_[v.c > 0, False]
        log_c = np.r_[np.log10(v.c + 1), 0.0]
        base_part = np.log10(v.n + v.v + 1)
        # A bucket's word has its share of the bucket; its own count comes later if the worker has none.
        other = np.r_[np.zeros(1 + v.n_words), np.log10(v.other)]
        sums, rare = np.zeros(4), []  # of a text's pieces so far
        for rows, at, units, starts, before, unlisted, last in _tokens(batches, v):
            own = log_c.take(at)
            p = scorer.log10(_contexts(units, starts, before))
            p += np.where(units > v.n_words, own - other.take(units), 0.0)
            size = np.diff(np.r_[starts, len(units)])
            found = np.stack([size, *[np.add.reduceat(x, starts) for x in (known.take(at).astype(np.int64), own - base_part, p)]]).astype(np.float64)
            found[:, 0] += sums
            rare.append(_unlisted(at, starts, unlisted, len(v.c), last))
            if not last:
                sums = found[:, 0]
                continue
            yield _scored(rows, found, rare, first)
            first += rows.num_rows
            sums, rare = np.zeros(4), []

    return run


def _unlisted(at: np.ndarray, starts: np.ndarray, unlisted: tuple, n_listed: int, last: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of each piece that have no count at hand: words, how often, and which of them are of which piece."""
    different, code, piece = unlisted
    word = np.ones(len(at), bool)
    if last:
        word[np.r_[starts[1:], len(at)] - 1] = False
    missing = np.flatnonzero(at[word] == n_listed)
    keys, times = np.unique(piece[missing] * len(different) + code[missing], return_counts=True)
    of, words = np.divmod(keys, max(1, len(different)))
    return different.take(pa.array(words)), times, np.searchsorted(of, np.arange(len(starts) + 1))


def _scored(rows: pa.RecordBatch, found: np.ndarray, rare: list[tuple], first: int) -> pa.RecordBatch:
    """found: a row's tokens, known ones, base and score; rare: of all pieces that end with these rows, earlier ones being of the first row."""
    words, times = pa.concat_arrays([r[0] for r in rare]).cast(pa.string()), np.concatenate([r[1] for r in rare])
    cut = rare[-1][2] + len(times) - len(rare[-1][1])
    cut = pa.array(np.r_[0, cut[1:]], pa.int32())
    columns = [
        pa.array(first + np.arange(rows.num_rows), pa.int64()),
        rows.column("doc_id"),
        rows.column("held_out"),
        *[pa.array(x.astype(np.int64)) for x in found[:2]],
        *[pa.array(x) for x in found[2:]],
        pa.ListArray.from_arrays(cut, words),
        pa.ListArray.from_arrays(cut, pa.array(times, pa.int32())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCORED.split(", ")])


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its tokens, how many are known, the unigram base score and the model's score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    train = rows.where(~F.col("held_out"))
    counts = count_tokens(train)
    vocabulary = spark.sparkContext.broadcast(vocabulary_of(counts))
    model = spark.sparkContext.broadcast(fit(train, vocabulary))
    scored = materialise(rows.mapInArrow(_scorer(vocabulary, model), SCORED), "lm-scored")
    rare = scored.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("v")).select("rid", F.col("v.rare").alias("token"), F.col("v.times").alias("times"))
    found = rare.join(counts, "token").groupBy("rid").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"), F.sum("times").alias("more_known"))
    out = scored.drop("rare", "times").join(found, "rid", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(vocabulary.value.n)).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
