"""Substring dedup: windows of WINDOW words that a document with a smaller id holds as well are cut out.

Rabin-Karp hashes are polynomials modulo 2^64 over words, words being hashed by the same
rule over their bytes (words above LONG bytes by BLAKE2); prefix sums give the hash of every
run of words in constant time. The windows of a text are named by an anchor, the run of
ANCHOR words with the least hash in the window: equal windows have equal anchors at equal
places. Neighbouring windows of one anchor make a segment, some forty words on average, and
Spark counts segments first: a segment that an earlier document holds goes with all its
windows, so that copies, however many, collapse in the tasks that read them. Only where an
anchor stands in different segments are single windows counted, by two independent 64-bit
hashes, in the first document of each such segment. All counts are partial sums and smallest
ids; what they are joined back to is split by Spark where a key is hot. Repeated windows
merge into maximal intervals of words, which are cut out.

Defined results: words are runs of other than white space; null and empty texts have none; a
text of fewer than WINDOW words stays; a text of any length is hashed whole, block by block;
windows are judged on the input, so that a chain of documents each loses what an earlier one
holds; rows of equal doc_id are not earlier than one another, and such rows of equal text
are cleaned alike; a null doc_id counts as the largest; other columns, whatever their names,
are not read, and `clean` returns them as they are; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenery.llm.common import materialise

WINDOW = 50
ANCHOR = 13
LONG = 64
LAST = 2**63 - 1
#: Bytes whose words, and words whose windows, are hashed together.
BLOCK_BYTES = 1 << 20
BLOCK_WORDS = 1 << 17

_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Odd multipliers: of bytes and of words, for two independent hashes.
_BASES = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64; kept for the worker's next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK_BYTES + 1024), base, np.uint64)
        have[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(have)
    return have[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of runs of a sequence, by prefix sums of value times power."""

    def __init__(self, values: np.ndarray, base: int):
        self.inverse = pow(base, -1, 1 << 64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(base, len(values)), dtype=np.uint64)])

    def runs(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[begin]) * _powers(self.inverse, len(self.sums))[begin])


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of UTF-8 bytes begin, and two hashes of each."""
    out, at = [], 0
    while at < len(data):
        cut = _BLANK.search(data, at + BLOCK_BYTES) if len(data) - at > BLOCK_BYTES else None
        upto = cut.start() if cut else len(data)
        block = np.frombuffer(data, np.uint8, upto - at, at)
        edge = np.concatenate([[True], _WHITE[block], [True]])
        begin, end = np.flatnonzero(edge[:-1] & ~edge[1:]), np.flatnonzero(~edge[:-1] & edge[1:])
        values = block.astype(np.uint64) + np.uint64(1)
        hashes = [Rolling(values, bases[0]).runs(begin, end) for bases in _BASES]
        for k in np.flatnonzero(end - begin > LONG).tolist():
            own = hashlib.blake2b(data[at + begin[k] : at + end[k]], digest_size=16).digest()
            hashes[0][k], hashes[1][k] = np.frombuffer(own, np.uint64)
        out.append((begin + at, *hashes))
        at = upto
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Block:
    """Words of some documents, or of a part of a long one, one behind the other.

    `row`, `word`: each word's document, and its number there.
    """

    def __init__(self, pieces: list[tuple[int, int, np.ndarray, np.ndarray]]):
        self.row = np.concatenate([np.full(len(p[2]), p[0]) for p in pieces])
        self.word = np.concatenate([np.arange(p[1], p[1] + len(p[2])) for p in pieces])
        self.rolling = [Rolling(np.concatenate([p[2 + k] for p in pieces]), bases[1]) for k, bases in enumerate(_BASES)]
        # A window lies within one document, whose words are numbered one by one.
        n = len(self.row) - WINDOW + 1
        self.windows = np.flatnonzero((self.row[:n] == self.row[WINDOW - 1 :]) & (self.word[:n] + WINDOW - 1 == self.word[WINDOW - 1 :])) if n > 0 else np.zeros(0, np.int64)

    def segments(self) -> tuple[np.ndarray, ...]:
        """Anchor, hash, first window and number of windows of each segment."""
        at = self.windows
        if not len(at):
            return (*[np.zeros(0, np.uint64)] * 2, *[np.zeros(0, np.int64)] * 2)
        begin = np.arange(len(self.row) - ANCHOR + 1)
        anchors = self.rolling[0].runs(begin, begin + ANCHOR)
        place = at + np.lib.stride_tricks.sliding_window_view(anchors, WINDOW - ANCHOR + 1)[at].argmin(1)
        first = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(at) != 1)]))
        n = np.diff(first, append=len(at))
        begin = at[first]
        return anchors[place[first]], self.rolling[1].runs(begin, begin + n + WINDOW - 1), begin, n


def _blocks(texts: Iterable[str | None]) -> Iterator[Block]:
    """Blocks of all texts; windows that cross two blocks of a long text are in the second."""
    pieces: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    held = 0
    waiting: list[tuple[int, bytes]] = []
    size = 0

    def hashed() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Texts are hashed together, a space between them."""
        if not waiting:
            return
        begin, h1, h2 = word_hashes(b" ".join(data for _, data in waiting))
        ends = np.cumsum([len(data) + 1 for _, data in waiting])
        to = np.searchsorted(begin, ends)
        for (row, _), i, j in zip(waiting, [0, *to[:-1]], to, strict=True):
            yield row, h1[i:j], h2[i:j]

    def placed(last: bool) -> Iterator[Block]:
        nonlocal pieces, held, waiting, size
        for row, h1, h2 in hashed():
            for at in range(0, max(len(h1) - WINDOW + 1, 0), BLOCK_WORDS):
                upto = at + BLOCK_WORDS + WINDOW - 1
                pieces.append((row, at, h1[at:upto], h2[at:upto]))
                held += len(pieces[-1][2])
                if held >= BLOCK_WORDS:
                    yield Block(pieces)
                    pieces, held = [], 0
        waiting, size = [], 0
        if last and pieces:
            yield Block(pieces)
            pieces, held = [], 0

    for row, text in enumerate(texts):
        data = (text or "").encode()
        if len(data) >= 2 * WINDOW - 1:  # fewer bytes have no window
            waiting.append((row, data))
            size += len(data)
        if size >= BLOCK_BYTES:
            yield from placed(False)
    yield from placed(True)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


KEYS = ["place", "text_hash"]
SEGMENT = "place long, text_hash long, anchor long, segment long, begin int, n int"


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place, text_hash = (batch.column(k).to_numpy() for k in (0, 1))
        for block in _blocks(batch.column(3).to_pylist()):
            anchor, segment, begin, n = block.segments()
            row = block.row[begin]
            columns = [pa.array(place[row]), pa.array(text_hash[row]), _signed(anchor), _signed(segment), pa.array(block.word[begin].astype(np.int32)), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["place", "text_hash", "anchor", "segment", "begin", "n"])


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both hashes of the windows asked for, `spans` (first window, number) of each document."""
    for batch in batches:
        place, text_hash = (batch.column(k).to_numpy() for k in (0, 1))
        spans = batch.column(4).to_pylist()
        asked: list[np.ndarray] = []
        for own in spans:
            last = max(s["begin"] + s["n"] for s in own)
            change = np.zeros(last + 1, np.int64)
            for s in own:
                change[s["begin"]] += 1
                change[s["begin"] + s["n"]] -= 1
            asked.append(np.cumsum(change)[:-1] > 0)
        offset = np.cumsum([0, *map(len, asked)])
        flat = np.concatenate(asked) if asked else np.zeros(0, bool)
        for block in _blocks(batch.column(3).to_pylist()):
            at = block.windows
            row, word = block.row[at], block.word[at]
            inside = word < offset[row + 1] - offset[row]
            at, row, word = at[inside], row[inside], word[inside]
            chosen = flat[offset[row] + word]
            at, row, word = at[chosen], row[chosen], word[chosen]
            hashes = [_signed(r.runs(at, at + WINDOW)) for r in block.rolling]
            yield pa.RecordBatch.from_arrays([pa.array(place[row]), pa.array(text_hash[row]), *hashes, pa.array(word.astype(np.int32))], names=["place", "text_hash", "h1", "h2", "begin"])


def _keyed(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """place (a null id comes last), the text's hash, the id and the text."""
    return docs.select(F.coalesce(doc_id.cast("long"), F.lit(LAST)).alias("place"), F.xxhash64(text).alias("text_hash"), doc_id.alias("id"), text.alias("text"))


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document that loses words (place, text_hash): spans of repeated windows, as first window and number."""
    rows = _keyed(docs, F.col(doc_id), F.col(text))
    segments = materialise(rows.mapInArrow(_segments, SEGMENT), "substring-segments")
    key = ["anchor", "segment"]
    held = segments.groupBy(*key).agg(F.min(F.struct("place", "text_hash", "begin", "n")).alias("first"), F.max("place").alias("last"))
    held = materialise(held, "substring-held")
    again = held.where(F.col("last") > F.col("first.place")).select(*key, F.col("first.place").alias("earliest"))
    whole = segments.join(again, key).where(F.col("place") > F.col("earliest")).select(*KEYS, "begin", "n")
    # Anchors in several segments, of different documents: their windows are counted one by one.
    mixed = held.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.min("first.place").alias("lo"), F.max("first.place").alias("hi")).where("m > 1 and lo < hi").select("anchor")
    asked = held.join(mixed, "anchor").select("first.*").groupBy(*KEYS).agg(F.collect_list(F.struct("begin", "n")).alias("spans"))
    asked = materialise(asked, "substring-asked")
    single = rows.join(asked, KEYS).select(*KEYS, "id", "text", "spans").mapInArrow(_windows, "place long, text_hash long, h1 long, h2 long, begin int")
    counted = single.groupBy("h1", "h2").agg(F.min("place").alias("earliest"), F.max("place").alias("last")).where("earliest < last").drop("last")
    hit = single.join(counted, ["h1", "h2"]).where(F.col("place") > F.col("earliest")).select(*KEYS, "begin", F.lit(1).alias("n"))
    return whole.unionByName(hit).groupBy(*KEYS).agg(F.collect_set(F.struct("begin", "n")).alias("spans"))


def intervals(n_words: int, spans: list[dict]) -> list[tuple[int, int]]:
    """The maximal runs of words, from and to, that the spans' windows cover."""
    change = np.zeros(n_words + 1, np.int64)
    for s in spans:
        change[s["begin"]] += 1
        change[s["begin"] + s["n"] + WINDOW - 1] -= 1
    covered = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


REMOVED = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _cut(words: list[bytes], found: list[tuple[int, int]]) -> bytes:
    stays = np.ones(len(words), bool)
    for i, j in found:
        stays[i:j] = False
    return b" ".join(compress(words, stays.tolist()) if found else words)


def _digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, digests = [], [], []
        for text, spans in zip(batch.column(3), batch.column(4), strict=True):
            words = (text.as_py() or "").encode().split()  # splits at just the white space of words
            found = intervals(len(words), spans.as_py() or []) if spans.is_valid else []
            n_words.append(len(words))
            n_removed.append(sum(j - i for i, j in found))
            digests.append(hashlib.sha256(_cut(words, found)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its words, how many are cut out, and the SHA-256 of the others, joined by one space."""
    rows = _keyed(docs, F.col(doc_id).cast("long"), F.col(text))
    rows = rows.join(removals(docs, doc_id, text), KEYS, "left").select(*KEYS, "id", "text", "spans")
    return rows.mapInArrow(_digested, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _cleaned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed = [], []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            whole = text.as_py()
            words = (whole or "").encode().split()
            found = intervals(len(words), spans.as_py()) if spans.is_valid else []
            kept.append(_cut(words, found).decode() if found else whole)
            removed.append([{"begin": i, "end": j} for i, j in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(removed, REMOVED)], names=["row", "kept", "removed"])


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with what is left of their texts, and `removed`, the intervals of words that were cut out; it replaces a column of that name.

    A text that loses words has the others joined by one space; other texts stay as they are.
    """
    row = docs.select(F.struct("*").alias("row"))
    own = row.select("row", F.coalesce(F.col("row")[doc_id].cast("long"), F.lit(LAST)).alias("place"), F.col("row")[text].alias("text")).withColumn("text_hash", F.xxhash64("text"))
    own = own.join(removals(docs, doc_id, text), KEYS, "left").select("row", "text", "spans")
    kinds = own.select("row", F.col("text").alias("kept"), F.array().cast("array<struct<begin:long,end:long>>").alias("removed")).schema
    out = own.mapInArrow(_cleaned, kinds)
    return out.select(*[F.col("kept").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c != "removed"], "removed")
