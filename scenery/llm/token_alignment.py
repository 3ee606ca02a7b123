"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A text, with one space before it, is encoded by a byte-level BPE (A) and a sentence-piece
BPE (B). The ends of the B tokens are a static interval index over the text's bytes; every
A token bisects it with its two edges and so lists the B tokens it overlaps, its links.
An offset that no token of either side spans, where an A and a B token both end, is a
group boundary.

Neither tokenizer merges across a single space or line break between two visible
characters, so a text is cut before it into chunks that are aligned on their own, each
distinct chunk once while it stays in the worker's cache (CACHED chunks or CACHED_CHARS
characters; emptied when full). `_check` proves this of the vocabularies before they are
used.

The texts are read once: every document's sums, digest and distinct linked pairs of ids,
each with its number of links, are written to the shared folder, the pairs compressed. From
these rows each task adds up the pairs of its documents and Spark adds up the tasks; then
each document reads its sums from the counts. The SENT most frequent pairs travel to the
workers in a broadcast of that bounded size, with each A id's highest count (one number an
id of the vocabulary); links of other pairs come out as rows and are joined with the counts,
with the same result.

Defined results: null and empty texts, and texts of which either side's bytes differ from
the text's (such as one that holds U+2581), have no tokens: zeros, an empty string, and
no part in any count; a text of any length is encoded whole; special tokens' strings are
plain text; of equal highest counts all are best; rows that repeat count as so many
documents and each gets its row; a null doc_id is returned as it is; other columns,
whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenery.llm.common import discard, materialise

FOLDER = "/opt/tokenizers"
A_FILE = "byte_bpe_50k.json"
B_FILE = "piece_bpe_32k.model"
#: Pairs sent to the workers, 12 bytes each.
SENT = 1 << 22
CACHED = 1 << 19
CACHED_CHARS = 1 << 24
#: Characters of text whose new chunks are aligned together, and pairs held before they are added up.
GROUP_CHARS = 1 << 21
HELD_PAIRS = 1 << 21

#: A place before a single space or line break between visible characters.
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: White space of any kind but the space.
BLANKS = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) != " "]
#: New chunks that are encoded as one string.
LINE = 64

#: The pattern by which the byte-level vocabulary splits a text before merging: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def vocabularies(folder: str = FOLDER) -> tuple[bytes, bytes]:
    """The two vocabulary files, about 2 MB together; they travel to the workers as they are."""
    with open(os.path.join(folder, A_FILE), "rb") as a, open(os.path.join(folder, B_FILE), "rb") as b:
        return a.read(), b.read()


def chunks(text: str) -> list[str]:
    """Space+text, cut before each single space or line break between visible characters; joined they are space+text."""
    whole = " " + text
    if "\0" in text or "  " in whole or "\n\n" in text or whole[-1] == " " or any(c in text and (c + " " in whole or " " + c in whole or c != "\n" and (c + "\n" in text or "\n" + c in text)) for c in BLANKS):
        return CUT.split(whole)
    return whole.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]


def _bytes_of_marks() -> dict[str, int]:
    """Byte-level vocabularies write a visible Latin-1 byte as itself, the n-th other byte as code point 256 + n."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Tokenizers:
    """Both encoders, built from their files, with every token's bytes."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        import tiktoken

        spec = json.loads(a_file)
        marks, added = _bytes_of_marks(), {t["id"] for t in spec["added_tokens"]}
        vocabulary = spec["model"]["vocab"]
        self.a_bytes = {i: bytes(marks[c] for c in token) for token, i in vocabulary.items() if i not in added}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={b: i for i, b in self.a_bytes.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces) if not self.b.is_control(i)}
        self._check(spec, pieces)
        self.a_len, self.b_len = (np.array([len(of.get(i, b"")) for i in range(1 << 16)], np.int64) for of in (self.a_bytes, self.b_bytes))
        self.a_flat, self.b_flat = (np.frombuffer(b"".join([of.get(i, b"") for i in range(1 << 16)]), np.uint8) for of in (self.a_bytes, self.b_bytes))
        #: A token's id, and what stands after it in the list of groups.
        self.written = [f"{i}{after}" for after in ",|;" for i in range(1 << 16)]

    def _check(self, spec: dict, pieces: list[str]) -> None:
        """Merges are ranked by id, so that ranks alone repeat them; no piece goes on over a space or line break; ids fit 16 bits."""
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        if any(vocabulary["".join(m if isinstance(m, list) else m.split(" "))] != 256 + k for k, m in enumerate(merges)):
            raise ValueError("the byte-level vocabulary's ids do not follow its merges")
        if any(re.search("[^▁]▁|\n", p) for p in pieces) or max(len(vocabulary), len(pieces)) > 1 << 16:
            raise ValueError("a piece spans a space or a line break, or an id is above 16 bits")

    def _lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole lines, one behind the other. B adds a space to what it gets: it stands for the line's own, or is dropped."""
        a = [i for t in texts for i in self.a.encode_ordinary(t)]
        spaced = [t[0] == " " for t in texts]
        b = self.b.encode([t[own:] for t, own in zip(texts, spaced, strict=True)], num_threads=1)
        b = [ids if own else ids[1:] for ids, own in zip(b, spaced, strict=True)]
        return np.array(a, np.int64), np.fromiter(itertools.chain.from_iterable(b), np.int64, sum(map(len, b)))

    @staticmethod
    def _decoded(ids: np.ndarray, length: np.ndarray, flat: np.ndarray) -> np.ndarray:
        n = length[ids]
        begins = (np.cumsum(length) - length)[ids]
        return flat[np.arange(int(n.sum())) + np.repeat(begins - np.cumsum(n) + n, n)]

    @staticmethod
    def in_order(texts: list[str]) -> tuple[list[str], int]:
        """The chunks that can stand side by side in a line come first; their number."""
        clean = [t for t in texts if len(t) > 1 and not t[1].isspace() and not t[-1].isspace()]
        return (texts if len(clean) == len(texts) else clean + [t for t in texts if len(t) < 2 or t[1].isspace() or t[-1].isspace()]), len(clean)

    def encode(self, texts: list[str], n_clean: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's and B's ids of chunks, the first n_clean in lines; their number for each chunk, and whether both sides' bytes are the chunk's."""
        a, b = self._lines(["".join(texts[i : min(i + LINE, n_clean)]) for i in range(0, n_clean, LINE)] + texts[n_clean:])
        own = [t.encode() for t in texts]
        ends, whole = np.cumsum(np.fromiter(map(len, own), np.int64, len(own))), np.frombuffer(b"".join(own), np.uint8)
        counts = []
        for ids, length, flat in ((a, self.a_len, self.a_flat), (b, self.b_len, self.b_flat)):
            at = np.searchsorted(np.cumsum(length[ids]), ends, "left") + 1
            counts.append(np.diff(at, prepend=0))
            if not np.array_equal(self._decoded(ids, length, flat), whole):
                if len(texts) == 1:  # this text's bytes differ
                    return a[:0], b[:0], np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, bool)
                each = [self.encode([t], 0) for t in texts]
                return tuple(np.concatenate(x) for x in zip(*each, strict=True))
        return a, b, *counts, np.ones(len(texts), bool)


class Aligned:
    """The alignment of many chunks at once: one behind the other, they are one run of bytes whose chunk ends both sides share.

    `texts` has the chunks in the order of all results.
    """

    def __init__(self, tokens: Tokenizers, texts: list[str]):
        self.texts, n_clean = tokens.in_order(texts)
        self.a, self.b, self.n_a, self.n_b, self.valid = tokens.encode(self.texts, n_clean)
        a_ends, b_ends = np.cumsum(tokens.a_len[self.a]), np.cumsum(tokens.b_len[self.b])
        # Stabbing: the first B token that ends after the A token's start, the last that starts before its end.
        first = np.searchsorted(b_ends, a_ends - tokens.a_len[self.a], "right")
        last = np.searchsorted(b_ends, a_ends, "left")
        n = last - first + 1
        before = np.cumsum(n) - n
        partner = np.arange(int(n.sum())) - np.repeat(before - first, n)
        #: Links in order of their A tokens: A id above 16 bits of B id.
        self.links = (np.repeat(self.a, n) << 16) | self.b[partner]
        self.bounds = np.intersect1d(a_ends, b_ends, assume_unique=True)
        self.a_group, self.b_group = np.searchsorted(self.bounds, a_ends, "left"), np.searchsorted(self.bounds, b_ends, "left")
        a_to = np.cumsum(self.n_a)
        self.n_links = self._per_chunk(n, a_to, self.n_a)
        closing = np.diff(self.a_group, append=self.a_group[-1:] + 1) if len(self.a) else n
        self.n_groups = self._per_chunk(closing, a_to, self.n_a)
        self.tokens = tokens

    @staticmethod
    def _per_chunk(values: np.ndarray, to: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Sums of the values over each chunk's own elements."""
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[to] - sums[to - n]

    def written(self) -> list[str]:
        """Each chunk's groups, `a,a|b;`, every group closed by a semicolon."""
        a_at = np.arange(len(self.a)) + np.searchsorted(self.b_group, self.a_group, "left")
        b_at = np.arange(len(self.b)) + np.searchsorted(self.a_group, self.b_group, "right")
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[a_at] = self.a + ((np.diff(self.a_group, append=-1) != 0) << 16)
        code[b_at] = self.b + ((np.diff(self.b_group, append=-1) != 0) << 17)
        parts = [self.tokens.written[i] for i in code.tolist()]
        to = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(parts[i:j]) for i, j in zip([0, *to], to, strict=False)]


_BUILT: dict[bytes, Tokenizers] = {}


def _tokenizers(files: tuple[bytes, bytes]) -> Tokenizers:
    """Built once in a worker."""
    key = hashlib.sha256(b"".join(files)).digest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Tokenizers(*files)
    return _BUILT[key]


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[list[str]]]]:
    """doc_ids and chunks of documents of some GROUP_CHARS characters together."""
    ids, cut, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            ids.append(key)
            cut.append(chunks(text) if text else [])
            size += len(text)
            if size >= GROUP_CHARS:
                yield ids, cut
                ids, cut, size = [], [], 0
    if ids:
        yield ids, cut


class _Numbers(dict):
    """Numbers chunks as they are first asked for."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n

    def of(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all chunks of some documents, and where each document's end."""
        self.new: list[str] = []
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        return np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(cut)), np.int64, int(sizes.sum())), np.cumsum(sizes)


class _Known:
    """Of every numbered chunk its groups as text, its links' bytes, and a row of sums, validity last."""

    def __init__(self, tokens: Tokenizers):
        self.tokens = tokens
        self._empty()

    def _empty(self) -> None:
        self.numbers, self.groups, self.links, self.rows, self.chars = _Numbers(), [], [], np.zeros((0, 5), np.int64), 0

    def of(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.numbers) > CACHED or self.chars > CACHED_CHARS:
            self._empty()
        at, to = self.numbers.of(cut)
        if new := self.numbers.new:
            found = Aligned(self.tokens, new)
            links, ends = found.links.astype("<u4").tobytes(), (4 * np.cumsum(found.n_links)).tolist()
            places = np.fromiter(map(self.numbers.__getitem__, found.texts), np.int64, len(new))
            self.groups += [""] * len(new)
            self.links += [b""] * len(new)
            for place, text, i, j in zip(places.tolist(), found.written(), [0, *ends], ends, strict=False):
                self.groups[place], self.links[place] = text, links[i:j]
            self.rows = np.concatenate([self.rows, np.empty((len(new), 5), np.int64)])
            self.rows[places] = np.stack([found.n_a, found.n_b, found.n_groups, found.n_links, found.valid], 1)
            self.chars += sum(map(len, new))
        return at, to


def _added_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts)


#: What a document has, but for the counts over all documents.
OWN = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs int, pairs binary"


def _packed(links: bytes) -> tuple[int, bytes]:
    """The distinct pairs in order, as steps, and the links of each; the bytes of equal weight stand together, which compresses well."""
    pairs, m = np.unique(np.frombuffer(links, "<u4"), return_counts=True)
    words = np.concatenate([np.diff(pairs, prepend=np.uint32(0)), m.astype("<u4")]).astype("<u4")
    return len(pairs), pa.compress(words.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8)
    words = np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    return np.cumsum(words[:n]), words[n:]


def _own(files: tuple[bytes, bytes]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(_tokenizers(files))
        for ids, cut in _groups(batches):
            at, to = known.of(cut)
            sums, digests, pairs = np.zeros((len(ids), 4), np.int64), [""] * len(ids), [(0, b"")] * len(ids)
            for k, own in enumerate(np.split(at, to[:-1])):
                rows = known.rows[own]
                if len(own) and rows[:, 4].all():
                    sums[k] = rows[:, :4].sum(0)
                    own = own.tolist()
                    digests[k] = hashlib.sha256("".join(map(known.groups.__getitem__, own))[:-1].encode()).hexdigest()
                    pairs[k] = _packed(b"".join(map(known.links.__getitem__, own)))
            n, data = zip(*pairs, strict=True)
            columns = [pa.array(ids, pa.int64()), *[pa.array(sums[:, i]) for i in range(4)], pa.array(digests, pa.string()), pa.array(n, pa.int32()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *SUMS[:4], "groups_sha256", "n_pairs", "pairs"])

    return run


def _pairs_of(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    return [_unpacked(n, data) for n, data in zip(batch.column("n_pairs").to_pylist(), batch.column("pairs").to_pylist(), strict=True)]


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs and the documents of a task that hold them; a pair may come out more than once."""

    def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])

    keys, counts, held = [], [], 0
    for batch in batches:
        for own, _ in _pairs_of(batch):
            keys.append(own)
            counts.append(np.ones(len(own), np.int64))
            held += len(own)
            if held >= HELD_PAIRS:
                keys, counts = ([x] for x in _added_up(keys, counts))
                held = len(keys[0])
                if held >= HELD_PAIRS // 2:
                    yield rows(keys[0], counts[0])
                    keys, counts, held = [], [], 0
    if keys:
        yield rows(*_added_up(keys, counts))


REST = pa.list_(pa.struct([("pair", pa.int64()), ("m", pa.int64())]))


def _measured(sent):
    """Adds n_best and count_sum by the counts that were sent, and the links whose pair was not."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, pair_counts, best = sent.value
        for batch in batches:
            n_best, count_sum, rests = [], [], []
            for own, m in _pairs_of(batch):
                at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
                there = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
                n = np.where(there, pair_counts[at] if len(pairs) else 0, 0)
                n_best.append(int(m[there & (n == best[own >> 16])].sum()))
                count_sum.append(int((m * n).sum()))
                rests.append([{"pair": p, "m": x} for p, x in zip(own[~there].tolist(), m[~there].tolist(), strict=True)])
            columns = {c: batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
            columns |= {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()), "groups_sha256": batch.column("groups_sha256"), "rest": pa.array(rests, REST)}
            yield pa.RecordBatch.from_pydict(columns)

    return run


ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, rest array<struct<pair:long,m:long>>"


def pair_counts(docs: DataFrame, folder: str = FOLDER, text: str = "text") -> DataFrame:
    """One row per linked pair of ids: a_id, b_id, the number of documents that hold it, and whether that is its A id's highest."""
    own = _aligned(docs, folder, F.lit(0), text)
    counts = _counted(own)
    discard(own)
    best = counts.groupBy(F.shiftright("pair", 16).alias("a_id")).agg(F.max("n").alias("top"))
    rows = counts.select(F.shiftright("pair", 16).alias("a_id"), F.col("pair").bitwiseAND(0xFFFF).alias("b_id"), "n")
    return rows.join(best, "a_id").select("a_id", "b_id", "n", (F.col("n") == F.col("top")).alias("best"))


def _aligned(docs: DataFrame, folder: str, doc_id: Column, text: str) -> DataFrame:
    rows = docs.select(doc_id.cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_own(vocabularies(folder)), OWN)
    return materialise(rows, "alignment-own")


def _counted(own: DataFrame) -> DataFrame:
    found = own.select("n_pairs", "pairs").mapInArrow(_added, "pair long, n long")
    return materialise(found.groupBy("pair").agg(F.sum("n").alias("n")), "alignment-counts")


def align(docs: DataFrame, folder: str = FOLDER, doc_id: str = "doc_id", text: str = "text", sent: int = SENT) -> DataFrame:
    """One row per document: tokens of either side, groups, links, and the links' counts over all documents.

    n_best: links whose pair is held by the most documents of all pairs of its A id.
    """
    spark = docs.sparkSession
    own = _aligned(docs, folder, F.col(doc_id), text)
    counts = _counted(own)
    tops = counts.groupBy(F.shiftright("pair", 16).alias("a_id")).agg(F.max("n").alias("top"))
    best = np.zeros(1 << 16, np.int64)
    for row in tops.collect():  # one row an id of A's vocabulary at most
        best[row["a_id"]] = row["top"]
    whole = counts.count() <= sent
    chosen = (counts if whole else counts.orderBy(F.desc("n"), "pair").limit(sent)).toArrow().sort_by("pair")
    table = spark.sparkContext.broadcast((chosen.column("pair").to_numpy().astype(np.uint32), chosen.column("n").to_numpy(), best))
    rows = own.mapInArrow(_measured(table), ROW)
    if whole:
        discard(counts)
        return rows.drop("rest")
    rows = materialise(rows, "alignment-rows")
    # Documents of equal groups have equal links, so that repeated rows are looked up once.
    asked = rows.where(F.size("rest") > 0).dropDuplicates(["doc_id", "groups_sha256"]).select("doc_id", "groups_sha256", F.explode("rest").alias("r"))
    asked = asked.select("doc_id", "groups_sha256", "r.pair", "r.m").join(counts, "pair").join(tops.select("a_id", "top"), F.shiftright("pair", 16) == F.col("a_id"))
    more = asked.groupBy(F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), "groups_sha256").agg(
        F.sum(F.col("m") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("n") == F.col("top"), F.col("m")).otherwise(0)).alias("more_best")
    )
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(-(2**63)))).join(more, ["k", "groups_sha256"], "left")
    return rows.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
