"""Substring dedup, filter audit and token alignment against plain Python, and their awkward cases."""

import hashlib
import random
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from scenery.llm import filter_audit, oracles, substring_dedup, token_alignment
from tests.llm import data

ODD = ["doc_id", "text", "anchor", "segment", "place", "spans", "begin", "n", "removed", "row", "kept", "a`b", "first"]


def words_of(text):
    return (text or "").encode().split()


def cut_by_hand(rows):
    """(doc_id, text) -> (n_words, n_removed, digest) by the contract, window by window."""
    key = lambda i: substring_dedup.LAST if i is None else i
    first = {}
    for i, text in rows:
        w = words_of(text)
        for k in range(len(w) - 49):
            window = tuple(w[k : k + 50])
            first[window] = min(first.get(window, key(i)), key(i))
    out = []
    for i, text in rows:
        w, gone = words_of(text), set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < key(i):
                gone.update(range(k, k + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages():
    """Passages around the window's length in other surroundings, overlapping runs, repeats inside a text, two-word patterns."""
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    prose = lambda n: [word() for _ in range(n)]
    base, rows = prose(400), []
    for i in range(60):
        k, n = rng.randrange(300), rng.choice([48, 49, 50, 51, 52, 70, 99])
        rows.append((1000 - i, " ".join(prose(rng.randrange(40)) + base[k : k + n] + prose(rng.randrange(40)))))
    rows += [(i, " ".join(["x", "y"] * 60 + prose(i % 3))) for i in range(5)]
    rows += [(2000, " ".join(base)), (2001, "\n".join(base)), (None, " ".join(base[:80])), (None, " ".join(base[:80])), (2000, " ".join(base[100:300]))]
    rows += [(3000, " ".join(base[:60] + prose(20) + base[:60])), (3001, None), (3002, " \t "), (-5, " ".join(base[200:260]))]
    rows += [(4000 + k, " ".join(["w" * 200 + str(k % 2)] * 30 + base[k : k + 60])) for k in range(3)]
    return rows


def test_substrings_by_hand(spark):
    rows = passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, substring_dedup.report(docs).collect()), key=str) == cut_by_hand(rows)


def test_substrings_of_awkward_rows(spark):
    got = substring_dedup.report(data.documents(spark)).collect()
    assert sorted(map(tuple, got), key=str) == cut_by_hand([(r[0], r[1]) for r in data.rows()])
    assert substring_dedup.report(data.empty(spark)).count() == 0


def test_a_long_text_in_blocks(spark, monkeypatch):
    """Segments of a text may be cut anywhere: the windows that are found stay the same."""
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 700)
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", 90)
    base = data.prose(9, 1_000).split()
    texts = [" ".join(base), " ".join(base[300:420] + ["new"] + base[500:]), None, "short"]
    windows = {}
    for block in substring_dedup._blocks(texts):
        at = block.windows
        for row, word, h in zip(block.row[at].tolist(), block.word[at].tolist(), block.rolling[0].runs(at, at + 50).tolist(), strict=True):
            assert windows.setdefault((row, word), h) == h
        anchor, segment, begin, n = block.segments()
        assert n.sum() == len(at)
    assert {k for k in windows if k[0] == 0} == {(0, i) for i in range(951)}
    assert {k for k in windows if k[0] == 1} == {(1, i) for i in range(len(texts[1].split()) - 49)}
    assert all(windows[1, i] == windows[0, 300 + i] for i in range(71)) and len(set(windows.values())) == len({tuple(t.split()[k : k + 50]) for t in texts[:2] for k in range(len(t.split()) - 49)})


def test_clean_returns_other_columns(spark):
    text = data.prose(3, 80)
    rows = [(i, text if i < 3 else "alone here", *[f"{c}{i}" for c in ODD[2:]]) for i in range(4)]
    docs = spark.createDataFrame(rows, ODD)
    got = {r["doc_id"]: r for r in substring_dedup.clean(docs).collect()}
    assert got[0]["text"] == text and got[0]["removed"] == [] and got[3]["text"] == "alone here"
    assert got[1]["text"] == "" and [(x["begin"], x["end"]) for x in got[2]["removed"]] == [(0, 80)]
    assert all(got[i][c] == f"{c}{i}" for i in range(4) for c in ODD[2:] if c != "removed")


def audit_by_hand(rows, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1} for k in (0, 1))
    fails = []
    for i, text, source in rows:
        t, w = text or "", words_of(text)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in t for c in "#$%&*|")}
        f["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails.append((source or "", f, i in good and i is not None, i in toxic and i is not None))
    out, removed_by = {}, Counter()
    for part in {p for p, *_ in fails}:
        for order in map("".join, permutations("ABCDE")):
            left = [x for x in fails if x[0] == part]
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if x[1][letter]]
                left = [x for x in left if not x[1][letter]]
                own = [x for x in fails if x[0] == part and x[1][letter]]
                removed_by[part, letter] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(any(x[1][e] for e in order[: step - 1]) for x in own), sum(sum(x[1].values()) == 1 for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_by_hand(spark):
    rows = [(r[0], r[1], r[3]) for r in data.rows()] + [(500, "two words", ""), (None, "two words", "a"), (501, "", "b"), (502, "SHOUT " * 250, "b"), (503, data.prose(2, 300), "b"), (504, data.prose(2, 300), "c")]
    labels = [(8, 1, 0), (9, 1, 1), (12, 0, 1), (12, 1, 0), (503, 1, 0), (504, 1, 1), (None, 1, 1), (100, 1, 0), (7777, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got == audit_by_hand(rows, labels)


def test_audit_of_no_rows(spark):
    assert filter_audit.audit(data.empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


@pytest.mark.parametrize("name", ["SUBSTRINGS", "FILTER_AUDIT"])
def test_twins_on_awkward_rows(spark, name):
    con = duckdb.connect()
    frame = data.documents(spark).toPandas().astype({"doc_id": "Int64"})
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(0, 160, 2)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "cast(toxic as int) as toxic")
    con.register("documents", frame)
    con.register("labels", labels.toPandas())
    got = substring_dedup.report(data.documents(spark)) if name == "SUBSTRINGS" else filter_audit.audit(data.documents(spark), labels)
    want = con.sql(getattr(oracles, name)).select(", ".join(got.columns)).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


TEXTS = [
    None, "", " ", "  ", "\n", "one", " lead", "trail ", "two  spaces", "a\nb\n\nc", "line\nbreak \n odd", "tab\tbed \t x", "it's we'll I'D 12 345,6.7 $%& #!", "ünï cödé 日本語 текст 🎉🎉 á",
    "has ▁ mark", "<|endoftext|> <s> </s> <unk> <0x41>", "nul\0byte", "x y  z", "\x1c \x1dq r", "a" * 3_000, "Donaudampfschifffahrt " * 40, "\r\n\r\nwin\r\ndows;\r x", "don't can't\nwon't  'tis", "﻿bom mark",
]


def alignment_by_hand(rows):
    """By the libraries' own calls on whole texts, token by token."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(f"{token_alignment.FOLDER}/{token_alignment.A_FILE}")
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=f"{token_alignment.FOLDER}/{token_alignment.B_FILE}")
    printable = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160)]
    marks = {chr(b): b for b in printable}
    for b in range(256):
        if b not in printable:
            marks[chr(256 + len(marks) - len(printable))] = b
    with open(f"{token_alignment.FOLDER}/{token_alignment.A_FILE}") as f:
        names = {i: t for t, i in json.load(f)["model"]["vocab"].items()}

    def b_bytes(i):
        p = b_tok.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()

    docs = []
    for i, text in rows:
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        ab, bb = [bytes(marks[c] for c in names[x]) for x in a], [b_bytes(x) for x in b]
        if not text or not b"".join(ab) == b"".join(bb) == (" " + text).encode():
            docs.append((i, [], [], [], 0, ""))
            continue
        a_end, b_end = [sum(map(len, ab[: k + 1])) for k in range(len(ab))], [sum(map(len, bb[: k + 1])) for k in range(len(bb))]
        links = [(a[k], b[m]) for k in range(len(a)) for m in range(bisect_right(b_end, a_end[k] - len(ab[k])), bisect_left(b_end, a_end[k]) + 1)]
        groups, begin = [], (0, 0)
        for end in sorted(set(a_end) & set(b_end)):
            to = (a_end.index(end) + 1, b_end.index(end) + 1)
            groups.append(",".join(map(str, a[begin[0] : to[0]])) + "|" + ",".join(map(str, b[begin[1] : to[1]])))
            begin = to
        docs.append((i, a, b, links, len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    counts = Counter(p for d in docs for p in set(d[3]))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return sorted(((i, len(a), len(b), g, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), sha) for i, a, b, links, g, sha in docs), key=str)


@pytest.mark.parametrize("sent", [1 << 22, 40, 0])
def test_alignment_by_hand(spark, sent):
    rows = list(enumerate(TEXTS)) + [(None, "one"), (3, "one"), (3, "one"), (99, "\n".join(t for t in TEXTS if t and "▁" not in t)), (100, data.prose(7, 400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, token_alignment.align(docs, sent=sent).collect()), key=str) == alignment_by_hand(rows)


def test_alignment_in_small_groups(spark, monkeypatch):
    """However documents and chunks fall into groups and caches, chunks joined are the text, and results are the same."""
    for text in TEXTS:
        if text:
            assert "".join(token_alignment.chunks(text)) == " " + text
    tokens = token_alignment.Tokenizers(*token_alignment.vocabularies())
    monkeypatch.setattr(token_alignment, "CACHED", 5)
    known = token_alignment._Known(tokens)
    for text in TEXTS:
        if text and "▁" not in text:
            at, _ = known.of([token_alignment.chunks(text)])
            whole = token_alignment.Aligned(tokens, [" " + text])
            assert "".join(known.groups[i] for i in at) == whole.written()[0]
            assert b"".join(known.links[i] for i in at) == whole.links.astype("<u4").tobytes()


def test_alignment_of_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in data.rows() if len(r[1] or "") < 5_000]
    docs = data.documents(spark).where("text is null or length(text) < 5000")
    assert sorted(map(tuple, token_alignment.align(docs).collect()), key=str) == alignment_by_hand(rows)
    assert token_alignment.align(data.empty(spark)).count() == 0
    assert token_alignment.pair_counts(docs).where("best").select("a_id").distinct().count() == token_alignment.pair_counts(docs).select("a_id").distinct().count()
