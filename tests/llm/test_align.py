"""Cross-tokenizer alignment against whole texts encoded by the libraries and ends walked in step."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from agorametrics.llm import align
from agorametrics.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "  ", "a  b ", "x ▁y z", "<|endoftext|> a<s> </s>", "\x00 a\n b\t c", "日本語 テキスト  です。 ok", "é" * 50, "　 x   y",
    "don't  we're 1234 5 ½ ﬁ", "a" * 3000, "👩‍👩‍👧 🇩🇪  x", "<0x41> b", "<unk> b", "tab\t\tx  \n\n  y", "﻿a​ b", "한국어 텍스트 ", "x\r\n y",
    "the same text twice", "the same text twice", "word " * 5000,
]


def brute(rows):
    """Expected columns of each (doc_id, text), in order."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = align.byte_letters()
    bytes_a = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    found, held = [], Counter()
    for _, text in rows:
        groups = []
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            parts = [bytes_a[i] for i in ids[0]], [
                bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
            if all(b"".join(p) == (" " + text).encode() for p in parts):
                at, ends, start = [0, 0], [0, 0], [0, 0]
                while at[0] < len(ids[0]) or at[1] < len(ids[1]):
                    side = int(ends[0] > ends[1])
                    ends[side] += len(parts[side][at[side]])
                    at[side] += 1
                    if ends[0] != ends[1]:
                        continue
                    groups.append((ids[0][start[0]:at[0]], ids[1][start[1]:at[1]]))
                    start = list(at)
        found.append(groups)
        held.update({(x, y) for p, q in groups for x in p for y in q})
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for (doc_id, _), groups in zip(rows, found, strict=True):
        links = [(x, y) for p, q in groups for x in p for y in q]
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((doc_id, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(links),
                    sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out, found


@pytest.mark.parametrize("frequent", [align.FREQUENT, 20, 1])
def test_equals_brute_force(spark, table, frequent):
    rows = [(i if i != 5 else None, t) for i, t in enumerate(ODD)]
    got = align.scores(table([(*r, "x") for r in rows], "doc_id long, text string, pairs string"), A, B, frequent)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows)[0], key=str)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op11_token_alignment"](spark, folder).collect())) == sorted(brute(rows)[0])


def test_groups_are_the_ids_of_both_sides(table):
    rows = list(enumerate(ODD))
    got = {r.doc_id: [(list(g.a), list(g.b)) for g in r.groups] for r in align.groups(table(rows, "doc_id long, text string"), A, B).collect()}
    assert [got[i] for i, _ in rows] == [[(list(p), list(q)) for p, q in g] for g in brute(rows)[1]]


def test_files_that_cannot_be_cut_are_encoded_whole(monkeypatch):
    own = align.Pair(A, B)
    assert own.cuttable
    assert not own._cuttable(A, ["▁a", "a▁b"])
    monkeypatch.setattr(own, "cuttable", False)
    found = align.Chunked(own, pa.array(["a b  c", None, "d e"]))
    assert found.doc.tolist() == [0, 2]
    assert sum(doc.tolist().count(0) for *_, doc in found.slabs()) == 4


def test_slabs_wide_groups_and_a_full_memory_change_nothing(table, monkeypatch):
    rows = list(enumerate([*ODD, "日本語" * 40, "x" * 500 + " é" * 30]))
    want = [tuple(r) for r in align.aligned(table(rows, "doc_id long, text string"), A, B).collect()]
    own = align.worker(A, B)
    small = align.Pair(A, B)
    monkeypatch.setattr(align, "SLAB", 7)
    monkeypatch.setattr(align, "WIDE", 1)
    monkeypatch.setattr(align, "CACHE", 3)
    monkeypatch.setattr(align, "JOINED", 2)
    column = pa.array([t for _, t in rows])
    for pair in (own, small):
        counts, parts = [[0] * 4 for _ in rows], []
        for ids_a, ids_b, n_a, n_b, doc in align.Chunked(pair, column).slabs():
            for i, x, y in zip(doc.tolist(), n_a.tolist(), n_b.tolist(), strict=True):
                counts[i] = [p + q for p, q in zip(counts[i], (x, y, 1, x * y), strict=True)]
            parts.append(align.links(ids_a, ids_b, n_a, n_b, doc))
        keys, times = align.merged(parts)
        mask = (1 << 2 * align.SHIFT) - 1
        assert len(small.known) <= 3
        for i, (_, *four, _, pairs, often) in enumerate(want):
            mine = keys >> 2 * align.SHIFT == i
            assert counts[i] == four and (keys[mine] & mask).tolist() == pairs and times[mine].tolist() == often


def test_empty_table(table):
    assert align.scores(table([], "doc_id long, text string"), A, B).collect() == []
