import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import SMALL
from logloom.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def sequences(plan, counts):
    """Contents of the sequences a plan makes: {sequence: [(offset, length)]}."""
    out = {}
    for length in np.flatnonzero(counts).tolist():
        rows = plan[plan[:, 0] == length]
        for rank in range(int(counts[length])):
            _, first, times, sequence, offset = rows[np.searchsorted(rows[:, 1], rank, side="right") - 1].tolist()
            nth, spot = divmod(rank - first, times)
            out.setdefault(sequence + nth, []).append((offset + spot * length, length))
    return out


def check(counts, capacity):
    plan = packing.packing_plan(counts, capacity)
    seqs = sequences(plan, counts)
    for content in seqs.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(len(c) for c in seqs.values()) == counts.sum()
    return len(seqs)


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_whole_gapless_and_near_the_bound(seed):
    rnd = np.random.default_rng(seed)
    capacity = 256
    lengths = np.minimum(rnd.lognormal(3.5, 1, 5000).astype(int) + 1, capacity)
    counts = np.bincount(lengths, minlength=capacity + 1)
    least = -(-int(lengths.sum()) // capacity)
    assert least <= check(counts, capacity) <= least + 2


def test_plan_with_only_large_or_equal_lengths():
    counts = np.zeros(11, int)
    counts[6] = 7
    assert check(counts, 10) == 7
    counts[:] = 0
    counts[5] = 7
    counts[10] = 2
    assert check(counts, 10) == 6
    assert len(packing.packing_plan(np.zeros(11, int), 10)) == 0


def test_exact_respects_counts():
    left = np.zeros(20, np.int64)
    left[4] = 1
    assert packing.SumIndex(left).exact(8, left) is None
    left[4] = 2
    assert packing.SumIndex(left).exact(8, left) == [4, 4]
    assert packing.SumIndex(left).exact(12, left) is None
    left[2] = 1
    assert sorted(packing.SumIndex(left).exact(10, left)) == [2, 4, 4]


def test_ids_equal_the_tokenizer(small):
    plain = Tokenizer.from_file(PATH)
    odd = ["", " ", "don't  'S x's <|endoftext|> a<|endoftext|>b \x1c \x00 ﻿ x", "a　b\x85c d ́x 12 3",
           "ΑΣ İ K ﬁ ... !!\n?? —— “a”", "x" * 50_000, "é é\tÅ\r\x0b\x0c"]
    texts = odd + small("documents").text.tolist()
    ids, ends = bpe.TextEncoder(PATH).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [
        plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_full_caches_change_nothing(small, monkeypatch):
    texts = small("documents").text.tolist()[:40]
    encoder = bpe.TextEncoder(PATH)
    want, ends = encoder.encode(pa.array(texts))
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    monkeypatch.setattr(bpe, "TABLE_PAIRS", 10)
    for i, t in enumerate(texts):
        assert encoder.encode(pa.array([t]))[0].tolist() == want[ends[i]:ends[i + 1]].tolist()


def verify(rows, texts, capacity):
    plain = Tokenizer.from_file(PATH)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, text in texts:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        want = [ids[a:a + capacity] for a in range(0, len(ids), capacity)]
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in mine] == [
            (p, p * capacity, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for p, x in enumerate(want)]
    for content in by_seq.values():
        at = 0
        for r in sorted(content, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    total = sum(r.length for r in rows)
    assert len(by_seq) <= -(-total // capacity) + 2


def test_whole_table(spark, small):
    d = small("documents")
    out = packing.pack(spark.read.parquet(f"{SMALL}/documents.parquet"), PATH, 512)
    verify(out.collect(), list(zip(d.doc_id, d.text)), 512)


def test_edge_cases(docs):
    rnd = random.Random(0)
    texts = [None, "", " \n"] + [" ".join(rnd.choices(["alpha", "b", "c3"], k=rnd.randrange(40))) for _ in range(50)]
    verify(packing.pack(docs(*texts), PATH, 16).collect(), list(enumerate(texts)), 16)
    rows = packing.pack(docs((None, "a b"), (4, "a b"), (4, "a b")), PATH, 16, with_ids=False).collect()
    assert sorted(r.offset for r in rows) == [0, 3, 6] and "ids" not in rows[0]
    assert packing.pack(docs("a").limit(0), PATH, 16).count() == 0
