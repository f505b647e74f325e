import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from logloom.llm import bpe
from logloom.llm.catalog import op13_bpe, tokenizer_path

PARTS = ["a", "b", "th", "the", "The", "ing", "'s", "'", "<|endoftext|>", "<|startoftext|>", "<|end", " ", "\x1c", "\x85", "\xa0",
         "é", "É", "é", "İ", "ΑΣ", "ﬁ", "中", "文", "😀", "１", "²", "　", "​", "9", "10", "!!", "\x00", "\x0012", "\n",
         "ß", "ǅ", "लि", "aaaaaaaaaaaaa", "ababab", "don't", "N°5"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    return bpe.TextEncoder(tokenizer_path())


def plain_merges(word, merges):
    """Merging step by step, lowest merge first, leftmost first: the definition."""
    tokens = [merges.token[c] for c in word]
    while made := [(merges.merged[p], i) for i, p in enumerate(zip(tokens, tokens[1:])) if p in merges.merged]:
        t, i = min(made)
        tokens[i:i + 2] = [t]
    return [merges.ids[t] for t in tokens]


def test_ids_equal_the_library(encoder, library):
    rnd = random.Random(0)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(12))) for _ in range(5000)]
    texts += [f"a{chr(c)}b {chr(c)}" for c in [*range(0x600), *range(0x1E00, 0x2200)]]
    ids, ends = encoder.encode(pa.array(texts))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want


def test_backtracking_equals_merging_on_any_merge_list():
    """Random merge lists, also with tokens that merging never gives."""
    rnd = random.Random(3)
    for _ in range(60):
        vocab = {c: i for i, c in enumerate("abc")} | {c + "</w>": 3 + i for i, c in enumerate("abc")}
        merges = []
        for _ in range(rnd.randrange(1, 25)):
            x, y = rnd.choice([t for t in vocab if not t.endswith("</w>")]), rnd.choice(list(vocab))
            if x + y not in vocab:
                merges.append((x, y))
                vocab[x + y] = len(vocab)
        m = bpe.Merges(vocab, merges, "</w>")
        for _ in range(60):
            word = bpe.Merges.spell("".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 14))) + "</w>", "</w>")
            assert m.encode(word) == plain_merges(word, m), (merges, word)


def test_long_words_take_linear_steps(encoder, library):
    rnd = random.Random(5)
    for text in ("".join(rnd.choice("abcdehint") for _ in range(100_000)), "a" * 100_000):
        assert encoder.encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip_and_edge_cases(spark, docs, library):
    texts = [(0, None), (1, ""), (2, " \n\t"), (3, "The house, the houses!"), (3, "The house, the houses!"), (None, "x<|endoftext|>y"),
             (4, "Ünïcode 中文 " * 3000)]
    p = tokenizer_path()
    rows = bpe.decode(bpe.encode(docs(*texts), p), p).collect()
    assert len(rows) == len(texts)
    want = {}
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), ids, library.decode(ids, skip_special_tokens=False))
    for r in rows:
        assert (r.n_tokens, np.frombuffer(bytes(r.ids), "<u4").tolist(), r.decoded) == want[r.doc_id]
    assert bpe.decode(bpe.encode(docs("x").limit(0), p), p).count() == 0
    odd = spark.createDataFrame([(1, None), (2, np.array([518, 10**9, 257], "<u4").tobytes())], "k int, ids binary")
    assert {r.k: r.decoded for r in bpe.decode(odd, p).collect()} == {1: "", 2: library.decode([518, 257], skip_special_tokens=False)}


def test_query_equals_the_library_on_whole_texts(spark, small, library):
    got = {r.doc_id: r for r in op13_bpe(spark, "/root/testdata/sf0.001").collect()}
    table = small("documents")
    assert len(got) == len(table)
    for i, text in zip(table.doc_id, table.text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = got[i]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
