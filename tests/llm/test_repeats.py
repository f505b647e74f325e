import random
from collections import defaultdict

import numpy as np
import pytest

from logloom.llm import repeats, suffix_array, suffix_tree


def brute_bytes(rows, length, keep):
    places = defaultdict(list)
    for r, (doc, text) in enumerate(rows):
        b = (text or "").encode()
        for p in range(len(b) - length + 1):
            places[b[p:p + length]].append(((doc if doc is not None else 2**63), p, r))
    out = []
    for r, (doc, text) in enumerate(rows):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            at = places[b[p:p + length]]
            me = ((doc if doc is not None else 2**63), p)
            if len(at) > 1 and (keep == "none" or min(a[:2] for a in at) < me):
                gone[p:p + length] = True
        out.append((len(b), int(gone.sum()), bytes(c for c, g in zip(b, gone) if not g)))
    return out


def brute_words(rows, length):
    places = defaultdict(set)
    split = [[w for w in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if w] for _, t in rows]
    key = lambda d: d if d is not None else 2**63
    for (doc, _), w in zip(rows, split):
        for p in range(len(w) - length + 1):
            places[tuple(w[p:p + length])].add(key(doc))
    out = []
    for (doc, _), w in zip(rows, split):
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - length + 1):
            if min(places[tuple(w[p:p + length])]) < key(doc):
                gone[p:p + length] = True
        out.append((len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def texts(seed, n=60, symbols="abcdefgh", sep=""):
    """Random texts with planted passages, copies and periodic parts."""
    rnd = random.Random(seed)
    make = lambda k: [rnd.choice(symbols) for _ in range(k)]
    passages = [make(rnd.randrange(10, 60)) for _ in range(5)] + [["a"] * 50, ["a", "b"] * 30]
    out = []
    for _ in range(n):
        t = make(rnd.randrange(60))
        for _ in range(rnd.randrange(3)):
            t += rnd.choice(passages)[rnd.randrange(5):] + make(rnd.randrange(30))
        out.append(sep.join(t))
        if rnd.random() < 0.2:
            t = list(t)
            if t:
                t[rnd.randrange(len(t))] = "z"
            out.append(sep.join(t))
    return out


def bytes_result(df):
    return sorted((r.doc_id is None, r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), bytes(r.kept)) for r in df.collect())


@pytest.mark.parametrize("seed, hot", [(0, 2000), (1, 3)])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_bytes_match_brute_force(docs, monkeypatch, seed, hot, keep):
    monkeypatch.setattr(repeats, "HOT_VARIANTS", hot)
    rows = list(enumerate(texts(seed)))
    got = bytes_result(suffix_array.remove_repeats(docs(*rows), 20, keep))
    assert [g[2:] for g in got] == brute_bytes(rows, 20, keep)


@pytest.mark.parametrize("seed, hot", [(2, 2000), (3, 3)])
def test_words_match_brute_force(docs, monkeypatch, seed, hot):
    monkeypatch.setattr(repeats, "HOT_VARIANTS", hot)
    rows = list(enumerate(texts(seed, sep=" ")))
    random.Random(seed).shuffle(rows)
    rows.sort()
    got = sorted((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r.kept)
                 for r in suffix_tree.remove_repeats(docs(*rows), 12).collect())
    assert [g[1:] for g in got] == brute_words(rows, 12)


def test_long_texts_are_cut_in_pieces_without_loss(docs, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 64)
    rows = list(enumerate(texts(5, n=20)))
    rows.append((len(rows), "".join(t for _, t in rows)))
    got = bytes_result(suffix_array.remove_repeats(docs(*rows), 16, "none"))
    assert [g[2:] for g in got] == brute_bytes(rows, 16, "none")


def test_edge_cases(docs):
    p = "0123456789abcdefghij"
    rows = [(0, None), (1, ""), (2, "é" * 30), (3, "x" + p), (None, "y" + p), (5, "dup" * 9), (5, "dup" * 9), (6, "short")]
    got = bytes_result(suffix_array.remove_repeats(docs(*rows), 18, "none"))
    want = sorted((d is None, d, *b) for (d, _), b in zip(rows, brute_bytes(rows, 18, "none")))
    assert got == want
    words = [(0, None), (1, " \n"), (7, "a b c d e"), (7, "a b c d e"), (None, "x a b c d"), (3, "q a\tb\nc d")]
    got = sorted((str(r.doc_id), r.n_words, sum(s.end - s.start for s in r.spans), r.kept)
                 for r in suffix_tree.remove_repeats(docs(*words), 4).collect())
    assert got == sorted((str(d), *b) for (d, _), b in zip(words, brute_words(words, 4)))
    for f in (suffix_array.remove_repeats, suffix_tree.remove_repeats):
        assert f(docs("a").limit(0), 20).count() == 0


def test_previous_factors_on_one_text():
    codes = np.frombuffer(b"abracadabra_abracadabra", np.uint8)
    starts = np.arange(len(codes) - 4 + 1)
    order, has = suffix_array.lpf_order(codes, starts, 4)
    raw = codes.tobytes()
    want = [raw.find(raw[i:i + 4]) < i for i in starts]
    got = np.empty(len(starts), bool)
    got[order] = has
    assert got.tolist() == want


def test_every_window_has_one_segment():
    rng = np.random.default_rng(0)
    for codes in (rng.integers(0, 3, 500).astype(np.uint8), np.zeros(300, np.uint8), rng.integers(0, 9, 80).astype(np.uint64)):
        lo, hi, _ = repeats.anchors(codes, 40, 16)
        assert np.array_equal(np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)]), np.arange(len(codes) - 39))
