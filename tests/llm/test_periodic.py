import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa

from logloom.llm import periodic
from logloom.llm.catalog import op11_periodic_runs, with_planted_runs


def brute_runs(w, min_length, min_exponent):
    n, out = len(w), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size, part = j - i + q, w[i:j + q]
            if size >= max(min_length, min_exponent * q) and not any(part[d:] == part[:size - d] for d in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rnd):
    out = []
    for _ in range(rnd.randrange(1, 7)):
        symbols = "abcdefghijklmnopqrstuvwxyz"[:rnd.choice([1, 2, 3, 26])]
        root = [rnd.choice(symbols) for _ in range(rnd.randrange(1, 9))]
        out += [rnd.choice(symbols) for _ in range(rnd.randrange(20))] if rnd.random() < 0.5 else (root * 50)[:rnd.randrange(1, 60)]
    return out


def test_runs_equal_brute_force():
    rnd = random.Random(0)
    for min_length, min_exponent in ((6, 4), (2, 2), (6, 2), (4, 3), (12, 5)):
        words = [random_words(rnd) for _ in range(250)]
        n, found = periodic.word_runs(pa.array([" ".join(w) for w in words]), min_length, min_exponent)
        for i, w in enumerate(words):
            assert n[i] == len(w)
            assert [tuple(r) for r in found.get(i, np.empty((0, 3), int)).tolist()] == brute_runs(w, min_length, min_exponent), w


def test_common_extensions_of_a_tree():
    rnd = random.Random(1)
    symbols = [rnd.randrange(1, 4) for _ in range(300)] + [0]
    extension = periodic.CommonExtension(*periodic.SuffixTree(symbols).tour(np.arange(4)))
    assert extension.rank.tolist() == np.argsort(sorted(range(301), key=lambda i: symbols[i:])).tolist()
    a = np.array([rnd.randrange(300) for _ in range(500)])
    b = (a + 1 + np.array([rnd.randrange(299) for _ in range(500)])) % 301
    for i, j, got in zip(a.tolist(), b.tolist(), extension.of(a, b).tolist()):
        want = 0
        while symbols[i + want:i + want + 1] and symbols[i + want:i + want + 1] == symbols[j + want:j + want + 1]:
            want += 1
        assert got == want


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_edge_cases_and_long_texts(spark, docs):
    rnd = random.Random(2)
    long_ = " ".join(["x y z"] * 20_000 + [rnd.choice("abcdef") for _ in range(2000)] + ["q"] * 5000)
    texts = [(0, None), (1, ""), (2, " \n"), (3, "a a a a a a"), (3, "a a a a a a"), (None, "b  b\tb\nb b b c"), (4, "a a a a a"),
             (5, long_)]
    rows = periodic.find_runs(docs(*texts)).collect()
    assert len(rows) == len(texts)
    want = {}
    for i, t in texts[:-1]:
        runs = brute_runs((t or "").split(), 6, 4)
        want[i] = (runs, collapsed((t or "").split(), runs))
    for r in rows:
        if r.doc_id == 5:
            assert (0, 60_000, 3) in [tuple(x) for x in r.runs] and (62_000, 5000, 1) in [tuple(x) for x in r.runs]
        else:
            assert ([tuple(x) for x in r.runs], r.collapsed) == want[r.doc_id]
    assert periodic.find_runs(docs("x").limit(0)).count() == 0


def planted(doc_id, text):
    h = zlib.crc32(str(doc_id).encode())
    w, g = (text or "").encode().split(), h // 10
    if h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    return [x.decode() for x in w]


def test_planted_words(docs):
    texts = [(i, " ".join(f"w{k % 17}" for k in range(i % 60))) for i in range(300)] + [(None, "a b c"), (400, None)]
    for r in with_planted_runs(docs(*texts)).collect():
        if r.doc_id is not None:
            assert (r.text or "").split() == planted(r.doc_id, dict(texts)[r.doc_id])


def test_query_equals_brute_force_on_whole_texts(spark, small):
    got = {r.doc_id: r for r in op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    table = small("documents")
    assert len(got) == len(table)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    seen = 0
    for i, text in zip(table.doc_id, table.text):
        w = planted(i, text)
        codes = np.unique(w, return_inverse=True)[1] if w else np.empty(0, int)
        runs = []
        for q in range(1, len(w) // 4 + 1):  # stretches of equal words q apart
            same = np.concatenate(([0], (codes[q:] == codes[:-q]).astype(np.int8), [0]))
            edge = np.flatnonzero(np.diff(same))
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                size = e - s + q
                if size >= max(6, 4 * q) and not any((codes[s + d:s + size] == codes[s:s + size - d]).all() for d in range(1, q)):
                    runs.append((s, size, q))
        runs.sort(key=lambda r: (r[0], r[2]))
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{a},{b},{c}\n" for a, b, c in runs))
        assert r.collapsed_sha256 == sha(collapsed(w, runs))
        seen += len(runs)
    assert seen > 5
