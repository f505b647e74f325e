import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from logloom.llm import collocations

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, max_words, min_count, cover, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in candidates.items():
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if not any(100 * b >= cover * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                       for q, b in candidates.items() if len(q) > len(p)):
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def texts(seed, n=150):
    rnd = random.Random(seed)
    words = ["a", "B", "the", "of", "é", "x\x1cy", "ab", "中", "a\x85b", "\xa0"]
    passages = ["New York City is big", "the a the a the a", "once upon a time, there", "a a a a a a a a"]
    out = []
    for _ in range(n):
        t = ""
        for _ in range(rnd.randrange(12)):
            t += rnd.choice(passages) if rnd.random() < 0.4 else rnd.choice(words)
            t += rnd.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "; ", "?!", "\x0b"])
        out.append((rnd.choice(["en", "fr", None, "und"]), t))
    return out + [("en", None), ("en", ""), (None, " .,. "), ("de", None)]


def result(spark, rows, **kw):
    df = spark.createDataFrame([(t, g, 1, "x") for g, t in rows], "text string, lang string, n long, phrase string")
    return sorted((r.grp, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(df, **kw).collect())


@pytest.mark.parametrize("seed, max_words, min_count, cover, top, trigger, own", [
    (0, 4, 3, 80, 2000, 16, 64), (1, 4, 2, 50, 7, 2, 3), (2, 2, 3, 80, 2000, 3, 1), (3, 3, 1, 100, 50, 1, 64), (4, 5, 2, 80, 2000, 4, 2)])
def test_collocations_equal_brute_force(spark, monkeypatch, seed, max_words, min_count, cover, top, trigger, own):
    parse = collocations.parse
    monkeypatch.setattr(collocations, "parse", lambda *a: parse(*a, one_in=trigger, longest=own))
    rows = texts(seed)
    got = result(spark, rows, max_words=max_words, min_count=min_count, cover_percent=cover, top=top)
    assert got == brute(rows, max_words, min_count, cover, top) and got


def test_a_full_bit_table_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "TABLE_BITS", 128)
    rows = texts(5)
    assert result(spark, rows, min_count=2) == brute(rows, 4, 2, 80, 2000)


def test_every_word_is_one_chunks_own():
    rnd = random.Random(7)
    lines = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(300))) + rnd.choice(["", ".", ", x y"]) for _ in range(40)]
    chunks, own, of = collocations.chunks_of(pa.array(lines), 4)
    for i, line in enumerate(lines):
        mine = [(c.split(" "), o) for c, o, t in zip(chunks.to_pylist(), own.tolist(), of.tolist()) if t == i]
        assert [w for c, o in mine for w in c[:o]] == re.findall("[a-z]", line)
        assert all(o <= len(c) <= o + 3 for c, o in mine)


def test_large_counts_stay_exact(spark):
    rows = [("en", "a b", 2, 4 * 10**18), ("en", "a", 1, 5 * 10**18), ("en", "b", 1, 4 * 10**18 + 1)]
    frequent = spark.createDataFrame(rows, "grp string, phrase string, size int, f long")
    r = collocations.scored(frequent).collect()[0]
    assert r.score == 2_000_000 * 4 * 10**18 // (9 * 10**18 + 1)
    longer = spark.createDataFrame([("en", "a b c", 3, 8 * 10**18)], "grp string, phrase string, size int, f long")
    kept = spark.createDataFrame([("en", "a b", 10**19 // 2 * 1), ("en", "b c", 9 * 10**18)], "grp string, phrase string, a long")
    assert [x.phrase for x in collocations.uncovered(kept, longer, cover_percent=90).collect()] == ["b c"]


def test_long_texts_and_empty_tables(spark):
    rows = [("en", "the end of " * 50_000), ("fr", "x " * 100_000)]
    got = result(spark, rows, min_count=30)
    assert ("fr", 1, "x x x x", 99_997, 100_000, 99_998, 100_000, 2_000_000 * 99_997 // 199_998) in got
    want = Counter(tuple(("the", "end", "of")[(i + j) % 3] for j in range(4)) for i in range(150_000 - 3))
    assert {tuple(p.split()): a for lang, _, p, a, *_ in got if lang == "en"} == want
    assert result(spark, [(None, None)]) == []
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(empty).count() == 0
    assert np.array_equal(collocations.chunks_of(pa.array([], pa.string()), 4)[1], [])
