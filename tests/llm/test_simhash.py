import random
from collections import defaultdict

import xxhash

from logloom.llm import simhash
from logloom.llm.components import connected_components


def brute_fingerprint(text, n=4):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
         .replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(nodes, radius):
    parent = {i: i for i, _ in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, f in nodes:
        for j, g in nodes:
            if i < j and (f ^ g).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in parent}


def test_fingerprints_and_components_match_brute_force(spark, small):
    d = small("documents")
    rows = simhash.near_dedup(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    fps = {i: brute_fingerprint(t) for i, t in zip(d.doc_id, d.text)}
    assert {r.doc_id: r.fp & (2**64 - 1) for r in rows} == fps
    assert {r.doc_id: r.component_id for r in rows} == brute_components(list(fps.items()), 4)


def test_shards_find_every_link(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for f in base:
        for _ in range(15):
            for b in rnd.sample(range(64), rnd.randrange(1, 6)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    hot, simhash.SHARD_ROWS = simhash.SHARD_ROWS, 5
    try:
        for rows in (5, 10_000):
            simhash.SHARD_ROWS = rows
            edges = simhash.fingerprint_edges(spark.createDataFrame([(f,) for f in signed], "fp long"), 4)
            got = {r.node: r.label for r in connected_components(edges).collect()}
            groups = defaultdict(set)
            for f, s in zip(fps, signed):
                groups[got.get(s, s)].add(f)
            want = defaultdict(set)
            for f, r in brute_components([(f, f) for f in fps], 4).items():
                want[r].add(f)
            assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    finally:
        simhash.SHARD_ROWS = hot


def test_edge_cases(docs):
    long = "word " * 30_000
    rows = simhash.near_dedup(docs(None, "", " \t", "One two", "one\x0btwo", long, long, (None, "one two"), (9, "x"), (9, "x")))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in rows.collect())
    assert got == [(-1, 3), (0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5), (6, 5), (9, 9), (9, 9)]
    assert simhash.near_dedup(docs("a").limit(0)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(None, 3), (200, 200), (7, 8)]
    rows = connected_components(spark.createDataFrame(path, "a long, b long")).collect()
    assert {r.node: r.label for r in rows} == {
        **{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(7, 60)}, 200: 200}
