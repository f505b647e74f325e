"""SimHash near-dedup with BK-trees.

Every document gets a 64-bit fingerprint of its word shingles. Fingerprints
that differ in at most ``radius`` bits link; a document's group is the
connected component of links.

The distinct fingerprints are sharded so that linked ones always meet: cut
into blocks, two fingerprints within the radius agree on all but ``radius`` of
them, so one row per choice of agreeing blocks brings them to a shared shard.
Each shard is one BK-tree (children keyed by their integer Hamming distance to
the parent; a search follows only the edges within the radius of the query's
own distance), searched and grown by its members in turn. A shard with more
than ``SHARD_ROWS`` members is dealt again on a finer choice of blocks, so no
task holds a hot shard. What leaves a shard is one edge per member, to its
group's least fingerprint.

Shards are co-partitioned with their queries instead of broadcast: the set of
fingerprints grows with the corpus, so its trees have no size bound.

Defined results: a null or empty text has no shingles and fingerprint zero,
which links like any other; fewer words than a shingle are one shingle of the
whole sequence; repeated rows share a fingerprint; a null doc_id is never a
component's id unless the component has no other; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import materialise, with_row_key
from logloom.llm.components import connected_components

BITS = 64
# (blocks, blocks that must agree) of the shards and of hot shards' pieces, for
# radius 4; other radii keep the number of agreeing blocks and add blocks
AGREEING = (2, 4, 8)
SHARD_ROWS = 4096
# shingles whose bits are counted at once: 64 bytes each
COUNT_ROWS = 1 << 16


def fingerprint(text: str, shingle: int, seed: int = 42) -> int:
    """SimHash of the whole text, over XXH64 of its word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1:] - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, COUNT_ROWS):
        rows = hashes[i:i + COUNT_ROWS].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, rid, fp): fp is the fingerprint's 64 bits as a signed long."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["rid"], pa.array(fps.view(np.int64))],
                                             ["doc_id", "rid", "fp"])

    rows = with_row_key(docs)
    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, rid long, fp long")


class BKTree:
    """Burkhard-Keller tree over integers under Hamming distance."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def near(self, value: int, radius: int) -> list[int]:
        """Members within ``radius`` of ``value``."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            member, children = todo.pop()
            d = (member ^ value).bit_count()
            if d <= radius:
                found.append(member)
            if children:
                todo.extend(node for edge, node in children.items() if -radius <= edge - d <= radius)
        return found

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while d := (node[0] ^ value).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = (value, {})
                return
            node = child


def shard_edges(members: list[int], radius: int) -> list[tuple[int, int]]:
    """(member, least member of its group) for the groups of a shard."""
    tree, parent = BKTree(), {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for value in members:
        if value in parent:
            continue
        parent[value] = value
        for other in tree.near(value, radius):
            a, b = root(value), root(other)
            parent[max(a, b)] = min(a, b)
        tree.add(value)
    return [(x, r) for x in parent if (r := root(x)) != x]


def shard_keys(level: int, radius: int) -> Column:
    """Array of shard keys of ``fp``: for every choice of agreeing blocks, the
    choice's number and the bits of those blocks, mixed into one long."""
    agree = AGREEING[level]
    blocks = agree + radius
    cuts = [i * BITS // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    keys = []
    for number, chosen in enumerate(combinations(masks, agree)):
        mask = sum(chosen)
        signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
        keys.append(F.xxhash64(F.lit(level * 10_000 + number), F.col("fp").bitwiseAND(F.lit(signed))))
    return F.array(*keys)


def bk_edges(shards: DataFrame, radius: int) -> DataFrame:
    """(a, b) fingerprint edges found inside the shards (key, fp)."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = np.stack([batch["key"].to_numpy(), batch["fp"].to_numpy()])
            held = now if held is None else np.concatenate([held, now], axis=1)
            ended = np.flatnonzero(held[0] != held[0, -1]) if held.shape[1] else []
            if len(ended):  # the last key may go on in the next batch
                yield groups(held[:, :ended[-1] + 1])
                held = held[:, ended[-1] + 1:]
        if held is not None and held.shape[1]:
            yield groups(held)

    def groups(rows: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(rows[0])) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [rows.shape[1]]))
        edges: list[tuple[int, int]] = []
        for i in np.flatnonzero(ends - starts > 1):
            edges += shard_edges(rows[1, starts[i]:ends[i]].view(np.uint64).tolist(), radius)
        pairs = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    dealt = shards.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(search, "a long, b long")


def fingerprint_edges(fps: DataFrame, radius: int) -> DataFrame:
    """Edges that connect every two fingerprints of ``fps`` (fp, distinct)
    within the radius, directly or through others within it."""
    edges, todo = [], fps
    for level in range(len(AGREEING)):
        keyed = todo.select("fp", F.explode(shard_keys(level, radius)).alias("key"))
        if level == len(AGREEING) - 1:
            edges.append(bk_edges(keyed, radius))
            break
        sizes = keyed.groupBy("key").agg(F.count("*").alias("n"))
        hot = materialise(sizes.where(F.col("n") > SHARD_ROWS).select("key"), "hot_shards")
        if hot.isEmpty():
            edges.append(bk_edges(keyed, radius))
            break
        edges.append(bk_edges(keyed.join(hot, "key", "left_anti"), radius))
        todo = materialise(keyed.join(hot, "key", "left_semi").select("fp").distinct(), "hot_fingerprints")
    found = edges[0]
    for more in edges[1:]:
        found = found.unionByName(more)
    return materialise(found.distinct(), "fingerprint_edges")


def near_dedup(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, rid, fp, group, component_id) for every document; the
    component's id is the smallest doc_id reachable by links, ``group`` its
    least fingerprint."""
    fps = materialise(fingerprints(docs, shingle), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = connected_components(fingerprint_edges(distinct.select("fp"), radius))
    # groups of two or more fingerprints; every other fingerprint is its own
    named = materialise(distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left"), "classes")
    linked = named.where(F.col("label").isNotNull())
    ids = materialise(linked.groupBy("label").agg(F.min("least").alias("component_id")), "component_ids")
    classes = named.join(ids, "label", "left").select(
        "fp", F.coalesce("label", "fp").alias("group"), F.coalesce("component_id", "least").alias("component_id"))
    return fps.join(materialise(classes, "class_ids"), "fp").select("doc_id", "rid", "fp", "group", "component_id")
