"""Maximal periodic runs of words, found with suffix trees.

A run is a stretch of consecutive words whose smallest period q fits into it at
least ``min_exponent`` times and that neither neighbouring word extends. In a
document:

1. A suffix tree of its words and one of their reversal are built (Ukkonen).
   On a tree's Euler tour the shallowest node between two leaves is their
   lowest common ancestor; its string depth, looked up in constant time in a
   table of range minima over the tour, is the length of the longest common
   extension of two places: to the right in the one tree, to the left in the
   other.
2. Visiting children in the order of their first word, and in the opposite
   order, the first tree gives the suffixes in both orders. From a place to the
   next place with a smaller suffix stretches the longest Lyndon word that
   begins there; every run has a root among these, in one of the two orders.
3. Each of them is extended in both directions by its length; what then holds
   enough periods is a run. A Lyndon word has no border, so its length is the
   smallest period.

Trees are built for the stretches of a document that can hold a run: there every
three consecutive words occur again and again, at least ``min_exponent - 1``
times, within the stretch itself. Places where they don't are cut away, counted
over hashes (a collision only keeps a place), until nothing changes; no run
and no neighbour that could extend one is lost, and no length is capped.

Documents are worked on one by one in Arrow batches: no shuffle, nothing on the
driver, a lost task is run again.

Defined results: a null or empty text, or one of white space, has no words and
no runs; repeated rows get equal results; a null doc_id is an ordinary value;
very long texts are whole, in memory linear in their longest periodic stretches;
an empty table gives an empty result; other columns never enter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.bpe import bounded_slices
from logloom.llm.common import with_row_key

BATCH_BYTES = 4 << 20
_FACTORS = np.random.default_rng(11).integers(0, 2**63, 5, np.uint64) * np.uint64(2) + np.uint64(1)


class SuffixTree:
    """Suffix tree of n small numbers whose last one is unique.

    Nodes below n are leaves, numbered by their suffix; n is the root. For
    every node: its parent, the first symbol of its edge, its string depth."""

    def __init__(self, symbols: list[int]) -> None:
        n, span = len(symbols), max(symbols) + 1
        # leaves need no more than these two; inner nodes are numbered from n on
        start, parent = [0] * n + [0], [0] * n + [n]
        inner_end, link, depth = [0], [n], [0]
        edge: dict[int, int] = {}
        node, at, length, left, leaves = n, 0, 0, 0, 0
        for i, symbol in enumerate(symbols):
            unlinked = -1
            left += 1
            while left:
                if not length:
                    at = i
                key = node * span + symbols[at]
                below = edge.get(key)
                if below is None:
                    edge[key] = leaves
                    owner = node
                else:
                    first = start[below]
                    if below > n and length >= inner_end[below - n] - first:  # walk down
                        reach = inner_end[below - n] - first
                        at += reach
                        length -= reach
                        node = below
                        continue
                    if symbols[first + length] == symbol:
                        length += 1
                        if unlinked >= 0:
                            link[unlinked - n] = node
                        break
                    owner = len(start)  # split the edge
                    edge[key] = owner
                    start.append(first)
                    parent.append(node)
                    inner_end.append(first + length)
                    link.append(n)
                    depth.append(depth[node - n] + length)
                    start[below] = first + length
                    parent[below] = owner
                    edge[owner * span + symbols[first + length]] = below
                    edge[owner * span + symbol] = leaves
                if unlinked >= 0:
                    link[unlinked - n] = owner
                unlinked = owner if below is not None else -1
                start[leaves] = i
                parent[leaves] = owner
                leaves += 1
                left -= 1
                if node != n:
                    node = link[node - n]
                elif length:
                    length -= 1
                    at = i - left + 1
        self.size = n
        self.parent = np.array(parent)
        self.depth = np.concatenate((np.arange(n, 0, -1), depth))
        self.first = np.array(symbols)[np.array(start)]

    def tour(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes, lows): the leaves of the Euler tour that visits children
        by order[first symbol], and the string depth of the shallowest node
        between each leaf and the one before (0 at the first)."""
        root = self.size
        nodes = np.delete(np.arange(len(self.parent)), root)
        nodes = nodes[np.lexsort((-order[self.first[nodes]], self.parent[nodes]))]  # as they leave a stack, backwards
        of = self.parent[nodes]
        edges = np.searchsorted(of, np.arange(root, len(self.parent) + 1)).tolist()
        below = self.depth[self.parent]
        below[nodes[np.flatnonzero(np.diff(np.append(of, -1)))]] = -1  # the eldest: entered from the parent itself
        below, kids = below.tolist(), nodes.tolist()
        leaves, lows, low = [], [], 0
        stack = [root]
        while stack:
            node = stack.pop()
            if below[node] >= 0:
                low = below[node]
            if node < root:
                leaves.append(node)
                lows.append(low)
            else:
                stack += kids[edges[node - root]:edges[node - root + 1]]
        lows[0] = 0
        return np.array(leaves), np.array(lows)


class CommonExtension:
    """Length of the longest common prefix of two suffixes: the string depth of
    their leaves' lowest common ancestor."""

    def __init__(self, leaves: np.ndarray, lows: np.ndarray) -> None:
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        self.minima = [lows.astype(np.int32)]
        width = 1
        while 2 * width <= len(lows):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For different suffixes a and b."""
        a, b = self.rank[a], self.rank[b]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << k)])
        return out


def next_smaller(rank: list[int]) -> np.ndarray:
    """The next place of smaller rank, for every place; the length where none is."""
    out, open_ = [len(rank)] * len(rank), []
    for i in range(len(rank) - 1, -1, -1):
        r = rank[i]
        while open_ and rank[open_[-1]] > r:
            open_.pop()
        if open_:
            out[i] = open_[-1]
        open_.append(i)
    return np.array(out)


def runs_of(stretches: list[np.ndarray], min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of some stretches of codes; starts
    count over the stretches, each followed by one separator."""
    m = len(stretches)
    letters = np.unique(np.concatenate(stretches), return_inverse=True)[1] + m
    sizes = np.array([len(s) for s in stretches])
    ends = np.cumsum(sizes + 1)
    n = int(ends[-1])
    symbols = np.empty(n, np.int64)
    inside = np.ones(n, bool)
    inside[ends - 1] = False
    symbols[inside], symbols[ends - 1] = letters, np.arange(m)  # separators: each unique, all smaller than letters
    count = int(letters.max()) + 1

    forward = SuffixTree(symbols.tolist())
    backward = SuffixTree([*symbols[::-1].tolist(), count])
    opposite = np.concatenate((np.arange(m), np.arange(count, m, -1)))
    leaves, lows = forward.tour(np.arange(count))
    right = CommonExtension(leaves, lows)
    left = CommonExtension(*backward.tour(np.arange(count + 1)))
    other = np.empty(n, np.int64)
    other[forward.tour(opposite)[0]] = np.arange(n)

    at = np.flatnonzero(inside)
    found = []
    for rank in (right.rank, other):
        end = next_smaller(rank.tolist())[at]  # separators are smaller than any letter
        period = end - at
        stretch = right.of(at, end)
        before = left.of(n - at, n - end)  # the place before p is n - p in the reversal
        length = before + period + stretch
        fits = length >= np.maximum(min_length, min_exponent * period)
        found.append(np.stack([at - before, length, period], axis=1)[fits])
    start, length, period = np.unique(np.concatenate(found), axis=0).T
    return start, length, period


def candidates(codes: np.ndarray, owner: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, stretch): the places of codes that a run may cover and the
    stretch of consecutive ones each belongs to; ``owner`` is the document."""
    need = min(min_exponent - 1, max(min_length, min_exponent) - 2)
    place, stretch = np.arange(len(codes)), owner
    while len(place):
        kept = np.ones(len(place), bool)
        if need > 1:
            kept[:] = False
            if len(place) > 2:
                c = codes[place].astype(np.uint64)
                key = c[:-2] * _FACTORS[0] + c[1:-1] * _FACTORS[1] + c[2:] * _FACTORS[2] + stretch[:-2].astype(np.uint64) * _FACTORS[3]
                key ^= key >> np.uint64(29)
                bits = max(10, int(4 * len(key)).bit_length())
                slot = ((key * _FACTORS[4]) >> np.uint64(64 - bits)).astype(np.int64)
                whole = stretch[:-2] == stretch[2:]
                often = np.bincount(slot[whole], minlength=1)
                begins = np.flatnonzero(whole)[often[slot[whole]] >= need]
                for k in range(3):
                    kept[begins + k] = True
        # consecutive kept places of one stretch are a stretch, if long enough
        there = np.flatnonzero(kept)
        new = (np.diff(there, prepend=-2) != 1) | (np.diff(stretch[there], prepend=-1) != 0)
        number = np.cumsum(new) - 1
        long_ = np.bincount(number, minlength=1)[number] >= max(min_length, min_exponent)
        there, number = there[long_], number[long_]
        if len(there) == len(place):
            return place, number
        place, stretch = place[there], number
    return place, stretch


def _documents(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes, edges): codes of the words of all texts, equal for equal words,
    and where each text's begin."""
    trimmed = pc.ascii_trim_whitespace(texts)
    split = pc.ascii_split_whitespace(trimmed)
    empty = pc.equal(trimmed, "").to_numpy(zero_copy_only=False)
    sizes = np.diff(split.offsets.to_numpy())
    words = split.flatten()
    if empty.any():
        words = words.filter(pa.array(np.repeat(~empty, sizes)))
        sizes[empty] = 0
    return (words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64),
            np.concatenate(([0], np.cumsum(sizes))))


def word_runs(texts: pa.Array, min_length: int, min_exponent: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(n_words, runs): runs[i] has the rows (start, length, period) of text i,
    by start and period, where it has any."""
    codes, edges = _documents(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(edges))
    place, stretch = candidates(codes, owner, min_length, min_exponent)
    found: dict[int, np.ndarray] = {}
    if len(place):
        firsts = np.flatnonzero(np.diff(stretch, prepend=-1))
        heads, stretches = place[firsts], np.split(codes[place], firsts[1:])
        doc = owner[heads]
        groups = np.flatnonzero(np.diff(doc, prepend=-1))
        for a, b in zip(groups.tolist(), [*groups[1:].tolist(), len(doc)]):
            start, length, period = runs_of(stretches[a:b], min_length, min_exponent)
            if len(start):
                sizes = np.array([len(s) + 1 for s in stretches[a:b]])
                shift = heads[a:b] - edges[doc[a]] - (np.cumsum(sizes) - sizes)
                start = start + shift[np.searchsorted(np.cumsum(sizes), start, side="right")]
                rows = np.stack([start, length, period], axis=1)
                found[int(doc[a])] = rows[np.lexsort((period, start))]
    return np.diff(edges), found


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run has after its first period."""
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """(doc_id, rid, n_words, runs, collapsed): the runs of every document, by
    start and period, and its words without their repetitions, joined by one
    space. ``min_exponent`` (2 or more) is the least length / period."""
    if min_exponent < 2:
        raise ValueError("a run holds its period twice at least")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, "text", BATCH_BYTES):
                n_words, found = word_runs(part["text"], min_length, min_exponent)
                kept = [text.encode("utf-8", "surrogatepass").split() for text in part["text"].to_pylist()]
                for i, rows in found.items():
                    kept[i] = collapse(kept[i], rows)
                sizes = np.zeros(len(kept) + 1, np.int32)
                for i, rows in found.items():
                    sizes[i + 1] = len(rows)
                flat = np.concatenate([np.empty((0, 3), np.int64), *(found[i] for i in sorted(found))])
                runs = pa.ListArray.from_arrays(np.cumsum(sizes, dtype=np.int32), pa.StructArray.from_arrays(
                    [pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["rid"], pa.array(n_words, pa.int64()), runs.cast(kind),
                     pa.array([b" ".join(w) for w in kept], pa.binary()).cast(pa.string())],
                    ["doc_id", "rid", "n_words", "runs", "collapsed"])

    rows = with_row_key(docs)
    key = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {key}, rid long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: str = "runs") -> Column:
    """The run of greatest length / period, compared exactly; of equal ones the
    first by start, then period. Null where there is none."""
    return F.reduce(F.col(runs), F.get(F.col(runs), F.lit(0)), lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
