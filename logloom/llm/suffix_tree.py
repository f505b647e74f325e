"""Substring dedup over words by prefix-partitioned suffix trees.

Suffixes are split by prefixes of variable length into groups that fit in
memory (see :mod:`repeats`: the prefix is an anchor's k words, and the whole
window where that leaves a group too large). Each group is one subtree, built
from its suffixes in order and their common prefixes; its internal nodes of
string depth ``length`` or more are the repeats. A window is removed from every
document but the one of smallest doc_id that has it.

Defined results: a null or empty text has no words; fewer words than
``length`` keep all; repeats inside one document stay; repeated rows (same
doc_id) have no smaller doc_id among them and stay; a null doc_id comes after
all others; an empty table gives an empty result. Words are compared by 64-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logloom.llm.common import with_row_key
from logloom.llm.repeats import merged, repeated_spans, truncated_ranks, word_codes

KGRAM = 16


def subtree(codes: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves (suffix starts) of a group's tree in order, and for each whether
    it hangs below the same node of depth ``length`` as the leaf before it:
    the runs are the deep internal nodes (runs of one: leaves without one)."""
    rank = truncated_ranks(codes, length)[starts]
    leaves = np.lexsort((starts, rank))
    deep = np.concatenate(([False], np.diff(rank[leaves]) == 0))
    return leaves, deep


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, rid, n_words, spans, kept): removed word runs (maximal) and the
    kept words, joined by one space, of every document."""
    spans = repeated_spans(docs, word_codes, "uint64", length, min(KGRAM, max(1, length // 2)), subtree, "document")
    rows = with_row_key(docs).join(spans, "rid", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, kept = [], [], []
            for text, found in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
                words, gone = text.encode("utf-8", "surrogatepass").split(), merged(found)
                edges = [0, *(x for run in gone for x in run), len(words)]
                sizes.append(len(words))
                runs.append([{"start": a, "end": b} for a, b in gone])
                left = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
                kept.append(b" ".join(left).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["rid"], pa.array(sizes, pa.int64()),
                 pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.string())], ["doc_id", "rid", "n_words", "spans", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "rid", "text", "spans").mapInArrow(
        cut, f"doc_id {kind}, rid long, n_words long, spans array<struct<start:long,end:long>>, kept string")
