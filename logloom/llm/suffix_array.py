"""Substring dedup over bytes by longest-previous-factor arrays.

In suffix order, the earlier text that matches a position longest is at its
previous or next smaller position; where that match (the longest previous
factor) is as long as ``length``, the position starts a repeat. Removing such
windows keeps the first copy of every repeat; ``keep="none"`` takes the
matches at previous and next larger positions too and removes the first copy
as well. Candidate suffixes are brought together as :mod:`repeats` says;
suffix order is exact to ``length`` bytes, which decides all that is asked.

Defined results: a null or empty text has no bytes; a text shorter than
``length`` keeps all; matches never cross rows; repeated rows are places like
any other; a null doc_id comes last in the order of documents; an empty table
gives an empty result. Bytes are cut as they are, so what is kept may not be
valid UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import with_row_key
from logloom.llm.repeats import byte_codes, merged, repeated_spans, truncated_ranks

KGRAM = 128


def suffix_array(codes: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the starts in suffix order (to ``length`` codes, ties by
    position) and whether the longest common prefix with the one before
    reaches ``length``."""
    rank = truncated_ranks(codes, length)[starts]
    order = np.argsort(rank, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = rank[order[1:]] == rank[order[:-1]]
    return order, same


def smaller_positions(order: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every rank, the rank of the previous and of the next smaller
    position that is reached without a common prefix below ``length`` (-1:
    none), by pointer jumping."""
    n = len(order)
    block = np.cumsum(~same)
    out = []
    for step in (-1, 1):
        at = np.arange(n) + step
        while True:
            inside = (at >= 0) & (at < n)
            inside[inside] = block[at[inside]] == block[inside]
            at[~inside] = -1
            larger = inside.copy()
            larger[inside] = order[at[inside]] > order[inside]
            if not larger.any():
                break
            at[larger] += step
        out.append(at)
    return out[0], out[1]


def lpf_order(codes: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the starts, and whether each has a previous factor of
    ``length`` codes (its first place has none)."""
    order, same = suffix_array(codes, starts, length)
    previous, following = smaller_positions(order, same)
    return order, (previous >= 0) | (following >= 0)


def remove_repeats(docs: DataFrame, length: int = 400, keep: str = "first") -> DataFrame:
    """(doc_id, rid, n_bytes, spans, kept): the removed byte runs (maximal) and
    the remaining bytes of every document. keep: "first" or "none"."""
    spans = repeated_spans(docs, byte_codes, "uint8", length, min(KGRAM, max(1, length // 2)), lpf_order, keep)
    rows = with_row_key(docs).join(spans, "rid", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, kept = [], [], []
            for text, found in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
                raw, gone = text.encode("utf-8", "surrogatepass"), merged(found)
                edges = [0, *(x for run in gone for x in run), len(raw)]
                sizes.append(len(raw))
                runs.append([{"start": a, "end": b} for a, b in gone])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["rid"], pa.array(sizes, pa.int64()),
                 pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary())], ["doc_id", "rid", "n_bytes", "spans", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "rid", "text", "spans").mapInArrow(
        cut, f"doc_id {kind}, rid long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def removed(spans: str = "spans"):
    """Length under maximal runs."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
