"""Best-fit packing of tokenised documents by exact-complement hashing.

Documents are tokenised, ended with one id and cut into pieces of at most
``capacity`` ids (only longer documents are cut). What the packing depends on
is the number of pieces of each length, at most ``capacity`` numbers however
large the corpus, so the plan is made from that histogram: the largest length
left opens a sequence; sums of one, two or three available lengths are
indexed, and a combination that fills the gap exactly is consumed; without one
the best-fitting (largest) length goes in and the smaller gap is looked up
again. A finished pattern is repeated as often as its lengths last, so every
pattern uses up a length and there are at most ``capacity`` patterns of at
most about sqrt(2 * capacity) different lengths.

Pieces then take their places in parallel: each has a rank among those of its
length (counted per salt, so a frequent length is split), and the plan maps
(length, rank) to a sequence and an offset.

Defined results: a null or empty text is the end id alone; repeated rows are
packed like others; ties within a length go by row key and piece, and leave
the number of sequences as it is; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.bpe import bounded_slices, ids_column, text_encoder
from logloom.llm.common import materialise, with_row_key

SALTS = 64


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, rid, piece, start, length, ids) of every document; ``ids`` are
    little-endian unsigned 32-bit. ``tokenizer`` is a file that every executor
    has, of a kind that drops white space and never joins across it."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer)
        for batch in batches:
            for part in bounded_slices(batch, "text"):
                ids, edges = encoder.encode(part["text"])
                sizes = np.diff(edges)
                # the end id behind each document's ids
                ids = np.insert(ids, edges[1:], np.uint32(end_id))
                sizes, edges = sizes + 1, edges + np.arange(len(edges))
                count = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                # pieces follow each other without gaps
                ends = np.append(edges[:-1][row] + start, edges[-1])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"].take(take), part["rid"].take(take), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(np.diff(ends), pa.int64()), ids_column(ids, ends)], ["doc_id", "rid", "piece", "start", "length", "ids"])

    rows = with_row_key(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, rid long, piece int, start long, length long, ids binary")


class SumIndex:
    """Which lengths, and which sums of two, are available."""

    def __init__(self, left: np.ndarray) -> None:
        self.one = left > 0
        size = 2 * len(left)
        spectrum = np.fft.rfft(self.one.astype(np.float64), size)
        self.two = np.fft.irfft(spectrum * spectrum, size)[:len(left)] > 0.5

    def exact(self, gap: int, left: np.ndarray) -> list[int] | None:
        """One, two or three lengths of sum ``gap`` within the counts left,
        those with the largest first length; None if there are none."""
        if left[gap] > 0:
            return [gap]
        if pair := self._pair(gap, left):
            return pair
        firsts = np.flatnonzero(self.one[:gap + 1] & self.two[gap::-1])
        for a in firsts[::-1].tolist():
            if left[a] > 0:
                left[a] -= 1
                pair = self._pair(gap - a, left)
                left[a] += 1
                if pair:
                    return [a, *pair]
        return None

    def _pair(self, gap: int, left: np.ndarray) -> list[int] | None:
        if not self.two[gap]:
            return None
        half = (gap + 1) // 2
        fits = (left[half:gap] > 0) & (left[gap - half:0:-1] > 0)
        if gap == 2 * half and fits.size and left[half] < 2:
            fits[0] = False
        found = np.flatnonzero(fits)
        return [half + int(found[-1]), gap - half - int(found[-1])] if found.size else None


def packing_plan(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (length, first rank, times in a sequence, first sequence, offset),
    sorted by length and rank: pieces of ``length`` from that rank on, as many
    in each sequence, in consecutive sequences. counts[i]: pieces of length i."""
    left = np.array(counts, np.int64)
    used, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    while left.any():
        largest = int(np.flatnonzero(left)[-1])
        pattern, gap, index = {largest: 1}, capacity - largest, SumIndex(left)
        left[largest] -= 1
        while gap:
            chosen = index.exact(gap, left)
            if chosen is None:
                fitting = np.flatnonzero(left[:gap + 1])
                if not fitting.size:
                    break
                chosen = [int(fitting[-1])]
            for x in chosen:
                pattern[x] = pattern.get(x, 0) + 1
                left[x] -= 1
                gap -= x
        times = 1 + min(int(left[x]) // n for x, n in pattern.items())
        offset = 0
        for x, n in pattern.items():
            rows.append((x, int(used[x]), n, sequence, offset))
            used[x] += n * times
            left[x] -= n * (times - 1)
            offset += n * x
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to written pieces with the columns
    rid, piece and length."""
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for row in histogram:
        counts[row["length"]] = row["n"]
    plan = packing_plan(counts, capacity)

    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("rid", "piece"), F.lit(SALTS)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = materialise(sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")),
                         "length_offsets")
    within = Window.partitionBy("length", "salt").orderBy("rid", "piece")
    ranked = (salted.withColumn("rank", F.row_number().over(within) - 1).join(firsts, ["length", "salt"])
              .withColumn("rank", F.col("rank") + F.col("first")).drop("salt", "first"))
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = (plan[:, 0] << 48) + plan[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            slot = plan[np.searchsorted(starts, (length << 48) + rank, side="right") - 1]
            nth, spot = np.divmod(rank - slot[:, 1], slot[:, 2])
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(slot[:, 3] + nth), pa.array(slot[:, 4] + spot * length)],
                [*kept.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(assign, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """(doc_id, rid, piece, start, length, ids_crc32, [ids,] sequence_id,
    offset) of every piece; without ``ids`` the pieces' ids are not kept."""
    pieces = token_pieces(docs, tokenizer, capacity, end_id).withColumn("ids_crc32", F.crc32("ids"))
    return place(materialise(pieces if with_ids else pieces.drop("ids"), "pieces"), capacity)
