"""Windows of codes that occur more than once in a corpus, shared by the
suffix-array and suffix-tree operators.

A document is a sequence of codes (bytes, or hashed words); a window is
``length`` consecutive codes of one document. Equal windows must meet without
moving every suffix:

1. Each window has an anchor, the k-gram of least hash in it (leftmost if it
   ties). Neighbouring windows mostly share theirs, so a document falls into
   segments: an anchor, the range of window starts it serves, and the codes
   those windows cover. Equal windows have equal anchors at equal places.
2. Only anchors met twice go on, as hashes; equal segments are counted and
   represented by the first of them, so copies are never compared.
3. Anchors whose segments differ send one text for each different segment to
   the task that holds the anchor's group, which orders their suffixes (the
   operator's own method) and returns, for each segment, the runs of window
   starts whose windows occur elsewhere, with the first place of each.
4. A group of more than ``HOT_VARIANTS`` different segments is split on: its
   suffixes are grouped by the longest prefix that matters, the whole window,
   counted before the shuffle, so no task holds a hot group.
5. Runs return to all members of their segment and become spans of documents.

Keys are 64-bit hashes of k-grams and segments are told apart by 128 bits; no
key is trusted for a text match but by those 128 bits or the codes themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import materialise, with_row_key

# window starts handled at once, so that very long texts need bounded memory
PIECE = 1 << 19
HOT_VARIANTS = 2000
# distinct keys (8 bytes each) that may be broadcast to filter the segments
BROADCAST_KEYS = 2_000_000
# codes of whole groups ordered at once in a task
BATCH_CODES = 1 << 20
LAST = 2**63 - 1  # stands for a null doc_id in the order of documents

_RNG = np.random.default_rng(20)
_BYTE_CODES = _RNG.integers(0, 2**64, 256, np.uint64)
_BASES = _RNG.integers(0, 2**63, 2, np.uint64) * np.uint64(2) + np.uint64(1)

Codes = Callable[[str], np.ndarray]


def byte_codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def word_codes(text: str) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def gram_hashes(codes: np.ndarray, k: int, base: int = 0) -> np.ndarray:
    """Hash of every k consecutive codes, by doubling."""
    h = _BYTE_CODES[codes] if codes.dtype == np.uint8 else codes * np.uint64(0x9E3779B97F4A7C15)
    factor, width = _BASES[base:base + 1].copy(), 1
    while width < k:
        step = min(width, k - width)
        if step < width:  # the last, overlapping, step
            factor = _BASES[1 - base:2 - base]
        h = (h[:-step] if step else h) * factor + h[step:]
        factor, width = factor * factor, width + step
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def anchors(codes: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, key): the ranges [lo, hi) of window starts with a common anchor."""
    found = [[np.empty(0, np.int64)] * 2 + [np.empty(0, np.uint64)]]
    span = length - k + 1
    for at in range(0, len(codes) - length + 1, PIECE):
        h = gram_hashes(codes[at:at + PIECE + length - 1], k)
        n = len(h) - span + 1
        ranked = (h & ~np.uint64(2 * PIECE - 1)) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(h) // span) * span, ~np.uint64(0))
        padded[:len(h)] = ranked
        rows = padded.reshape(-1, span)
        ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(back[:n], ahead[span - 1:span - 1 + n]) & np.uint64(2 * PIECE - 1)
        cuts = np.flatnonzero(np.diff(least)) + 1
        lo, hi = np.concatenate(([0], cuts)), np.concatenate((cuts, [n]))
        found.append([lo + at, hi + at, h[least[lo].astype(np.int64)]])
    return tuple(np.concatenate(x) for x in zip(*found))


def truncated_ranks(codes: np.ndarray, length: int) -> np.ndarray:
    """Rank of every position by its next ``length`` codes, by prefix doubling;
    equal ranks are equal windows. Positions too near the end are meaningless."""
    n = len(codes)
    if codes.dtype == np.uint8 and length >= 8:
        padded = np.concatenate([codes, np.zeros(8, np.uint8)])
        key, width = np.zeros(n, np.uint64), 8
        for i in range(8):
            key = (key << np.uint64(8)) | padded[i:i + n]
    else:
        key, width = codes.astype(np.uint64), 1
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    while width < length:
        step = min(width, length - width)
        later = np.zeros(n, np.uint64)
        later[:max(0, n - step)] = rank[step:]
        rank = np.unique((rank << np.uint64(32)) | later, return_inverse=True)[1].astype(np.uint64)
        width += step
    return rank.astype(np.int64)


def segment_rows(docs: DataFrame, codes: Codes, length: int, k: int) -> DataFrame:
    """(rid, doc, key, seg1, seg2, lo, hi) of every segment; doc orders documents."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], []]
            owner, digests = [], []
            for row, text in enumerate(batch["text"].to_pylist()):
                c = codes(text)
                if len(c) < length:
                    continue
                lo, hi, key = anchors(c, length, k)
                raw, size = c.tobytes(), c.itemsize
                digests += [xxhash.xxh3_128_digest(raw[a * size:b * size])
                            for a, b in zip(lo.tolist(), (hi + (length - 1)).tolist())]
                owner.append(np.full(len(lo), row))
                for col, x in zip(cols, (lo, hi, key)):
                    col.append(x)
            if not owner:
                continue
            take = pa.array(np.concatenate(owner))
            seg = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            lo, hi, key = (np.concatenate(x) for x in cols)
            yield pa.RecordBatch.from_arrays(
                [batch["rid"].take(take), batch["doc"].take(take), pa.array(key.view(np.int64)),
                 pa.array(seg[:, 0]), pa.array(seg[:, 1]), pa.array(lo), pa.array(hi)],
                ["rid", "doc", "key", "seg1", "seg2", "lo", "hi"])

    rows = with_row_key(docs).select("rid", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text")
    return rows.mapInArrow(cut, "rid long, doc long, key long, seg1 long, seg2 long, lo long, hi long")


SEGMENT = ["key", "seg1", "seg2"]
RUNS = "key long, seg1 long, seg2 long, s long, e long, least_doc long, least_pos long"


def _texts(docs: DataFrame, chosen: DataFrame, codes: Codes, length: int) -> DataFrame:
    """The codes of one member of each of ``chosen`` segments, as bytes."""
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, segments in zip(batch["text"].to_pylist(), batch["segments"]):
                c = codes(text)
                raw, size = c.tobytes(), c.itemsize
                part = pa.RecordBatch.from_struct_array(segments.values)
                ends = zip(part["lo"].to_pylist(), part["hi"].to_pylist())
                body = [raw[a * size:(b + length - 1) * size] for a, b in ends]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(body, pa.binary())],
                                                 [*part.schema.names, "codes"])

    per_doc = chosen.groupBy("rid").agg(F.collect_list(F.struct(*[c for c in chosen.columns if c != "rid"])).alias("segments"))
    joined = with_row_key(docs).select("rid", "text").join(per_doc, "rid").select("text", "segments")
    return joined.mapInArrow(extract, chosen.drop("rid").schema.add("codes", "binary"))


def _group_runs(texts: DataFrame, dtype: str, length: int, order: Callable) -> DataFrame:
    """Runs found inside the groups of ``texts``; ``order`` is the operator's
    method: (codes, starts) -> (order of the starts, whether each has the
    window of the one before)."""
    def batch_runs(t: pa.Table) -> pa.RecordBatch:
        t = t.sort_by([("doc", "ascending"), ("lo", "ascending")])
        codes = np.frombuffer(b"".join(t["codes"].to_pylist()), dtype)
        ranges = t["hi"].to_numpy() - t["lo"].to_numpy()
        base = np.concatenate(([0], np.cumsum(ranges + length - 1)))[:-1]
        seg = np.repeat(np.arange(len(ranges)), ranges)
        off = np.arange(len(seg)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
        place, same = order(codes, base[seg] + off, length)
        # classes of equal windows, each in the order of documents and places
        number = np.cumsum(~same) - 1
        first = place[np.flatnonzero(~same)]
        total = np.bincount(number, t["n"].to_numpy()[seg[place]])
        of = np.empty(len(seg), np.int64)
        of[place] = number
        least = first[of]
        doc = t["doc"].to_numpy()[seg[least]]
        pos = t["lo"].to_numpy()[seg[least]] + off[least]
        hit = total[of] >= 2
        new = np.ones(len(seg), bool)
        new[1:] = ((seg[1:] != seg[:-1]) | (hit[1:] != hit[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1))
        start = np.flatnonzero(new)
        end = np.concatenate((start[1:], [len(seg)]))
        some = hit[start]
        start, end = start[some], end[some]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(t[c].to_numpy()[seg[start]]) for c in SEGMENT), pa.array(off[start]),
             pa.array(off[end - 1] + 1), pa.array(doc[start]), pa.array(pos[start])],
            [*SEGMENT, "s", "e", "least_doc", "least_pos"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            # whole groups only: the last key may go on in the next batch
            at = 0
            while batch.num_rows - at:
                part = batch.slice(at, 256)
                at += part.num_rows
                keys = part["key"].to_numpy()
                if size > BATCH_CODES * np.dtype(dtype).itemsize:
                    others = np.flatnonzero(keys != held[-1]["key"][-1].as_py())
                    if len(others):
                        yield batch_runs(pa.Table.from_batches([*held, part.slice(0, others[0])]))
                        part, held, size = part.slice(others[0]), [], 0
                held.append(part)
                size += part["codes"].nbytes
        if held:
            yield batch_runs(pa.Table.from_batches(held))

    return texts.repartition("key").sortWithinPartitions("key").mapInArrow(find, RUNS)


def _hot_runs(texts: DataFrame, dtype: str, length: int) -> DataFrame:
    """Runs (of one window each) of hot groups: their windows are counted by
    128-bit hash, partly before the shuffle."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                codes = np.frombuffer(row["codes"][0].as_py(), dtype)
                one, two = (gram_hashes(codes, length, base).view(np.int64) for base in (0, 1))
                many = pa.array(np.zeros(len(one), np.int64))
                kept = [row[c].take(many) for c in (*SEGMENT, "doc", "lo", "n")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(one), pa.array(two), pa.array(np.arange(len(one)))],
                    [*SEGMENT, "doc", "lo", "n", "w1", "w2", "s"])

    schema = "key long, seg1 long, seg2 long, doc long, lo long, n long, w1 long, w2 long, s long"
    found = texts.mapInArrow(windows, schema).withColumn("at", F.struct("doc", (F.col("lo") + F.col("s")).alias("pos")))
    counted = materialise(found.groupBy("key", "w1", "w2").agg(F.sum("n").alias("total"), F.min("at").alias("least"))
                          .where("total >= 2"), "hot_windows")
    return (found.select(*SEGMENT, "w1", "w2", "s").join(counted, ["key", "w1", "w2"])
            .select(*SEGMENT, "s", (F.col("s") + 1).alias("e"), F.col("least.doc").alias("least_doc"),
                    F.col("least.pos").alias("least_pos")))


def repeated_spans(docs: DataFrame, codes: Codes, dtype: str, length: int, k: int, order: Callable,
                   keep: str) -> DataFrame:
    """(rid, spans): [start, end) of the codes under windows that ``keep`` gives up:
    "none": windows that occur at any other place; "first": those with an
    earlier place (by doc_id, then position); "document": those with a place in
    a document of smaller doc_id. Spans may overlap and touch."""
    rows = materialise(segment_rows(docs, codes, length, k), "segments")
    keys = materialise(rows.groupBy("key").agg(F.count("*").alias("n")).where("n >= 2").select("key"), "repeated_keys")
    few = keys.count() <= BROADCAST_KEYS
    members = materialise(rows.join(F.broadcast(keys) if few else keys, "key"), "members")

    segments = materialise(
        members.groupBy(*SEGMENT).agg(F.count("*").alias("n"), F.min(F.struct("doc", "lo", "rid", "hi")).alias("one"))
        .select(*SEGMENT, "n", "one.*"), "distinct_segments")
    several = segments.groupBy("key").agg(F.count("*").alias("variants")).where("variants >= 2")
    several = materialise(several.select("key", (F.col("variants") > HOT_VARIANTS).alias("hot")), "variants")
    texts = materialise(_texts(docs, segments.join(several, "key"), codes, length), "segment_texts")

    alone = (segments.where("n >= 2").join(several, "key", "left_anti")
             .select(*SEGMENT, F.lit(0).cast("long").alias("s"), (F.col("hi") - F.col("lo")).alias("e"),
                     F.col("doc").alias("least_doc"), F.col("lo").alias("least_pos")))
    runs = alone.unionByName(_group_runs(texts.where("not hot"), dtype, length, order))
    if not several.where("hot").isEmpty():
        runs = runs.unionByName(_hot_runs(texts.where("hot"), dtype, length))
    runs = materialise(runs, "runs")

    start = F.col("lo") + F.col("s")
    gone = {"none": F.lit(True), "document": F.col("doc") > F.col("least_doc"),
            "first": (F.col("doc") > F.col("least_doc"))
            | ((F.col("doc") == F.col("least_doc")) & (start > F.col("least_pos")))}[keep]
    spans = members.join(runs, SEGMENT).where(gone).select(
        "rid", F.struct(start.alias("start"), (F.col("lo") + F.col("e") + (length - 1)).alias("end")).alias("span"))
    return spans.groupBy("rid").agg(F.collect_list("span").alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """The maximal runs covered by spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
