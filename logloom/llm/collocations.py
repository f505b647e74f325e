"""Phrase collocations, counted over a prefix-free parse of the corpus.

Text is cut into pieces at punctuation and line ends, and a piece into chunks
that begin at trigger words (chosen by their own hash, so equal passages are
cut alike wherever they stand) and run on over the next ``max_words - 1`` words
of the piece: neighbouring chunks overlap by as much as a phrase can reach. The
different chunks are the dictionary, their numbers of occurrences the parse
frequencies. A phrase belongs to the chunk in whose own words it begins, never
to the one whose overlap also shows it, so counting the phrases of every
different chunk once, weighted by its frequency, counts each occurrence once.

The dictionary is read three times: for words, for pairs of frequent words, and
for longer phrases of which every pair is frequent; nothing else can be frequent.
What is frequent is known there by a bit table of hashes of fixed size: where it
fills up, or two hashes meet, more phrases are counted, and the exact counts
still decide. Chunks and phrases are added up in each Arrow batch, by Spark
before the shuffle, and after it.

Defined results: a null or empty text has no words; a null group is ``missing``;
repeated rows count as often as they are there; ties go by count, then phrase;
very long texts are whole (a chunk without trigger is cut at ``CHUNK_WORDS``
words, which changes no count); an empty table gives an empty result; other
columns never enter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.bpe import bounded_slices
from logloom.llm.common import materialise

# one word in so many triggers a chunk; the longest own part of a chunk
TRIGGER = 16
CHUNK_WORDS = 64
# bits of the table of frequent words or pairs: 4 MB, whatever the corpus
TABLE_BITS = 1 << 25
# bytes of text parsed, and of dictionary counted, at once
BATCH_BYTES = 4 << 20
COUNT_BYTES = 12 << 20
# a group's best are picked in so many parts before they are ranked together
RANK_PARTS = 64
BREAKS = r"[.,;:!?\x0A-\x0D]+"
_FACTORS = np.random.default_rng(12).integers(0, 2**63, 3, np.uint64) * np.uint64(2) + np.uint64(1)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, edges): all places of the ranges, one after the other."""
    edges = np.concatenate(([0], np.cumsum(sizes)))
    return np.arange(edges[-1]) + np.repeat(starts - edges[:-1], sizes), edges


def chunks_of(texts: pa.Array, max_words: int, one_in: int = TRIGGER, longest: int = CHUNK_WORDS) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(chunks, own, text): all chunks of some texts, the number of words that
    are each chunk's own, and the text it is from."""
    # what is left of the white space after this is space and tab
    split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), BREAKS, " . "))
    words = split.flatten().dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False)
    listed = words.dictionary.to_pylist()
    breaks = np.array([w in ("", ".") for w in listed], bool)
    trigger = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % one_in == 0 for w in listed], bool)
    text = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    piece = np.cumsum(breaks[code]) + text
    word = np.flatnonzero(~breaks[code])
    code, piece, text = code[word], piece[word], text[word]
    heads = np.diff(piece, prepend=-1) != 0
    at = np.arange(len(code))
    begins = np.maximum.accumulate(np.where(heads | trigger[code], at, 0))
    starts = np.flatnonzero((at - begins) % longest == 0)
    ends = np.append(starts[1:], len(code)) if len(starts) else starts
    piece_end = np.append(np.flatnonzero(heads)[1:], len(code))[np.cumsum(heads)[starts] - 1] if len(starts) else starts
    places, edges = _ranges(starts, np.minimum(ends + max_words - 1, piece_end) - starts)
    shown = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), words.dictionary.take(pa.array(code[places])))
    return pc.binary_join(shown, " "), ends - starts, text[starts]


def parse(docs: DataFrame, text: str = "text", group: str = "lang", missing: str = "und", max_words: int = 4,
          one_in: int = TRIGGER, longest: int = CHUNK_WORDS) -> DataFrame:
    """The written dictionary of the corpus: (grp, chunk, own, n), with the
    number of occurrences ``n`` of each different chunk in each group. One word
    ``one_in`` so many begins a chunk, cut at ``longest`` own words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, "text", BATCH_BYTES):
                chunks, own, of = chunks_of(part["text"], max_words, one_in, longest)
                table = pa.table({"grp": part["grp"].take(pa.array(of)), "chunk": chunks, "own": pa.array(own, pa.int32())})
                counted = table.group_by(["grp", "chunk", "own"], use_threads=False).aggregate([([], "count_all")])
                yield from counted.rename_columns(["grp", "chunk", "own", "n"]).to_batches()

    rows = docs.select(F.coalesce(F.col(group).cast("string"), F.lit(missing)).alias("grp"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = rows.mapInArrow(run, "grp string, chunk string, own int, n long")
    return materialise(found.groupBy("grp", "chunk", "own").agg(F.sum("n").alias("n")), "chunks")


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def _slots(bits: int, groups: np.ndarray, *words: np.ndarray) -> np.ndarray:
    """Bit of a word, or of consecutive words, in a table of so many bits (a
    power of two): from the hashes of its group and words."""
    h = groups * _FACTORS[2]
    for w in words:
        h = (h + w) * _FACTORS[0]
        h ^= h >> np.uint64(31)
    return (h * _FACTORS[1]) >> np.uint64(65 - bits.bit_length())


def bit_table(frequent: DataFrame) -> np.ndarray:
    """Bits of the phrases in (grp, phrase), all of as many words; at most
    TABLE_BITS / 64 numbers reach the driver."""
    size = TABLE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = zip(*(p.split(" ") for p in batch["phrase"].to_pylist()))
                slot = np.unique(_slots(size, _hashes(batch["grp"].to_pylist()), *map(_hashes, words)))
                place = (slot >> np.uint64(6)).astype(np.int64)
                first = np.flatnonzero(np.diff(place, prepend=-1))
                bits = np.bitwise_or.reduceat(np.uint64(1) << (slot & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(place[first]), pa.array(bits.view(np.int64))], ["place", "bits"])

    found = frequent.select("grp", "phrase").mapInArrow(run, "place long, bits long").groupBy("place").agg(
        F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(size // 64, np.int64)
    table[found["place"].to_numpy()] = found["bits"].to_numpy()
    return table.view(np.uint64)


def _in(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (table[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) == 1


def gram_counts(dictionary: DataFrame, sizes: list[int], min_count: int, table: np.ndarray | None = None,
                of_words: bool = False) -> DataFrame:
    """(grp, phrase, size, f): phrases of the given sizes with ``min_count``
    occurrences or more. With ``table``, only those whose words (``of_words``)
    or whose pairs are all in it."""
    def counted(dictionary: pa.Table) -> Iterator[pa.RecordBatch]:
        dictionary = dictionary.combine_chunks()
        split = pc.ascii_split_whitespace(dictionary["chunk"].chunk(0))
        words = split.flatten().dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False)
        size = np.diff(split.offsets.to_numpy())
        at, edges = _ranges(np.zeros(len(size), np.int64), size)
        left = np.repeat(size, size) - at  # words from here to the chunk's end
        own = at < np.repeat(dictionary["own"].to_numpy(), size)
        groups = dictionary["grp"].chunk(0).dictionary_encode()
        grp = np.repeat(groups.indices.to_numpy(zero_copy_only=False), size)
        n = np.repeat(dictionary["n"].to_numpy(), size)
        joined = np.ones(len(code), bool)  # do this word and the next go together?
        if table is not None:
            hashes, named = _hashes(words.dictionary.to_pylist())[code], _hashes(groups.dictionary.to_pylist())[grp]
            joined[:] = False
            if of_words:
                known = _in(table, _slots(64 * len(table), named, hashes))
                joined[:-1] = known[:-1] & known[1:]
            else:
                joined[:-1] = _in(table, _slots(64 * len(table), named[:-1], hashes[:-1], hashes[1:]))
        for k in sizes:
            here = own & (left >= k)
            for step in range(k - 1):
                here[:len(here) - step] &= joined[step:]
            here = np.flatnonzero(here)
            keys = [f"w{i}" for i in range(k)]
            rows = pa.table({"grp": grp[here], "n": n[here]} | {f"w{i}": code[here + i] for i in range(k)})
            rows = rows.group_by(["grp", *keys], use_threads=False).aggregate([("n", "sum")])
            spelled = [words.dictionary.take(rows[c].combine_chunks()) for c in keys]
            spelled = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in spelled]
            yield pa.RecordBatch.from_arrays(
                [groups.dictionary.take(rows["grp"].combine_chunks()), pc.binary_join_element_wise(*spelled, " "),
                 pa.array(np.full(len(rows), k, np.int32)), rows["n_sum"].combine_chunks()], ["grp", "phrase", "size", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_bytes = [], 0
        for batch in batches:  # Spark's batches are small in words: several at once
            held.append(batch)
            held_bytes += batch["chunk"].nbytes
            if held_bytes >= COUNT_BYTES:
                yield from counted(pa.Table.from_batches(held))
                held, held_bytes = [], 0
        if sum(b.num_rows for b in held):
            yield from counted(pa.Table.from_batches(held))

    found = dictionary.mapInArrow(run, "grp string, phrase string, size int, f long")
    return found.groupBy("grp", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)


def frequent_phrases(dictionary: DataFrame, max_words: int = 4, min_count: int = 30) -> DataFrame:
    """(grp, phrase, size, f), written: all phrases of 1 to ``max_words`` words
    with at least ``min_count`` occurrences in their group."""
    out = materialise(gram_counts(dictionary, [1], min_count), "words")
    if max_words > 1:
        pairs = materialise(gram_counts(dictionary, [2], min_count, bit_table(out), of_words=True), "pairs")
        out = out.unionByName(pairs)
        if max_words > 2:
            out = out.unionByName(materialise(
                gram_counts(dictionary, list(range(3, max_words + 1)), min_count, bit_table(pairs)), "phrases"))
    return out


def _sub(words: str, first, count):
    return F.array_join(F.slice(words, first, count), " ")


def scored(frequent: DataFrame, max_words: int = 4) -> DataFrame:
    """(grp, phrase, size, a, l, r, score) of every candidate, at its cut of
    lowest score floor(2000000 * a / (l + r)), the first of equals."""
    candidates = frequent.where(F.col("size") > 1).select("grp", "phrase", "size", F.col("f").alias("a"))
    cuts = candidates.withColumn("words", F.split("phrase", " ")).withColumn(
        "k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("grp", "phrase", "size", "a", "k", _sub("words", F.lit(1), F.col("k")).alias("first"),
                       _sub("words", F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    for side, part in (("l", "first"), ("r", "rest")):
        known = frequent.select("grp", F.col("phrase").alias(part), F.col("f").alias(side))
        cuts = cuts.join(known, ["grp", part])
    score = F.expr("2000000BD * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("grp", "phrase", "size", "a").agg(best).select(
        "grp", "phrase", "size", "a", "best.l", "best.r", "best.score")


def uncovered(candidates: DataFrame, frequent: DataFrame, max_words: int = 4, cover_percent: int = 80) -> DataFrame:
    """``candidates`` without those inside a longer candidate that has at
    least ``cover_percent`` of their occurrences."""
    longer = frequent.where(F.col("size") > 2).withColumn("words", F.split("phrase", " "))
    inside = F.array(*[F.when((F.col("size") > n) & (F.col("size") >= i + n), _sub("words", F.lit(i + 1), F.lit(n)))
                       for n in range(2, max_words) for i in range(max_words - n + 1)])
    inside = longer.select("grp", F.explode(F.array_compact(inside)).alias("phrase"), "f")
    most = inside.groupBy("grp", "phrase").agg(F.max("f").alias("covered"))
    wide = lambda c: F.col(c).cast("decimal(20, 0)")
    kept = F.col("covered").isNull() | (wide("covered") * 100 < wide("a") * cover_percent)
    return candidates.join(most, ["grp", "phrase"], "left").where(kept).drop("covered")


def collocations(docs: DataFrame, text: str = "text", group: str = "lang", missing: str = "und", max_words: int = 4,
                 min_count: int = 30, cover_percent: int = 80, top: int | None = 2000) -> DataFrame:
    """(grp, rank, phrase, size, a, l, r, n, score): the best candidates of each
    group by score, count and phrase (all, without rank, if ``top`` is None);
    ``n`` is the group's number of words."""
    dictionary = parse(docs, text, group, missing, max_words)
    frequent = frequent_phrases(dictionary, max_words, min_count)
    totals = dictionary.groupBy("grp").agg(F.sum(F.col("n") * F.col("own")).alias("n"))
    kept = uncovered(scored(frequent, max_words), frequent, max_words, cover_percent)
    if top is None:
        return kept.join(totals, "grp")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = Window.partitionBy("grp", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).join(totals, "grp")
