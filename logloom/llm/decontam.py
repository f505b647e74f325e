"""Benchmark decontamination by winnowing.

Both sides are cut into words (ASCII letters and digits, lower-cased, and all
non-ASCII), and each word is hashed once. Of every ``window`` consecutive words
the minimum of their k-gram hashes is kept (the leftmost, if it ties), so two
texts that share a window share a fingerprint at the same place of it: no shared
window is missed. Document and benchmark fingerprints are joined; each hit fixes
a diagonal (document place minus item place), along which equal words are
extended into runs. A document's diagonals are extended together, so its text is
read once. Runs as long as the item's window are hits. Items of fewer words than
a window are one window of their own length: all their words together are looked
up among the documents' windows of that length.

The benchmark's tables are broadcast when their rows and bytes are below
``BROADCAST_ROWS`` and ``BROADCAST_BYTES``; beyond that they are joined by a
shuffle.

Defined results: a null or empty text has no words, is never hit and, as an
item, never occurs; repeated items each count under their item_id; repeated
documents each get the same row; very long texts are whole, one row each; empty
tables give no hits or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import materialise, with_row_key, words_array

KGRAM = 6
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20
# low bits of a packed k-gram that hold its place: no text has as many words
PLACE_BITS = 30


def _kgram(hashes: str, start: Column, k: int) -> Column:
    return F.xxhash64(F.slice(F.col(hashes), start, k))


def fingerprints(words: DataFrame, key: str, window: int, k: int) -> DataFrame:
    """(key, hash, pos) of the winnowed k-grams of ``words``: of every
    ``window`` words the k-gram of least hash. Texts of fewer words give none."""
    span, place = window - k + 1, (1 << PLACE_BITS) - 1
    hashed = words.select(key, F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    count = F.size("hashes") - (k - 1)
    # high bits of a k-gram's hash, then its place: the least is the leftmost minimum
    packed = F.transform(F.sequence(F.lit(1), count), lambda i: F.shiftleft(F.shiftright(
        _kgram("hashes", i, k), PLACE_BITS), PLACE_BITS).bitwiseOR((i - 1).cast("long")))
    hashed = hashed.select(key, "hashes", F.when(count >= span, packed).alias("packed"))
    least = F.transform(F.sequence(F.lit(1), F.size("packed") - (span - 1)),
                        lambda i: F.array_min(F.slice(F.col("packed"), i, span)))
    kept = hashed.select(key, "hashes", F.when(F.col("packed").isNotNull(), F.array_distinct(least)).alias("kept"))
    found = F.transform("kept", lambda m: F.struct(
        _kgram("hashes", m.bitwiseAND(F.lit(place)).cast("int") + 1, k).alias("hash"),
        m.bitwiseAND(F.lit(place)).cast("int").alias("pos")))
    return kept.select(key, F.explode(found).alias("fp")).select(key, "fp.hash", "fp.pos")


def _sized(df: DataFrame, words: str | None = None) -> DataFrame:
    """Broadcast a materialised table only behind a count of its rows and of the
    bytes in its column of ``words``."""
    size = F.sum(F.octet_length(F.array_join(words, " ")) + 8 * F.size(words)) if words else F.lit(0)
    rows, size = df.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def diagonals(docs: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    """Distinct (rid, item, diag): alignments that share a fingerprint."""
    long_items = materialise(fingerprints(items, "item", window, k), "item_fingerprints")
    hits = fingerprints(docs, "rid", window, k).withColumnRenamed("pos", "doc_pos").join(_sized(long_items), "hash")
    return hits.select("rid", "item", (F.col("doc_pos") - F.col("pos")).alias("diag")).distinct()


def short_runs(docs: DataFrame, items: DataFrame, window: int) -> DataFrame | None:
    """(rid, item, start, end) of the occurrences of items of fewer words than a
    window; None if there are no such items."""
    size = F.size("words")
    short = materialise(items.where((size > 0) & (size < window)).select(
        "item", size.alias("size"), F.array_join("words", " ").alias("gram"), "words"), "short_items")
    sizes = sorted(r["size"] for r in short.select("size").distinct().collect())  # fewer than a window's words
    known, found = _sized(short, "words").drop("words"), None
    for n in sizes:
        grams = F.transform(F.sequence(F.lit(1), F.size("words") - (n - 1)), lambda i: F.array_join(F.slice(F.col("words"), i, n), " "))
        grams = F.col("words") if n == 1 else F.when(F.size("words") >= n, grams)
        places = docs.select("rid", F.posexplode(grams).alias("start", "gram"))
        hits = places.join(known.where(F.col("size") == n), "gram").select(
            "rid", "item", "start", (F.col("start") + n).alias("end"))
        found = hits if found is None else found.unionByName(hits)
    return found


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = KGRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside an occurrence
    of a benchmark window), items (sorted ids, as strings, of the items with
    occurring windows), hit_runs (array of [start, end) word runs)."""
    rows = with_row_key(docs)
    texts = rows.select("doc_id", "rid", words_array(F.col("text")).alias("words"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"),
                             words_array(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words"))
    items = materialise(items.distinct(), "benchmark_items")
    found = materialise(diagonals(texts, items, window, k), "alignments")

    runs, short = matching_runs(found, rows, items, window), short_runs(texts, items, window)
    runs = materialise(runs if short is None else runs.unionByName(short), "hit_runs")
    per_doc = runs.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("runs"),
                                      F.sort_array(F.collect_set("item")).alias("items"))
    out = texts.select("doc_id", "rid", F.size("words").cast("long").alias("n_words")).join(per_doc, "rid", "left")
    covered = F.aggregate(
        "runs", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda acc, r: F.struct(
            (acc["n"] + F.greatest(r["end"] - F.greatest(r["start"], acc["upto"]), F.lit(0))).alias("n"),
            F.greatest(acc["upto"], r["end"]).alias("upto")))["n"]
    return out.select(
        "doc_id", "rid", "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("runs", F.array().cast("array<struct<start:int,end:int>>")).alias("hit_runs"))


def matching_runs(found: DataFrame, rows: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(rid, item, start, end): the runs of equal words along each alignment
    that are at least as long as a window."""
    placed = found.join(_sized(items, "words"), "item").withColumnRenamed("words", "item_words")
    placed = placed.groupBy("rid").agg(F.collect_list(F.struct("item", "diag", "item_words")).alias("lines"))
    placed = placed.join(rows.select("rid", "text"), "rid").select(
        "rid", "lines", words_array(F.col("text")).alias("words"))

    def breaks(a: Column) -> Column:
        """Places of unequal words, and both ends of the overlap, bound the runs."""
        low = F.greatest(a["diag"], F.lit(0))
        high = F.least(a["diag"] + F.size(a["item_words"]), F.size("words"))
        return F.when(high > low, F.concat(
            F.array(low - 1),
            F.filter(F.sequence(low, high - 1), lambda i: F.get(F.col("words"), i) != F.get(a["item_words"], i - a["diag"])),
            F.array(high)))

    marked = placed.select("rid", F.explode(F.transform("lines", lambda a: F.struct(
        a["item"].alias("item"), breaks(a).alias("breaks")))).alias("a"))
    spans = marked.select("rid", "a.item", "a.breaks")
    pairs = F.zip_with(F.slice("breaks", 1, F.size("breaks") - 1), F.slice("breaks", 2, F.size("breaks") - 1),
                       lambda a, b: F.struct((a + 1).alias("start"), b.alias("end")))
    return (spans.where(F.col("breaks").isNotNull()).select("rid", "item", F.explode(pairs).alias("run"))
            .where(F.col("run.end") - F.col("run.start") >= window)
            .select("rid", "item", F.col("run.start").alias("start"), F.col("run.end").alias("end")))
