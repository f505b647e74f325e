"""Embedding near-dedup with a pivot-permutation index.

Reference points (pivots) are chosen farthest-first from a bounded sample of
``SAMPLE`` vectors. Every vector orders the pivots by distance and is posted,
per label and dimension, to the inverted list of the nearest (its home) and to
those that a link can have as home: if unit vectors a and b link, they are at
most r = sqrt(2 - 2 threshold) apart, so b cannot lie further than r beyond the
plane that bounds the cell of a's home. The prefix of pivots is therefore as
long as the vector needs, and no link is lost, whatever the data; vectors that
crowd together share more lists and cost more comparisons.

A list compares its home vectors with each other and with its guests, all in
double precision; a pair of different homes meets in the lower-numbered list
only. Exact copies are one entry with a count. Home and guest vectors of a list
are cut into blocks of about ``BLOCK`` and dealt as pairs of blocks, so no task
holds a hot list and no pair is dropped. A task returns one row per linked
entry (its links, and the least entry it reaches there), never pairs.

Defined results: a null label, and a vector that is null, empty, zero or has
null or non-finite components, links with nothing; vectors of different
length do not link; repeated rows are other vectors and link; a null vec_id
is never a component's id unless the component has no other; cosine equal to
the threshold links; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import materialise
from logloom.llm.components import connected_components

SAMPLE, PIVOTS = 2048, 64
BLOCK = 256
# what rounding may add to a distance
ROUNDING = 1e-6


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Up to ``count`` unit rows, each the farthest from those before it."""
    x = unit_rows(sample)
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(count, len(x)):
        far = int(np.argmin(nearest))
        if nearest[far] > 0.999:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, x @ x[far])
    return x[chosen]


def permutation_prefixes(x: np.ndarray, pivots: np.ndarray, reach: float) -> list[np.ndarray]:
    """The lists of every unit row: its nearest pivot, then the pivots of lower
    number whose cells come within ``reach`` of it."""
    dots, rows = x @ pivots.T, np.arange(len(x))
    home = dots.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
    near = dots[rows, home][:, None] - dots <= (reach + ROUNDING) * apart[home] + ROUNDING
    near &= np.arange(len(pivots)) < home[:, None]
    return [np.concatenate(([h], np.flatnonzero(n))).astype(np.int32) for h, n in zip(home, near)]


def usable(label: str, embedding: str) -> Column:
    """Whether a row can link at all (never null)."""
    numbers = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & numbers & F.exists(embedding, lambda v: v != 0), F.lit(False))


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding, ok, class): class hashes label and vector."""
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return (rows.withColumn("ok", usable("label", "embedding"))
            .withColumn("class", F.when(F.col("ok"), F.xxhash64("label", "embedding"))))


def postings(entries: DataFrame, pivots: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """The entries with their lists, home first (a single list for a dimension
    that the sample did not meet)."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                x = part["embedding"].flatten().to_numpy().reshape(-1, dim)
                lists = (permutation_prefixes(unit_rows(x), pivots[dim], reach) if dim in pivots
                         else [np.zeros(1, np.int32)] * len(x))
                offsets = np.concatenate(([0], np.cumsum([len(one) for one in lists]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(offsets, np.concatenate(lists))],
                    [*part.schema.names, "lists"])

    more = T.StructField("lists", T.ArrayType(T.IntegerType()))
    return entries.mapInArrow(post, T.StructType([*entries.schema.fields, more]))


def cells(posted: DataFrame) -> DataFrame:
    """Cut the home and the guest vectors of every list into blocks and deal
    each pair of blocks with a home block as a cell."""
    listed = posted.select("*", F.posexplode("lists").alias("nth", "pivot")).drop("lists")
    listed = listed.withColumn("guest", F.col("nth") > 0).drop("nth")
    sizes = listed.groupBy("label", "dim", "pivot").agg(
        F.count_if(~F.col("guest")).alias("homes"), F.count_if("guest").alias("guests"))
    dealt = listed.join(materialise(sizes.where("homes > 0"), "list_sizes"), ["label", "dim", "pivot"])
    homes, guests = (F.ceil(F.col(n) / BLOCK).cast("int") for n in ("homes", "guests"))
    hashed = F.xxhash64("class", "pivot")
    dealt = dealt.withColumn("block", F.when(F.col("guest"), homes + F.pmod(hashed, F.greatest(guests, F.lit(1))))
                             .otherwise(F.pmod(hashed, homes)).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(
        F.lit(0), F.when(F.col("guest"), homes - 1).otherwise(homes + guests - 1))))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    cell = F.xxhash64("label", "dim", "pivot", i, j)
    return dealt.select(cell.alias("cell"), "block", i.alias("i"), j.alias("j"), "class", "copies", "embedding")


def cell_links(x: np.ndarray, side: np.ndarray, across: bool, copies: np.ndarray, nodes: np.ndarray,
               threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, links, root) of the entries that link in a cell. side: which of
    its blocks the entries are of; across: a cell of two blocks, where only
    pairs across them count."""
    size = np.sqrt(np.einsum("ij,ij->i", x, x))
    close = (x @ x.T) / (size[:, None] * size[None]) >= threshold
    np.fill_diagonal(close, False)
    if across:
        close &= side[:, None] != side[None]
    a, b = np.nonzero(close)
    if not len(a):
        return np.empty(0, int), np.empty(0, int), np.empty(0, nodes.dtype)
    links = np.bincount(a, copies[b], len(x)).astype(np.int64)
    root = nodes.copy()
    while True:  # the least entry reached
        new = root.copy()
        np.minimum.at(new, a, root[b])
        if np.array_equal(new, root):
            break
        root = new
    rows = np.flatnonzero(links)
    return rows, links[rows], root[rows]


def verified(dealt: DataFrame, threshold: float) -> DataFrame:
    """(class, links, root): what every cell found."""
    def check(rows: pa.Table, out: list) -> None:
        dim = len(rows["embedding"][0])
        x = rows["embedding"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        side = rows["block"].to_numpy() != rows["i"].to_numpy()
        across, nodes = rows["i"][0] != rows["j"][0], rows["class"].to_numpy()
        at, links, root = cell_links(x, side, across, rows["copies"].to_numpy(), nodes, threshold)
        out.append((nodes[at], links, root))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        out: list = []
        for batch in batches:
            key = batch["cell"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if held and held[-1]["cell"][0] != part["cell"][0]:
                    check(pa.Table.from_batches(held), out)
                    held = []
                held.append(part)
            if out:
                yield rows_of(out)
                out = []
        if held:
            check(pa.Table.from_batches(held), out)
            yield rows_of(out)

    def rows_of(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["class", "links", "root"])

    return (dealt.repartition("cell").sortWithinPartitions("cell")
            .mapInArrow(run, "class long, links long, root long"))


def near_dedup(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    rows = prepared(vectors)
    entries = materialise(
        rows.where("ok").groupBy("class", "label", "embedding")
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("dim", F.size("embedding")), "entries")
    sample = entries.select("class", "dim", "embedding").orderBy("class").limit(SAMPLE).collect()  # bounded
    pivots = {d: choose_pivots(np.array([r["embedding"] for r in sample if r["dim"] == d], float))
              for d in {r["dim"] for r in sample}}
    posted = materialise(postings(entries.drop("least"), pivots, threshold), "postings")
    found = materialise(verified(cells(posted), threshold), "links")

    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    labels = connected_components(found.where("class <> root").select(F.col("class").alias("a"), F.col("root").alias("b")))
    named = materialise(entries.select("class", "copies", "least").join(labels.withColumnRenamed("node", "class"), "class", "left")
                        .join(links, "class", "left"), "classes")
    ids = materialise(named.where("label is not null").groupBy("label").agg(F.min("least").alias("least_id")), "component_ids")
    classes = materialise(named.join(ids, "label", "left").select(
        "class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("least_id", "least").alias("component_id")), "class_ids")
    out = rows.select("vec_id", "ok", "class").join(classes, "class", "left")
    component = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
