"""Chronological merge of log files (W2-W5, O1-O3) and order-based limits.

Merge semantics: each line's key is its own timestamp, else the first
timestamp of its file, else year 1. Files are merged like a k-way heap merge
of per-file streams, which is the same as sorting by

    (run_key, running max of the key inside the file, file order, line order)

because a line whose key goes backwards is emitted right after its
predecessor. The running max is a segmented prefix, so that no file, however
large, is processed by a single task, and the input is read once:

1. lines are hash-partitioned once by (file, block), where a block is a
   bounded range of lines (``block_rows`` lines, or a file split); a window
   inside each block gives every line the block's carry so far: the greatest
   stamp, the first stamp, whether a line has none, and the last line with one;
2. the lines are written once, in (file, block) order. A block's own carry is
   that of its last line, so the carries are a filtered read of the table;
3. the carries of the blocks before are combined (they form a monoid), in
   groups of blocks and then over the groups, written (a row per block) and
   joined back to the lines.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.session import write_and_read

FILE_COLS = ["run_key", "file_origin"]
DEFAULT_BLOCK_ROWS = 1 << 20
# Blocks whose prefix is taken together, and the usual bytes of a file split.
BLOCKS_PER_GROUP = 1000
SPLIT_BYTES = 128 << 20
_EPOCH = _dt.datetime(1970, 1, 1, tzinfo=_dt.timezone.utc)
# Year 1 (the floor key of a file without any timestamp) and the largest
# timestamp (sort key of an active file), as epoch microseconds.
FLOOR_MICROS = int((_dt.datetime(1, 1, 1, tzinfo=_dt.timezone.utc) - _EPOCH).total_seconds()) * 1_000_000
MAX_MICROS = int((_dt.datetime(9999, 12, 31, 23, 59, 59, tzinfo=_dt.timezone.utc) - _EPOCH).total_seconds()) * 1_000_000


def max_ts() -> Column:
    return F.timestamp_micros(F.lit(MAX_MICROS))

# Spark plans row_number() <= n as a per-partition top-n before the shuffle
# up to this n (spark.sql.optimizer.windowGroupLimitThreshold default).
WINDOW_GROUP_LIMIT = 1000
# Quantiles of a run's merge keys that bracket the n-th; the sketch's error is a
# tenth of a step.
GRID = 1000


# ----------------------------------------------------------------------- W2
def executor_number(source_detail: Column | str = "source_detail") -> Column:
    sd = F.col(source_detail) if isinstance(source_detail, str) else source_detail
    return F.when(sd.rlike("^[0-9]{1,18}$"), sd.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def file_sort_key(path_col: str = "file_origin") -> Column:
    """Order of files inside a run: driver first, executors by number,
    then app, executor dir, stream, rotation time (active last), path."""
    return F.struct(
        (F.col("source_type") == "executor").alias("is_exec"),
        F.when(F.col("source_type") == "executor", executor_number()).otherwise(F.lit(0).cast("bigint")).alias("n"),
        F.coalesce(F.col("app_id"), F.lit("")).alias("app"),
        F.col("source_detail").alias("detail"),
        F.col("stream").alias("stream"),
        F.coalesce(F.col("file_timestamp"), max_ts()).alias("rot"),
        F.col(path_col).alias("path"),
    )


def with_file_order(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Add ``file_idx`` (0-based position of each file in its run).

    The files table holds one row per file, so partitioning by run is
    bounded by the directory layout, not by data volume.
    """
    w = Window.partitionBy("run_key").orderBy(file_sort_key(path_col))
    return files.withColumn("file_idx", (F.row_number().over(w) - 1).cast("int"))


# ------------------------------------------------------------------- W3-W5
def first_stamps(entries: DataFrame, order_col: str = "line_no") -> DataFrame:
    """W4 of every file: (run_key, file_origin, first_us), its first known
    timestamp in microseconds, or year 1; partly aggregated before the shuffle."""
    us = F.unix_micros("timestamp")
    first = F.min_by(us, F.when(us.isNotNull(), F.col(order_col)))
    return entries.groupBy(*FILE_COLS).agg(F.coalesce(first, F.lit(FLOOR_MICROS)).alias("first_us"))


def with_merge_keys(entries: DataFrame, order_col: str = "line_no", block: Column | None = None,
                    block_rows: int = DEFAULT_BLOCK_ROWS, num_partitions: int | None = None,
                    within_block: Column | None = None) -> DataFrame:
    """Add ``ts_key`` (W4 fallback applied), ``merge_ts`` (W5 running max), both
    as epoch microseconds (year 1 = file without any timestamp),
    ``merge_block``, the block of the line in its file, and ``event_line``, the
    order key of the last line with a timestamp up to here (null: none yet).

    ``order_col`` orders lines inside a file (a number or a struct);
    ``block`` groups consecutive lines into bounded blocks (default:
    ``line_no`` div ``block_rows``). Must run before any line-level filter:
    keys are defined on all lines of a file. ``within_block`` orders lines
    inside one block (default ``order_col``; a fixed-width number sorts
    faster). Lines of a file scan (with ``block_start``, ``file_size``,
    ``is_compressed``) get both automatically.

    The lines are written to the checkpoint folder here, when the function is
    called; the result reads that table.
    """
    scanned = {"block_start", "file_size", "is_compressed"} <= set(entries.columns)
    if block is None:  # of a file scan: a block is a file split
        block = F.col("block_start") if scanned else F.floor(F.col(order_col) / F.lit(block_rows))
    if within_block is None:  # inside a split the line number alone orders lines
        within_block = F.col(order_col)["row"] if scanned else F.col(order_col)
    # blocks are numbered one by one, or by their first byte
    group_span = BLOCKS_PER_GROUP * (SPLIT_BYTES if scanned else 1)

    part_cols = [*FILE_COLS, "merge_block"]
    rows = entries.withColumns({"merge_block": block, "_us": F.unix_micros("timestamp")})
    rows = rows.repartition(num_partitions, *part_cols) if num_partitions else rows.repartition(*part_cols)
    us = F.col("_us")
    in_block = Window.partitionBy(*part_cols).orderBy(within_block)
    so_far = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(
        "*",
        F.max(us).over(so_far).alias("_max"),
        F.max(us.isNull()).over(so_far).alias("_null"),
        F.first(us, ignorenulls=True).over(so_far).alias("_first"),
        F.last(F.when(us.isNotNull(), F.col(order_col)), ignorenulls=True).over(so_far).alias("_head"),
        F.lead(F.lit(1)).over(in_block).isNull().alias("_last"),
    )
    rows = write_and_read(entries.sparkSession, rows, "merge-lines")

    # a group's carries, by block, in one row; then the carry over the groups before
    carries = rows.where("_last").select(*part_cols, F.floor(F.col("merge_block") / F.lit(group_span)).alias("_grp"),
                                         "_max", "_null", "_first", "_head")
    groups = carries.groupBy(*FILE_COLS, "_grp").agg(F.sort_array(F.collect_list(
        F.struct("merge_block", "_max", "_null", "_first", "_head"))).alias("_blocks"))
    file_order = Window.partitionBy(*FILE_COLS).orderBy("_grp")
    before = file_order.rowsBetween(Window.unboundedPreceding, -1)
    whole = file_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = F.filter(F.col("_blocks._first"), lambda x: x.isNotNull())
    heads = F.filter(F.col("_blocks._head"), lambda x: x.isNotNull())
    groups = groups.select(
        *FILE_COLS, "_grp", "_blocks", F.max(F.array_max("_blocks._max")).over(before).alias("_gmax"),
        F.max(F.exists("_blocks._null", lambda x: x)).over(before).alias("_gnull"),
        F.last(F.try_element_at(heads, F.lit(-1)), ignorenulls=True).over(before).alias("_ghead"),
        F.first(F.get(firsts, F.lit(0)), ignorenulls=True).over(whole).alias("_file_first"))
    blocks = groups.select(*FILE_COLS, "_grp", "_gmax", "_gnull", "_ghead", "_file_first",
                           F.explode("_blocks").alias("_b"))
    before = Window.partitionBy(*FILE_COLS, "_grp").orderBy("_b.merge_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        *FILE_COLS, F.col("_b.merge_block").alias("merge_block"), "_file_first",
        F.greatest("_gmax", F.max("_b._max").over(before)).alias("_cmax"),
        F.coalesce(F.last("_b._head", ignorenulls=True).over(before), "_ghead").alias("_chead"),
        (F.coalesce("_gnull", F.lit(False)) | F.coalesce(F.max("_b._null").over(before), F.lit(False))).alias("_cnull"))

    blocks = write_and_read(entries.sparkSession, blocks.drop("_grp"), "merge-blocks")
    floor = F.lit(FLOOR_MICROS)
    fallback = F.coalesce("_file_first", floor)
    out = rows.join(blocks, part_cols).withColumns({
        "ts_key": F.coalesce(us, fallback),
        "event_line": F.coalesce("_head", "_chead"),
        # greatest() skips nulls
        "merge_ts": F.greatest("_cmax", "_max", F.when(F.col("_cnull") | F.col("_null"), fallback), floor),
    })
    return out.drop("_us", "_max", "_null", "_first", "_head", "_last", "_file_first", "_cmax", "_cnull", "_chead")


def merge_sort_cols(order_col: str = "line_no") -> list[Column]:
    """O1: the merged order of a run."""
    return [F.col("run_key"), F.col("merge_ts"), file_sort_key(), F.col(order_col)]


def merge_order(entries: DataFrame, order_col: str = "line_no", **kw) -> DataFrame:
    """Entries in merged order (range-partitioned sort, spills if needed)."""
    keyed = entries if "merge_ts" in entries.columns else with_merge_keys(entries, order_col=order_col, **kw)
    return keyed.orderBy(*merge_sort_cols(order_col))


# ------------------------------------------------------------ distributed rank
def rank_within(df: DataFrame, group_cols: list[str], order_cols: list[Column], name: str = "rank",
                descending: bool = False) -> DataFrame:
    """1-based position of each row inside its group in the given order.

    Unlike ``row_number().over(partitionBy(group))`` no group has to fit in
    one task: rows are range-partitioned by (group, order), each partition
    is sorted, rows are counted per (partition, group), and a prefix sum
    over partitions (a table of at most partitions + groups rows) gives
    each row its offset. The sorted, tagged rows are checkpointed to the
    session's checkpoint folder so both passes see one materialisation.
    """
    keys = [F.col(c) for c in group_cols] + list(order_cols)
    tmp = [f"_k{i}" for i in range(len(keys))]
    tagged = (
        df.withColumns(dict(zip(tmp, keys)))
        .repartitionByRange(*tmp)
        .sortWithinPartitions(*tmp)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
        .drop(*tmp)
        .checkpoint(eager=True)
    )
    seg = tagged.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    w = Window.partitionBy(*group_cols).orderBy("_pid")
    seg = seg.withColumn(
        "_off", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("_tot", F.sum("_n").over(Window.partitionBy(*group_cols)))
    pos = F.col("_off") + F.col("_mid") - F.col("_m0") + 1
    if descending:
        pos = F.col("_tot") - pos + 1
    out = tagged.join(seg, ["_pid", *group_cols], "inner").withColumn(name, pos.cast("bigint"))
    return out.drop("_pid", "_mid", "_n", "_m0", "_off", "_tot")


# ----------------------------------------------------------------------- O2
def _wanted(keyed: DataFrame, n: int, per_run: bool) -> DataFrame:
    """(run_key, _total, _wanted, _grid): how many of a run's last rows belong to
    the result, for every run that has any in it, and the quantiles of its merge
    keys. Taken as one stream, runs follow each other by run_key, so all but one
    of them are in it whole or not at all."""
    sizes = keyed.groupBy("run_key").agg(F.count("*").alias("_total"), F.percentile_approx(
        "merge_ts", [i / GRID for i in range(GRID + 1)], 10 * GRID).alias("_grid"))
    skipped = F.lit(0)
    if not per_run:  # rows of the runs nearer to the end that is counted from
        order = Window.orderBy(F.col("run_key").desc() if n > 0 else F.col("run_key"))
        skipped = F.coalesce(F.sum("_total").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(abs(n)) - skipped
    wanted = F.least("_total", left) if n > 0 else F.col("_total") - F.greatest(left, F.lit(0))
    return sizes.withColumn("_wanted", wanted.cast("bigint")).where(F.col("_wanted") > 0)


def _last_rows(keyed: DataFrame, wanted: DataFrame, order_col: str) -> DataFrame:
    """The last ``_wanted`` rows of every run in merged order, without ranking
    the rows: the merge key at which they begin is bracketed by a quantile
    sketch and found by exact counts inside the bracket; rows that share it are
    told apart by counts of their blocks, and only rows of the one block where
    the cut falls are numbered.

    Every step is a grouped count over the written lines. What is gathered for
    one run is a row per key inside the bracket (a few thousandths of its
    different keys), then a row per block; the bracket is wider than the
    sketch's error, so the n-th key is always in it.
    """
    key = F.col("merge_ts")
    middle = F.floor((1 - F.col("_wanted") / F.col("_total")) * GRID).cast("int")
    bracket = wanted.select(
        "run_key", "_wanted", F.when(middle > 1, F.get("_grid", middle - 1)).alias("_low"),
        F.when(middle < GRID - 2, F.get("_grid", middle + 2)).alias("_high"))
    # rows above the bracket count as one, those inside by their key
    inside = keyed.join(bracket, "run_key").where(F.col("_low").isNull() | (key >= F.col("_low")))
    above = F.col("_high").isNotNull() & (key > F.col("_high"))
    counts = inside.groupBy("run_key", "_wanted", F.when(~above, key).alias("_key")).agg(F.count("*").alias("_n"))
    down = Window.partitionBy("run_key").orderBy(F.col("_key").desc_nulls_first())
    counts = counts.withColumn("_upto", F.sum("_n").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rest = F.col("_wanted") - F.col("_upto") + F.col("_n")
    # the key at which all wanted rows are reached, and how many of its rows are
    nth = counts.where((rest > 0) & (F.col("_upto") >= F.col("_wanted"))).select("run_key", F.col("_key").alias("_nth"), rest.alias("_rest"))

    # of the rows of that key: whole blocks, and lines of one block
    places = keyed.join(nth, "run_key").where(key == F.col("_nth")).groupBy(*FILE_COLS, "merge_block", "_rest").agg(
        F.first(file_sort_key()).alias("_file"), F.count("*").alias("_n"))
    down = Window.partitionBy("run_key").orderBy(F.col("_file").desc(), F.col("merge_block").desc())
    places = places.withColumn("_take", F.col("_rest") - F.coalesce(
        F.sum("_n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("_take") > 0)
    places = places.select(*FILE_COLS, "merge_block", "_take", (F.col("_take") < F.col("_n")).alias("_cut"))

    found = keyed.join(nth, "run_key").where(key >= F.col("_nth")).join(places, [*FILE_COLS, "merge_block"], "left")
    tied = key == F.col("_nth")
    whole = found.where(~tied | ~F.col("_cut"))
    last = Window.partitionBy(*FILE_COLS, "merge_block").orderBy(F.col(order_col).desc())
    cut = found.where(tied & F.col("_cut")).withColumn("_rn", F.row_number().over(last)).where(F.col("_rn") <= F.col("_take"))
    return whole.select(*keyed.columns).unionByName(cut.select(*keyed.columns))


def tail(entries: DataFrame, n: int | None, per_run: bool = True, order_col: str = "line_no") -> DataFrame:
    """Last ``n`` lines in merged order (per run by default).

    ``None`` or 0 keeps everything; ``-k`` drops the first ``k`` lines.
    Small ``n`` uses a per-partition top-n before the shuffle; large ``n``
    and negative ``n`` a distributed selection, so no run is ever gathered
    into one task and nothing but the n-th place is ranked.
    """
    if not n:
        return entries
    keyed = entries if "merge_ts" in entries.columns else with_merge_keys(entries, order_col=order_col)
    cols = merge_sort_cols(order_col)
    if not 0 < n <= WINDOW_GROUP_LIMIT:
        return _last_rows(keyed, _wanted(keyed, n, per_run), order_col)
    if not per_run:  # top-n per partition, n rows reach the final task
        return keyed.orderBy(*[c.desc() for c in cols]).limit(n)
    w = Window.partitionBy("run_key").orderBy(*[c.desc() for c in cols[1:]])
    return keyed.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
