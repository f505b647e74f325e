"""Merged order (W4, W5, O1) on a stream of growing files.

The batch merge sorts a run's lines by the running maximum of the line key
inside each file, then by file and line. On a stream the same keys are kept as
state of the run (``transformWithState``): for every file its first stamp and its
running maximum, and the lines that can't be placed yet. A line is released when
the run has seen a key ``delay`` later than the line's; what is released is
numbered (``seq``), so the order survives any sink. Lines of a file wait for its
first stamp; a file that ends without one has the earliest key. A run that has
been silent for ``idle`` seconds releases all it holds (0: after every batch, for
trees that are finished).

If no file lags more than ``delay`` behind the run, the order is that of the
batch query over the finished tree. A line that comes later than that is
released with the next ones and marked ``late``. State is bounded by the lines
of ``delay`` (and of files still without a stamp); runs are independent of each
other. A batch's lines of a run are ordered in one task, whose memory does not
grow with them: a table of the batch's files (first and greatest stamp) is all
that is kept of the lines, which wait on the task's local disk in sorted chunks.

Files of one folder and stream are taken in the order of their rotation: an
active file, its rest under its rotated name, then the next active file.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import os
import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from logloom.operators.merge import FLOOR_MICROS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FILE = ["source_type", "app_id", "source_detail", "stream"]
# what a waiting line is kept as
LINE = ("merge_us long, app_id string, source_type string, source_detail string, stream string, gen long, at long, part long, "
        "us long, level int, file_origin string, line string")
OUT = ("run_key string, seq long, late boolean, merge_us long, app_id string, source_type string, source_detail string, "
       "stream string, us long, level int, file_origin string, line string")
_M, _APP, _TYPE, _DETAIL, _STREAM, _GEN, _AT, _PART = range(8)
# lines (or characters of them) that a task holds of what it sorts, that move
# between disk, state or output and memory at once, and chunks merged at once
CHUNK_LINES, CHUNK_CHARS = 50_000, 16 << 20
BLOCK_LINES, BLOCK_CHARS = 500, 1 << 18
FRAME_LINES, FRAME_CHARS = 10_000, 4 << 20
FAN_IN = 32


@functools.lru_cache(1 << 12)
def _file_key(source_type: str, detail: str | None, app: str | None, stream: str) -> tuple:
    executor = source_type == "executor"
    detail = detail or ""
    number = int(detail) if executor and detail.isascii() and detail.isdigit() and len(detail) <= 18 else 0
    return executor, number, app or "", detail, stream


def line_key(x: tuple) -> tuple:
    """Merged order of kept lines: key (the earliest, if there is none), file (as
    in the batch merge), line."""
    return x[_M], _file_key(x[_TYPE], x[_DETAIL], x[_APP], x[_STREAM]), x[_GEN], x[_AT], x[_PART]


def _waiting_key(x: tuple) -> tuple:
    return line_key((FLOOR_MICROS, *x[1:]))


def _blocks(lines: Iterable[tuple], most: int, chars: int) -> Iterator[list[tuple]]:
    """Lists of at most ``most`` lines, and about ``chars`` characters of them."""
    block, size = [], 0
    for x in lines:
        block.append(x)
        size += len(x[-1])
        if len(block) >= most or size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def _local_dir() -> str | None:
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return folder if os.path.isdir(folder) else None


class SortedLines:
    """Any number of lines (the text last) in the order of ``key``, ties as they
    came, in bounded memory: sorted chunks of them wait on local disk. To be
    filled first and then iterated."""

    def __init__(self, key: Callable[[tuple], tuple]) -> None:
        self.key, self.count, self.chunk, self.chars = key, 0, [], 0
        self.levels: list[list] = []  # files of sorted chunks; those of a higher level hold earlier lines

    def __len__(self) -> int:
        return self.count

    def add(self, x: tuple) -> None:
        self.chunk.append(x)
        self.chars += len(x[-1])
        self.count += 1
        if len(self.chunk) >= CHUNK_LINES or self.chars >= CHUNK_CHARS:
            self.chunk.sort(key=self.key)
            self._write(self.chunk, 0)
            self.chunk, self.chars = [], 0

    def _write(self, lines: Iterable[tuple], level: int) -> None:
        f = tempfile.TemporaryFile(dir=_local_dir())
        for block in _blocks(lines, BLOCK_LINES, BLOCK_CHARS):
            pickle.dump(block, f, pickle.HIGHEST_PROTOCOL)
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(f)
        if len(self.levels[level]) == FAN_IN:
            whole, self.levels[level] = self.levels[level], []
            self._write(heapq.merge(*map(self._read, whole), key=self.key), level + 1)
            for f in whole:
                f.close()

    @staticmethod
    def _read(f) -> Iterator[tuple]:
        f.seek(0)
        while True:
            try:
                yield from pickle.load(f)
            except EOFError:
                return

    def __iter__(self) -> Iterator[tuple]:
        self.chunk.sort(key=self.key)
        files = [self._read(f) for level in reversed(self.levels) for f in level]
        return heapq.merge(*files, self.chunk, key=self.key) if files else iter(self.chunk)


class _BatchFile:
    """What a batch has of a file: its first stamped line and greatest stamp; then
    generation, first stamp and running maximum, or the key of all its lines."""

    __slots__ = ("number", "name", "first_at", "first_us", "max_us", "gen", "first", "so_far", "key")

    def __init__(self, number: int, name: tuple) -> None:
        self.number, self.name = number, name
        self.first_at = self.first_us = self.max_us = self.gen = self.first = self.so_far = self.key = None

    @property
    def series(self) -> tuple:
        return tuple(c or "" for c in self.name[:len(FILE)])

    def order(self) -> tuple:
        fresh, rotated, origin = self.name[len(FILE):]
        return self.series, fresh, rotated is None, rotated or 0, origin


class RunMerge:
    """The merge of one run: ``files`` maps a file series to [generation, first
    stamp, running maximum], ``held`` are its lines not yet released and ``waiting``
    those still without a key, ``top`` is the greatest key seen, ``out`` that of the
    last line released, ``seq`` their number."""

    def __init__(self, files: dict[tuple, list], held: Iterable[tuple], top: int | None, out: int | None, seq: int) -> None:
        self.files, self.top, self.out, self.seq = files, top, out, seq
        self.held, self.waiting = SortedLines(line_key), SortedLines(_waiting_key)
        for x in held:
            self._keep(x)

    def _keep(self, x: tuple) -> None:
        (self.waiting if x[_M] is None else self.held).add(x)

    def add(self, rows: Iterable[dict]) -> None:
        """A batch's lines, in any order."""
        found: dict[tuple, _BatchFile] = {}
        lines = SortedLines(itemgetter(0, 1, 2))
        for r in rows:
            name = (*(r[c] for c in FILE), r["fresh"], r["rotated"], r["file_origin"])
            file = found.get(name)
            if file is None:
                file = found[name] = _BatchFile(len(found), name)
            us, at = r["us"], (r["at"], r["part"])
            if us is not None:
                if file.first_at is None or at < file.first_at:
                    file.first_at, file.first_us = at, us
                file.max_us = us if file.max_us is None else max(file.max_us, us)
            lines.add((file.number, *at, us, r["level"], r["line"]))
        keys = self._place(sorted(found.values(), key=_BatchFile.order))
        before, self.waiting = self.waiting, SortedLines(_waiting_key)
        for x in before:
            self._keep((keys.get(((x[_TYPE], x[_APP] or "", x[_DETAIL] or "", x[_STREAM]), x[_GEN])), *x[1:]))
        files = list(found.values())
        for number, at, part, us, level, line in lines:
            file = files[number]
            key = file.key
            if file.first is not None:
                key = file.so_far = max(file.so_far, us if us is not None else file.first)
            source_type, app, detail, stream, _, _, origin = file.name
            self._keep((key, app, source_type, detail, stream, file.gen, at, part, us, level, origin, line))

    def _place(self, files: list[_BatchFile]) -> dict[tuple, int]:
        """Carries the state of the series over the files of a batch, in their order.
        Returns the keys found for the waiting lines of (series, generation)."""
        keys, path = {}, None
        for file in files:
            series, (fresh, _, origin) = file.series, file.name[len(FILE):]
            state = self.files.get(series)
            if state is None:
                state = self.files[series] = [0, None, None]
            elif fresh and origin != path:  # a file not read before follows
                if state[1] is None:
                    keys[series, state[0]] = FLOOR_MICROS
                state[:] = [state[0] + 1, None, None]
            path = origin
            if file.first_us is not None and state[1] is None:
                keys[series, state[0]] = state[1] = state[2] = file.first_us
            file.gen, file.first, file.so_far = state
            if file.first is not None:
                if file.max_us is not None:
                    state[2] = max(state[2], file.max_us)
                self.top = state[2] if self.top is None else max(self.top, state[2])
        for file in files:
            if file.first is None:
                file.key = keys.get((file.series, file.gen))
        return keys

    def release(self, delay_us: int | None) -> Iterator[tuple]:
        """(seq, late, kept line) of what can be placed; all if ``delay_us`` is None.
        What stays is in ``held`` when all of them have been taken."""
        bound = None
        if delay_us is None:
            for x in self.waiting:
                self.held.add((FLOOR_MICROS, *x[1:]))
            self.waiting = SortedLines(_waiting_key)
        else:
            bound = self.top - delay_us if self.top is not None else FLOOR_MICROS - 1
        ready, self.held = self.held, SortedLines(line_key)
        for x in ready:
            if bound is not None and x[_M] > bound:
                self.held.add(x)
                continue
            late = self.out is not None and x[_M] < self.out
            self.out = x[_M] if self.out is None else max(self.out, x[_M])
            self.seq += 1
            yield self.seq, late, x


class MergeRuns(StatefulProcessor):
    """:class:`RunMerge` over the state store; a processing-time timer releases
    the rest of a run that has gone silent."""

    def __init__(self, delay_us: int, idle_ms: int) -> None:
        self.delay_us, self.idle_ms = delay_us, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "source_type string, app_id string, source_detail string, stream string",
                                        "gen long, first_us long, max_us long")
        self.held = handle.getListState("held", LINE)
        self.run = handle.getValueState("run", "top_us long, out_us long, seq long, seen_ms long")

    def _load(self) -> RunMerge:
        top, out, seq, _ = self.run.get() if self.run.exists() else (None, None, 0, 0)
        files = {tuple(k): list(v) for k, v in self.files.iterator()}
        return RunMerge(files, map(tuple, self.held.get()), top, out, seq)

    def _store(self, merge: RunMerge, files: dict, now: int) -> None:
        for series, state in merge.files.items():
            if files.get(series) != state:
                self.files.updateValue(series, tuple(state))
        self.held.clear()
        for block in _blocks(itertools.chain(merge.waiting, merge.held), BLOCK_LINES, BLOCK_CHARS):
            self.held.appendList(block)
        self.run.update((merge.top, merge.out, merge.seq, now))

    @staticmethod
    def _rows(frame: pd.DataFrame) -> Iterator[dict]:
        whole = lambda c: [None if pd.isna(v) else int(v) for v in frame[c]]
        text = lambda c: [None if pd.isna(v) else v for v in frame[c]]
        columns = {c: frame[c].tolist() for c in frame.columns}
        columns |= {c: whole(c) for c in ("us", "level", "rotated")} | {"app_id": text("app_id")}
        return (dict(zip(columns, r)) for r in zip(*columns.values()))

    @staticmethod
    def _frames(key, released: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in OUT.split(", ")]
        rows = ((key[0], seq, late, x[_M], *x[1:5], *x[8:]) for seq, late, x in released)
        for block in _blocks(rows, FRAME_LINES, FRAME_CHARS):
            yield pd.DataFrame(block, columns=names).astype({"merge_us": "Int64", "us": "Int64", "level": "Int32"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        merge = self._load()
        files = {k: list(v) for k, v in merge.files.items()}
        merge.add(r for frame in rows for r in self._rows(frame))
        yield from self._frames(key, merge.release(self.delay_us if self.idle_ms else None))
        now = timerValues.getCurrentProcessingTimeInMs()
        self._store(merge, files, now)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if self.idle_ms:
            self.handle.registerTimer(now + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        merge = self._load()
        files = {k: list(v) for k, v in merge.files.items()}
        yield from self._frames(key, merge.release(None))
        self._store(merge, files, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def merged_stream(entries: DataFrame, delay: str = "10 minutes", idle_seconds: float = 600) -> DataFrame:
    """Stream of :func:`follow.follow_growing` -> the same lines with ``merge_us``,
    ``seq`` (their number in the run's merged order) and ``late``."""
    spark = entries.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    delay_us = spark.sql(f"SELECT unix_micros(timestamp'1970-01-02' + INTERVAL {delay}) - unix_micros(timestamp'1970-01-02')").first()[0]
    rows = entries.select(
        "run_key", *FILE, "file_origin", "fresh", F.unix_micros("file_timestamp").alias("rotated"), F.col("line_no.at").alias("at"),
        F.col("line_no.row").alias("part"), F.unix_micros("timestamp").alias("us"), "level", "line")
    out = rows.groupBy("run_key").transformWithStateInPandas(
        MergeRuns(delay_us, int(1000 * idle_seconds)), StructType.fromDDL(OUT), "append", "processingTime")
    return out.withColumn("timestamp", F.timestamp_micros("us")).drop("us")
