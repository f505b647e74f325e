"""A streaming source of the lines of log files that are still being written.

Spark's file source takes a file once, whole. This one's offset is the size of
every file, so bytes appended to an active file are the next batch's, and a
restart goes on from the offsets in the checkpoint. A batch has the lines that
end (at \\n) between the two sizes; an unfinished line waits, until its end
arrives or the file is rotated.

Rotation renames an active file, and may pack it. The offset therefore also
holds, for an active file, a fingerprint of its first and of its last read
bytes. A file that is new to the source is looked at for the places where
active files of the same folder and stream had been read up to; where the
fingerprint fits, it is that file under its new name and reading goes on there.
An active file whose fingerprint no longer fits is a new one and is read from
its beginning. And where the file of a batch has been rotated before its task ran, or
before the batch is run again after a restart, the task finds it by its
fingerprint among its neighbours. All this is decided by the tasks; the driver
lists names and sizes and reads two kilobytes of every active file that has
grown. Rotated files are taken to be complete when they appear, and may appear
late, after a new active file: the places read to in files that are gone are
kept in the next offset, and, so that a stream restarted for every batch has
them too, in the folder ``state``. The offset grows with the number of files
under the roots followed.

Plain files are read in ranges of ``RANGE_BYTES`` by several tasks; a gzip
archive by one, in bounded memory, and not at all if it is damaged.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from logloom import rules
from logloom.sources.byte_files import PIECE_BYTES, archive_pieces, archive_text_bytes, file_system, lines_of, pieces

RANGE_BYTES = 128 << 20
EDGE_BYTES = 1024
# places of rotated files that have not appeared yet, remembered for each series
HELD = 8
# ``fresh``: no byte of the file has been read before
SCHEMA = "_uri string, fresh boolean, at bigint, value string"
_ARROW = pa.schema([("_uri", pa.string()), ("fresh", pa.bool_()), ("at", pa.int64()), ("value", pa.string())])

# (name pattern, stream, active names) of driver and executor files
_DRIVER = [(rules.DRIVER_STDERR, "stderr"), (rules.DRIVER_STDOUT, "stdout"), (rules.LOG4J_ACTIVE, "log4j"),
           (rules.LOG4J_ROTATED, "log4j"), (rules.STACKTRACE_ACTIVE, "stacktrace"), (rules.STACKTRACE_ROTATED, "stacktrace")]
_EXECUTOR = [(rules.EXECUTOR_STDERR, "stderr"), (rules.EXECUTOR_STDOUT, "stdout")]
_ACTIVE = re.compile("|".join(["^stderr$", "^stdout$", rules.LOG4J_ACTIVE, rules.STACKTRACE_ACTIVE]))


def stream_of(relative: str) -> str | None:
    """The stream of a file below a run's root; None if it is no log file."""
    parts = relative.split("/")
    if len(parts) == 2 and parts[0] == "driver":
        known = _DRIVER
    elif len(parts) == 4 and parts[0] == "executor" and re.search(rules.APP_DIR, parts[1]):
        known = _EXECUTOR
    else:
        return None
    return next((stream for pattern, stream in known if re.search(pattern, parts[-1])), None)


def is_active(name: str) -> bool:
    return bool(_ACTIVE.search(name))


def _print(head: bytes, tail: bytes) -> str:
    return hashlib.sha256(len(head).to_bytes(4, "big") + head + tail).hexdigest()[:32]


def edge_print(uri: str, at: int) -> str | None:
    """Fingerprint of a plain file's first bytes and of those before ``at``;
    None if the file is gone or shorter."""
    size = min(at, EDGE_BYTES)
    try:
        system, path = file_system(uri)
        with system.open_input_file(path) as f:
            if f.size() < at:
                return None
            return _print(f.read_at(size, 0), f.read_at(size, at - size))
    except OSError:
        return None


def archive_prints(uri: str, places: list[int]) -> dict[int, str]:
    """The same fingerprints of an archive's text, at several places."""
    found, at, head, tail = {}, 0, b"", b""
    wanted = sorted(set(places))
    for data in archive_pieces(uri):
        if len(head) < EDGE_BYTES:
            head = (head + data)[:EDGE_BYTES]
        while wanted and wanted[0] <= at + len(data):
            place = wanted.pop(0)
            size = min(place, EDGE_BYTES)
            found[place] = _print(head[:size], (tail + data[:place - at])[-size:] if size else b"")
        at += len(data)
        tail = (tail + data)[-EDGE_BYTES:]
        if not wanted:
            break
    return found


class Range(InputPartition):
    """The lines of a file that end in its bytes [low, high); with ``ends`` also
    one without \\n at ``high``. Of the places ``read_to`` (place, fingerprint) the
    first that fits tells what has been read. ``mark``: the fingerprint the file
    must have at ``size`` (active files)."""

    def __init__(self, uri: str, low: int, high: int, size: int, mark: str, ends: bool, read_to: list[list]) -> None:
        self.uri, self.low, self.high, self.size = uri, low, high, size
        self.mark, self.ends, self.read_to = mark, ends, read_to


class GrowingFiles(DataSource):
    """``spark.readStream.format("logloom_growing").option("roots", json)``."""

    @classmethod
    def name(cls) -> str:
        return "logloom_growing"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(json.loads(self.options["roots"]), int(self.options.get("rangeBytes", RANGE_BYTES)),
                             self.options.get("state"))


class GrowingReader(DataSourceStreamReader):
    def __init__(self, roots: list[str], range_bytes: int = RANGE_BYTES, state: str | None = None) -> None:
        self.roots = sorted({r.rstrip("/") for r in roots})
        self.range_bytes, self.state = range_bytes, state
        self.held = self._kept()

    def _kept(self) -> dict[str, list]:
        if self.state:
            system, path = file_system(self.state, encoded=False)
            if system.get_file_info(f"{path}/held.json").type == pafs.FileType.File:
                with system.open_input_stream(f"{path}/held.json") as f:
                    return json.loads(f.read())
        return {}

    def _keep(self, held: dict[str, list]) -> None:
        """Marks that are kept too long do no harm: they fit no other file."""
        if self.state and held != self.held:
            system, path = file_system(self.state, encoded=False)
            system.create_dir(path, recursive=True)
            with system.open_output_stream(f"{path}/held.new") as f:
                f.write(json.dumps(held).encode())
            system.move(f"{path}/held.new", f"{path}/held.json")
        self.held = held

    def initialOffset(self) -> dict:
        return {}

    def _listed(self, root: str) -> Iterator[tuple[str, int]]:
        system, base = file_system(root, encoded=False)
        for folder in ("driver", "executor"):
            for info in system.get_file_info(pafs.FileSelector(f"{base}/{folder}", allow_not_found=True, recursive=True)):
                relative = info.path[len(base):].lstrip("/")
                if info.type == pafs.FileType.File and stream_of(relative):
                    yield f"{quote(root, safe='/:')}/{quote(relative)}", info.size

    def latestOffset(self) -> dict:
        """files: {file: [size, fingerprint at that size (active files)]}; held:
        the last such entries of active files that are gone, by folder and stream."""
        def entry(item: tuple[str, int]) -> tuple[str, list | None]:
            uri, size = item
            if not is_active(uri.rsplit("/", 1)[1]):
                return uri, [size, ""]
            mark = edge_print(uri, size)
            return uri, [size, mark] if mark else None  # rotated just now: seen next time

        with ThreadPoolExecutor(16) as pool:
            found = [x for listed in pool.map(lambda r: list(self._listed(r)), self.roots) for x in listed]
            files = {uri: x for uri, x in pool.map(entry, sorted(found)) if x}
        return {"files": files, "held": self.held}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        """The ranges to read between two offsets."""
        held = {series: list(marks) for series, marks in start.get("held", {}).items()}
        start, end = start.get("files", {}), end["files"]
        read_to = {series: list(marks) for series, marks in held.items()}
        for uri, (size, mark) in start.items():
            if mark and size:
                read_to.setdefault(self._series(uri), []).append([size, mark])
                if uri not in end or (end[uri] != [size, mark] and edge_print(uri, size) != mark):
                    held.setdefault(self._series(uri), []).append([size, mark])
        for series, marks in self.held.items():
            held[series] = held.get(series, []) + [m for m in marks if m not in held.get(series, [])]
            read_to[series] = read_to.get(series, []) + [m for m in marks if m not in read_to.get(series, [])]
        self._keep({series: marks[-HELD:] for series, marks in sorted(held.items())})
        out = []
        for uri, (size, mark) in end.items():
            before, active = start.get(uri), is_active(uri.rsplit("/", 1)[1])
            if before == [size, mark] or (before and not active):  # rotated files don't change
                continue
            marks = sorted(read_to.get(self._series(uri), []), reverse=True)
            if active and before and before[0] <= size:
                marks = [before]
            step = size if uri.endswith(".gz") else self.range_bytes
            out += [Range(uri, low, min(low + step, size), size, mark, not active and low + step >= size, marks)
                    for low in range(0, max(size, 1), max(step, 1))]
        return out

    @staticmethod
    def _series(uri: str) -> str:
        """Folder and stream: an active file and what it has been rotated to."""
        folder, _, name = uri.rpartition("/")
        kinds = _EXECUTOR if "/executor/" in uri else _DRIVER
        return f"{folder}/{next((stream for pattern, stream in kinds if re.search(pattern, name)), name)}"

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for fresh, places, lines in _new_lines(partition):
            yield pa.RecordBatch.from_arrays(
                [pa.array([partition.uri] * len(lines)), pa.array([fresh] * len(lines)), pa.array(places, pa.int64()),
                 pa.array(lines, pa.string())], schema=_ARROW)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def _marked(uri: str, places: list[list]) -> int:
    """The first of ``places`` (place, fingerprint) that fits the file; 0 if none does."""
    if not places:
        return 0
    packed = archive_prints(uri, [at for at, _ in places]) if uri.endswith(".gz") else None
    return next((at for at, mark in places if (packed.get(at) if packed is not None else edge_print(uri, at)) == mark), 0)


def _found(p: Range) -> str | None:
    """Where the active file of a range is now: at its place, or rotated."""
    if not p.mark or not p.size or edge_print(p.uri, p.size) == p.mark:
        return p.uri
    folder, _, name = p.uri.rpartition("/")
    system, path = file_system(folder)
    for info in system.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
        uri = f"{folder}/{quote(info.base_name)}"
        if info.type == pafs.FileType.File and uri != p.uri and GrowingReader._series(uri) == GrowingReader._series(p.uri):
            if uri.endswith(".gz") and archive_text_bytes(uri) is None:
                continue
            if _marked(uri, [[p.size, p.mark]]):
                return uri
    return None


def _new_lines(p: Range) -> Iterator[tuple[bool, list[int], list[str]]]:
    """(fresh, places, lines) of a range."""
    uri = _found(p)
    if uri is None or (p.uri.endswith(".gz") and archive_text_bytes(uri) is None):  # gone, or damaged: dropped whole
        return
    done = _marked(uri, p.read_to)
    if uri.endswith(".gz"):
        own = uri == p.uri  # the archive's sizes are no places in its text
        low, high = (done, None) if own else (max(p.low, done), p.high)
        for places, ends, lines in lines_of(archive_pieces(uri), last=own):
            kept = [i for i, end in enumerate(ends) if end >= low and (high is None or end < high)]
            if kept:
                yield not done, [places[i] for i in kept], [lines[i] for i in kept]
            if high is not None and ends[-1] >= high:
                return
        return
    low = max(p.low, done)
    if low > p.high or (low == p.high and not p.ends):
        return
    system, path = file_system(uri)
    with system.open_input_file(path) as f:
        begin = low  # back to the beginning of the line that byte ``low`` is in
        while begin:
            size = min(PIECE_BYTES, begin)
            piece = f.read_at(size, begin - size)
            cut = piece.rfind(b"\n")
            begin -= size - (cut + 1)
            if cut >= 0:
                break
        f.seek(begin)
        for places, _, lines in lines_of(_bounded(f, p.high - begin), begin, last=p.ends):
            yield not done, places, lines


def _bounded(f, size: int) -> Iterator[bytes]:
    for data in pieces(f, PIECE_BYTES):
        yield data[:size]
        size -= len(data)
        if size <= 0:
            return
