"""Log files as bytes, for the two readers Spark's text source cannot replace:
archives that must be read whole or not at all whatever their size, and files
that grow while they are read.

Files are opened in the tasks through Arrow's file systems (local, S3, GCS,
Azure, HDFS) and are read in pieces, so memory is bounded by the longest line.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as pafs

PIECE_BYTES = 1 << 20
BATCH_LINES = 1 << 16
# a read that fails only because of the file's own content
_DAMAGE = (zlib.error, EOFError)


def file_system(uri: str, encoded: bool = True) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a path or URI; ``encoded``: with %XX."""
    plain = unquote(uri) if encoded else uri
    local = re.sub(r"^file:/+", "/", plain)
    if local.startswith("/"):
        return pafs.LocalFileSystem(), local
    scheme, _, rest = plain.partition("://")
    system, base = pafs.FileSystem.from_uri(f"{scheme}://{rest.split('/', 1)[0]}/")
    return system, f"{base.rstrip('/')}/{rest.split('/', 1)[1]}" if "/" in rest else base


def readable(uri: str) -> bool:
    """Does Arrow have a file system for this path?"""
    try:
        file_system(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def pieces(stream, size: int = PIECE_BYTES) -> Iterator[bytes]:
    while data := stream.read(size):
        yield data


def inflated(stream) -> Iterator[bytes]:
    """The text of a gzip archive of any number of members, piece by piece.
    zlib checks each member's length and checksum at its end; an archive that
    is cut, damaged or none at all raises an error there."""
    members, inflate = 0, zlib.decompressobj(wbits=31)
    for data in pieces(stream):
        while data:
            if inflate.eof:
                if not data.strip(b"\0"):  # padding behind the last member
                    data = b""
                    continue
                inflate = zlib.decompressobj(wbits=31)
            text = inflate.decompress(data, PIECE_BYTES)
            if text:
                yield text
            if inflate.eof:
                members += 1
                data = inflate.unused_data
            else:
                data = inflate.unconsumed_tail
        while not inflate.eof and (text := inflate.decompress(inflate.unconsumed_tail, PIECE_BYTES)):
            yield text
    if not inflate.eof or not members:
        raise EOFError("the archive ends early")


def archive_text_bytes(uri: str) -> int | None:
    """Bytes of text in a whole gzip archive, or None if it is damaged, cut, no
    archive, gone or cannot be read. Nothing of it is kept."""
    try:
        system, path = file_system(uri)
        with system.open_input_stream(path, compression=None) as stream:
            return sum(map(len, inflated(stream)))
    except (*_DAMAGE, OSError):
        return None


def archive_pieces(uri: str) -> Iterator[bytes]:
    """The text of an archive known to be whole."""
    system, path = file_system(uri)
    with system.open_input_stream(path, compression=None) as stream:
        yield from inflated(stream)


def lines_of(data: Iterator[bytes], start: int = 0, last: bool = True) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """(places, ends, lines): the lines of ``data``, which begins at byte
    ``start`` of its text, split at \\n, some at a time; a line's end is the
    place of its \\n. ``last``: what follows the last \\n is a line as well (if
    it is not empty). Invalid UTF-8 becomes U+FFFD."""
    rest: list[bytes] = []
    places: list[int] = []
    ends: list[int] = []
    lines: list[str] = []
    for piece in data:
        found = piece.split(b"\n")
        if len(found) > 1:
            found[0] = b"".join([*rest, found[0]])
            rest = []
            for line in found[:-1]:
                places.append(start)
                start += len(line) + 1
                ends.append(start - 1)
                lines.append(line.decode("utf-8", "replace"))
            if len(lines) >= BATCH_LINES:
                yield places, ends, lines
                places, ends, lines = [], [], []
        rest.append(found[-1])
    tail = b"".join(rest)
    if last and tail:
        places.append(start)
        ends.append(start + len(tail))
        lines.append(tail.decode("utf-8", "replace"))
    if lines:
        yield places, ends, lines
