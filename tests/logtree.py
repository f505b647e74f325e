"""Builds small log trees on disk in the layout of cluster log delivery."""

from __future__ import annotations

import gzip
import os

APP = "app-20260311170849-0000"

DRIVER_STDERR_ROTATED = (
    "26/03/11 18:00:01 INFO SparkContext: Running Spark\n"
    "26/03/11 18:00:05 WARN NativeCodeLoader: Unable to load native-hadoop library\n"
)
DRIVER_STDERR = (
    "26/03/11 21:01:15 ERROR TransportChannelHandler: peer 10.9.8.7 sent nothing for two minutes\n"
    "java.io.IOException: Connection reset\n"
    "\tat org.apache.spark.network.Foo.bar(Foo.java:1)\n"
    "\n"
    "26/03/11 21:01:16 INFO Executor: Finished task 1.0 in stage 2.0\n"
)
DRIVER_STDOUT = "[2026-03-11T21:01:07.016+0000] [heap] young collection took 9 ms\n"
LOG4J_ACTIVE = "2026-03-11 21:00:01,234 INFO Driver: started\n"
LOG4J_ROTATED = "2026-03-11 17:59:59,999 INFO Driver: rotated\n"
STACKTRACE_ACTIVE = "java.lang.OutOfMemoryError: Java heap space\n"


def _w(path: str, text: str | bytes, gz: bool = False) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    data = text.encode("utf-8") if isinstance(text, str) else text
    if gz:
        data = gzip.compress(data)
    with open(path, "wb") as f:
        f.write(data)


def executor_lines(n: int, hour: int) -> str:
    out = []
    for i in range(3):
        out.append(f"26/03/11 {hour:02d}:{10 + i:02d}:00 {'ERROR' if i == 1 else 'INFO'} Exec{n}: step {i}\n")
    out.append("\tat app//com.x.Foo.run(Foo.scala:1)\n")
    return "".join(out)


def build(root: str) -> dict[str, str]:
    """Two runs under ``root``: ``job/c1`` (full) and ``job/c2`` (driver only).

    Returns the run roots.
    """
    r1 = os.path.join(root, "job", "c1")
    r2 = os.path.join(root, "job", "c2")
    d = os.path.join(r1, "driver")
    _w(os.path.join(d, "stderr--2026-03-11--18-00"), DRIVER_STDERR_ROTATED)
    _w(os.path.join(d, "stderr"), DRIVER_STDERR)
    _w(os.path.join(d, "stdout"), DRIVER_STDOUT)
    _w(os.path.join(d, "log4j-active.log"), LOG4J_ACTIVE)
    _w(os.path.join(d, "log4j-2026-03-11-17.log.gz"), LOG4J_ROTATED, gz=True)
    _w(os.path.join(d, "stacktrace.log"), STACKTRACE_ACTIVE)
    _w(os.path.join(d, "2026-03-11-17.stacktrace.log.gz"), STACKTRACE_ACTIVE, gz=True)
    for n in (0, 1, 2, 10):
        e = os.path.join(r1, "executor", APP, str(n))
        _w(os.path.join(e, "stderr--2026-03-11--18.gz"), executor_lines(n, 18), gz=True)
        _w(os.path.join(e, "stderr"), executor_lines(n, 19))
        _w(os.path.join(e, "stdout"), "")  # zero-length file
    # damaged gzip: listed, never read, reported as skipped
    good = gzip.compress(executor_lines(2, 17).encode())
    _w(os.path.join(r1, "executor", APP, "2", "stderr--2026-03-11--17.gz"), good[: len(good) // 2])
    # invalid UTF-8 bytes become U+FFFD
    _w(os.path.join(r1, "executor", APP, "1", "stdout--2026-03-11--19"), b"26/03/11 19:30:00 WARN bad \xff\xfe bytes\n")
    # ignored trees and names
    _w(os.path.join(r1, "eventlog", "x", "eventlog"), "{}\n")
    _w(os.path.join(r1, "init_scripts", "init.sh"), "echo hi\n")
    _w(os.path.join(r1, "driver", "notes.txt"), "ignored ERROR\n")
    _w(os.path.join(r1, "executor", "not-an-app", "0", "stderr"), "ignored ERROR\n")
    # second run: driver only, no executor directory
    _w(os.path.join(r2, "driver", "stderr"), "26/03/12 01:00:00 ERROR Main: failed\n")
    return {"c1": r1, "c2": r2}
