"""Merged order on a stream against the batch merge of the finished tree."""

import heapq
import os
import random
import time
import tracemalloc

from logloom.operators.merge import FLOOR_MICROS
from logloom.plans.query import query_logs
from logloom.streaming import merged
from logloom.streaming.follow import follow_merged
from logloom.streaming.merged import RunMerge
from test_follow import APP, put


def heap_order(files):
    """files: {series: [file, ...]}, a file is a list of stamps or None; the
    order a heap merge of the files gives, as (series, file, line)."""
    streams = []
    for series, generations in sorted(files.items()):
        for g, stamps in enumerate(generations):
            first = next((s for s in stamps if s is not None), FLOOR_MICROS)
            streams.append([(s if s is not None else first, (series, g, i)) for i, s in enumerate(stamps)])
    return [x for _, x in heapq.merge(*streams, key=lambda x: x[0])]


def row(series, g, i, us, fresh, rotated):
    return {"source_type": "executor", "app_id": "a", "source_detail": str(series), "stream": "stderr", "fresh": fresh, "rotated": rotated,
            "file_origin": f"{series}/{g}" if rotated is not None else f"{series}/active", "at": i, "part": 0, "us": us, "level": None,
            "line": (series, g, i)}


def test_any_delivery_gives_the_heap_merge():
    rnd = random.Random(0)
    for _ in range(300):
        files = {s: [[None if rnd.random() < 0.3 else rnd.randrange(40) for _ in range(rnd.randrange(1, 12))]
                     for _ in range(rnd.randrange(1, 4))] for s in range(rnd.randrange(1, 4))}
        merge, order = RunMerge({}, [], None, None, 0), []
        at = {s: [0, 0] for s in files}
        while any(g < len(files[s]) for s, (g, _) in at.items()):
            batch = []
            for s, (g, i) in at.items():
                for _ in range(rnd.randrange(3)):
                    if g >= len(files[s]):
                        break
                    stop = rnd.randrange(i, len(files[s][g])) + 1
                    ends = stop == len(files[s][g])  # read to its end as it is rotated
                    batch += [row(s, g, k, files[s][g][k], i == 0, g if ends else None) for k in range(i, stop)]
                    if not ends:
                        i = stop
                        break
                    g, i = g + 1, 0
                at[s] = [g, i]
            rnd.shuffle(batch)
            merge.add(batch)
            order += merge.release(40)
        order += merge.release(None)
        assert [x[-1] for _, _, x in order] == heap_order(files)
        assert [seq for seq, _, _ in order] == list(range(1, len(order) + 1)) and not any(late for _, late, _ in order)


def test_lines_behind_the_delay_are_late():
    merge = RunMerge({}, [], None, None, 0)
    merge.add([row(0, 0, i, 10 * i, True, None) for i in range(10)])
    assert [x[-1][2] for _, _, x in merge.release(30)] == [0, 1, 2, 3, 4, 5, 6] and len(merge.held) == 3
    merge.add([row(1, 0, 0, 5, True, None), row(1, 0, 1, 95, True, None)])
    assert [(late, x[-1]) for _, late, x in merge.release(30)] == [(True, (1, 0, 0))]
    assert [(late, x[-1][0]) for _, late, x in merge.release(None)] == [(False, 0), (False, 0), (False, 0), (False, 1)]


def test_stream_equals_the_batch_query(spark, tmp_path):
    rnd = random.Random(6)
    roots = [str(tmp_path / "job/r1"), str(tmp_path / "job/r2")]
    places = [f"{r}/{d}/{s}" for r in roots for d in ("driver", f"executor/{APP}/2", f"executor/{APP}/10") for s in ("stderr", "stdout")]

    def grow(minute):
        for p in places:
            out = ""
            for s in sorted(rnd.randrange(60) for _ in range(rnd.randrange(8))):
                out += f"26/03/11 18:{minute:02d}:{s:02d} {rnd.choice(['INFO', 'ERROR'])} {rnd.randrange(10**9)}\n"
                out += f"\tat frame {rnd.randrange(10**9)}\n\n" * rnd.randrange(3)
            put(p, f"no stamp {minute} {rnd.randrange(10**9)}\n" + out)

    grow(0)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        def start(idle):
            stream = follow_merged(spark, roots, delay="3 minutes", idle_seconds=idle, state=str(tmp_path / "held"))
            return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(
                processingTime="200 milliseconds").start()

        def wait(q, done):
            end = time.time() + 240
            while not q.exception() and not done(q) and time.time() < end:
                time.sleep(0.2)
            assert q.exception() is None and done(q)

        def read(lines):
            return lambda q: sum(p["numInputRows"] for p in q.recentProgress) >= lines

        def released(lines):
            return lambda q: os.path.isdir(f"{out}/_spark_metadata") and spark.read.parquet(out).count() >= lines

        total = lambda: sum(1 for r in roots for d, _, fs in os.walk(r) for f in fs for x in open(f"{d}/{f}") if x.strip())
        q = start(600)
        wait(q, read(total()))
        grow(1)
        wait(q, read(total()))
        q.stop()
        for p in places[::2]:  # rotated while the stream is down
            os.rename(p, p + ("--2026-03-11--18-00" if "driver" in p else "--2026-03-11--18"))
        grow(2)
        q = start(3)
        wait(q, released(total()))
        q.stop()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = query_logs(spark, roots).select("run_key", "line").collect()
    got = spark.read.parquet(out).orderBy("run_key", "seq").collect()
    assert len(got) == total() and not any(r.late for r in got)
    assert [(r.run_key, r.line) for r in got] == [(r.run_key, r.line) for r in want]


def small_chunks(monkeypatch, **sizes):
    for name, n in sizes.items():
        monkeypatch.setattr(merged, name, n, raising=False)


def test_chunks_on_disk_keep_the_order(monkeypatch):
    small_chunks(monkeypatch, CHUNK_LINES=3, BLOCK_LINES=2, FAN_IN=2)
    test_any_delivery_gives_the_heap_merge()


def test_memory_does_not_grow_with_a_batch(monkeypatch):
    small_chunks(monkeypatch, CHUNK_LINES=500, BLOCK_LINES=20, FAN_IN=8)

    def peak(n):
        text = lambda s, i: f"{s} {i} " + "x" * 300
        rows = ({**row(s, 0, i, None if i % 3 == 0 else 1000 * (i * 7919 % n), True, None), "line": text(s, i)}
                for i in range(n) for s in range(2))
        merge, count, last = RunMerge({}, [], None, None, 0), 0, FLOOR_MICROS
        tracemalloc.start()
        merge.add(rows)
        for seq, late, x in merge.release(None):
            count += 1
            assert seq == count and not late and x[0] >= last
            last = x[0]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert count == 2 * n
        return most

    peak(10)  # imports
    small, large = peak(2_000), peak(16_000)
    assert large < 2 * small and large < 4 << 20
