"""Following files that grow and are rotated."""

import gzip
import os
import random
from collections import Counter

import pytest

from logloom.sources import byte_files
from logloom.streaming import growing
from logloom.streaming.follow import follow_logs, follow_to

APP = "app-20260311170849-0000"


class Step:
    """One run of the stream over what is there, always from its checkpoint."""

    def __init__(self, spark, root, base, **options):
        self.spark, self.root, self.base, self.options = spark, root, str(base), options

    def __call__(self):
        df = follow_logs(self.spark, [self.root], growing=True, state=f"{self.base}/held", **self.options)
        follow_to(df, f"{self.base}/out", f"{self.base}/state", available_now=True).awaitTermination()
        return Counter(r.line for r in self.spark.read.schema(df.schema).parquet(f"{self.base}/out").collect())


def put(path, text, mode="ab"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def lines(a, b, tag=""):
    return "".join(f"26/03/11 18:{i // 60:02d}:{i % 60:02d} INFO step {tag}{i}\n" for i in range(a, b))


def names(*spans):
    return Counter(f"26/03/11 18:{i // 60:02d}:{i % 60:02d} INFO step {tag}{i}" for tag, a, b in spans for i in range(a, b))


def test_a_file_grows_in_three_steps_and_is_rotated(spark, tmp_path):
    root, active = str(tmp_path / "run"), str(tmp_path / "run/driver/stderr")
    step = Step(spark, root, tmp_path)
    put(active, lines(0, 40) + "26/03/11 18:00:40 INFO")
    assert step() == names(("", 0, 40))  # the unfinished line waits
    put(active, " step 40\n" + lines(41, 60))
    assert step() == names(("", 0, 61)) - names(("", 60, 61))
    put(active, lines(60, 80) + "no line end")
    os.rename(active, active + "--2026-03-11--18-00")
    put(active, lines(0, 5, "new"))
    want = names(("", 0, 80), ("new", 0, 5)) + Counter(["no line end"])
    assert step() == want
    assert step() == want  # nothing new: nothing again
    put(active, lines(5, 9, "new"))
    assert step() == want + names(("new", 5, 9))


def test_a_rotated_file_is_packed_and_comes_late(spark, tmp_path):
    root, active = str(tmp_path / "r un+1"), str(tmp_path / f"r un+1/executor/{APP}/3/stdout")
    step = Step(spark, root, tmp_path)
    put(active, lines(0, 30))
    assert step() == names(("", 0, 30))
    old = open(active, "rb").read() + lines(30, 50).encode()
    put(active, lines(0, 40, "second"), "wb")  # a new active file; the old one is not there yet
    assert step() == names(("", 0, 30), ("second", 0, 40))
    put(active, lines(40, 41, "second"))
    step()
    put(active + "--2026-03-11--18.gz", gzip.compress(old[:70]) + gzip.compress(old[70:]))
    put(active + "--2026-03-11--17.gz", gzip.compress(b"other\n" * 50)[:-9])  # cut: dropped whole
    put(str(tmp_path / "r un+1/eventlog/x"), "not a log file\n")
    assert step() == names(("", 0, 50), ("second", 0, 41))


def test_long_lines_and_filters(spark, tmp_path):
    root = str(tmp_path / "run")
    text = lines(0, 100) + " ".join(["26/03/11 19:00:00 ERROR a", "b"]) + "\nbad \xff\n"
    put(f"{root}/driver/stdout", text.encode("utf-8")[:-3] + b"\xff\n")
    put(f"{root}/driver/stderr--2026-03-11--18-00", "x" * 500)  # one line longer than a range, without end
    assert Step(spark, root, tmp_path)() == names(("", 0, 100)) + Counter(
        ["26/03/11 19:00:00 ERROR a", "b", "bad �", "x" * 500])
    assert Step(spark, root, tmp_path / "e", level="ERROR")() == Counter(["26/03/11 19:00:00 ERROR a"])


def test_a_batch_is_run_again_after_its_file_was_rotated(tmp_path):
    """The offsets say [size, fingerprint]; the file has since been renamed."""
    active = str(tmp_path / "driver/stderr")
    put(active, lines(0, 10))
    reader = growing.GrowingReader([str(tmp_path)])
    first = reader.latestOffset()
    put(active, lines(10, 20))
    second = reader.latestOffset()
    os.rename(active, active + "--2026-03-11--18-00")
    put(active, lines(0, 40, "new"))

    def read(start, end):
        return Counter(x for p in growing.GrowingReader([str(tmp_path)]).partitions(start, end) for *_, ls in growing._new_lines(p) for x in ls)

    assert read({}, first) == names(("", 0, 10))
    assert read(first, second) == names(("", 10, 20))
    third = reader.latestOffset()
    assert read(second, third) == names(("new", 0, 40))
    os.remove(active + "--2026-03-11--18-00")
    assert read(first, second) == Counter()


def test_any_growth_gives_every_line_once(tmp_path):
    rnd = random.Random(4)
    for trial in range(30):
        root = tmp_path / str(trial)
        active, hour, n = str(root / f"executor/{APP}/0/stderr"), 0, 0
        want, got, start = Counter(), Counter(), {}
        reader = growing.GrowingReader([str(root)], rnd.choice([37, 200, 10**6]))
        for _ in range(12):
            for _ in range(rnd.randrange(4)):
                text = "".join(f"{n + i} {'z' * rnd.randrange(60)}\n" for i in range(rnd.randrange(1, 30)))
                n += 30
                want += Counter(text.splitlines())
                cut = rnd.randrange(len(text) + 1)
                put(active, text[:cut])
                if rnd.random() < 0.3:
                    end = reader.latestOffset()
                    got += Counter(x for p in reader.partitions(start, end) for *_, ls in growing._new_lines(p) for x in ls)
                    start = end
                put(active, text[cut:])
                if rnd.random() < 0.3:
                    hour += 1
                    target = f"{active}--2026-03-11--{hour:02d}"
                    if rnd.random() < 0.5:
                        put(target + ".gz", gzip.compress(open(active, "rb").read()))
                        os.remove(active)
                    else:
                        os.rename(active, target)
            end = reader.latestOffset()
            got += Counter(x for p in reader.partitions(start, end) for *_, ls in growing._new_lines(p) for x in ls)
            start = end
        assert got == want


def test_archives_are_checked_to_their_end(tmp_path):
    whole = gzip.compress(b"a\nb\n" * 1000) + gzip.compress(b"") + gzip.compress(b"c")
    cases = {"whole": whole, "padded": whole + b"\0" * 20, "empty": gzip.compress(b""), "cut": whole[:-3], "none": b"plain text",
             "no bytes": b"", "checksum": whole[:-8] + bytes([whole[-8] ^ 1]) + whole[-7:], "tail": whole + b"junk"}
    found = {}
    for name, data in cases.items():
        put(str(tmp_path / name), data, "wb")
        found[name] = byte_files.archive_text_bytes(str(tmp_path / name))
    assert found == {"whole": 4001, "padded": 4001, "empty": 0, "cut": None, "none": None, "no bytes": None, "checksum": None,
                     "tail": None}
    assert byte_files.archive_text_bytes(str(tmp_path / "missing")) is None
    assert not byte_files.readable("nosuchstore://x/y")


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_lines_do_not_depend_on_pieces(size):
    data = "a\n\nlong line é\n".encode() * 7 + b"rest"
    pieces = [data[i:i + size] for i in range(0, len(data), size)]
    for last in (True, False):
        got = [x for p, e, ls in byte_files.lines_of(iter(pieces), 5, last) for x in zip(p, e, ls)]
        want, at = [], 5
        for line in data.split(b"\n"):
            want.append((at, at + len(line), line.decode()))
            at += len(line) + 1
        assert got == (want if last else want[:-1])
