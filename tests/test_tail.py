"""Growing files: appended, unfinished, renamed, emptied; bounds and restarts."""

import json
import os

from authlytics.sources import fixtures as FX
from authlytics.sources.tail import GrowingLogsReader, tail_sources


def lines(n, tag):
    return [f"{tag} line {i} {'x' * (i % 50)}" for i in range(n)]


class Tail:
    def __init__(self, spark, tmp, max_lines=None, part_bytes=None):
        self.spark, self.tmp, self.args = spark, tmp, (max_lines, part_bytes)
        os.makedirs(f"{tmp}/log", exist_ok=True)
        self.start()

    def start(self):
        src = tail_sources(self.spark, {"auth_log": f"{self.tmp}/log/auth.log*"}, *self.args)
        self.q = (src.writeStream.format("parquet").option("path", f"{self.tmp}/out").option("checkpointLocation", f"{self.tmp}/ck")
                  .trigger(processingTime="0 seconds").start())

    def append(self, text, name="auth.log"):
        with open(f"{self.tmp}/log/{name}", "ab") as f:
            f.write(text if isinstance(text, bytes) else text.encode())

    def rows(self):
        self.q.processAllAvailable()
        return sorted(r.value for r in self.spark.read.parquet(f"{self.tmp}/out").collect())


def test_growth_rotation_truncation_and_restart(spark, tmp_path):
    t = Tail(spark, tmp_path)
    want = lines(30, "a")
    t.append("\n".join(want) + "\nunfin")
    assert t.rows() == sorted(want)
    t.append("ished\r\n\n")
    want += ["unfinished", ""]
    assert t.rows() == sorted(want)
    t.append("last before rotation\n")
    os.rename(tmp_path / "log/auth.log", tmp_path / "log/auth.log.1")      # rotation with unread lines
    t.append("\n".join(lines(5, "b")) + "\n")
    want += ["last before rotation", *lines(5, "b")]
    assert t.rows() == sorted(want)
    t.q.stop()
    t.append("while stopped\nbad \xff".encode("latin-1") + b"\n")
    t.start()
    want += ["while stopped", "bad �"]
    assert t.rows() == sorted(want)
    with open(tmp_path / "log/auth.log", "wb") as f:                       # emptied in place
        f.write(b"b line 0 \nshorter\n")
    want += ["b line 0 ", "shorter"]
    assert t.rows() == sorted(want)
    with open(tmp_path / "log/auth.log", "wb") as f:                       # emptied and grown past its old size
        f.write(b"b line 0 \n" + b"longer than it was before\n" * 3)
    want += ["b line 0 "] + ["longer than it was before"] * 3
    assert t.rows() == sorted(want)
    t.q.stop()


def test_line_bound_and_parts(spark, tmp_path):
    t = Tail(spark, tmp_path, max_lines=7, part_bytes=50)
    want = lines(40, "a") + ["y" * 500]
    t.append("\n".join(want) + "\n")
    t.append("\n".join(lines(9, "b")) + "\n", "auth.log.1")
    want += lines(9, "b")
    assert t.rows() == sorted(want)
    t.q.stop()
    t.start()                                  # the bound holds from where it stopped
    t.append("\n".join(lines(20, "c")) + "\n")
    assert t.rows() == sorted(want + lines(20, "c"))
    n = [p["numInputRows"] for p in t.q.recentProgress]
    assert max(n) == 7 and sum(n) == 20
    ids = [r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(set(ids)) == len(ids)
    t.q.stop()


def test_a_held_reader_takes_no_lines(tmp_path):
    (tmp_path / "auth.log").write_text("a\n")
    hold = tmp_path / ".appending"
    reader = GrowingLogsReader({"sources": json.dumps({"auth_log": f"{tmp_path}/auth.log*"}), "hold": str(hold)})
    before = reader.latestOffset()
    hold.touch()
    (tmp_path / "auth.log").write_text("a\nbb\n")
    assert reader.latestOffset() == before
    hold.unlink()
    assert [f["pos"] for f in reader.latestOffset()["auth_log"].values()] == [5]


def test_logs_are_held_while_they_grow(spark, tmp_path, monkeypatch):
    """A reader that looks at any time sees all files of a phase or none of it."""
    held, spots = str(tmp_path / "logs"), []
    hold = FX.hold_file(held)
    end = type(spark.range(1).write.format("noop")).save
    monkeypatch.setattr(type(spark.range(1).write), "save", lambda self, *a, **b: (spots.append(os.path.exists(hold)), end(self, *a, **b)))
    rows = [("auth_log", i % 2, i, f"line {i}") for i in range(100)]
    for part in (rows[:50], rows[50:]):
        FX.grow_logs(spark.createDataFrame(part, "source string, host long, n long, value string").repartition(4), held)
    assert spots == [True, True] and not os.path.exists(hold)
    for host in range(2):
        with open(f"{held}/auth_log-{host}.log") as f:
            assert f.read().split("\n") == [f"line {i}" for i in range(100) if i % 2 == host] + [""]
