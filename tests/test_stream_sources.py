"""Stream sources and sinks of our own: replays read and write the same."""

import os

import pytest

from tidemark.sources import streams


def test_ticks(spark, tmp_path):
    reader = streams._Ticks(1000, 10, 1055)
    assert reader.latestOffset() == {"n": 5}
    assert [r for p in reader.partitions({"n": 1}, {"n": 4}) for r in reader.read(p)] == [(2, 1020), (3, 1030), (4, 1040)]
    assert reader.partitions({"n": 5}, {"n": 5}) == [] and streams._Ticks(2000, 10, 1055).latestOffset() == {"n": 0}
    streams.register(spark)
    with pytest.raises(Exception, match="period"):
        spark.readStream.format("ticks").option("period", 0).load().writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()


def test_differences():
    assert streams.differences({"a": [1, 1], "b": [1, 1], "c": [1, 1]}, {"a": [1, 1], "b": [1, 2], "d": [0, 0]}) == [("b", "modified", 1, 2), ("d", "created", 0, 0), ("c", "deleted", 1, 1)]


def test_listings_are_kept(tmp_path):
    folder = tmp_path / "in"
    reader = streams._Events(str(folder), str(tmp_path / "state"))
    assert reader.latestOffset() == {"listing": 0}
    (folder / "sub").mkdir(parents=True)
    (folder / "sub" / "x.txt").write_text("one")
    (folder / "_hidden").write_text("no")
    assert reader.latestOffset() == {"listing": 1} == reader.latestOffset()
    (folder / "sub" / "x.txt").unlink()
    (folder / "y.txt").write_text("two")
    again = streams._Events(str(folder), str(tmp_path / "state"))  # after a restart
    assert again.latestOffset() == {"listing": 2}
    rows = [[r[:3] for r in again.read(p)] for p in again.partitions({"listing": 0}, {"listing": 2})]
    x, y = f"{folder}/sub/x.txt", f"{folder}/y.txt"
    assert rows == [[(x, "created", 3)], [(y, "created", 3), (x, "deleted", 3)]]


def test_epochs_write_once(tmp_path):
    out = str(tmp_path / "out")
    writer = streams._Rotated(out, 8)
    parts = lambda: {n: open(f"{out}/{n}").read() for n in sorted(os.listdir(out)) if n[0] != "_"}
    first = writer.write(iter([{"value": "aaa"}, {"value": "bbb"}, {"value": "ccc"}, {"value": None}]))
    writer.commit([first, None], 0)
    want = {"part-00000000.txt": "aaa\nbbb\n", "part-00000001.txt": "ccc\n\n"}
    assert parts() == want
    writer.commit([first], 0)  # told twice
    writer.commit([writer.write(iter([{"value": "aaa"}]))], 0)  # written twice
    assert parts() == want
    writer.commit([streams._Written([])], 1)
    last = writer.write(iter([{"value": "a line that is longer than the limit"}, {"value": "d"}]))
    writer._put("_epochs/000000000002.json", {"first": 2, "files": last.names})  # cut off before any file was moved
    writer.commit([last], 2)
    assert parts() == want | {"part-00000002.txt": "a line that is longer than the limit\n", "part-00000003.txt": "d\n"}
    writer.abort([writer.write(iter([{"value": "gone"}]))], 3)
    assert not [n for n in os.listdir(out) if n[0] == "_" and n not in ("_epochs", "_rotation.json")]


def test_rotation_goes_on_over_batches(spark, tmp_path):
    streams.register(spark)
    out = str(tmp_path / "out")
    for k in range(2):
        spark.createDataFrame([(f"{k}{i:03d}",) for i in range(50)], "value string").repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        rows = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        rows.writeStream.format("rotated_text").option("path", out).option("limit", 50).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    names = sorted(n for n in os.listdir(out) if n[0] != "_")
    assert names == [f"part-{k:08d}.txt" for k in range(len(names))] and all(os.path.getsize(f"{out}/{n}") <= 50 for n in names)
    assert sorted(x for n in names for x in open(f"{out}/{n}").read().split()) == [f"{k}{i:03d}" for k in range(2) for i in range(50)]
