"""How byte ranges of files are dealt to tasks."""

from tidemark.sources import ranges


def read(reader):
    return [r for p in reader.partitions() for r in reader.read(p)]


def test_small_files_share_tasks(tmp_path):
    for k in range(3000):
        (tmp_path / f"f{k:04d}").write_bytes(bytes([k % 251]) * (k % 7))
    reader = ranges._Reader(str(tmp_path), 0, None, 1 << 20, 1 << 27)
    assert len(reader.partitions()) == 2
    assert [(p[-4:], at, len(d), set(d)) for p, at, d in read(reader)] == [(f"{k:04d}", 0, k % 7, {k % 251}) for k in range(3000) if k % 7]


def test_spans_share_tasks_where_there_are_very_many(tmp_path, monkeypatch):
    whole = bytes(range(250)) * 40
    (tmp_path / "one").write_bytes(whole)
    reader = ranges._Reader(str(tmp_path), 10, 9_995, 30, 100)
    assert len(reader.partitions()) == 111 and all(len(p.spans) == 1 for p in reader.partitions())
    monkeypatch.setattr(ranges, "TASKS", 10)
    assert len(reader.partitions()) == 10
    assert b"".join(d for _, _, d in read(reader)) == whole[10:9_995] and [at for _, at, _ in read(reader)] == list(range(10, 9_995, 30))
