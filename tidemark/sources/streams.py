"""Stream sources and sinks of our own: ticks of a clock, changes of a folder, and text files that are rotated by size.

`register(spark)` adds the formats. Offsets and epochs say all that a replay needs: a batch that is run again reads the same rows, and one that is committed again writes nothing.

"ticks": one row (n, us) for every period from start on that has passed by the clock, or by `until`, if that is given. "file_events": (path, event, length, modified) for each file below a folder that was created, modified or deleted since the listing before; listings are kept under `state`, a folder of the reader's own, so that a batch is the difference of two of them whenever it is asked for. "rotated_text": writes the column value as lines to numbered files of about `limit` bytes each.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

from tidemark.sources.paths import store_of

#: Ticks that one task makes.
TICKS = 1 << 20


class _Span(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class _Ticks(DataSourceStreamReader):
    def __init__(self, start: int, period: int, until: int | None):
        self.start, self.period, self.until = start, period, until

    def initialOffset(self) -> dict:  # noqa: N802
        return {"n": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        now = time.time_ns() // 1000
        passed = (now if self.until is None else min(now, self.until)) - self.start
        return {"n": max(passed // self.period, 0)}

    def partitions(self, start: dict, end: dict):
        return [_Span(lo, min(lo + TICKS, end["n"])) for lo in range(start["n"], end["n"], TICKS)]

    def read(self, partition) -> Iterator[tuple]:
        for n in range(partition.lo + 1, partition.hi + 1):
            yield n, self.start + n * self.period


class Ticks(DataSource):
    @classmethod
    def name(cls):
        return "ticks"

    def schema(self):
        return "n long, us long"

    def streamReader(self, schema):  # noqa: N802
        o = self.options
        start, period = int(o["start"]) if "start" in o else time.time_ns() // 1000, int(o["period"])
        if period < 1:
            raise ValueError("period is positive")
        return _Ticks(start, period, int(o["until"]) if "until" in o else None)


CREATED, MODIFIED, DELETED = "created", "modified", "deleted"


def differences(before: dict[str, list], after: dict[str, list]) -> list[tuple]:
    """(path, event, length, modified) from two listings of path -> [length, modified]; of a deleted file as it was."""
    out = [(p, CREATED if p not in before else MODIFIED, *after[p]) for p in sorted(after) if before.get(p) != after[p]]
    return out + [(p, DELETED, *before[p]) for p in sorted(before) if p not in after]


class _Events(DataSourceStreamReader):
    def __init__(self, path: str, state: str):
        self.path, self.state = path, state

    def _file(self, n: int) -> tuple[pafs.FileSystem, str]:
        store, folder = store_of(self.state)
        return store, f"{folder}/{n:012d}.json"

    def _listing(self, n: int) -> dict:
        if n == 0:
            return {}
        store, name = self._file(n)
        with store.open_input_stream(name) as f:
            return json.loads(f.read())

    def _newest(self) -> int:
        store, folder = store_of(self.state)
        return max((int(f.base_name[:-5]) for f in store.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.base_name.endswith(".json")), default=0)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"listing": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        store, folder = store_of(self.path)
        found = {f.path: [f.size, (f.mtime_ns or 0) // 1000] for f in store.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True)) if f.type == pafs.FileType.File and f.base_name[0] not in "._"}
        newest = self._newest()
        if found != self._listing(newest):
            newest += 1
            held, name = self._file(newest)
            held.create_dir(name.rpartition("/")[0], recursive=True)
            part = f"{name}.{uuid.uuid4().hex}"
            with held.open_output_stream(part) as f:
                f.write(json.dumps(found).encode())
            held.move(part, name)  # whole or not there
        return {"listing": newest}

    def partitions(self, start: dict, end: dict):
        return [_Span(n, n + 1) for n in range(start["listing"], end["listing"])]

    def read(self, partition) -> Iterator[tuple]:
        yield from differences(self._listing(partition.lo), self._listing(partition.hi))


class FileEvents(DataSource):
    @classmethod
    def name(cls):
        return "file_events"

    def schema(self):
        return "path string, event string, length long, modified long"

    def streamReader(self, schema):  # noqa: N802
        return _Events(self.options["path"], self.options["state"])


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class _Rotated(DataSourceStreamWriter):
    """Tasks write files under names that readers pass over. A commit gives them the next numbers and only then says in `_epochs/<epoch>` which; an epoch that is there already is not committed again, and one that was cut off is finished from the list of moves that it wrote first."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit = folder, limit

    def write(self, iterator) -> _Written:
        store, folder = store_of(self.folder)
        store.create_dir(folder, recursive=True)
        names: list[str] = []
        out, held = None, 0
        for row in iterator:
            line = ((row["value"] or "") + "\n").encode()
            if out is not None and held + len(line) > self.limit:
                out.close()
                out = None
            if out is None:
                names.append(f"_{uuid.uuid4().hex}")
                out, held = store.open_output_stream(f"{folder}/{names[-1]}"), 0
            out.write(line)
            held += len(line)
        if out is not None:
            out.close()
        return _Written(names)

    def _json(self, name: str):
        store, folder = store_of(self.folder)
        if store.get_file_info(f"{folder}/{name}").type == pafs.FileType.NotFound:
            return None
        with store.open_input_stream(f"{folder}/{name}") as f:
            return json.loads(f.read())

    def _put(self, name: str, what) -> None:
        store, folder = store_of(self.folder)
        with store.open_output_stream(f"{folder}/{name}.new") as f:
            f.write(json.dumps(what).encode())
        store.move(f"{folder}/{name}.new", f"{folder}/{name}")

    def _remove(self, names) -> None:
        store, folder = store_of(self.folder)
        for n in names:
            if store.get_file_info(f"{folder}/{n}").type == pafs.FileType.File:
                store.delete_file(f"{folder}/{n}")

    def commit(self, messages, batchId: int) -> None:  # noqa: N803
        store, folder = store_of(self.folder)
        store.create_dir(f"{folder}/_epochs", recursive=True)
        mine = [n for m in messages if m is not None for n in m.names]
        said = f"_epochs/{batchId:012d}.json"
        moves = self._json(said)
        if moves is None:
            state = self._json("_rotation.json") or {"next": 0}
            moves = {"first": state["next"], "files": mine}
            self._put(said, moves)
        else:
            self._remove(set(mine) - set(moves["files"]))  # a second writing of the same epoch
        for k, n in enumerate(moves["files"], moves["first"]):
            if store.get_file_info(f"{folder}/{n}").type == pafs.FileType.File:
                store.move(f"{folder}/{n}", f"{folder}/part-{k:08d}.txt")
        state = self._json("_rotation.json") or {"next": 0}
        self._put("_rotation.json", {"next": max(state["next"], moves["first"] + len(moves["files"]))})

    def abort(self, messages, batchId: int) -> None:  # noqa: N803
        self._remove(n for m in messages if m is not None for n in m.names)


class RotatedText(DataSource):
    @classmethod
    def name(cls):
        return "rotated_text"

    def schema(self):
        return "value string"

    def streamWriter(self, schema, overwrite):  # noqa: N802
        limit = int(self.options.get("limit", 1 << 27))
        if limit < 1:
            raise ValueError("limit is positive")
        return _Rotated(self.options["path"], limit)


def register(spark: SparkSession) -> None:
    for source in (Ticks, FileEvents, RotatedText):
        spark.dataSource.register(source)
