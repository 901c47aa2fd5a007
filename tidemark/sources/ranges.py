"""Ranges of bytes of files as a data source: "byte_ranges" reads pieces of `chunk` bytes between `start` and `end`, split over tasks every `span` bytes; a task seeks to its part, so that no file is read whole by one task or held in one value. Small files share tasks, and so do neighbouring spans where there are very many: a task has a price as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources.paths import listed, opened


#: Bytes that opening a file counts as; tasks above which short spans share them, and the bytes up to which they do.
OPENING, TASKS, SHARE = 1 << 16, 1 << 7, 1 << 24


class _Spans(InputPartition):
    def __init__(self, spans: list[tuple[str, int, int]]):
        self.spans = spans


class _Reader(DataSourceReader):
    def __init__(self, path: str, start: int, end: int | None, chunk: int, span: int):
        self.path, self.start, self.end, self.chunk = path, max(start, 0), end, chunk
        self.span = max(span // chunk, 1) * chunk

    def partitions(self):
        spans = [(p, at, min(at + self.span, end)) for p, size in listed(self.path) for end in [size if self.end is None else min(size, self.end)] for at in range(self.start, end, self.span)]
        dealt: list[list[tuple[str, int, int]]] = []
        held = self.span
        for s in spans:
            size = max(s[2] - s[1], min(OPENING, self.span))
            if held + size > self.span:
                dealt.append([])
                held = 0
            dealt[-1].append(s)
            held += size
        each = max(min(-(-len(dealt) // TASKS), -(-SHARE // self.span)), 1)
        return [_Spans([s for d in dealt[k : k + each] for s in d]) for k in range(0, len(dealt), each)] or [_Spans([])]

    def read(self, partition):
        for path, start, end in partition.spans:
            with opened(path) as stream:
                stream.seek(start)
                for at in range(start, end, self.chunk):
                    yield path, at, stream.read(min(self.chunk, end - at))


class ByteRanges(DataSource):
    @classmethod
    def name(cls):
        return "byte_ranges"

    def schema(self):
        return "path string, off long, data binary"

    def reader(self, schema):
        o = self.options
        return _Reader(o["path"], int(o.get("start", 0)), int(o["end"]) if "end" in o else None, int(o.get("chunk", 1 << 20)), int(o.get("span", 1 << 27)))


def read(spark: SparkSession, path: str, start: int = 0, end: int | None = None, chunk: int = 1 << 20, span: int = 1 << 27) -> DataFrame:
    """(path, off, data): a cursor's reads from start to end (the end of each file, if none is given)."""
    if chunk < 1:
        raise ValueError("chunk is positive")
    spark.dataSource.register(ByteRanges)
    r = spark.read.format("byte_ranges").option("start", start).option("chunk", chunk).option("span", span)
    return (r if end is None else r.option("end", end)).load(path)
